import random

from pyspark.sql import functions as F

from corvina.llm import components as C
from corvina.operators.graph import SALTS

SP = "id bigint, source string, doi string, publication_id bigint, external_ids string, token string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def union_find(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), edges[0]], "src bigint, dst bigint")
    want = union_find((a, b) for a, b in edges if a != b)
    assert dict(rows(C.connected_components(spark, df))) == want


def test_empty(spark):
    assert rows(C.connected_components(spark, spark.createDataFrame([], "src bigint, dst bigint"))) == []


def test_star_edges_are_linear_for_a_hot_key(spark):
    t = spark.range(5000).select(F.col("id").alias("n"), F.lit("hot").alias("k"))
    e = C.star_edges(t, "n", "k")
    assert e.count() < 5000 + SALTS
    assert e.groupBy("dst").count().agg(F.max("count")).first()[0] < 500
    assert {r[1] for r in rows(C.connected_components(spark, e))} == {0}


def test_ways_of_citing(spark):
    data = [
        (1, "hal", "10.1234/ab.99", None, "{}", None), (2, "wos", " https://doi.example/10.1234%2FAB.99?x=1 ", None, None, None), (3, "wos", "DOI: 10.1234/ab.99.", None, "bad json", None),
        (4, "hal", "n/a", None, '{"hal_id": ["hal-000031676v2"], "pmid": 0}', None), (5, "hal", "n/a", None, '{"hal_id": "https://d/HAL-000031676/document", "pmid": "0"}', None),
        (6, "hal", "10.0000/unknown", 5, '{"nnt": "NNT"}', None), (7, "hal", "10.0000/unknown", None, '{"nnt": "NNT", "pmid": "PMID:"}', None), (8, "wos", None, 5, '{"pmid": 77}', None),
        (9, "wos", "10.", None, '{"pmid": "https://p/77/"}', None), (10, "wos", "", None, '{"nnt": " 2005zvwy03"}', None), (11, "wos", None, None, '{"nnt": "https://t/2005ZVWY03"}', None),
        (12, "hal", None, None, '{"arxiv_id": "9910.00105", "related_dois": ["10.1234/ab.99"]}', None), (13, "hal", "10.1234/ab.9O", None, '{"hal_id": ["hal-"]}', None),
    ]
    sp = spark.createDataFrame(data, SP)
    assert rows(C.publication_groups(spark, sp)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (8, 6), (9, 6), (10, 10), (11, 10)]
    assert rows(C.publication_groups(spark, sp.where("false"))) == []
