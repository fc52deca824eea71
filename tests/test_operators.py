import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from corvina.operators import aggregates as A
from corvina.operators import facets as FA
from corvina.operators import filters as P
from corvina.operators import graph as G
from corvina.operators import joins as J
from corvina.operators import maintenance as M
from corvina.operators import matcher as MA
from corvina.operators import nested as NE
from corvina.operators import persons as PE
from corvina.operators import resolution as R
from corvina.operators import rules as RU
from corvina.operators.pivot import Dimension, Registry, pivot


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def pubs(spark):
    return spark.createDataFrame(
        [(1, "gold", 2020, ["hal", None]), (2, None, 2021, None), (3, "closed", None, []), (4, "unknown", 2020, ["wos"])], "id bigint, oa string, year int, sources array<string>"
    )


def test_filters(pubs):
    ids = lambda *f: [r[0] for r in rows(P.fold(pubs, f).select("id"))]
    assert ids(P.access_level("a", F.col("oa"), "closed")) == [2, 3, 4]
    assert ids(P.one_of("y", F.col("year"), [2020])) == [1, 4]
    assert ids(P.one_of("y", F.col("year"), [])) == []
    assert ids(P.one_of("y", F.col("year"), None)) == [1, 2, 3, 4]
    assert ids(P.none_of("o", F.col("oa"), ["gold"])) == [3, 4]
    assert ids(P.in_array("s", F.col("sources"), "hal", False)) == [2, 3, 4]
    assert ids(P.overlaps("s", F.col("sources"), ["wos"])) == [4]
    assert ids(P.toggle("t", F.col("oa") == "gold", True, True)) == [1, 2, 3, 4]
    assert [r[0] for r in rows(P.fold(pubs, [P.one_of("y", F.col("year"), [2020])], skip="y").select("id"))] == [1, 2, 3, 4]


def test_facets_exclude_themselves(pubs):
    got = FA.facets(pubs, {"y": F.col("year"), "o": F.col("oa")}, [P.one_of("y", F.col("year"), [2020]), P.one_of("o", F.col("oa"), ["gold"])])
    assert rows(got) == [("o", "gold", 1), ("o", "unknown", 1), ("y", "2020", 1)]


def test_pivot(spark, pubs):
    r = Registry({"n": F.count_distinct("id")}, {"year": Dimension(F.col("year"), ordinal=True), "oa": Dimension(F.col("oa"), groupable=False)})
    assert [tuple(x) for x in pivot(pubs, r, "n", ["year"]).collect()] == [(2020, 2), (2021, 1), (None, 1)]
    assert rows(pivot(pubs, r, "n", [])) == [(4,)]
    for bad in (["oa"], ["nope"], ["year", "year"]):
        with pytest.raises(ValueError):
            pivot(pubs, r, "n", bad)


def test_aggregates(spark):
    v = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None)], "k string, v string")
    assert rows(A.consensus(v, ["k"], "v")) == [("a", "y", 2), ("b", "x", 1)]
    assert rows(A.modes(v, ["k"], "v")) == [("a", ["y"], 2), ("b", ["x", "y"], 1)]
    co = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (None, "b")], "g int, i string")
    assert rows(A.co_occurrence(co, "i", "g")) == [("a", "b", 2)]


def test_components_and_closure(spark):
    t = spark.createDataFrame([(5, "h"), (2, "d"), (2, "h"), (9, "p"), (4, "d"), (7, None)], "id bigint, token string")
    nodes = spark.createDataFrame([(i,) for i in (2, 4, 5, 7, 9)], "id bigint")
    assert rows(G.components(spark, nodes, t)) == [(2, 2), (4, 2), (5, 2), (7, 7), (9, 9)]
    chain = spark.createDataFrame([(i, f"e{j}") for i in range(40) for j in (i, i + 1)], "id bigint, token string")
    assert {r[1] for r in rows(G.components(spark, chain.select("id"), chain))} == {0}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "parent bigint, child bigint")
    assert [r[1] for r in rows(G.closure(spark, spark.createDataFrame([(1,)], "node bigint"), e).select("root", "node"))] == [1, 2, 3]
    assert G.would_cycle(spark, e, 5, 4) and not G.would_cycle(spark, e, 4, 1)
    empty = t.where("false")
    assert rows(G.components(spark, nodes, empty)) == [(i, i) for i in (2, 4, 5, 7, 9)]


def test_rules(spark):
    rec = [
        (1, "x", "interview with y", "article", None, None), (2, "Letter: z", "letter z", "article", None, None), (3, "A systematic review", "a systematic review", "article", None, None),
        (4, "ISBN 978", "isbn 978", "review", None, None), (5, "t", "t", "thesis", 7, "10.1/x"), (6, "t", "t", "thesis", 7, "10.70675/x"), (7, None, None, None, None, None),
        (8, "Erratum", "erratum to", "letter", None, None),
    ]
    df = spark.createDataFrame(rec, "id bigint, title string, title_normalized string, doc_type string, journal_id bigint, doi string")
    got = RU.correct(df)
    assert {r.id: r.doc_type for r in got.collect()} == {1: "media", 2: "letter", 3: "review", 4: "book_review", 5: "article", 6: "thesis", 7: None, 8: "erratum"}
    assert rows(RU.correct(got).select("id", "doc_type", "raw_doc_type")) == rows(got.select("id", "doc_type", "raw_doc_type"))


def test_resolution(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id bigint, label bigint")
    dois = spark.createDataFrame([(1, "a"), (2, "b"), (4, "a")], "id bigint, doi string")
    assert rows(R.cannot_link(labels, dois)) == [(1, 1, "a"), (2, 1, "b"), (3, 1, None), (4, 4, "")]
    s = "id bigint, label bigint, part string, publication_id bigint, publication_doi string, doi string, in_perimeter boolean, title_normalized string, pub_year int"
    m = spark.createDataFrame(
        [
            (1, 1, "", 10, "x", "x", False, "t", 2000), (2, 1, "", 20, None, None, False, "t", 2000),  # 20 gives way to the carrier of the DOI
            (3, 3, "p", 30, "p", "p", False, "t", 2000), (4, 3, "q", 30, "p", "q", False, "t", 2000), (5, 3, "q", 50, None, "q", True, "t", 2000),  # the loser of 30 gets a new one, not 50
            (6, 6, "", None, None, None, True, "t", 2000), (7, 7, "", None, None, None, False, "t", 2000), (8, 8, "", None, None, None, True, None, 2000),  # create, outside, without title
            (9, 9, "u", 90, None, "u", False, "t", 2000), (10, 9, None, 91, None, None, False, "t", 2000), (11, 9, "w", None, None, "w", False, "t", 2000),  # 91 is residual
        ],
        s,
    )
    kept = R.claims(m, spark.createDataFrame([("w", 77)], "doi string, publication_id bigint"))
    assert {(r.first, r.anchor, r.action) for r in kept.collect()} == {(1, 10, "keep"), (3, 30, "keep"), (4, None, "create"), (6, None, "create"), (9, 90, "keep"), (11, 77, "keep")}
    assert rows(R.dissolved(m, kept)) == [(20, 10)]
    assert rows(R.claims(m.where("false"))) == []


def test_survivors(spark):
    s = "id bigint, source string, publication_id bigint, title string, doi string, doc_type string, pub_year int, oa_status string, is_retracted boolean, keywords array<string>, biblio string, topics string"
    data = [
        (1, "hal", 1, None, None, "review", 2001, "green", None, ["Soil", "Rock"], '{"volume": "1", "page": "7"}', "a"), (2, "crossref", 1, "T", "d", "article", None, None, False, ["rock", None, "Ice"], '{"volume": "2"}', None),
        (3, "wos", 1, "U", None, None, 1999, "closed", True, None, "broken", "c"), (4, "wos", 2, None, None, None, None, None, None, None, None, None), (5, "hal", None, "x", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, s)
    got = {r.publication_id: r for r in R.survivors(df).collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert (r.title, r.doi, r.doc_type, r.pub_year, r.oa_status, r.is_retracted) == ("T", "d", "review", 2001, "green", True)
    assert r.keywords == ["rock", "Ice", "Soil"] and r.biblio == {"volume": "2", "page": "7"} and r.topics == {"hal": "a", "wos": "c"}
    assert (got[2].doc_type, got[2].oa_status, got[2].keywords) == ("other", "unknown", None)
    first = {r.publication_id: r.title for r in R.survivors(df, secondary=F.col("source") == "crossref").collect()}
    assert first[1] == "U"
    checked = spark.createDataFrame([(1, "closed"), (2, "bronze")], "publication_id bigint, oa_status string")
    assert {r.publication_id: r.oa_status for r in R.survivors(df, checked=checked).collect()} == {1: "green", 2: "bronze"}
    assert R.survivors(df.where("false")).count() == 0


def test_relations(spark):
    pubs = spark.createDataFrame(
        [(1, "erratum", "a"), (2, "preprint", "b"), (3, "book", "c"), (4, "book_chapter", "d"), (5, "article", "e"), (6, "article", "f"), (7, "peer_review", "g"), (8, "article", None), (9, "article", "E")], "publication_id bigint, doc_type string, doi string"
    )
    keys = spark.createDataFrame([(1, "pmid", "1"), (2, "pmid", "1"), (3, "nnt", "2"), (4, "nnt", "2"), (5, "pmid", "3"), (6, "pmid", "3"), (7, "pmid", "3"), (8, "pmid", "3"), (5, "hal_id", "9"), (9, "hal_id", "9"), (None, "pmid", "3"), (5, "pmid", None)], "publication_id bigint, type string, value string")
    shared = R.shared_key_relations(pubs, keys)
    assert rows(shared) == [(2, 1, "is_preprint_of"), (4, 3, "is_part_of"), (5, 6, "is_related_to")]
    meta = spark.createDataFrame(
        [
            (1, "datacite", '{"related_identifiers": [{"doi": "https://doi.org/10.5555/M", "relation_type": "IsSupplementTo"}, {"doi": "10.5555/n", "relation_type": "Cites"}, {"doi": null, "relation_type": "IsPartOf"}]}'),
            (2, "crossref", '{"relation": {"is-preprint-of": [{"id": "10.5555/m", "id-type": "doi"}, {"id": "x", "id-type": "uri"}], "has-review": [{"id": "10.5555/q", "id-type": "doi"}], "is-part-of": [{"id": "10.5555/n", "id-type": "doi"}]}}'),
            (3, "datacite", "broken"), (4, "datacite", None), (None, "datacite", '{"related_identifiers": [{"doi": "10.5555/m", "relation_type": "HasPart"}]}'),
        ],
        "publication_id bigint, source string, meta string",
    )
    declared = R.declared_relations(meta)
    assert rows(declared) == [(1, "10.5555/m", "is_supplement_to"), (2, "10.5555/m", "is_preprint_of"), (2, "10.5555/n", "describes")]
    base = "measuring the slow drift of the northern shore"
    titles = spark.createDataFrame(
        [(1, "erratum", "erratum to " + base, 2010), (2, "article", base, 2009), (3, "preprint", base, 2009), (4, "article", base, 1990), (5, "erratum", "xx" + base, 2009), (6, "article", "short", 2010), (7, "erratum", "erratum short", 2010), (8, "erratum", None, 2010), (9, "dataset", base, 2009)],
        "publication_id bigint, doc_type string, title_normalized string, pub_year int",
    )
    assert rows(R.title_relations(titles)) == [(1, 2, "is_correction_of"), (3, 2, "is_preprint_of"), (5, 2, "is_correction_of")]
    known = spark.createDataFrame([(5, "10.5555/M"), (6, "10.5555/n")], "publication_id bigint, doi string")
    more = spark.createDataFrame([(5, "10.5555/n", "is_part_of"), (5, "10.5555/m", "is_part_of"), (5, "10.5555/far", "has_part")], "source_id bigint, target_doi string, type string")
    got = rows(R.rebuild_relations(more, shared, R.title_relations(titles.where("false")), known))
    assert got == sorted([(2, 1, None, "is_preprint_of", 1), (4, 3, None, "is_part_of", 1), (5, 6, "10.5555/n", "is_part_of", 0), (5, None, "10.5555/far", "has_part", 0)], key=repr)
    assert (6, 5, "has_part") in rows(R.both_ways(R.rebuild_relations(more, shared, R.title_relations(titles.where("false")), known)))


def test_duplicate_publications(spark):
    t = "measuring the slow drift of the northern shore"
    data = [
        (1, t, None, "article", ["hal"]), (2, t, None, "article", ["wos"]), (3, t, "10.5555/a", "article", ["scanr"]), (4, t, "10.5555/b", "article", ["scanr"]), (5, t, None, "conference_paper", ["crossref"]), (6, t, None, "book", ["hal", "wos"]),
        (7, "short", None, "article", ["hal"]), (8, "short", None, "article", ["wos"]), (9, None, None, None, None), (10, t, "10.5281/zenodo.1", "dataset", ["datacite"]), (11, t, "10.5281/zenodo.2", "dataset", ["datacite"]),
    ]
    pubs = spark.createDataFrame(data, "publication_id bigint, title_normalized string, doi string, doc_type string, sources array<string>")
    apart = spark.createDataFrame([(2, 1)], "id_a bigint, id_b bigint")
    got = set(rows(R.duplicate_pairs(pubs, apart)))
    assert {(1, 3), (1, 4), (2, 3), (10, 11), (5, 6), (1, 10)} <= got
    assert not got & {(1, 2), (3, 4), (1, 5), (1, 6), (2, 6), (7, 8), (3, 10)}


def test_doi_clusters(spark):
    data = [
        (1, "a", "book", "the book", None, None), (2, "a", "book_chapter", "x", None, None), (3, "b", "book_chapter", "chapter 14 soil water", None, None), (4, "b", "book_chapter", "soil water", None, None), (5, "c", "book_chapter", "soil", None, None),
        (6, "c", "book_chapter", "rock", None, None), (7, "c", "article", "other", None, None), (8, "d", "article", "v", "z", "version_to_concept"), (9, "d", None, None, None, None), (10, None, "book_chapter", "q", None, None), (11, "e", "article", "v", "z", None),
    ]
    df = spark.createDataFrame(data, "id bigint, doi string, doc_type string, title_normalized string, canonical_doi string, same_work string")
    assert rows(RU.correct_clusters(df)) == sorted([(2, None, "book_and_chapters"), (5, None, "chapters"), (6, None, "chapters"), (8, "z", "version_to_concept"), (9, "z", "version_to_concept")], key=repr)
    meta = '{"related_identifiers": [{"doi": "%s", "relation_type": "%s"}]}'
    rec = [("datacite", "a", "dataset", meta % ("B", "IsPartOf")), ("hal", "b", "dataset", None), ("datacite", "c", "dataset", meta % ("nowhere", "IsPartOf")), ("datacite", "d", "article", meta % ("e", "IsVersionOf")), ("datacite", "f", "article", meta % ("F", "IsVariantFormOf")), ("crossref", "g", None, meta % ("e", "IsVersionOf"))]
    assert rows(RU.same_work(spark.createDataFrame(rec, "source string, doi string, doc_type string, meta string"))) == [("a", "b", "package_piece"), ("d", "e", "version_to_concept")]


def test_hot_keys_and_class_pairs(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(600)] + [(999, None)], "i bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v bigint")
    got = {r.i: r.v for r in G.lookup(left, right, "k").collect()}
    assert len(got) == 601 and got[1] == 1 and got[3] == 2 and got[6] is None and got[999] is None
    m = spark.createDataFrame([("c", i) for i in range(60)] + [("d", 1), ("c", 5)], "c string, i bigint")
    old, G.BLOCK = G.BLOCK, 7
    try:
        pairs = rows(G.class_pairs(m, "c", "i"))
    finally:
        G.BLOCK = old
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2


def test_matching(spark):
    t = spark.createDataFrame([(1, "univ clermont auvergne"), (2, "polimos lab"), (3, None), (4, "")], "id bigint, t string")
    f = spark.createDataFrame([(1, "clermont"), (2, "limos"), (3, "clermont auvergne"), (4, "")], "f bigint, form string")
    assert rows(MA.contained(t, "id", "t", f, "f", "form")) == [(1, 1), (1, 3)]
    pool = spark.createDataFrame([("lab foo paris", ["FR"]), ("lab foo x", ["FR"]), ("lab foo y", ["US"]), ("philippe equipe lab", ["DE"])], "t string, c array<string>")
    target = spark.createDataFrame([(1, "lab foo"), (2, "ip")], "id bigint, x string")
    assert rows(MA.suggest(target, "id", "x", pool, "t", "c")) == [(1, ["FR"], 2)]
    names = spark.createDataFrame([("ivoire", "XX"), ("cote d ivoire", "CI")], "n string, c string")
    ends = spark.createDataFrame([(1, "abidjan cote d ivoire"), (2, "x")], "id bigint, t string")
    assert rows(MA.trailing(ends, "id", "t", names, "n", "c")) == [(1, "CI")]


def test_forms_within_words(spark):
    texts = ["univ clermont auvergne", "clermontauvergne", "polimos lab", "limos", None, "", "universites de lyon", "unilyon", "lyon", "polimos lab"]
    forms = [("clermont", False), ("limos", True), ("clermont auvergne", False), ("", False), ("universite", None), ("lyon", False), ("lyon", True), (None, False)]
    t = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    f = spark.createDataFrame([(i, *x) for i, x in enumerate(forms)], "f bigint, form string, b boolean")
    want = [(i, j) for i, x in enumerate(texts) for j, (y, b) in enumerate(forms) if x and y and (f" {y} " in f" {x} " if b else y in x)]
    assert rows(MA.matched_forms(t, "id", "t", f, "f", "form", "b")) == sorted(want, key=repr)


def test_delta_takes_all_links(spark, tmp_path):
    from corvina.plans.resolving import QUERIES

    tables = {
        "source_authorship_addresses": spark.createDataFrame([(500, 1), (501, 2), (502, 3)], "source_authorship_id bigint, address_id bigint"),
        "source_authorships": spark.createDataFrame([(500, True), (501, False), (502, None)], "id bigint, in_perimeter boolean"),
        "addresses": spark.createDataFrame([(1, False), (2, False), (3, True), (4, True)], "id bigint, countries_dirty boolean"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(QUERIES["E9_detection_delta"](spark, str(tmp_path))) == [(1, "unflag"), (2, "delete"), (3, "keep"), (4, "insert")]


def _plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_element_counts(spark):
    data = [(1, ["FR", "DE", "FR"], True), (2, ["FR"], False), (3, ["FR", None], None), (4, ["DE"], True), (5, ["US"], True), (6, None, True), (7, [], True), (8, ["IT"], False), (9, ["IT"], False), (None, ["FR"], True), (2, ["FR"], True), (2, ["DE"], False)]
    df = spark.createDataFrame(data, "id bigint, c array<string>, dirty boolean")
    both = J.element_join(df.select("id", "c"), "c", df.where("dirty").select(F.col("id").alias("id2"), F.col("c").alias("c2")), "c2").where("id <> id2").select("id", "id2", "element").distinct()
    got = J.element_counts(df, "id", "c", F.col("dirty"))
    assert rows(got) == rows(both.groupBy("element").count()) == [("DE", 4), ("FR", 4)]
    assert "Join" not in _plan_of(got)


def test_compatible_pairs_meet_once(spark):
    names = ["durand helene", "helene durand", "durand h", "h durand", "durand d", "durand", "jean paul durand", "paul jean", "jean-paul durand", "d durand", "2003 durand", "xu durand xu", "h helene", ""]
    n = spark.createDataFrame([(i, x.rpartition(" ")[2], x.rpartition(" ")[0]) for i, x in enumerate(names)], "id bigint, last string, first string")
    tokens = {i: set(re.findall("[a-z]+", x)) for i, x in enumerate(names)}
    parts = {i: {x.rpartition(" ")[2], x.rpartition(" ")[0]} - {""} for i, x in enumerate(names)}
    fit = lambda t, u: t == u or (len(t) == 1 and u.startswith(t)) or (len(u) == 1 and t.startswith(u))
    want = []
    for a, b in itertools.combinations(range(len(names)), 2):
        x, y = sorted((tokens[a], tokens[b]), key=len)
        if x and parts[a] & parts[b] and all(any(fit(t, u) for u in y) for t in x):
            want.append((a, b))
    got = PE.compatible_pairs(n)
    assert rows(got) == sorted(want, key=repr) and len(want) > 10
    assert "Aggregate" not in _plan_of(got)  # no pair is shuffled to drop repeated ones


def test_one_edit_pairs_meet_once(spark):
    names = ["jean durand", "jaen durand", "jan durand", "jean dupont", "durand durnad", "durand x", "x durand", "y durand", "durnad durand", "jean", "dupont", "jean", "j", "jean durand", "ab ba", "ba ab", ""]
    n = spark.createDataFrame([(i, x.rpartition(" ")[2], x.rpartition(" ")[0]) for i, x in enumerate(names)], "id bigint, last string, first string")
    parts = {i: (x.rpartition(" ")[2], x.rpartition(" ")[0]) for i, x in enumerate(names)}

    def near(x, y):
        cut = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
        swaps = {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for i in range(len(x) - 1)}
        return x == y or y in swaps or x in cut(y) or y in cut(x) or (len(x) == len(y) and sum(a != b for a, b in zip(x, y)) == 1)

    want = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if (set(parts[a]) & set(parts[b])) - {""} and near(parts[a][1], parts[b][1])]
    got = PE.one_edit_pairs(n)
    assert rows(got) == sorted(want, key=repr) and len(want) > 10
    top = _plan_of(got).splitlines()[:3]
    assert top[0].startswith("Union") and "Aggregate" not in "".join(top)  # no pair is shuffled to drop repeated ones


def test_persons(spark):
    c = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8), (3, None)], "sig bigint, person_id bigint")
    a = PE.unique_person(c, "sig", "orcid")
    assert rows(a) == [(1, 7, "orcid")]
    b = PE.unique_person(c, "sig", "name_form", spark.createDataFrame([(2, 7)], "sig bigint, person_id bigint"))
    assert rows(PE.cascade([a, b], "sig")) == [(1, 7, "orcid"), (2, 8, "name_form")]


def test_person_cascade(spark):
    s = "id bigint, source string, publication_id bigint, author_position int, name string, raw_name string, in_perimeter boolean, roles array<string>, person_id bigint, orcid string, hal_person_id string, idref string"
    data = [
        (1, "crossref", 1, 0, "ines zubo", "Ines Zubo", False, ["author"], None, "o1", None, None),  # ORCID, name agrees
        (2, "wos", 1, 0, "i zubo", "Zubo, I.", False, ["author"], None, "o1", None, None),  # its ORCID doesn't count, the place does: 1 is an anchor
        (3, "crossref", 2, 0, "karl mora", "Karl Mora", False, ["author"], None, "o1", None, None),  # another name
        (4, "crossref", 2, 1, "rita fau", "Rita Fau", False, ["author"], None, "o1", None, None),  # confirmed by hand
        (5, "hal", 3, 0, "ines zubo", "Ines Zubo", True, ["author"], None, None, None, None),  # rejected for this publication
        (6, "hal", 4, 0, "luz diaz", "Luz Diaz", True, ["author"], None, None, None, None),  # two persons
        (7, "hal", 5, 0, "luz diaz", "Luz Diaz", True, ["author"], None, None, None, None),  # one of them rejected here
        (8, "hal", 6, 0, "nova person", "Nova Person", True, ["author"], None, None, None, None), (9, "theses", 6, None, "nova juror", "N Juror", True, ["rapporteur"], None, None, None, None),
        (10, "hal", 7, 0, "kim loo", "Kim Loo", False, ["author"], None, None, "h9", "r1"), (11, "hal", 8, 0, "kim loo", "Kim Loo", True, ["author"], 3, None, None, None), (12, "hal", 9, 0, None, None, True, None, None, None, None, None),
    ]
    sigs = spark.createDataFrame(data, s)
    own = "value string, person_id bigint, last string, first string"
    owners = {"orcid": spark.createDataFrame([("o1", 1, "zubo", "ines")], own), "hal_person_id": spark.createDataFrame([("h9", 3, "loo", "kim")], own), "idref": spark.createDataFrame([("r1", 4, "loo", "kim")], own)}
    forms = spark.createDataFrame([("rita fau", 1, "confirmed"), ("ines zubo", 1, "pending"), ("luz diaz", 5, "pending"), ("luz diaz", 6, "confirmed"), ("nova person", 9, "rejected")], "name_form string, person_id bigint, status string")
    rejected = spark.createDataFrame([(3, 1), (5, 5)], "publication_id bigint, person_id bigint")
    got = {r.id: (r.action, r.person_id, r.reason, r.new_key) for r in PE.match_persons(sigs, owners, forms, rejected).collect()}
    assert got == {
        1: ("match", 1, "orcid", None), 2: ("match", 1, "cross_source", None), 3: ("skip", None, "out_of_perimeter", None), 4: ("match", 1, "orcid", None), 5: ("skip", None, "ambiguous_name_form", None),
        6: ("skip", None, "ambiguous_name_form", None), 7: ("match", 6, "single_name", None), 8: ("create", None, "new", "nova person"), 9: ("skip", None, "creation_not_allowed", None), 10: ("match", 3, "hal_person_id", None),
        12: ("create", None, "new", None),
    }
    assert PE.match_persons(sigs.where("false"), owners, forms, rejected).count() == 0


def test_shared_identifiers_are_marked(spark):
    d = spark.createDataFrame([(1, 1, {"orcid": "a", "idref": "x"}), (2, 1, {"orcid": "a"}), (3, 2, {"orcid": "a"}), (4, 2, None)], "id bigint, rec bigint, ids map<string,string>")
    assert {r.id: r.ids for r in PE.mark_dubious(d, "rec", "id", "ids").collect()} == {1: {"orcid_dubious": "a", "idref": "x"}, 2: {"orcid_dubious": "a"}, 3: {"orcid": "a"}, 4: None}


def test_duplicate_persons_meet_on_any_shared_word(spark):
    names = ["michel dupont", "m dupont", "dupont michel", "dupont m j", "li w", "wei li", "dupont d", "dupont", "anne dupont", "michel durand", "michel  rare", "m rare", "x", "martin martin", "martin", "m martin", "m dupont"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(99, None)], "id bigint, n string")

    def fits(a, b):
        return a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b))

    def brute(a, b):
        s, l = sorted((set(a.split()), set(b.split())), key=len)
        shared = {w for w in s if len(w) >= 2} & l
        same = len(s) == len(l) and all(any(fits(u, v) for v in s) for u in l)
        return bool(shared) and (all(any(fits(u, v) for v in l) for u in s) or same)

    want = [(i, j) for j in range(len(names)) for i in range(j) if brute(names[i], names[j])]
    assert rows(PE.duplicate_persons(df, "id", "n")) == sorted(want, key=repr)
    links = spark.createDataFrame([(0, 5), (1, 5), (1, 6), (0, 7), (2, 7)], "person_id bigint, value bigint")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "id_a bigint, id_b bigint")
    assert rows(PE.rank_duplicates(pairs, {"shared_pubs": links})) == [(0, 1, 1), (1, 2, 0)]


def test_joins(spark):
    df = spark.createDataFrame([("10.1/ab", ), ("10.1/x",), ("9",), (None,)], "t string")
    p = spark.createDataFrame([("10.1/", 1), ("10.1/a", 2), ("10.1/x", 3), ("10.1/x", 4)], "p string, j int")
    assert rows(J.longest_prefix(df, "t", p, "p", "j")) == [("10.1/ab", 2), ("10.1/x", None), ("9", None), (None, None)]


def test_maintenance(spark):
    cols = "k int, doi string, raw_hash string"
    old = spark.createDataFrame([(1, None, "a"), (2, "d", "b"), (4, "z", "q")], cols)
    new = spark.createDataFrame([(1, "x", "a"), (2, "e", "c"), (3, "f", "g")], cols)
    assert rows(M.merge_staging(old, new, ["k"], fill=("doi",))) == [(1, "x", "a", "same"), (2, "d", "c", "update"), (3, "f", "g", "insert"), (4, "z", "q", "old")]
    assert rows(M.changes(old, new, ["k"])) == [(1, 1, 2, 0)]
    m = spark.createDataFrame([(2, 1), (3, 1)], "old_id bigint, new_id bigint")
    e = spark.createDataFrame([(1, None, False), (2, "b", True), (3, "c", False), (4, "d", None)], "id bigint, v string, f boolean")
    assert rows(M.merge_rows(e, "id", m, any_of=("f",))) == [(1, "b", True), (4, "d", None)]
    pairs = spark.createDataFrame([(1, 2), (2, 4), (3, 4), (4, 5)], "a bigint, b bigint")
    assert rows(M.repoint_pairs(pairs, "a", "b", m)) == [(1, 4), (4, 5)]
    sp = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id bigint, publication_id bigint")
    au = spark.createDataFrame([(1, 7, "own"), (2, 7, "moved"), (3, 8, "new"), (2, None, "none")], "publication_id bigint, person_id bigint, v string")
    s2, a2, p2 = M.merge_publications(sp, au, pairs.toDF("id_a", "id_b"), m)
    assert rows(s2) == [(1, 1), (2, 1), (3, None)] and rows(a2) == [(1, 7, "own"), (1, 8, "new"), (1, None, "none")] and rows(p2) == [(1, 4), (4, 5)]


def test_journals(spark):
    j = spark.createDataFrame([(1, "A", "S1", "1111-1111", None, None, None), (2, "B", None, None, "2222-2222", None, 5)], "id bigint, title string, openalex_id string, issn string, eissn string, issnl string, publisher_id bigint")
    forms = spark.createDataFrame([("a", None, 1), ("b", 5, 2)], "norm string, publisher_id bigint, journal_id bigint")
    data = [
        (1, "X", "x", "S1", [], None), (2, "Y", "y", "S9", ["9999-9999", "2222-2222"], 7), (3, "B", "b", None, [], 5), (4, "New ", "new", None, ["3333-3333"], 8), (5, "NEW", "new", None, [], 8), (6, "New", "new", None, [], None), (7, " ", "", None, [], None), (8, None, None, None, None, None),
    ]
    r = spark.createDataFrame(data, "rid bigint, title string, norm string, openalex_id string, issns array<string>, publisher_id bigint")
    got, after, learnt = M.find_or_create_journals(r, j, forms)
    assert rows(got) == [(1, 1, "openalex_id"), (2, 2, "issn"), (3, 2, "name"), (4, 3, "created"), (5, 3, "created"), (6, 4, "created")]
    known = {x.id: x for x in after.collect()}
    assert known[2].openalex_id == "S9" and known[2].issn == "9999-9999" and known[2].publisher_id == 5 and known[3].title == "New" and known[3].issn == "3333-3333"
    assert ("y", 7, 2) in rows(learnt) and ("new", None, 4) in rows(learnt)
    dump = spark.createDataFrame([(1, ["0000-0000", "b"], "first"), (2, ["a"], "second"), (3, ["z"], "none")], "row bigint, issns array<string>, fact string")
    js = spark.createDataFrame([(1, ["a", None]), (2, ["a", "b"]), (3, None)], "id bigint, issns array<string>")
    assert rows(M.refresh_from_dump(js, dump, ("fact",))) == [(1, True, "second"), (2, True, "first"), (3, False, None)]


def test_nested(spark):
    one = {"static_data": {"summary": {"titles": {"title": {"type": "item", "content": "t"}}, "names": {"name": [None, {"addr_no": "1 2"}, "x", {"addr_no": 2}]}},
                           "fullrecord_metadata": {"addresses": {"address_name": [{"address_spec": {"addr_no": 2, "organizations": {"organization": {"content": "o"}}}}, None]}}}}
    two = {"locations": [None, {"id": "l", "source": {"id": "s"}}, {"source": None}]}
    data = [(1, json.dumps(one)), (2, json.dumps(json.dumps(two))), (3, json.dumps(one)[:-5]), (4, None), (5, ""), (6, "{}"), (7, "[]")]
    st = spark.createDataFrame([(*x, "y") for x in data], "id bigint, raw_data string, rid string")
    got = rows(NE.children(NE.triples(st, "id", "raw_data")))
    assert got == sorted(
        [(1, "title", 0, 1), (1, "name", 0, 2), (1, "name", 0, 4), (1, "address", 0, 1), (1, "organization", 1, 1), (1, "name_address", 2, 1), (1, "name_address", 4, 1),
         (2, "location", 0, 2), (2, "location", 0, 3), (2, "location_source", 2, 1)], key=repr)
    t = NE.triples(st, "id", "raw_data")
    assert rows(NE.pivot_group(t, NE.ORGANIZATION, {"content": "content", "none": "nope"})) == [(1, [1], 1, "object", "o", None)]
