import random

import pytest
from pyspark.sql import functions as F

from corvina.llm import addresses as AD
from corvina.llm import canonical as CA
from corvina.llm import linkage as LI
from corvina.llm import names as NA
from corvina.llm import survivor as SU


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_prefix_join_against_brute_force(spark):
    rnd = random.Random(5)
    make = lambda n: [(i, sorted({rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(0, 7))})) for i in range(n)]
    a, b = make(60), make(50)
    for t in (0.3, 0.5, 0.8):
        got = {(x, y) for x, y, _ in rows(CA.prefix_join(spark.createDataFrame(a, "lid bigint, toks array<string>"), spark.createDataFrame(b, "rid bigint, toks array<string>"), t))}
        want = {(x, y) for x, s in a for y, u in b if s and u and len(set(s) & set(u)) / len(set(s) | set(u)) >= t - 1e-12}
        assert got == want


def test_weighted_prefix_join_against_brute_force(spark):
    import math
    from collections import Counter

    rnd = random.Random(6)
    items = [(i, ["k", "k", "l"], sorted({rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 6))})) for i in range(50)]
    n = Counter(g for _, _, gs in items for g in gs)
    w = {g: math.log1p(len(items) / c) for g, c in n.items()}
    norm = lambda gs: math.sqrt(sum(w[g] ** 2 for g in gs))
    for t in (0.4, 0.7):
        want = {(i, j) for i, _, a in items for j, _, b in items if i < j and sum(w[g] ** 2 for g in set(a) & set(b)) / norm(a) / norm(b) >= t}
        got = {(r.a, r.b) for r in AD.weighted_prefix_join(spark.createDataFrame(items, "id bigint, blocks array<string>, grams array<string>"), t).collect()}
        assert got == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Revue Nagri de théologie", 1), ("REVUE NAGRI DE THEOLOGIE", 1), ("Rev. Nagri théologie", 1), ("Revue Nagri de thÃ©ologie", 1), ("Nagri de théologie, Revue", 1), ("The Revue Nagrri de théologie (Online)", 1),
        ("Stakilo Journal of Optics, Series A", 2), ("Stakilo J. Opt. Ser. B", 3), ("Stakilo Journal of Optics, Series C", 0), ("Dudra Journal of Optics", 0), ("n/a", None), ("  ", None), (None, None), ("-", None),
    ],
)
def test_canonical(spark, value, want):
    entries = spark.createDataFrame([(1, "Revue Nagri de théologie"), (2, "Stakilo Journal of Optics, Series A"), (3, "Stakilo Journal of Optics, Series B"), (4, None)], "canonical_id bigint, name string")
    got = CA.map_values(spark, spark.createDataFrame([(value,), (value,)], "value string"), entries).collect()
    assert [r.canonical_id for r in got] == ([] if want is None else [want])


def test_canonical_empty(spark):
    none = spark.createDataFrame([], "value string")
    assert CA.map_values(spark, none, spark.createDataFrame([], "canonical_id bigint, name string")).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Lab. X, 64 rte Broudro; 90010 Flosti/Lisaine Cedex 3; FRANCE", ("64", "route", "broudro", "flosti lisaine", "90010")),
        ("UNIV DE FLOSTI-SUR-LISAINE - av. Groutre 216 - F-90010 Flosti-sur-Lisaine - FR", ("216", "avenue", "groutre", "flosti lisaine", "90010")),
        ("N° 62 all. du Dr Fleu, Saint Bou, BP 12", ("62", "allee", "docteur fleu", "saint bou", None)), ("133bis, Bvd Dafleu\nBP 90, 80120 St-Nodra cedex", ("133bis", "boulevard", "dafleu", "saint nodra", "80120")),
        ("Pl du Général Zai 110 - Plou - UNIVERSITÉ DE PLOU", ("110", "place", "general zai", "plou", None)), ("rue Zai, Plou", (None, "rue", "zai", "plou", None)), ("", (None,) * 5), (None, (None,) * 5),
    ],
)
def test_parse_address(text, want):
    assert AD.parse(text) == want


def test_places(spark):
    data = [
        (1, "12 rue Broudrojogu, 90010 Flostitaicu"), (2, "Univ X; 12, R. Broudrojougu; Flostitaicu; France"), (3, "13 rue Broudrojogu, 90010 Flostitaicu"), (4, "12 avenue Broudrojogu, 90010 Flostitaicu"),
        (5, "12 rue Broudrojogu, 80000 Zastipplai"), (6, "rue Broudrojogu, Zastipplai"), (7, "rue Broudrojogu, Flostitaicu"), (8, None), (9, "  "), (10, "12 rue Broudrojogu, 90010 Flostitaicu"),
    ]
    df = spark.createDataFrame(data, "id bigint, full_address string")
    assert rows(AD.places(spark, df)) == [(1, 1), (10, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]
    assert rows(AD.places(spark, df.where("false"))) == []


def test_names(spark):
    data = [
        (1, None, None), (2, "thomas geucuplobre", None), (3, "geucuplobre tom phd", "{}"), (4, "dr thomas m geucuplobre", '{"orcid": "a"}'), (5, "t geucuplobre", None), (6, "thomas geukuplobre", '{"orcid": "A"}'),
        (7, "wanda geucuplobre", None), (8, "storitragri collaboration", None), (9, "on behalf of the storitragri study group", None), (10, "daniel zuvofeu", '{"orcid": "b"}'), (11, "daniel zuvofeu", '{"orcid": "c"}'),
        (12, "et al", None), (13, "gabriel lakaifo", None), (14, "gerard lakaifo", None), (15, "g lakaifo", None), (16, "", None), (17, "1957", None),
    ]
    df = spark.createDataFrame(data, "id bigint, author_name_normalized string, person_identifiers string")
    got = dict(rows(NA.person_classes(spark, df)))
    assert {i for i, c in got.items() if c == 2} == {2, 3, 4, 5, 6} or {i for i, c in got.items() if c == 2} == {2, 3, 4, 6}
    assert got[7] == 7 and got[8] == got[9] == 8 and got[10] != got[11] and 1 not in got and 12 not in got and 16 not in got
    assert len({got[13], got[14], got[15]}) == 3
    assert rows(NA.person_classes(spark, df.where("false"))) == []


def test_linkage(spark):
    t = "Effects of aquifer on the medieval cathode of Joflaitrabou populations"
    data = [
        (1, "hal", None, t, 2020, 1), (2, "wos", None, t.upper() + ".", 2021, None), (3, "crossref", None, "Effects of aquifer on the medieval cathdoe of Joflaitrabou populations", 2020, 1), (4, "hal", None, "Erratum to: " + t, 2020, 1),
        (5, "wos", None, t + ". Part II", 2020, 1), (6, "scanr", None, "Effects of aquifer on the medieval cathode of Joflaitrabou…", None, 1), (7, "hal", None, t, 2020, 1), (8, "hal", None, None, None, None), (9, "wos", None, "[Untitled]", 2020, 1),
        (10, "wos", None, "Effects of aquifer on the medieval cathode of Zewufaiplou populations", 2020, 1), (11, "openalex", None, t + " (texte intégral)", 2020, 1),
    ]
    noise = [(100 + i, "hal", None, f"Study number of the {a}{b}gu river in the {b}{a}po basin", 2000 + i % 9, 2) for i, (a, b) in enumerate((x, y) for x in ("zai", "brou", "fle", "tro", "ka") for y in ("mi", "lo", "dra", "pou", "che"))]
    df = spark.createDataFrame([(*r, None, "{}") for r in data + noise], "id bigint, source string, doi string, title string, pub_year int, journal_id bigint, publication_id bigint, external_ids string")
    w, _ = LI.link_records(spark, df)
    work = {r.sp_id: r.work for r in w.collect()}
    same = {i for i in work if work[i] == work[1]}
    assert same == {1, 2, 3, 6, 7, 11}
    assert 8 not in work and 9 not in work


def test_mixture_separates():
    rnd = random.Random(1)
    data = [((min(1.0, 0.95 + rnd.gauss(0, 0.03)), 1.0, 0.5, 0.9), 1) for _ in range(50)] + [((0.55 + rnd.gauss(0, 0.02), 0.2, 0.3, 0.3), 1) for _ in range(150)]
    post, model = LI.fit_mixture(data)
    assert all(p > 0.9 for p in post[:50]) and all(p < 0.1 for p in post[50:])
    assert LI.fit_mixture([]) == ([], {})


def test_em_learns_the_sources():
    # Source 0 is right, source 1 is wrong half of the time.
    pat = [(0b11, 0b11, 0, 100), (0b01, 0b11, 0, 95), (0b10, 0b11, 0, 10), (0b10, 0b11, 1, 90)]
    post, sens, _, prior = SU.em_two_sided(pat, 2, 2)
    assert post[0b11, 0b11, 0] > 0.9 and post[0b10, 0b11, 1] < post[0b11, 0b11, 0] and sens[0] > sens[1] and prior[1] < prior[0]


def test_survivors(spark):
    s = "id bigint, source string, publication_id bigint, title string, abstract string, oa_status string, language string, updated_at timestamp, value string"
    good = "The aquifer limits the wetland over 12 sites. The corpus was coded twice by the raters."
    day = lambda n: __import__("datetime").datetime(2024, 1, n)
    data = [
        (1, "hal", 7, "THE AQUIFER OF ZAIPOU AND ITS WETLAND", good + " " + good, "Gold ", "en", day(9), "x"), (2, "wos", 7, "The aquifer of Zaipou and its wetland", good, "unknown", "en", day(1), None),
        (3, "hal", 7, "The aquifer of Zaipou…", "The aquifer limits the wet…", "DIAMOND", "en", day(5), None), (4, "hal", 7, "[Untitled]", "n/a", None, None, None, None), (5, "openalex", 7, "The aquifer of Zaipou and its wetland", None, "diamond", None, None, None),
        (6, "hal", 8, "Alone", None, "gold", None, None, None), (7, "hal", None, "No group", None, "gold", None, None, None), (8, "hal", None, "No group", None, "gold", None, None, None),
        (9, "hal", 9, None, "", "n/a", None, None, None), (10, "wos", 9, "(sans titre)", "See full text", "", None, None, None),
    ]
    got = rows(SU.survivors(spark, spark.createDataFrame(data, s)).select("publication_id", "field", "sp_id"))
    assert got == [(7, "abstract", 2), (7, "oa_status", 3), (7, "title", 2)]
    assert rows(SU.survivors(spark, spark.createDataFrame([], s))) == []


def test_equal_titles_are_scored_like_others(spark):
    words = ["zai", "brou", "fle", "tro", "ka", "mi", "lo", "dra", "pou", "che"]
    data, n = [], 0
    for i, a in enumerate(words):
        for j, b in enumerate(words[:5]):
            t, y, doi, jo = f"Studies of the {a}{b}gu river in the {b}{a}po basin", 1990 + i, f"10.91000/{a}{b}.{i}{j}7731", i
            data += [(n, "hal", doi, t, y, jo), (n + 1, "wos", doi, t + " abstract", y, jo)]
            n += 2
    generic = "Table of contents of the issue"
    data += [(1000 + i, ("hal", "wos")[i % 2], f"10.9{i}123/issue.{i}{i}{i}{i}9{i}", generic, 1950 + 9 * i, 50 + i) for i in range(4)]
    data += [(2000, "hal", None, generic, 1950, 50)]
    df = spark.createDataFrame([(*r, None, "{}") for r in data], "id bigint, source string, doi string, title string, pub_year int, journal_id bigint, publication_id bigint, external_ids string")
    groups = df.selectExpr("id as sp_id", "id as group_id")
    work = {r.sp_id: r.work for r in LI.link_records(spark, df, groups)[0].collect()}
    assert all(work[i] == work[i + 1] for i in range(0, n, 2))
    assert len({work[1000 + i] for i in range(4)}) == 4
    assert work[2000] == work[1000]


@pytest.mark.parametrize(
    ("doi", "same"),
    [("10.1000/182", True), ("https://doi.org/10.1000%2F182?x=1", True), ("10.1000/abc", True), ("10.1000.7/x", True), ("10.0000/unknown", False), ("10.1000/", False), ("10.1000/n/a", False), ("10.", False), ("-", False), (None, False)],
)
def test_short_dois_link(spark, doi, same):
    from corvina.llm.components import doi_key

    assert (spark.createDataFrame([(doi,)], "d string").select(doi_key(F.col("d")).alias("k")).first()["k"] is not None) == same


def test_long_dois_stay_apart(spark):
    df = spark.createDataFrame([("10.5555/journal.pone.section.000111",), ("10.5555/journal.pone.section.000222",), ("10.5555journal.pone.section.OOO111",)], "d string")
    k = [r.k for r in df.select(LI.mended_doi(F.col("d")).alias("k")).collect()]
    assert k[0] != k[1]


def test_transitive_posteriors(spark):
    cols = "a bigint, b bigint, title_sim double, year_sim double, doi_sim double, journal_sim double, posterior double"
    p = spark.createDataFrame(
        [
            (1, 2, 1.0, 1.0, 0.5, 0.5, 0.9), (2, 3, 1.0, 1.0, 0.5, 0.5, 0.8), (1, 3, 0.6, 1.0, 0.5, 0.5, 0.1),  # raised to both sides together
            (5, 6, 1.0, 1.0, 0.5, 0.5, 0.9), (6, 7, 1.0, 1.0, 0.5, 0.5, 0.7), (5, 7, 0.0, 1.0, 0.5, 0.5, 0.0),  # 5 and 7 exclude each other: the weaker side falls
            (8, 9, 0.6, 1.0, 0.5, 0.5, 0.2),
        ],
        cols,
    )
    got = {(r.a, r.b): round(r.posterior, 4) for r in LI.transitive(p).collect()}
    assert got == {(1, 2): 0.9, (2, 3): 0.8, (1, 3): 0.72, (5, 6): 0.9, (6, 7): 0.0, (5, 7): 0.0, (8, 9): 0.2}


def test_titles_meet_whatever_the_size(spark):
    pair = ["measuring comparative soil moisture with the wabrousoubo instrument", "measuring comparative soil moiture with the wabrousoubo instrumeent", "results of the study", "results of the studdy"]
    noise = [f"measuring comparative soil moisture with the {a}{b}{c} instrument" for a in ("zai", "brou", "fle", "tro") for b in ("mi", "lo", "dra", "pou") for c in ("kex", "vus", "nim")]
    more = [f"measuring comparative soil moisture with the {a}{b}{c}fu instrument" for a in ("zai", "brou", "fle", "tro") for b in ("mi", "lo", "dra", "pou") for c in ("kex", "vus", "nim")]
    for titles in (pair + noise, pair + noise + more):
        keys = spark.createDataFrame(list(enumerate(titles)), "k bigint, stem string")
        none = spark.createDataFrame([], "k bigint, doi string")
        got = {tuple(r) for r in LI.candidates(spark, keys, none).collect()}
        assert {(0, 1), (2, 3)} <= got
    assert LI.candidates(spark, keys.where("false"), none).count() == 0


def test_titles_with_two_errors_in_a_word_meet(spark):
    titles = [
        "spectral plasma and corpus in the poulwage basin", "spectral plasma and corpus in the pouleuwage basin",  # both words belong to one title each
        "l effet du chateau sur les populations de pofloduousta", "l effet du chateau sur les populatiois de poffloudousta",  # another word is mistyped too
        "clinical welfare policy at the fatradailu site wi", "clinical welfae policy at the fatradailu site with a note on enzyme",  # cut beyond an error
    ]
    noise = [f"{x} {y} and corpus in the {z} basin with a note on enzyme" for x in ("spectral", "clinical", "chateau") for y in ("plasma", "welfare", "policy") for z in ("kezaimi", "lobroudra", "poufletro", "nimvuskex")]
    noise += [f"l effet du {y} sur les populations de {z}" for y in ("chateau", "plasma") for z in ("kezaimi", "lobroudra", "poufletro")]
    keys = spark.createDataFrame(list(enumerate(titles + noise)), "k bigint, stem string")
    got = {tuple(r) for r in LI.candidates(spark, keys, spark.createDataFrame([], "k bigint, doi string")).collect()}
    assert {(0, 1), (2, 3), (4, 5)} <= got
    assert [r.f for r in spark.createDataFrame([("ab",)], "w string").select(F.explode(LI.shorter("w")).alias("f")).collect()] == ["b", "a", "ab"]


def test_given_names_come_from_signatures(spark):
    raw = [f"Ines {f}" for f in ("Zubo", "Mora", "Diaz", "Loo")] + ["Fau, Rita", "Zubo, Rita", "Mora, Rita", "LOO Rita", "Saflos Taipou", "HÃ©lÃ¨ne Mora", "Study Group", None]
    given = {r.t for r in NA.given_names(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()}
    assert {"ines", "rita"} <= given and not given & {"zubo", "mora", "saflos", "ha", "study"}
    info = {r.t: r for r in NA.token_info(spark.createDataFrame([("rta",), ("inesrita",), ("xyz",), ("ines",)], "t string"), spark.createDataFrame([("ines", 4), ("rita", 4)], "t string, n bigint")).collect()}
    assert "rita" in info["rta"].near and info["inesrita"].double and info["ines"].given and "xyz" not in info


def test_short_families_and_first_letters(spark):
    data = [(1, "roux marcelline", None), (2, "raux marcelline", None), (3, "xarcelline roux", None), (4, "m roux", None), (5, "marcelline", None)] + [(10 + i, f"{g} {f}", None) for i, (g, f) in enumerate((g, f) for g in ("ines", "rita", "karl") for f in ("zubofla", "moradi", "diazne", "looti"))]
    signed = spark.createDataFrame([(f"Marcelline {f}",) for f in ("Zubofla", "Moradi", "Diazne", "Looti")], "raw_author_name string")
    got = dict(rows(NA.person_classes(spark, spark.createDataFrame(data, "id bigint, author_name_normalized string, person_identifiers string"), None, signed)))
    assert got[1] == got[2]


def test_values_judged_true(spark):
    s = "id bigint, source string, publication_id bigint, title string, abstract string, oa_status string, language string, updated_at timestamp"
    data = [(i * 3 + k, src, i, f"Title of work {i}", None, "gold" if k < 2 else "closed", "en", None) for i in range(30) for k, src in enumerate(("hal", "wos", "scanr"))]
    got = SU.true_values(spark, spark.createDataFrame(data, s))
    assert got.where("field = 'title' and kept").count() == 30 and got.where("field = 'oa_status' and value = 'gold' and kept").count() == 30
    assert SU.true_values(spark, spark.createDataFrame([], s)).count() == 0
