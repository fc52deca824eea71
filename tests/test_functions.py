import pytest
from pyspark.sql import functions as F

from corvina.functions import domain as D
from corvina.functions import identifiers as I
from corvina.functions import names as N
from corvina.functions import text as X
from corvina.functions import vocabularies as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Forêt équatoriale", "foret equatoriale"), ("Maß der Größe", "mass der grosse"), ("N₂O₅", "n2o5"), ("¼ sec", "1 4 sec"), ("cm⁻²", "cm 2"), ("Bœuf & cætera", "boeuf caetera"),
        ("<sup>a</sup>b", "a b"), ("<100> plane", "100 plane"), ("x y «z»", "x y z"), ("ą́", "a"), ("", ""), (None, None), ("x" * 100_000, "x" * 100_000),
    ],
)
def test_normalize_text(spark, text, want):
    assert one(spark, X.normalize_text, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("&amp;lt;u&amp;gt;", "<u>"), ("&amp;amp;amp;amp;amp;amp;lt;", "<"), ("&ouml;&#233;&ndash;&#x3b1;", "öé–α"), ("&nosuch; &", "&nosuch; &"), ("AT&T &copy;", "AT&T ©"), ("&#38;lt;", "<"), ("&#x1F600;", "😀"),
        ("&#0;&#xD800;", "&#0;&#xD800;"), ("a;b", "a;b"), (None, None), ("", ""),
    ],
)
def test_entities(spark, text, want):
    assert one(spark, X.decode_entities, text) == want


def test_titles(spark):
    assert one(spark, X.clean_title, "  x &amp;   y ") == "x & y"
    assert one(spark, X.clean_title, "  ") is None


@pytest.mark.parametrize(
    ("doi", "want"),
    [
        ("https://doi.org/10.5555/QR.t", "10.5555/qr.t"), ("DOI = 10.5555/m?utm=1", "10.5555/m"), ("10.5555%252Fm", "10.5555/m"), ("10.5555/m....................", "10.5555/m"), ("10.5555/m.v3/pdf/", "10.5555/m"), ("10.5555/m(7)", "10.5555/m(7)"),
        ("10.5555/m)", "10.5555/m"), ("10.5555/m.).)", "10.5555/m"), ("10.5555/m(7", "10.5555/m(7"), ("10.5555/m(", "10.5555/m"), ("10.5555/a;10.5555/b", "10.5555/a"), ("10.5555/a−b", "10.5555/a-b"), ("10.5555/a+b", "10.5555/a+b"), ("none", None), ("10.", None), ("%", None),
        (None, None), ("", None),
    ],
)
def test_clean_doi(spark, doi, want):
    assert one(spark, I.clean_doi, doi) == want
    assert one(spark, I.clean_doi, want) == want  # nothing is left for another round


def test_validate(spark):
    kinds = [("orcid", "0000-0002-1825-0097", ("0000-0002-1825-0097", None)), ("orcid", "x", (None, "malformed")), ("doi", " ", (None, "empty")), ("idref", None, (None, "empty"))]
    for kind, value, want in kinds:
        got = one(spark, lambda c, kind=kind: I.validate(kind, c), value)
        assert (got.value, got.error) == want
    with pytest.raises(ValueError):
        I.validate("nope", F.lit("x"))


def test_identifiers(spark):
    assert one(spark, I.hal_id, "https://x/hal-01234567v2/document") == "hal-01234567"
    assert one(spark, I.pmid, "PMID: 123") == "123"
    assert one(spark, I.pmid, "0") is None
    assert one(spark, I.pmcid, "PMC99") == "PMC99"
    assert one(spark, I.arxiv_id, "arXiv:2101.00001v2") == "2101.00001"
    assert one(spark, I.orcid, "https://orcid.org/0000-0001-2345-678x") == "0000-0001-2345-678X"
    assert one(spark, I.idref, "12345678X") == "12345678X"
    assert one(spark, I.ror_id, "https://ror.org/02feahw73") == "02feahw73"
    assert one(spark, I.hal_person_id, "007") is None
    got = one(spark, I.ids_from_urls, ["https://doi.org/10.5555/m", "https://y/hal-01234567", "https://z", None, "https://arxiv.org/abs/2101.00009", "https://pubmed.ncbi.nlm.nih.gov/77/"], "array<string>")
    assert [(g.type, g.value) for g in got] == [("doi", "10.5555/m"), ("hal_id", "hal-01234567"), ("arxiv_id", "2101.00009"), ("pmid", "77")]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (("zubo", "ines"), ("zubo", "i"), True), (("ines", "zubo"), ("zubo", "ines"), True), (("van loo", "kim"), ("vanloo", "kim"), True), (("zubo", "joris"), ("zubo", "jorris"), True), (("kaole", "ines"), ("koale", "ines"), True),
        (("fau", "rene"), ("fay", "rene"), True), (("mora diaz", "luz"), ("diaz mora", "luz"), True), (("zubo", "ines 1961"), ("zubo", "ines clara"), True), (("zubo", "rita"), ("zubo", "rosa"), False), (("zubo", "k"), ("zubo", "m"), False),
        (("", ""), ("zubo", "ines"), False),
    ],
)
def test_same_person(spark, a, b, same):
    df = spark.createDataFrame([(*a, *b)], "la string, fa string, lb string, fb string")
    assert df.select(N.same_person(*[F.col(c) for c in ("la", "fa", "lb", "fb")]).alias("y")).first()["y"] is same


def test_one_edit_against_brute_force(spark):
    import itertools

    def osa(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["", "a", "ab", "ba", "abc", "acb", "bac", "abcd", "abdc", "badc", "xbcd", "abc d", "dcba"]
    df = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    for r in df.select("a", "b", N.within_one_edit(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.y == (osa(r.a, r.b) <= 1), (r.a, r.b)


def test_domain(spark):
    assert one(spark, D.abstract_from_index, '{"b": [1], "a": [0, 2]}') == "a b a"
    assert one(spark, D.abstract_from_index, "{}") is None
    assert one(spark, D.iso_date, "31/02/2020") is None
    assert str(one(spark, D.iso_date, "01/02/2020")) == "2020-02-01"
    for raw, source, want in [("Article; Proceedings Paper", "wos", "article"), ("Note; Book Review", "wos", "book_review"), ("ART_bookreview", "hal", "book_review"), ("proceedings", "scanr", "conference_paper"), ("proceedings", "crossref", "proceedings"), ("memoir", "wos", "memoir"), (None, "hal", "other"), ("?", None, "other")]:
        assert one(spark, lambda c, source=source: V.doc_type(c, F.lit(source)), raw) == want, raw
    assert one(spark, lambda c: D.decide_oa(c, F.lit("gold")), "diamond") == "diamond"
    assert one(spark, lambda c: D.decide_oa(c, F.lit("closed")), "embargoed") == "embargoed"
    assert one(spark, lambda c: D.decide_oa(c, F.lit("closed"), F.lit(True)), "green") == "green"
    assert one(spark, lambda c: D.decide_oa(c, F.lit("closed")), "green") == "closed"
    assert one(spark, lambda c: D.decide_oa(c, F.lit("gold")), "closed") == "gold"
    assert one(spark, V.merge_roles, ["rapporteur", "jury_member", "author"], "array<string>") == ["author", "rapporteur"]
    assert one(spark, V.merge_roles, ["jury_member", "author", "author"], "array<string>") == ["author", "jury_member"]
    assert one(spark, D.distinct_chapters, ["chapter 14 soil water", "soil water"], "array<string>") is False
    assert one(spark, D.distinct_chapters, ["soil", "soil water", "rock"], "array<string>") is True
    assert one(spark, D.distinct_chapters, ["12", "soil"], "array<string>") is False
    f = spark.range(1)
    oa = lambda c: f.select(c.alias("y")).first()["y"]
    none = F.lit(None)
    assert oa(V.hal_oa(F.lit(True), F.lit("f.pdf"), none.cast("string"), F.lit("2030-01-01").cast("date"))) == "embargoed"
    assert oa(V.hal_oa(F.lit(True), none.cast("string"), F.lit("arxiv"), none.cast("date"))) == "green"
    assert oa(V.hal_oa(F.lit(True), none.cast("string"), F.lit("istex"), none.cast("date"))) is None
    assert oa(V.scanr_oa(F.lit(True), F.lit("publisher"), F.lit("CC-BY"))) == "hybrid" and oa(V.scanr_oa(F.lit(True), F.lit("publisher"), none.cast("string"))) == "bronze"
    assert oa(V.openalex_oa(F.lit("odd"))) == "unknown" and oa(V.wos_oa(F.lit("N"))) is None
