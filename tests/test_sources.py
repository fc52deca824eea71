import json

import pytest
from pyspark.sql import functions as F

from corvina.plans import pipeline
from corvina.sources import extract, io, normalize, paged
from corvina.streaming import staging


def test_paged_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.jsonl").write_text(json.dumps({"id": i, "v": 1}) + "\n\nnot json\n")
    paged.register(spark)
    df = spark.read.format("paged").option("path", str(tmp_path)).option("source", "hal").option("slices", "2").load()
    assert sorted(r.source_id for r in df.collect()) == ["", "", "", "0", "1", "2"]


def test_raw_store_and_log(spark, tmp_path):
    s = io.RawStore(spark, str(tmp_path / "raw"))
    s.put(spark.createDataFrame([("hal", "1", "{}"), ("wos", "2", "{}")], "source string, source_id string, raw_data string"))
    s.put(spark.createDataFrame([("hal", "1", '{"a":1}')], "source string, source_id string, raw_data string"))
    assert s.read().count() == 2
    keys = spark.createDataFrame([("hal", "1"), ("hal", "9")], "source string, source_id string")
    assert s.get(keys).first()["raw_data"] == '{"a":1}'
    assert sorted((r.source_id, r.stored) for r in s.exists(keys).collect()) == [("1", True), ("9", False)]
    log = io.RunLog(spark, str(tmp_path / "log"))
    phases = {"a": lambda sp, t: {"x": spark.range(1)}, "b": lambda sp, t: {"y": t["x"]}}
    out = pipeline.run(spark, {}, phases, log)
    assert set(out) == {"x", "y"} and log.read().count() == 2
    assert list(pipeline.select(phases, start="b")) == ["b"]


def test_paged_source_fails_loudly(spark, tmp_path):
    reader = paged.PagedReader({"path": str(tmp_path), "max_failures": "2"}, lambda page, o: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(RuntimeError):
        list(reader.read(paged.Pages(["p"])))


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>a</b>  c", ["x", "y"]), (2, 'q"uote', None)], "id bigint, title string, s array<string>")
    path = str(tmp_path / "out.csv")
    io.write_csv(io.csv_rows(df, {"Id": df.id, "Title": df.title, "S": df.s}).coalesce(1), path)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf\"Id\",\"Title\",\"S\"\n") and raw.count(b"\xef\xbb\xbf") == 1 and raw.count(b"Title") == 1
    got = io.read_csv_dump(spark, path)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("a c", "x; y"), ('q"uote', None)]
    io.write_csv(df.select("id").where("false"), path, bom=False)
    assert open(path, "rb").read() == b'"id"\n'


def pages(source, request):
    """A small catalogue of each source, with one failing request."""
    import os

    if source == "hal":
        docs = {"*": ([{"halId_s": "h1", "doiId_s": "d"}, {"halId_s": None}], "m1"), "m1": ([{"halId_s": "h2"}], "m1")}
        got, mark = docs[request["mark"]]
        return {"response": {"docs": got, "numFound": 3}, "nextCursorMark": mark}
    if source == "openalex":
        return {"results": [{"id": f"https://x/W{request['year']}{request['mark']}"}] if request["mark"] in ("*", "n") else [], "meta": {"next_cursor": {"*": "n", "n": "e"}.get(request["mark"])}}
    if source == "scanr":
        return {"hits": {"hits": [{"_source": {"id": f"s{request['mark'] or 0}", "externalIds": [{"type": "doi", "id": "q"}]}, "sort": (request["mark"] or 0) + 1}] if (request["mark"] or 0) < 3 else []}}
    if source == "theses":
        every = [{"nnt": f"{y}X{i}"} for i, y in enumerate((2019, 2020, 2020))]
        return {"totalHits": 3, "theses": every[request["start"] : request["start"] + 2]}
    if source == "wos":
        return {"found": 5, "records": [{"UID": f"w{i}"} for i in range(request["first"], min(6, request["first"] + 2))]}
    raise OSError(os.getpid())


@pytest.mark.parametrize(
    ("source", "slices", "want"),
    [
        ("hal", [{"collections": ["A", "B"]}], ["h1", "h2"]), ("openalex", [{"year": 1}, {"year": 2}], ["W1*", "W1n", "W2*", "W2n"]), ("scanr", [{"year": 1}], ["s0", "s1", "s2"]), ("theses", [{"ppn": "p", "rows": 2}], ["2019X0", "2020X1", "2020X2"]),
        ("theses", [{"ppn": "p", "rows": 2, "year": 2020}], ["2020X1", "2020X2"]), ("wos", [{"year": 1}], ["w1", "w2", "w3", "w4", "w5"]),
    ],
)
def test_catalogues(source, slices, want):
    reader = extract.CatalogueReader({"source": source, "slices": json.dumps(slices)}, pages)
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[1] for r in got) == want and all(r[0] == source for r in got)


def test_catalogue_as_source(spark):
    def transport(source, request):  # local, so it goes to the workers by value
        mark = request["mark"] or 0
        return {"hits": {"hits": [{"_source": {"id": f"s{mark}", "externalIds": [{"type": "doi", "id": "q"}]}, "sort": mark + 1}] if mark < 3 else []}}

    extract.register(spark, transport)
    df = spark.read.format("catalogue").option("source", "scanr").option("slices", json.dumps([{"year": 1}])).load()
    assert sorted((r.source_id, r.doi) for r in df.collect()) == [("s0", "q"), ("s1", "q"), ("s2", "q")]


def test_breaker_and_quota():
    calls = []

    def flaky(source, request):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return pages("wos", request)

    assert len(list(extract.wos(extract.Breaker("wos", flaky, 3), {"year": 1}))) == 5
    with pytest.raises(extract.SourceUnavailable):
        list(extract.wos(extract.Breaker("wos", lambda *_: (_ for _ in ()).throw(OSError()), 3), {}))
    with pytest.raises(extract.SourceUnavailable):
        list(extract.wos(extract.Breaker("wos", pages), {"year": 1, "budget": 2}))
    with pytest.raises(ValueError):
        extract.CatalogueReader({"source": "nope", "slices": "[]"}, pages)


def test_fetch_pool(spark):
    def fetch(k):
        if k.startswith("x"):
            raise OSError
        return None if k == "m" else {"k": k}

    keys = spark.createDataFrame([("a",), ("a",), ("m",), ("x1",), (None,)], "doi string")
    got = sorted((r.doi, r.raw_data, r.status) for r in extract.fetch_all(keys, fetch, "doi", workers=2, most=1).collect() if r.doi != "a")
    assert got[0] == ("m", None, "missing") or got[0] == ("m", None, "failed")
    assert ("x1", None, "failed") in got and len(got) == 2


PAYLOADS = {
    "crossref": {
        "DOI": "10.5555/CR", "type": "journal-article", "title": ["A <i>t</i>"], "container-title": ["J"], "issued": {"date-parts": [[2019, 5]]}, "published": {"date-parts": [[2999]]}, "publisher": " P ", "language": "EN", "abstract": "<jats:p>x y</jats:p>",
        "issn-type": [{"type": "electronic", "value": "2"}, {"type": "print", "value": "1"}], "relation": {"is-preprint-of": [{"id": "10.5555/z", "id-type": "doi"}]},
        "author": [{"given": "Ines", "family": "Zubo", "ORCID": "http://orcid.org/0000-0002-1825-0097", "affiliation": [{"name": "Lab"}, {"name": " "}]}, {"given": "Kim", "family": "Loo", "ORCID": "http://orcid.org/0000-0002-1825-0097"}, {"name": "none"}],
    },
    "datacite": {"attributes": {
        "doi": "10.5555/DC", "titles": [{"title": "sub", "titleType": "Subtitle"}, {"title": "Main"}], "publicationYear": 2020, "publisher": {"name": "Repo"}, "types": {"resourceTypeGeneral": "Text", "resourceType": "Journal contribution"}, "descriptions": [{"description": "d", "descriptionType": "Other"}, {"description": "abs", "descriptionType": "Abstract"}],
        "relatedIdentifiers": [{"relatedIdentifier": "10.5555/Q", "relatedIdentifierType": "DOI", "relationType": "IsPartOf"}, {"relatedIdentifier": "u", "relatedIdentifierType": "URL", "relationType": "Cites"}],
        "creators": [{"name": "Org", "nameType": "Organizational"}, {"givenName": "Rita", "familyName": "Fau", "nameIdentifiers": [{"nameIdentifier": "https://orcid.org/0000-0002-1825-0097", "nameIdentifierScheme": "ORCID"}], "affiliation": ["Lab A", {"name": "Lab B"}]}],
    }},
    "openalex": {
        "id": "https://x/W9", "title": None, "display_name": "Shown", "publication_year": 2018, "type": "article", "doi": "https://doi.org/10.5555/OA", "open_access": {"oa_status": "gold"}, "abstract_inverted_index": {"b": [1], "a": [0]},
        "locations": [{"id": "doi:10.5555/oa", "landing_page_url": "https://hal.science/hal-01234567v2"}, {"pdf_url": "https://arxiv.org/abs/2101.00009"}, None, {"id": "doi:10.5555/other"}], "keywords": [{"keyword": "k1"}, "k2"],
        "authorships": [{"raw_author_name": "Luz Diaz", "raw_orcid": None, "is_corresponding": True, "raw_affiliation_strings": [], "institutions": [{"display_name": "Inst", "country_code": "FR"}]}, {"raw_author_name": None}],
    },
    "wos": {
        "UID": "WOS:1", "static_data": {"summary": {"titles": {"title": {"type": "item", "content": "One"}}, "pub_info": {"pubyear": "2017", "journal_oas_gold": "Y"}, "doctypes": {"doctype": ["Article", "Data Paper"]}, "names": {"name": [{"role": "author", "display_name": "Zubo, I.", "seq_no": 2, "addr_no": "1 3", "reprint": "Y", "r_id": "R1"}, {"display_name": "no role"}]}},
        "fullrecord_metadata": {"addresses": {"address_name": {"address_spec": {"addr_no": 1, "full_address": "Somewhere"}}}, "languages": {"language": {"content": "French"}}, "abstracts": {"abstract": {"abstract_text": {"p": ["p1", "p2"]}}}, "keywords": {"keyword": "single"}}},
        "dynamic_data": {"cluster_related": {"identifiers": {"identifier": [{"type": "doi", "value": "10.5555/W"}, {"type": "issn", "value": "1111-1111"}]}}},
    },
    "scanr": {
        "title": {"default": "S"}, "year": 2016, "type": "thesis", "isOa": True, "oaEvidence": {"hostType": "repository", "pdfUrl": "u2"}, "externalIds": [{"type": "doi", "id": "10.5555/S"}, {"type": "hal", "id": "tel-01234567"}, {"type": "doi", "id": "10.5555/S2"}], "keywords": {"default": "a, b"}, "landingPage": "u1",
        "authors": [{"fullName": "Karl Mora", "role": "directeurthese", "denormalized": {"idref": "12345678X"}, "affiliations": [{"name": "Lab"}]}],
    },
    "theses": {
        "titrePrincipal": "T", "dateSoutenance": "03/12/2015", "nnt": "2015abcd0001", "etabSoutenanceN": "Univ", "partenairesDeRecherche": [{"nom": "Lab", "type": "l"}], "auteurs": [{"nom": "Zubo", "prenom": "Ines", "ppn": "12345678X"}], "directeurs": [{"nom": "Mora", "prenom": "Karl"}], "examinateurs": [{"nom": "Mora", "prenom": "Karl"}], "president": {"nom": "Fau", "prenom": "Rita"},
        "sujets": [{"libelle": "soil"}],
    },
    "hal": {
        "halId_s": "hal-01234567", "title_s": ["H"], "docType_s": "ART", "docSubType_s": "ArtRev", "producedDateY_i": 2014, "openAccess_bool": True, "fileMain_s": "f.pdf", "language_s": ["fr"], "linkExtUrl_s": "https://arxiv.org/abs/2101.00009", "collCode_s": ["B", "A"], "authQuality_s": ["crp", "aut"],
        "label_xml": '<tei:TEI><biblFull><titleStmt><author><idno type="idhal" notation="string">ines-z</idno><idno type="ORCID">https://orcid.org/0000-0002-1825-0097</idno></author><author><idno type="IDREF">https://www.idref.fr/12345678X</idno></author></titleStmt></biblFull><ref type="file"><date notBefore="2031-01-01"/></ref></tei:TEI>'.replace("<biblFull", "<tei:biblFull").replace("</biblFull", "</tei:biblFull"),
        "authFullNameFormIDPersonIDIDHal_fs": ["Ines Zubo_FacetSep_11-22_FacetSep_x", "Kim Loo_FacetSep_12-0_FacetSep_"], "authIdHasPrimaryStructure_fs": ["11-22_FacetSep_Ines Zubo_JoinSep_77_FacetSep_Lab H"],
    },
}


def test_normalisers(spark):
    data = [(i, s, f"these2016XY{i}" if s == "scanr" else f"id{i}", None, json.dumps(p)) for i, (s, p) in enumerate(PAYLOADS.items())]
    bad = [(100 + i, s, "b", None, t) for i, s in enumerate(PAYLOADS) for t in ("{}", "", None, "[1]", '{"cut": ', '"text"')]
    st = spark.createDataFrame(data + bad, "id bigint, source string, source_id string, doi string, raw_data string")
    out = normalize.normalise(st, today=F.lit("2025-06-01").cast("date"))
    got = {r.source: r for r in out.collect()}
    assert set(got) == set(PAYLOADS) and out.count() == len(PAYLOADS)
    c = got["crossref"]
    assert (c.doi, c.title, c.pub_year, c.publisher, c.language, c.abstract, c.issns) == ("10.5555/cr", "A <i>t</i>", 2019, "P", "en", "x y", ["1", "2"])
    assert [(a.position, a.raw_name, a.ids, a.addresses) for a in c.authors] == [(0, "Ines Zubo", {"orcid_dubious": "0000-0002-1825-0097"}, ["Lab"]), (1, "Kim Loo", {"orcid_dubious": "0000-0002-1825-0097"}, [])]
    d = got["datacite"]
    assert (d.doi, d.title, d.doc_type, d.publisher, d.abstract, d.external_ids) == ("10.5555/dc", "Main", "Journal contribution", "Repo", "abs", {"related_dois": ["10.5555/q"]})
    assert [(a.position, a.raw_name, a.ids, a.addresses) for a in d.authors] == [(1, "Rita Fau", {"orcid": "0000-0002-1825-0097"}, ["Lab A", "Lab B"])]
    o = got["openalex"]
    assert (o.source_id, o.title, o.oa_status, o.abstract, o.keywords) == ("W9", "Shown", "gold", "a b", ["k1", "k2"])
    assert o.external_ids == {"hal_id": ["hal-01234567"], "related_dois": ["10.5555/other"], "arxiv_id": ["2101.00009"]} and [(a.raw_name, a.is_corresponding, a.addresses) for a in o.authors] == [("Luz Diaz", True, ["Inst"])]
    w = got["wos"]
    assert (w.doi, w.title, w.pub_year, w.doc_type, w.oa_status, w.language, w.abstract, w.keywords, w.issns) == ("10.5555/w", "One", 2017, "Article", "gold", "French", "p1 p2", ["single"], ["1111-1111"])
    assert [(a.position, a.raw_name, a.is_corresponding, a.ids, a.addresses) for a in w.authors] == [(1, "Zubo, I.", True, {"researcher_id": "R1"}, ["Somewhere"])]
    s = got["scanr"]
    assert (s.doi, s.title, s.oa_status, s.keywords, s.urls) == ("10.5555/s", "S", "green", ["a", "b"], ["u1", "u2"]) and s.external_ids["nnt"] == ["2016XY4"] and s.external_ids["related_dois"] == ["10.5555/s2"]
    assert [(a.raw_name, a.roles, a.ids) for a in s.authors] == [("Karl Mora", ["thesis_director"], {"idref": "12345678X"})]
    t = got["theses"]
    assert (t.title, t.pub_year, t.doc_type, t.oa_status, t.external_ids) == ("T", 2015, "thesis", "closed", {"nnt": ["2015ABCD0001"]})
    assert [(a.position, a.raw_name, a.roles) for a in t.authors] == [(0, "Ines Zubo", ["author"]), (None, "Karl Mora", ["thesis_director"]), (None, "Rita Fau", ["jury_president"])] and t.authors[0].addresses == ["Lab", "Univ"]
    h = got["hal"]
    assert (h.title, h.doc_type, h.oa_status, h.language) == ("H", "ART_ArtRev", "embargoed", "fr") and h.external_ids["hal_collections"] == ["A", "B"] and h.external_ids["arxiv_id"] == ["2101.00009"]
    assert [(a.raw_name, a.is_corresponding, a.ids, a.addresses) for a in h.authors] == [("Ines Zubo", True, {"orcid": "0000-0002-1825-0097", "idhal": "ines-z", "hal_person_id": "22"}, ["Lab H"]), ("Kim Loo", False, {"idref": "12345678X"}, [])]
    assert ("soil", "theses") in {(r.label, r.source) for r in normalize.subjects(out).collect()}
    with pytest.raises(ValueError):
        normalize.normalise(st, ["nope"])


def test_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"source":"hal","source_id":"1","doi":null,"raw_data":"a"}\n{"source":"hal","source_id":"2","raw_data":"b"}\n')
    staging.ingest(spark, src, dst, ck).awaitTermination()
    (tmp_path / "in" / "2.json").write_text('{"source":"hal","source_id":"1","doi":"d","raw_data":"c"}\n')
    staging.ingest(spark, src, dst, ck).awaitTermination()
    staging.ingest(spark, src, dst, ck).awaitTermination()
    assert sorted((r.source_id, r.doi, r.raw_data) for r in staging.snapshot(spark, dst).collect()) == [("1", "d", "c"), ("2", None, "b")]
    assert staging.manifest(spark, dst)[0] == 1 and len(staging.manifest(spark, dst)[1]) == 2
