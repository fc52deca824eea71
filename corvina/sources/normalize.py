"""Normalisers of seven sources: a raw payload to one record with its authors, as native projections.

Payloads are read by ``from_json`` with the schema of the fields that count; where a source has a single item
where others have a list, the field is read as JSON text first. A payload that isn't a whole JSON object, and
one without what the source's record must have, gives no row. All sources give the columns of ``RECORD``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions import vocabularies as V
from corvina.functions.domain import abstract_from_index, iso_date
from corvina.functions.identifiers import arxiv_id, clean_doi, hal_id, idref, nnt, orcid, pmcid, pmid
from corvina.functions.text import strip_markup

AUTHOR = "struct<position:int,raw_name:string,roles:array<string>,is_corresponding:boolean,ids:map<string,string>,addresses:array<string>>"
RECORD = (
    "id bigint", "source string", "source_id string", "doi string", "title string", "pub_year int", "doc_type string", "oa_status string", "language string", "container_title string",
    "publisher string", "issns array<string>", "abstract string", "keywords array<string>", "urls array<string>", "external_ids map<string,array<string>>", "meta string", "is_retracted boolean",
    f"authors array<{AUTHOR}>",
)
#: Years before the first are errors; the last is the year after that of ``today``.
FIRST_YEAR = 1500


def text(c: Column) -> Column:
    """A trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def texts(c: Column) -> Column:
    """The texts of an array that hold something; null if none does."""
    out = F.filter(F.transform(c, text), lambda x: x.isNotNull())
    return F.when(F.size(out) > 0, out)


def items(c: Column, schema: str) -> Column:
    """A list of ``schema`` from JSON text that holds a list or a single item; empty for null and for other kinds."""
    t = F.trim(c)
    many = F.from_json(F.when(F.startswith(t, F.lit("[")), t), f"array<{schema}>")
    single = F.from_json(F.when(F.startswith(t, F.lit("{")), t), schema) if schema.startswith("struct") else F.when(t.isNotNull() & ~F.startswith(t, F.lit("[")), t)
    return F.coalesce(F.filter(many, lambda x: x.isNotNull()), F.when(single.isNotNull(), F.array(single)), F.array().cast(f"array<{schema}>"))


def first(c: Column) -> Column:
    return F.get(c, 0)


def year_in(c: Column, today: Column) -> Column:
    y = c.cast("string").try_cast("int")
    return F.when(y.between(F.lit(FIRST_YEAR), F.year(today) + 1), y)


def id_map(**kinds: Column) -> Column:
    """map<string,string> of the identifiers that are there."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kinds.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def lists(**kinds: Column) -> Column:
    """map<string,array<string>> of the identifier lists that hold something; single texts are lists of one."""
    as_list = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull()))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), as_list(v).alias("value")) for k, v in kinds.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))


def authors_of(c: Column, name: Callable[[Column], Column], roles: Callable[[Column], Column], corresponding: Callable[[Column], Column], ids: Callable[[Column], Column], addresses: Callable[[Column], Column], position: Callable[[Column, Column], Column] | None = None) -> Column:
    """Author records of a list, those without a name left out; positions count all items from 0.

    An identifier that two or more authors of the record carry is kept under its kind with ``_dubious``.
    """
    at = position or (lambda _, i: i)
    raw = F.transform(c, lambda a, i: F.struct(at(a, i).cast("int").alias("position"), text(name(a)).alias("raw_name"), roles(a).alias("roles"), F.coalesce(corresponding(a), F.lit(False)).alias("is_corresponding"), ids(a).alias("ids"), F.coalesce(texts(addresses(a)), F.array().cast("array<string>")).alias("addresses")))
    all_ids = F.flatten(F.transform(raw, lambda a: F.map_entries(a["ids"])))
    shared = lambda e: F.size(F.filter(all_ids, lambda x: (x["key"] == e["key"]) & (x["value"] == e["value"]))) > 1
    marked = F.transform(raw, lambda a: a.withField("ids", F.map_from_entries(F.transform(F.map_entries(a["ids"]), lambda e: F.struct(F.when(shared(e), F.concat(e["key"], F.lit("_dubious"))).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))))
    return F.filter(marked, lambda a: a["raw_name"].isNotNull())


def one_role(c: Column) -> Column:
    return F.array(c)


def _record(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    """The columns of ``RECORD``; what a source lacks is null."""
    out = []
    for spec in RECORD:
        n, kind = spec.split(" ", 1)
        c = F.col("id") if n == "id" else F.lit(source) if n == "source" else cols.get(n, F.lit(None))
        out.append(c.cast(kind).alias(n))
    return df.select(*out)


def _parsed(staging: DataFrame, source: str, schema: str) -> DataFrame:
    """(id, source_id, staged_doi, r) of the payloads that are whole JSON objects."""
    s = staging.where(F.col("source") == source)
    s = s.where(F.try_parse_json("raw_data").isNotNull() & F.startswith(F.ltrim("raw_data"), F.lit("{")))
    return s.select("id", "source_id", F.col("doi").alias("staged_doi"), F.from_json("raw_data", schema).alias("r"))


def crossref(staging: DataFrame, today: Column) -> DataFrame:
    """A record needs a DOI, a title and a year; statuses of open access aren't taken from here."""
    date = "struct<`date-parts`:array<array<string>>>"
    d = _parsed(staging, "crossref", (
        f"DOI string, type string, title string, `container-title` string, published {date}, issued {date}, `published-online` {date}, `published-print` {date}, publisher string, language string, abstract string, subject array<string>,"
        "ISSN array<string>, `issn-type` array<struct<type:string,value:string>>, ISBN array<string>, relation string, license string, funder string,"
        "author array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>"
    ))
    r = lambda n: F.col(f"r.`{n}`")
    year = F.coalesce(*[year_in(r(n)["date-parts"][0][0], today) for n in ("published", "issued", "published-online", "published-print")])
    kinds = lambda k: text(first(F.filter(r("issn-type"), lambda x: (x["type"] == k) & (F.trim(x["value"]) != "")))["value"])
    typed = F.filter(F.array(kinds("print"), kinds("electronic")), lambda x: x.isNotNull())
    issns = F.when(F.size(typed) > 0, typed).otherwise(F.slice(F.coalesce(r("ISSN"), F.array().cast("array<string>")), 1, 1))
    authors = authors_of(r("author"), lambda a: F.concat_ws(" ", text(a["given"]), text(a["family"])), lambda a: one_role(F.lit("author")), lambda a: F.lit(False), lambda a: id_map(orcid=orcid(a["ORCID"])), lambda a: F.transform(a["affiliation"], lambda x: x["name"]))
    out = _record(
        d, "crossref", source_id=clean_doi(F.coalesce(r("DOI"), F.col("staged_doi"))), doi=clean_doi(F.coalesce(r("DOI"), F.col("staged_doi"))), title=text(first(items(r("title"), "string"))), pub_year=year, doc_type=text(r("type")),
        language=F.lower(text(r("language"))), container_title=text(first(items(r("container-title"), "string"))), publisher=text(r("publisher")), issns=issns, abstract=text(strip_markup(r("abstract"))), keywords=texts(r("subject")),
        external_ids=lists(issn=r("ISSN"), isbn=r("ISBN")), meta=F.when(r("relation").isNotNull(), F.concat(F.lit('{"relation":'), r("relation"), F.lit("}"))), authors=authors,
    )
    return out.where("doi is not null and title is not null and pub_year is not null")


def datacite(staging: DataFrame, today: Column) -> DataFrame:
    """A record needs a DOI, a title and a year; creators that are organisations are no authors."""
    d = _parsed(staging, "datacite", (
        "attributes struct<doi:string,titles:array<struct<title:string,titleType:string>>,publicationYear:string,publisher:string,language:string,container:struct<title:string,identifier:string,identifierType:string>,"
        "types:struct<resourceTypeGeneral:string,resourceType:string>,descriptions:array<struct<description:string,descriptionType:string>>,subjects:array<struct<subject:string>>,"
        "relatedIdentifiers:array<struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string>>,"
        "creators:array<struct<name:string,givenName:string,familyName:string,nameType:string,nameIdentifiers:array<struct<nameIdentifier:string,nameIdentifierScheme:string,schemeUri:string>>,affiliation:string>>>"
    ))
    a = lambda n: F.col(f"r.attributes.{n}")
    full = lambda x, n: F.filter(x, lambda y: F.trim(y[n]) != "")
    plain = lambda x, n, tag: F.coalesce(first(F.filter(full(x, n), lambda y: F.coalesce(y[tag], F.lit("")) == "")), first(full(x, n)))[n]
    abstract = F.coalesce(first(F.filter(full(a("descriptions"), "description"), lambda y: y["descriptionType"] == "Abstract")), first(full(a("descriptions"), "description")))["description"]
    general, free = text(a("types.resourceTypeGeneral")), text(a("types.resourceType"))
    kind = F.when(general.isNotNull() & ~F.lower(general).isin("text", "other"), general).otherwise(F.coalesce(free, general))
    publisher = F.when(F.startswith(a("publisher"), F.lit("{")), F.get_json_object(a("publisher"), "$.name")).otherwise(a("publisher"))
    related = F.filter(F.transform(F.filter(a("relatedIdentifiers"), lambda x: x["relatedIdentifierType"] == "DOI"), lambda x: F.struct(clean_doi(x["relatedIdentifier"]).alias("doi"), x["relationType"].alias("relation_type"))), lambda x: x["doi"].isNotNull() & (x["relation_type"] != ""))
    mine = lambda c: orcid(first(F.filter(c["nameIdentifiers"], lambda n: (F.lower(F.trim(n["nameIdentifierScheme"])) == "orcid") | F.contains(F.lower(n["schemeUri"]), F.lit("orcid.org"))))["nameIdentifier"])
    both = lambda c: F.when((F.trim(c["givenName"]) != "") & (F.trim(c["familyName"]) != ""), F.concat_ws(" ", F.trim(c["givenName"]), F.trim(c["familyName"])))
    name = lambda c: F.when(F.coalesce(c["nameType"], F.lit("")) != "Organizational", F.coalesce(both(c), text(c["name"]), text(c["familyName"]), text(c["givenName"])))
    places = lambda c: F.transform(F.from_json(c["affiliation"], "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
    authors = authors_of(a("creators"), name, lambda c: one_role(F.lit("author")), lambda c: F.lit(False), lambda c: id_map(orcid=mine(c)), places)
    doi = clean_doi(F.coalesce(a("doi"), F.col("staged_doi")))
    out = _record(
        d, "datacite", source_id=doi, doi=doi, title=text(plain(a("titles"), "title", "titleType")), pub_year=year_in(a("publicationYear"), today), doc_type=kind, language=F.lower(text(a("language"))),
        container_title=text(a("container.title")), publisher=text(publisher), issns=F.when(a("container.identifierType") == "ISSN", F.array(a("container.identifier"))), abstract=text(abstract),
        keywords=texts(F.transform(a("subjects"), lambda x: x["subject"])), external_ids=lists(related_dois=F.filter(F.transform(related, lambda x: x["doi"]), lambda x: x != doi)),
        meta=F.when(F.size(related) > 0, F.to_json(F.struct(related.alias("related_identifiers")))), authors=authors,
    )
    return out.where("doi is not null and title is not null and pub_year is not null")


def openalex(staging: DataFrame, today: Column) -> DataFrame:
    """Ids are found in the landing pages, files and ids of all locations; only ORCIDs that authors deposited are taken."""
    place = "struct<id:string,landing_page_url:string,pdf_url:string,is_oa:boolean,source:struct<id:string,display_name:string,host_organization_name:string,issn:array<string>,issn_l:string,type:string>>"
    d = _parsed(staging, "openalex", (
        f"id string, title string, display_name string, publication_year string, type string, doi string, language string, is_retracted boolean, open_access struct<oa_status:string>, primary_location {place}, locations string, keywords string, abstract_inverted_index string,"
        "authorships array<struct<raw_author_name:string,raw_orcid:string,is_corresponding:boolean,raw_affiliation_strings:array<string>,institutions:array<struct<display_name:string,country_code:string>>>>"
    ))
    r = lambda n: F.col(f"r.{n}")
    places = items(r("locations"), place)
    urls = F.array_distinct(F.filter(F.flatten(F.transform(places, lambda p: F.array(p["landing_page_url"], p["pdf_url"]))), lambda u: u != ""))
    seen = F.concat(urls, F.filter(F.transform(places, lambda p: p["id"]), lambda x: x.isNotNull()))
    doi = clean_doi(r("doi"))
    dois = F.transform(F.filter(seen, lambda u: u.rlike(r"^doi:|doi\.[a-z.]+/")), clean_doi)
    ids = lists(hal_id=F.transform(seen, hal_id), related_dois=F.filter(dois, lambda x: ~x.eqNullSafe(doi)),
                pmid=F.slice(F.filter(F.transform(F.filter(urls, lambda u: F.contains(u, F.lit("pubmed"))), pmid), lambda x: x.isNotNull()), 1, 1), arxiv_id=F.slice(F.filter(F.transform(urls, arxiv_id), lambda x: x.isNotNull()), 1, 1))
    words = F.transform(items(r("keywords"), "string"), lambda k: F.coalesce(F.get_json_object(k, "$.keyword"), F.get_json_object(k, "$.display_name"), k))
    src = r("primary_location.source")
    spots = lambda a: F.when(F.size(a["raw_affiliation_strings"]) > 0, a["raw_affiliation_strings"]).otherwise(F.transform(a["institutions"], lambda i: i["display_name"]))
    authors = authors_of(r("authorships"), lambda a: a["raw_author_name"], lambda a: one_role(F.lit("author")), lambda a: a["is_corresponding"], lambda a: id_map(orcid=orcid(a["raw_orcid"])), spots)
    return _record(
        d, "openalex", source_id=F.element_at(F.split(r("id"), "/"), -1), doi=doi, title=F.coalesce(text(r("title")), text(r("display_name"))), pub_year=r("publication_year").try_cast("int"), doc_type=r("type"), oa_status=V.openalex_oa(r("open_access.oa_status")), language=r("language"),
        container_title=text(src["display_name"]), publisher=text(src["host_organization_name"]), issns=F.array_distinct(F.filter(F.concat(F.array(src["issn_l"]), F.coalesce(src["issn"], F.array().cast("array<string>"))), lambda x: x.isNotNull())),
        abstract=abstract_from_index(r("abstract_inverted_index")), keywords=texts(words), urls=F.when(F.size(urls) > 0, urls), external_ids=ids, is_retracted=F.coalesce(r("is_retracted"), F.lit(False)), authors=authors,
    ).where("source_id is not null")


def wos(staging: DataFrame, today: Column) -> DataFrame:
    """Single items and lists are read alike; addresses are joined to authors by number; ORCIDs, which the catalogue guesses, aren't taken."""
    d = _parsed(staging, "wos", "UID string, static_data struct<summary:string,fullrecord_metadata:string>, dynamic_data string")
    s, m, y = F.col("r.static_data.summary"), F.col("r.static_data.fullrecord_metadata"), F.col("r.dynamic_data")
    get = F.get_json_object
    d = d.select("id", "staged_doi", F.col("r.UID").alias("uid"), items(get(s, "$.titles.title"), "struct<type:string,content:string>").alias("titles"),
        items(get(s, "$.names.name"), "struct<seq_no:string,role:string,display_name:string,full_name:string,addr_no:string,daisng_id:string,r_id:string,reprint:string>").alias("names"),
        items(get(s, "$.doctypes.doctype"), "string").alias("types"), get(s, "$.pub_info.pubyear").alias("year"), get(s, "$.pub_info.journal_oas_gold").alias("gold"), items(get(s, "$.publishers.publisher.names.name"), "struct<unified_name:string,full_name:string>").alias("makers"),
        items(get(m, "$.addresses.address_name"), "struct<address_spec:struct<addr_no:string,full_address:string>>").alias("spots"), items(get(m, "$.languages.language"), "string").alias("tongues"),
        items(get(m, "$.abstracts.abstract.abstract_text.p"), "string").alias("paragraphs"), items(get(m, "$.keywords.keyword"), "string").alias("words"),
        items(get(y, "$.cluster_related.identifiers.identifier"), "struct<type:string,value:string>").alias("codes"))
    named = lambda kind: text(first(F.filter("titles", lambda t: t["type"] == kind))["content"])
    code = lambda kind: text(first(F.filter("codes", lambda c: c["type"] == kind))["value"])
    numbers = lambda a: F.filter(F.split(F.coalesce(a["addr_no"], F.lit("")), r"\s+"), lambda x: x != "")
    # The last address of a number counts, as in a dictionary.
    at = lambda no: F.element_at(F.filter("spots", lambda p: p["address_spec"]["addr_no"] == no), -1)["address_spec"]["full_address"]
    known = lambda no: F.exists("spots", lambda p: p["address_spec"]["addr_no"] == no)
    authors = authors_of(
        F.filter("names", lambda a: a["role"] != ""), lambda a: F.coalesce(text(a["display_name"]), text(a["full_name"])), lambda a: one_role(V.role(a["role"], F.lit("wos"))), lambda a: a["reprint"] == "Y",
        lambda a: id_map(researcher_id=text(a["r_id"]), daisng_id=text(a["daisng_id"])), lambda a: F.transform(F.filter(numbers(a), known), at), lambda a, i: F.coalesce(a["seq_no"].try_cast("int") - 1, F.lit(0)),
    )
    kind = first(F.col("types"))
    return _record(
        d, "wos", source_id=text(F.col("uid")), doi=F.coalesce(clean_doi(code("doi")), clean_doi(F.col("staged_doi"))), title=F.coalesce(named("item"), F.lit("(sans titre)")), pub_year=F.trim("year").try_cast("int"),
        doc_type=F.coalesce(text(F.when(F.startswith(kind, F.lit("{")), get(kind, "$.content")).otherwise(kind)), F.lit("other")), oa_status=V.wos_oa(F.col("gold")),
        language=F.coalesce(get(first(F.col("tongues")), "$.content"), first(F.col("tongues"))), container_title=named("source"), publisher=F.coalesce(text(first(F.col("makers"))["unified_name"]), text(first(F.col("makers"))["full_name"])),
        issns=F.filter(F.array(code("issn"), code("eissn")), lambda x: x.isNotNull()), abstract=text(F.array_join("paragraphs", " ")), keywords=texts(F.col("words")), authors=authors,
    ).where("source_id is not null")


def scanr(staging: DataFrame, today: Column) -> DataFrame:
    """A record needs a title and a year; a thesis is known by its id."""
    d = _parsed(staging, "scanr", (
        "title string, year string, type string, isOa boolean, oaEvidence struct<hostType:string,license:string,landingPageUrl:string,url:string,pdfUrl:string>, externalIds array<struct<type:string,id:string>>, summary struct<default:string>,"
        "keywords struct<default:string>, source struct<title:string,publisher:string,journalIssns:array<string>>, landingPage string, doiUrl string, pdfUrl string,"
        "authors array<struct<fullName:string,role:string,denormalized:struct<orcid:string,idref:string>,affiliations:array<struct<name:string>>>>"
    ))
    r = lambda n: F.col(f"r.{n}")
    title = F.when(F.startswith(r("title"), F.lit("{")), F.get_json_object(r("title"), "$.default")).otherwise(r("title"))
    of = lambda kind: F.transform(F.filter(r("externalIds"), lambda e: F.lower(e["type"]) == kind), lambda e: e["id"])
    dois = F.transform(of("doi"), clean_doi)
    doi = clean_doi(first(F.filter(r("externalIds"), lambda e: e["type"] == "doi"))["id"])
    kw = r("keywords.default")
    words = F.when(F.startswith(F.trim(kw), F.lit("[")), F.from_json(kw, "array<string>")).otherwise(F.split(kw, ","))
    urls = F.array_distinct(F.filter(F.array(r("landingPage"), r("doiUrl"), r("pdfUrl"), r("oaEvidence.landingPageUrl"), r("oaEvidence.url"), r("oaEvidence.pdfUrl")), lambda u: u != ""))
    number = F.when(F.startswith(F.col("source_id"), F.lit("these")), F.upper(F.substring("source_id", 6, 100)))
    authors = authors_of(r("authors"), lambda a: a["fullName"], lambda a: one_role(V.role(a["role"], F.lit("scanr"))), lambda a: F.lit(False), lambda a: id_map(orcid=orcid(a["denormalized"]["orcid"]), idref=idref(a["denormalized"]["idref"])), lambda a: F.transform(a["affiliations"], lambda x: x["name"]))
    return _record(
        d, "scanr", source_id=F.col("source_id"), doi=doi, title=text(title), pub_year=r("year").try_cast("int"), doc_type=r("type"), oa_status=V.scanr_oa(r("isOa"), r("oaEvidence.hostType"), r("oaEvidence.license")),
        container_title=text(r("source.title")), publisher=text(r("source.publisher")), issns=F.slice(r("source.journalIssns"), 1, 2), abstract=text(r("summary.default")), keywords=texts(words), urls=F.when(F.size(urls) > 0, urls),
        external_ids=lists(nnt=F.array(number), hal_id=of("hal"), pmid=F.slice(of("pmid"), -1, 1), related_dois=F.filter(dois, lambda x: ~x.eqNullSafe(doi))), authors=authors,
    ).where("title is not null and pub_year is not null")


def theses(staging: DataFrame, today: Column) -> DataFrame:
    """A thesis with a date of defence, or one in preparation; all persons of the jury are authors records, with their roles merged.

    Only authors have a position. Addresses are those of the thesis: partner laboratories, then the institution.
    """
    person = "array<struct<nom:string,prenom:string,ppn:string>>"
    d = _parsed(staging, "theses", (
        f"titrePrincipal string, dateSoutenance string, datePremiereInscriptionDoctorat string, doi string, nnt string, discipline string, etabSoutenanceN string, partenairesDeRecherche array<struct<nom:string,type:string>>,"
        f"ecolesDoctorale array<struct<nom:string,ppn:string>>, sujets array<struct<libelle:string>>, auteurs {person}, directeurs {person}, rapporteurs {person}, examinateurs {person}, president string"
    ))
    r = lambda n: F.col(f"r.{n}")
    defended, started = iso_date(r("dateSoutenance")), iso_date(r("datePremiereInscriptionDoctorat"))
    spots = F.concat(F.coalesce(texts(F.transform(r("partenairesDeRecherche"), lambda p: p["nom"])), F.array().cast("array<string>")), F.filter(F.array(text(r("etabSoutenanceN"))), lambda x: x.isNotNull()))
    def named(f: str, role: str) -> Column:
        """(n, role, pos, idref) of the persons of a field; only authors have a position."""
        c = items(r(f), person[6:-1]) if f == "president" else F.coalesce(r(f), F.array().cast(person))
        at = (lambda i: i) if role == "author" else (lambda i: F.lit(None))
        return F.transform(c, lambda p, i: F.struct(text(F.concat_ws(" ", text(p["prenom"]), text(p["nom"]))).alias("n"), F.lit(role).alias("role"), at(i).cast("int").alias("pos"), idref(p["ppn"]).alias("idref")))

    people = [named(f, role) for f, role in V.THESIS_FIELDS.items()]
    every = F.filter(F.concat(*people), lambda p: p["n"].isNotNull())
    same = lambda p: F.filter(every, lambda q: (q["n"] == p["n"]) & (q["idref"].isNull() | p["idref"].isNull() | (q["idref"] == p["idref"])))
    once = F.filter(every, lambda p, i: F.size(F.filter(F.slice(every, F.lit(1), i), lambda q: (q["n"] == p["n"]) & (q["idref"].isNull() | p["idref"].isNull() | (q["idref"] == p["idref"])))) == 0)
    authors = F.transform(once, lambda p: F.struct(
        F.array_min(F.transform(same(p), lambda q: q["pos"])).alias("position"), p["n"].alias("raw_name"), V.merge_roles(F.transform(same(p), lambda q: q["role"])).alias("roles"), F.lit(False).alias("is_corresponding"),
        id_map(idref=F.coalesce(p["idref"], F.array_max(F.transform(same(p), lambda q: q["idref"])))).alias("ids"), spots.alias("addresses")))
    meta = F.struct(defended.alias("date_soutenance"), started.alias("date_inscription"), text(r("discipline")).alias("discipline"), text(r("etabSoutenanceN")).alias("etablissement"), r("ecolesDoctorale").alias("ecoles_doctorales"), r("partenairesDeRecherche").alias("partenaires"))
    return _record(
        d, "theses", source_id=F.col("source_id"), doi=clean_doi(r("doi")), title=text(r("titrePrincipal")), pub_year=F.year(F.coalesce(defended, started)), doc_type=F.when(defended.isNotNull(), "thesis").otherwise("ongoing_thesis"),
        oa_status=F.lit("closed"), keywords=texts(F.transform(r("sujets"), lambda x: x["libelle"])), external_ids=lists(nnt=F.array(nnt(r("nnt")))), meta=F.to_json(meta), authors=authors,
    ).where("title is not null")


def hal(staging: DataFrame, today: Column) -> DataFrame:
    """Author ids come from the record's TEI by position, their HAL account and structures from the aligned fields; an embargo counts while it runs."""
    d = _parsed(staging, "hal", (
        "halId_s string, title_s string, label_s string, docType_s string, docSubType_s string, doiId_s string, nntId_s string, pubmedid_s string, linkExtUrl_s string, linkExtId_s string, openAccess_bool boolean, fileMain_s string, producedDateY_i string,"
        "language_s array<string>, journalTitle_s string, journalIssn_s string, journalEissn_s string, journalPublisher_s string, publisher_s string, bookTitle_s string, conferenceTitle_s string, abstract_s string, keyword_s array<string>, uri_s string,"
        "collCode_s array<string>, label_xml string, authQuality_s array<string>, authFullNameFormIDPersonIDIDHal_fs array<string>, authIdHasPrimaryStructure_fs array<string>, authIdHasStructure_fs array<string>"
    ))
    r = lambda n: F.col(f"r.{n}")
    one = lambda n: text(first(items(r(n), "string")))
    tei = F.regexp_replace(r("label_xml"), r"<(/?)tei:", "<$1")
    files = F.regexp_extract_all(tei, F.lit(r'(?s)<ref\b[^>]*type="file"[^>]*>.*?</ref>'), 0)
    ends = F.flatten(F.transform(files, lambda f: F.regexp_extract_all(f, F.lit(r'notBefore="(\d{4}-\d\d-\d\d)"'), 1)))
    end = F.array_max(F.transform(ends, lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")))
    embargo = F.when(end > today, end)
    head = F.regexp_extract(tei, r"(?s)<biblFull>.*?<titleStmt>(.*?)</titleStmt>", 1)
    people = F.regexp_extract_all(head, F.lit(r"(?s)<author\b.*?</author>"), 0)
    idno = lambda p, kind: text(F.regexp_extract(p, rf'(?is)<idno\b[^>]*type="{kind}"[^>]*>(.*?)</idno>', 1))
    slug = lambda p: text(F.regexp_extract(F.array_join(F.filter(F.regexp_extract_all(p, F.lit(r"(?is)<idno\b[^>]*>.*?</idno>"), 0), lambda x: x.rlike(r'(?i)type="idhal"') & x.rlike(r'(?i)notation="string"')), ""), r"(?s)>(.*?)<", 1))
    struct_of = lambda e: F.struct(F.regexp_extract(e, r"^(.*)-[^-]*_FacetSep_.*_JoinSep_", 1).alias("form"), text(F.regexp_extract(e, r"_JoinSep_.*?_FacetSep_(.*)$", 1)).alias("name"))
    links = F.transform(F.when(F.size(r("authIdHasPrimaryStructure_fs")) > 0, r("authIdHasPrimaryStructure_fs")).otherwise(r("authIdHasStructure_fs")), struct_of)
    aligned = F.transform(r("authFullNameFormIDPersonIDIDHal_fs"), lambda e, i: F.struct(
        F.split_part(e, F.lit("_FacetSep_"), F.lit(1)).alias("name"), F.regexp_extract(F.split_part(e, F.lit("_FacetSep_"), F.lit(2)), r"^(.*)-[^-]*$", 1).alias("form"), text(F.regexp_extract(F.split_part(e, F.lit("_FacetSep_"), F.lit(2)), r"-([1-9]\d*)$", 1)).alias("account"),
        F.get(r("authQuality_s"), i).alias("quality"), F.get(people, i).alias("tei")))
    places = lambda a: F.array_distinct(F.transform(F.filter(links, lambda s: (s["form"] == a["form"]) & (a["form"] != "")), lambda s: s["name"]))
    authors = authors_of(
        aligned, lambda a: a["name"], lambda a: one_role(V.role(a["quality"], F.lit("hal"))), lambda a: V.is_corresponding(a["quality"], F.lit("hal")),
        lambda a: id_map(orcid=orcid(idno(a["tei"], "ORCID")), idref=F.element_at(F.split(idno(a["tei"], "IDREF"), "/"), -1), idhal=slug(a["tei"]), hal_person_id=a["account"]), places,
    )
    links_out = items(r("linkExtUrl_s"), "string")
    ident = text(r("halId_s"))
    return _record(
        d, "hal", source_id=ident, doi=clean_doi(one("doiId_s")), title=F.coalesce(one("title_s"), text(r("label_s"))), pub_year=r("producedDateY_i").try_cast("int"), doc_type=F.concat_ws("_", text(r("docType_s")), text(r("docSubType_s"))),
        oa_status=V.hal_oa(r("openAccess_bool"), r("fileMain_s"), r("linkExtId_s"), embargo), language=first(r("language_s")), container_title=F.coalesce(one("journalTitle_s"), one("bookTitle_s"), one("conferenceTitle_s")),
        publisher=F.coalesce(one("journalPublisher_s"), one("publisher_s")), issns=F.filter(F.array(one("journalIssn_s"), one("journalEissn_s")), lambda x: x.isNotNull()), abstract=one("abstract_s"), keywords=texts(F.array_distinct(r("keyword_s"))),
        urls=F.when(one("uri_s").isNotNull(), F.array(one("uri_s"))),
        external_ids=lists(hal_id=F.array(ident), nnt=F.array(nnt(one("nntId_s"))), pmid=F.array(pmid(one("pubmedid_s"))), pmcid=F.slice(F.filter(F.transform(links_out, pmcid), lambda x: x.isNotNull()), 1, 1), arxiv_id=F.slice(F.filter(F.transform(links_out, arxiv_id), lambda x: x.isNotNull()), 1, 1), hal_collections=F.array_sort(r("collCode_s"))),
        meta=F.to_json(F.struct(embargo.alias("embargo_until"))), authors=authors,
    ).where("source_id is not null")


#: The normaliser of each source.
NORMALISERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {"hal": hal, "openalex": openalex, "wos": wos, "crossref": crossref, "scanr": scanr, "theses": theses, "datacite": datacite}
#: The subjects of a normalised record by source; a source that isn't here has its keywords.
SUBJECTS: dict[str, Callable[[], Column]] = {s: lambda: F.col("keywords") for s in NORMALISERS}


def normalise(staging: DataFrame, sources: list[str] | None = None, today: Column | None = None) -> DataFrame:
    """The records of all, or some, sources. ``staging``: id, source, source_id, doi, raw_data; unknown sources raise ValueError."""
    out = None
    for s in sources or list(NORMALISERS):
        if s not in NORMALISERS:
            raise ValueError(f"unknown source {s!r}")
        part = NORMALISERS[s](staging, today if today is not None else F.current_date())
        out = part if out is None else out.unionByName(part)
    return out


def subjects(records: DataFrame) -> DataFrame:
    """(label, source, id) of the subjects of normalised records, by lower-case label."""
    c = F.lit(None).cast("array<string>")
    for s, f in SUBJECTS.items():
        c = F.when(F.col("source") == s, f()).otherwise(c)
    return records.select("id", "source", F.explode(c).alias("s")).select(F.lower(F.trim("s")).alias("label"), "source", "id").where("label <> ''").distinct()
