"""Queries of the scalar library and of the resolution and maintenance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import domain as D
from corvina.functions import identifiers as I
from corvina.functions import names as N
from corvina.functions import text as X
from corvina.functions import vocabularies as V
from corvina.operators import graph as G
from corvina.operators import maintenance as M
from corvina.operators import matcher as MA
from corvina.operators import persons as PE
from corvina.operators import resolution as R
from corvina.operators import rules as RU
from corvina.session import table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- scalar functions --------------------------------------------------------------------------

FOLD_SQL = "replace(replace(replace(replace(replace(replace(strip_accents(lower({0})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd')"
NORM_SQL = "trim(regexp_replace(" + FOLD_SQL.format("regexp_replace({0}, '</?[A-Za-z][^>]*>', ' ', 'g')") + ", '[^a-z0-9]+', ' ', 'g'))"


@query("F1_normalize_text", f"SELECT id, {NORM_SQL.format('name')} AS norm FROM publishers UNION ALL SELECT id + 100000, {NORM_SQL.format('title')} FROM journals")
def f1(spark, d):
    p = T(spark, d, "publishers").select("id", X.normalize_text(F.col("name")).alias("norm"))
    return p.unionByName(T(spark, d, "journals").select((F.col("id") + 100000).alias("id"), X.normalize_text(F.col("title")).alias("norm")))


@query("F2_normalize_agrees", "SELECT id, title_normalized AS norm FROM journals UNION ALL SELECT id + 100000, name_normalized FROM publishers")
def f2(spark, d):
    """The column twin gives what the tables hold as normalised."""
    j = T(spark, d, "journals").select("id", X.normalize_text(F.col("title")).alias("norm"))
    return j.unionByName(T(spark, d, "publishers").select((F.col("id") + 100000).alias("id"), X.normalize_text(F.col("name")).alias("norm")))


@query("F3_strip_markup", "SELECT id, regexp_replace(title, '</?[A-Za-z][^>]*>', ' ', 'g') AS plain FROM source_publications")
def f3(spark, d):
    return T(spark, d, "source_publications").select("id", X.strip_markup(F.col("title")).alias("plain"))


@query("F4_sanitize", r"SELECT id, raw_text AS clean FROM addresses")
def f4(spark, d):
    """The delivered text without control characters and odd blanks is the table's own raw text."""
    return T(spark, d, "addresses").select("id", X.sanitize_raw_text(F.col("full_address")).alias("clean"))


# Unicode white space, which DuckDB's pattern language does not count as such.
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("F5_label", f"SELECT id, lower(trim(regexp_replace(journal_title, '{BLANKS}', ' ', 'g'))) AS label FROM venue_mentions")
def f5(spark, d):
    return T(spark, d, "venue_mentions").select("id", X.normalize_label(F.col("journal_title")).alias("label"))


ENTITY = "(?:[A-Za-z][A-Za-z0-9]*|#\\d+|#[xX][0-9A-Fa-f]+);"
ENTITIES = "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in X.entity_table().items() if "\0" not in v) + "}"
# Each reference that stands in the text is replaced by its character, the ampersand last.
TITLES_SQL = f"""flat AS (SELECT id, regexp_replace(title, '&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+({ENTITY})', '&\\1', 'g') AS t FROM source_publications), ent AS (SELECT id, t, list_distinct(regexp_extract_all(t, '&{ENTITY}')) AS es, {ENTITIES} AS m FROM flat),
dec AS (SELECT id, CASE WHEN len(es) > 0 THEN list_reduce(list_concat([t], list_concat(list_filter(es, lambda e: e NOT IN ('&amp;', '&AMP;')), list_filter(es, lambda e: e IN ('&amp;', '&AMP;')))), lambda acc, e: replace(acc, e, CASE WHEN e LIKE '&#x%' THEN chr(('0x' || regexp_extract(e, '([0-9A-Fa-f]+);', 1))::int) WHEN e LIKE '&#%' THEN chr(regexp_extract(e, '(\\d+)', 1)::int) ELSE coalesce(m[e], e) END)) ELSE t END AS plain FROM ent)"""


@query("F6_decode_entities", f"WITH {TITLES_SQL} SELECT id, plain FROM dec")
def f6(spark, d):
    return T(spark, d, "source_publications").select("id", X.decode_entities(F.col("title")).alias("plain"))


WIDE_NORM = NORM_SQL.format("replace(replace(replace(replace(trim(regexp_replace(plain, '" + BLANKS + "', ' ', 'g')), 'ﬂ', 'fl'), 'ﬁ', 'fi'), '²', '2'), '…', '...')")


@query("F7_normalized_title", f"WITH {TITLES_SQL} SELECT id, {WIDE_NORM} AS norm FROM dec WHERE trim(regexp_replace(plain, '{BLANKS}', ' ', 'g')) <> ''")
def f7(spark, d):
    return T(spark, d, "source_publications").select("id", X.normalize_text(X.clean_title(F.col("title"))).alias("norm")).where("norm is not null")


DOI1 = (
    "regexp_replace(regexp_replace(regexp_replace(lower(url_decode(regexp_replace(regexp_replace(lower(regexp_replace(doi, '" + BLANKS + "', '', 'g')), '[" + I.DASHES + "]', '-', 'g'), '%(?:25)+', '%', 'g'))), "
    r"'^(?:doi\s*[:=]\s*|(?:https?://)?[a-z.]*doi\.[a-z.]+/)+', ''), '[?#;].*$', ''), '(?:/pdf|/full|\.v\d+|[/.,:<>\]}\x22\x27])+$', '')"
)


@query("F8_clean_doi", rf"WITH c AS (SELECT id, {DOI1} AS d FROM source_publications) SELECT id, CASE WHEN regexp_matches(d, '^10\.\d{{4,9}}/\S+$') THEN d END AS doi FROM c")
def f8(spark, d):
    return T(spark, d, "source_publications").select("id", I.clean_doi(F.col("doi")).alias("doi"))


@query("F9_external_ids", r"""WITH e AS (SELECT id, json_extract_string(external_ids, '$.pmid') AS p, json_extract_string(external_ids, '$.arxiv_id') AS a, json_extract_string(external_ids, '$.nnt') AS n, lower(external_ids->>'$.hal_id') AS h FROM source_publications)
SELECT id, nullif(regexp_extract(trim(p), '(?i)^(?:https?://\S*?/|pmid:?\s*)?([1-9]\d*)/?$', 1), '') AS pmid, nullif(regexp_extract(lower(trim(a)), '(?:arxiv:|/abs/|^)(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?$', 1), '') AS arxiv,
CASE WHEN regexp_matches(upper(trim(n)), '^[0-9A-Z]+$') THEN upper(trim(n)) END AS nnt, nullif(regexp_extract(h, '([a-z][a-z0-9]*-\d{8,})', 1), '') AS hal FROM e""")
def f9(spark, d):
    m = F.from_json("external_ids", "map<string,string>")
    return T(spark, d, "source_publications").select("id", I.pmid(m["pmid"]).alias("pmid"), I.arxiv_id(m["arxiv_id"]).alias("arxiv"), I.nnt(m["nnt"]).alias("nnt"), I.hal_id(m["hal_id"]).alias("hal"))


@query("F10_person_ids", r"""SELECT id, nullif(upper(regexp_extract(json_extract_string(person_identifiers, '$.orcid'), '(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])$', 1)), '') AS orcid FROM author_identifying_keys""")
def f10(spark, d):
    m = F.from_json("person_identifiers", "map<string,string>")
    return T(spark, d, "author_identifying_keys").select("id", I.orcid(m["orcid"]).alias("orcid"))


@query("F13_parse_name", r"""WITH s AS (SELECT id, trim(regexp_replace(raw_author_name, '[\s\x{00A0}]+', ' ', 'g')) AS n FROM source_authorships WHERE raw_author_name IS NOT NULL)
SELECT id, CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) ELSE regexp_extract(n, '[^ ]*$') END AS last, CASE WHEN contains(n, ',') THEN trim(regexp_replace(n, '^[^,]*,\s*', '')) ELSE trim(regexp_replace(n, '[^ ]*$', '')) END AS first FROM s""")
def f13(spark, d):
    s = T(spark, d, "source_authorships").where("raw_author_name is not null").select("id", N.parse_name(F.col("raw_author_name")).alias("p"))
    return s.select("id", "p.last", "p.first")


@query("F12_ids_from_urls", r"""WITH u AS (SELECT id, unnest(from_json(json_extract(raw_data, '$.locations'), '["JSON"]')) AS l FROM staging WHERE source = 'openalex' AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT' AND json_type(raw_data, '$.locations') = 'ARRAY'), t AS (SELECT id, unnest([l ->> '$.id', l ->> '$.landing_page_url', l ->> '$.pdf_url']) AS x FROM u)
SELECT DISTINCT id, 'doi' AS type, regexp_replace(lower(x), '^doi:', '') AS value FROM t WHERE x LIKE 'doi:10.%/%' UNION SELECT id, 'hal_id', regexp_extract(lower(x), '([a-z][a-z0-9]*-\d{8,})', 1) FROM t WHERE regexp_matches(lower(x), '[a-z][a-z0-9]*-\d{8,}')""")
def f12(spark, d):
    """Identifiers in the locations of openalex payloads."""
    st = T(spark, d, "staging").where("source = 'openalex'").where(F.try_parse_json("raw_data").isNotNull())
    place = "array<struct<id:string,landing_page_url:string,pdf_url:string>>"
    urls = F.flatten(F.transform(F.from_json(F.get_json_object("raw_data", "$.locations"), place), lambda p: F.array(p["id"], p["landing_page_url"], p["pdf_url"])))
    return st.select("id", F.explode(I.ids_from_urls(urls)).alias("i")).select("id", "i.type", "i.value").distinct()


@query("F14_name_forms", """WITH p AS (SELECT id, regexp_extract(author_name_normalized, '[^ ]*$') AS l, trim(regexp_replace(author_name_normalized, '[^ ]*$', '')) AS f FROM author_identifying_keys WHERE author_name_normalized IS NOT NULL),
q AS (SELECT id, l, f, list_transform(list_filter(string_split(f, ' '), lambda t: t <> ''), lambda t: t[1]) AS i FROM p), r AS (SELECT id, unnest([l || ' ' || f, f || ' ' || l, l || ' ' || array_to_string(i, ' '), array_to_string(i, ' ') || ' ' || l, l || ' ' || array_to_string(i, ''), array_to_string(i, '') || ' ' || l]) AS form FROM q)
SELECT DISTINCT id, trim(form) AS form FROM r WHERE trim(form) <> ''""")
def f14(spark, d):
    s = T(spark, d, "author_identifying_keys").where("author_name_normalized is not null").select("id", N.parse_name(F.col("author_name_normalized")).alias("p"))
    return s.select("id", F.explode(N.name_forms(F.col("p.last"), F.col("p.first"))).alias("form"))


def _names(spark, d):
    """Family and given names of the identities."""
    n = T(spark, d, "author_identifying_keys").select("id", "author_name_normalized").where("author_name_normalized is not null")
    return n.select("id", N.parse_name(F.col("author_name_normalized")).alias("p")).select("id", "p.last", "p.first")


def _name_pairs(spark, d):
    """Pairs of identities that share a family name, or whose family name is the other's given name."""
    n = _names(spark, d)
    k = n.select("id", F.explode(F.array_distinct(F.array("last", "first"))).alias("k")).where("k <> ''")
    pairs = G.class_pairs(k, "k", "id").select("a", "b").distinct()
    a, b = n.toDF("a", "la", "fa"), n.toDF("b", "lb", "fb")
    return pairs.join(a, "a").join(b, "b").withColumnsRenamed({"a": "id_a", "b": "id_b"})


PAIRS_SQL = """n AS (SELECT id, regexp_extract(author_name_normalized, '[^ ]*$') AS l, trim(regexp_replace(author_name_normalized, '[^ ]*$', '')) AS f FROM author_identifying_keys WHERE author_name_normalized IS NOT NULL),
k AS (SELECT id, l AS k FROM n WHERE l <> '' UNION SELECT id, f FROM n WHERE f <> ''), pr AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM k x JOIN k y ON x.k = y.k AND x.id < y.id), np AS (SELECT id_a, id_b, a.l AS la, a.f AS fa, b.l AS lb, b.f AS fb FROM pr JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b)"""
TOKENS = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'), '\\d+', ' ', 'g'), ' '), lambda t: t <> ''))"
FITS = "(len({0}) > 0 AND len({1}) > 0 AND len(list_filter(CASE WHEN len({0}) <= len({1}) THEN {0} ELSE {1} END, lambda x: len(list_filter(CASE WHEN len({0}) <= len({1}) THEN {1} ELSE {0} END, lambda y: x = y OR (length(x) = 1 AND starts_with(y, x)) OR (length(y) = 1 AND starts_with(x, y)))) = 0)) = 0)"


@query("F15_compatible", f"WITH {PAIRS_SQL}, t AS (SELECT id_a, id_b, {TOKENS.format(chr(39) + chr(39) + ' || la || ' + chr(39) + ' ' + chr(39) + ' || fa')} AS a, {TOKENS.format('lb || ' + chr(39) + ' ' + chr(39) + ' || fb')} AS b FROM np) SELECT id_a, id_b FROM t WHERE {FITS.format('a', 'b')}")
def f15(spark, d):
    return PE.compatible_pairs(_names(spark, d)).toDF("id_a", "id_b")


@query("F16_one_edit", f"WITH {PAIRS_SQL} SELECT id_a, id_b FROM np WHERE damerau_levenshtein(fa, fb) <= 1")
def f16(spark, d):
    return PE.one_edit_pairs(_names(spark, d)).toDF("id_a", "id_b")


JOINED = "replace(regexp_replace(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g')), '\\d+', '', 'g'), ' ', '')"
CLOSE = "(len({a}) > 0 AND len({b}) > 0 AND (list_sort({a}) = list_sort({b}) OR {x} = {y} OR (length({x}) >= 2 AND length({y}) >= 2 AND damerau_levenshtein({x}, {y}) <= 1)))"


@query("F16_same_person", f"""WITH {PAIRS_SQL}, t AS (SELECT id_a, id_b, {TOKENS.format("la || ' ' || fa")} AS a, {TOKENS.format("lb || ' ' || fb")} AS b, {TOKENS.format('la')} AS tla, {TOKENS.format('lb')} AS tlb, {TOKENS.format('fa')} AS tfa, {TOKENS.format('fb')} AS tfb,
{JOINED.format('la')} AS jla, {JOINED.format('lb')} AS jlb, {JOINED.format('fa')} AS jfa, {JOINED.format('fb')} AS jfb FROM np)
SELECT id_a, id_b FROM t WHERE {FITS.format('a', 'b')} OR ({CLOSE.format(a='tla', b='tlb', x='jla', y='jlb')} AND {CLOSE.format(a='tfa', b='tfb', x='jfa', y='jfb')})""")
def f16b(spark, d):
    """Names of one person, spelling apart, among pairs that share a part."""
    return _name_pairs(spark, d).where(N.same_person(F.col("la"), F.col("fa"), F.col("lb"), F.col("fb"))).select("id_a", "id_b")


_OWN = ", ".join(f"('{s} {k}', '{v}')" for s, t in V.SOURCE_TYPES.items() for k, v in t.items())
_ALL = ", ".join(f"('{k}', '{v}')" for k, v in V.everywhere().items())
_TYPES = "(" + ", ".join(f"'{t}'" for t in V.DOC_TYPES) + ")"


@query("F17_doc_type", f"""WITH own(k, v) AS (VALUES {_OWN}), everywhere(k, v) AS (VALUES {_ALL}), raw AS (SELECT id, source, doc_type AS r FROM source_publications UNION ALL SELECT id + 10000000, source, raw_type FROM (SELECT id, source, json_extract_string(raw_data, '$.static_data.summary.doctypes.doctype') AS raw_type FROM staging WHERE source = 'wos' AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT'))
SELECT r.id, coalesce(o.v, e.v, CASE WHEN lower(trim(r.r)) IN {_TYPES} THEN lower(trim(r.r)) END, 'other') AS t FROM raw r LEFT JOIN own o ON o.k = r.source || ' ' || lower(trim(r.r)) LEFT JOIN everywhere e ON e.k = lower(trim(r.r))""")
def f17(spark, d):
    """Types of the records, and of the raw payloads of one source."""
    sp = T(spark, d, "source_publications").select("id", "source", F.col("doc_type").alias("r"))
    st = T(spark, d, "staging").where("source = 'wos'").where(F.try_parse_json("raw_data").isNotNull() & F.startswith(F.ltrim("raw_data"), F.lit("{")))
    st = st.select((F.col("id") + 10_000_000).alias("id"), "source", F.get_json_object("raw_data", "$.static_data.summary.doctypes.doctype").alias("r"))
    return sp.unionByName(st).select("id", V.doc_type(F.col("r"), F.col("source")).alias("t"))


@query("F18_roles", """SELECT id, list_sort(list_distinct(CASE WHEN list_has_any(roles, ['thesis_director', 'rapporteur', 'jury_president']) THEN list_filter(roles, lambda r: r <> 'jury_member') ELSE roles END)) AS roles FROM (SELECT id, list_concat(roles, CASE WHEN author_position % 2 = 0 THEN ['jury_member'] ELSE [] END) AS roles FROM source_authorships WHERE roles IS NOT NULL)""")
def f18(spark, d):
    """Merged roles of the signatures, every other one with a plain membership beside them."""
    more = F.when(F.col("author_position") % 2 == 0, F.array(F.lit("jury_member"))).otherwise(F.array().cast("array<string>"))
    return T(spark, d, "source_authorships").where("roles is not null").select("id", V.merge_roles(F.concat("roles", more)).alias("roles"))


_ROLES = ", ".join(f"('{s} {k}', '{v}')" for s, t in V.SOURCE_ROLES.items() for k, v in t.items())


@query("F18_map_role", f"""WITH m(k, v) AS (VALUES {_ROLES}), a AS (SELECT DISTINCT s.source, r.raw FROM (SELECT DISTINCT source FROM source_authorships) s, (SELECT unnest(['aut', 'CRP', ' edt ', 'ctb', 'book_editor', 'presidentjury', 'nope', '', NULL]) AS raw) r)
SELECT a.source, a.raw, CASE WHEN a.raw IS NULL OR a.raw = '' OR a.source NOT IN ('hal', 'wos', 'scanr') THEN 'author' ELSE coalesce(m.v, 'other') END AS role, coalesce(a.source = 'hal' AND lower(trim(a.raw)) = 'crp', false) AS corresponding FROM a LEFT JOIN m ON m.k = a.source || ' ' || lower(trim(a.raw))""")
def f18b(spark, d):
    """Every source against roles that some of them have."""
    raw = F.explode(F.array(*[F.lit(x) for x in ("aut", "CRP", " edt ", "ctb", "book_editor", "presidentjury", "nope", "")], F.lit(None).cast("string")))
    a = T(spark, d, "source_authorships").select("source").distinct().select("source", raw.alias("raw"))
    return a.select("source", "raw", V.role(F.col("raw"), F.col("source")).alias("role"), V.is_corresponding(F.col("raw"), F.col("source")).alias("corresponding"))


@query("F19_best_oa", """WITH s AS (SELECT publication_id, lower(trim(oa_status)) AS o FROM source_publications WHERE publication_id IS NOT NULL), r AS (SELECT *, CASE o WHEN 'diamond' THEN 8 WHEN 'gold' THEN 7 WHEN 'hybrid' THEN 6 WHEN 'bronze' THEN 5 WHEN 'green' THEN 4 WHEN 'embargoed' THEN 3 WHEN 'closed' THEN 2 WHEN 'unknown' THEN 1 END AS k FROM s)
SELECT publication_id, arg_max(o, k) AS best FROM r GROUP BY 1""")
def f19(spark, d):
    return T(spark, d, "source_publications").where("publication_id is not null").groupBy("publication_id").agg(D.best_oa(F.lower(F.trim("oa_status"))).alias("best"))


@query("F20_F21_journal_oa", """SELECT p.id, CASE WHEN j.oa_model = 'full_oa' THEN coalesce(p.oa_status, '') IN ('gold','diamond') WHEN j.oa_model = 'subscription' THEN coalesce(p.oa_status, '') NOT IN ('gold','diamond') END AS expected FROM source_publications p JOIN journals j ON j.id = p.journal_id""")
def f21(spark, d):
    j = T(spark, d, "journals").select(F.col("id").alias("journal_id"), "oa_model")
    return T(spark, d, "source_publications").join(j, "journal_id").select("id", D.expected_oa(F.col("oa_model"), F.coalesce("oa_status", F.lit(""))).alias("expected"))


@query("F22_iso_date", "SELECT o_orderkey, o_orderdate::date AS day FROM orders")
def f22(spark, d):
    return T(spark, d, "orders").select("o_orderkey", D.iso_date(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")).alias("day"))


@query("F23_json_path", "SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events")
def f23(spark, d):
    return T(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("F24_arrays", "SELECT id, list_contains(countries, 'FR') AS fr, len(countries) AS n, list_filter(countries, lambda x: x <> 'FR') AS others FROM addresses WHERE countries IS NOT NULL")
def f24(spark, d):
    c = F.col("countries")
    return T(spark, d, "addresses").where("countries is not null").select("id", F.array_contains(c, "FR").alias("fr"), F.size(c).alias("n"), F.array_remove(c, "FR").alias("others"))


@query("F25_scalars", "SELECT id, greatest(pub_year, 2015) AS g, least(pub_year, 2015) AS l, coalesce(language, '?') AS lang, left(source_id, 3) AS a, right(source_id, 3) AS b, md5(source || source_id) AS h FROM source_publications")
def f25(spark, d):
    return T(spark, d, "source_publications").select("id", F.when(F.col("pub_year").isNull(), 2015).otherwise(F.greatest("pub_year", F.lit(2015))).alias("g"), F.when(F.col("pub_year").isNull(), 2015).otherwise(F.least("pub_year", F.lit(2015))).alias("l"), F.coalesce("language", F.lit("?")).alias("lang"), F.left("source_id", F.lit(3)).alias("a"), F.right("source_id", F.lit(3)).alias("b"), F.md5(F.concat("source", "source_id")).alias("h"))


@query("F26_abstract_index", """WITH s AS (SELECT id, json_extract(raw_data, '$.abstract_inverted_index') AS x FROM staging WHERE source = 'openalex' AND json_valid(raw_data)), k AS (SELECT id, x, unnest(json_keys(x)) AS w FROM s WHERE x IS NOT NULL AND json_type(x) = 'OBJECT'),
p AS (SELECT id, w, unnest(from_json(x -> w, '["INT"]')) AS pos FROM k) SELECT id, string_agg(w, ' ' ORDER BY pos, w) AS abstract FROM p GROUP BY 1""")
def f26(spark, d):
    s = T(spark, d, "staging").where("source = 'openalex'").select("id", F.get_json_object("raw_data", "$.abstract_inverted_index").alias("x"))
    return s.where("x is not null").select("id", D.abstract_from_index(F.col("x")).alias("abstract")).where("abstract is not null")


@query("F28_first_year", "SELECT id, coalesce(pub_year, year(created_at)) AS y FROM source_publications")
def f28(spark, d):
    return T(spark, d, "source_publications").select("id", D.first_year(F.col("pub_year"), F.year("created_at")).alias("y"))


# --- graph -------------------------------------------------------------------------------------

E2_SQL = """WITH RECURSIVE t AS (SELECT id, 'd' || doi AS k FROM source_publications WHERE doi LIKE '10.%/%' UNION SELECT id, 'p' || publication_id FROM source_publications WHERE publication_id IS NOT NULL),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM t a JOIN t b ON a.k = b.k), c(id, label) AS (SELECT id, id FROM source_publications UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.id)
SELECT id, min(label) AS label FROM c GROUP BY 1"""


@query("E2_components", E2_SQL)
def e2(spark, d):
    sp = T(spark, d, "source_publications").select("id", "doi", "publication_id")
    t = sp.where("doi like '10.%/%'").select("id", F.concat(F.lit("d"), "doi").alias("token")).unionByName(sp.where("publication_id is not null").select("id", F.concat(F.lit("p"), F.col("publication_id").cast("string")).alias("token")))
    return G.components(spark, sp.select("id"), t)


EDGES_SQL = "e AS (SELECT DISTINCT l_suppkey AS parent, l_suppkey + 1 + l_linenumber AS child FROM lineitem WHERE l_suppkey + 1 + l_linenumber <= (SELECT max(l_suppkey) FROM lineitem) UNION SELECT 5, 2)"


def _edges(spark, d):
    li = T(spark, d, "lineitem").select("l_suppkey", "l_linenumber")
    e = li.select(F.col("l_suppkey").alias("parent"), (F.col("l_suppkey") + 1 + F.col("l_linenumber")).alias("child")).distinct()
    top = li.agg(F.max("l_suppkey").alias("m"))
    return e.join(F.broadcast(top), F.col("child") <= F.col("m")).select("parent", "child").unionByName(spark.createDataFrame([(5, 2)], "parent bigint, child bigint"))


@query("U5_closure", f"WITH RECURSIVE {EDGES_SQL}, c(root, node) AS (SELECT 2::bigint, 2::bigint UNION SELECT c.root, e.child FROM c JOIN e ON e.parent = c.node) SELECT root, node FROM c")
def u5(spark, d):
    return G.closure(spark, spark.createDataFrame([(2,)], "node bigint"), _edges(spark, d)).select("root", "node")


@query("U6_ancestors", f"WITH RECURSIVE {EDGES_SQL}, c(root, node) AS (SELECT 9::bigint, 9::bigint UNION SELECT c.root, e.parent FROM c JOIN e ON e.child = c.node) SELECT root, node FROM c WHERE node <> 9")
def u6(spark, d):
    return G.ancestors(spark, spark.createDataFrame([(9,)], "node bigint"), _edges(spark, d)).select("root", "node").where("node <> 9")


# --- publication resolution --------------------------------------------------------------------

@query("E1_confirmation_keys", rf"""WITH c AS (SELECT id, {DOI1} AS d, title_normalized AS t, pub_year AS y, lower(external_ids->>'$.hal_id') AS h, json_extract_string(external_ids, '$.pmid') AS p, json_extract_string(external_ids, '$.nnt') AS n FROM source_publications)
SELECT DISTINCT * FROM (SELECT id, 'doi' AS type, d AS value FROM c WHERE regexp_matches(d, '^10\.\d{{4,9}}/\S+$') UNION ALL SELECT id, 'metadata_block', t || '|' || y FROM c WHERE length(t) > 30 AND y IS NOT NULL
UNION ALL SELECT id, 'hal_id', unnest(regexp_extract_all(h, '([a-z][a-z0-9]*-\d{{8,}})')) FROM c UNION ALL SELECT id, 'pmid', regexp_extract(trim(p), '(?i)^(?:https?://\S*?/|pmid:?\s*)?([1-9]\d*)/?$', 1) FROM c WHERE regexp_extract(trim(p), '(?i)^(?:https?://\S*?/|pmid:?\s*)?([1-9]\d*)/?$', 1) <> ''
UNION ALL SELECT id, 'nnt', upper(trim(n)) FROM c WHERE regexp_matches(upper(trim(n)), '^[0-9A-Z]+$'))""")
def e1(spark, d):
    return R.confirmation_keys(T(spark, d, "source_publications"))


PARTS_SQL = f"""keys AS ({SQL['E1_confirmation_keys']}), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.type = b.type AND a.value = b.value), c(id, label) AS (SELECT id, id FROM source_publications UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.id),
l AS (SELECT id, min(label) AS label FROM c GROUP BY 1), dd AS (SELECT id, {DOI1} AS d FROM source_publications), dois AS (SELECT id, CASE WHEN regexp_matches(d, '^10\\.\\d{{4,9}}/\\S+$') THEN d END AS doi FROM dd), n AS (SELECT label, count(DISTINCT doi) AS n FROM l JOIN dois USING (id) GROUP BY 1),
parts AS (SELECT id, label, CASE WHEN n.n <= 1 THEN '' ELSE doi END AS part FROM l JOIN dois USING (id) JOIN n USING (label))"""


@query("E3_cannot_link", f"WITH RECURSIVE {PARTS_SQL} SELECT id, label, part FROM parts")
def e3(spark, d):
    return R.resolve(spark, T(spark, d, "source_publications"))


def _members(spark, d):
    sp = T(spark, d, "source_publications")
    parts = R.resolve(spark, sp)
    own = sp.where("publication_id is not null").groupBy("publication_id").agg(F.min(I.clean_doi(F.col("doi"))).alias("publication_doi"))
    inside = T(spark, d, "source_authorships").groupBy(F.col("source_publication_id").alias("id")).agg(F.bool_or(F.coalesce("in_perimeter", F.lit(False))).alias("in_perimeter"))
    m = sp.select("id", "publication_id", "title_normalized", "pub_year", I.clean_doi(F.col("doi")).alias("doi")).join(parts, "id").join(own, "publication_id", "left")
    return m.join(inside, "id", "left")


CLAIMS_SQL = f"""{PARTS_SQL}, own AS (SELECT publication_id, min(doi) AS publication_doi FROM source_publications s JOIN dois x USING (id) WHERE publication_id IS NOT NULL GROUP BY 1).""".replace("min(doi) AS publication_doi FROM source_publications s JOIN dois x USING (id)", "min(x.doi) AS publication_doi FROM source_publications s JOIN dois x ON x.id = s.id").rstrip(".") + """,
ins AS (SELECT source_publication_id AS id, bool_or(coalesce(in_perimeter, false)) AS inside FROM source_authorships GROUP BY 1), mem AS (SELECT s.id, p.label, p.part, s.publication_id, o.publication_doi, x.doi, coalesce(i.inside, false) AS inside, coalesce(s.title_normalized <> '' AND s.pub_year > 0, false) AS usable FROM source_publications s JOIN parts p ON p.id = s.id JOIN dois x ON x.id = s.id LEFT JOIN own o ON o.publication_id = s.publication_id LEFT JOIN ins i ON i.id = s.id),
g AS (SELECT label, part, min(id) AS first, max(doi) AS doi, arg_min(publication_id, id) FILTER (publication_id IS NOT NULL) AS weak, bool_or(usable) AS usable, bool_or(inside) AS inside FROM mem WHERE part IS NOT NULL GROUP BY 1, 2),
k AS (SELECT label, part, publication_doi AS doi, min(publication_id) AS carrier FROM mem WHERE part IS NOT NULL AND publication_id IS NOT NULL AND publication_doi IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT label, part, first, coalesce(carrier, weak) AS wanted, row_number() OVER (PARTITION BY coalesce(carrier, weak) ORDER BY carrier IS NULL, first) AS rn FROM g LEFT JOIN k USING (label, part, doi) WHERE coalesce(carrier, weak) IS NOT NULL OR (inside AND usable)),
kept AS (SELECT label, part, CASE WHEN rn = 1 AND wanted IS NOT NULL THEN wanted END AS anchor, CASE WHEN rn = 1 AND wanted IS NOT NULL THEN 'keep' ELSE 'create' END AS action, first FROM w)"""


@query("E4_claims", f"WITH RECURSIVE {CLAIMS_SQL} SELECT * FROM kept")
def e4(spark, d):
    return R.claims(_members(spark, d))


@query("E5_dissolved", f"""WITH RECURSIVE {CLAIMS_SQL}, pl AS (SELECT m.id, m.publication_id, k.anchor, k.label IS NOT NULL AS assigned FROM mem m LEFT JOIN kept k ON k.label = m.label AND k.part = m.part WHERE m.publication_id IS NOT NULL),
gone AS (SELECT publication_id, arg_min(coalesce(anchor, -1), id) AS successor FROM pl WHERE publication_id NOT IN (SELECT anchor FROM kept WHERE anchor IS NOT NULL) AND publication_id NOT IN (SELECT publication_id FROM pl WHERE NOT assigned) GROUP BY 1) SELECT * FROM gone WHERE successor > 0 AND successor <> publication_id""")
def e5(spark, d):
    m = _members(spark, d)
    return R.dissolved(m, R.claims(m))


@query("E6_dirty_universe", f"WITH keys AS ({SQL['E1_confirmation_keys']}), dirty AS (SELECT id FROM source_publications WHERE keys_dirty) SELECT id FROM dirty UNION SELECT b.id FROM keys a JOIN keys b ON a.type = b.type AND a.value = b.value WHERE a.id IN (SELECT id FROM dirty)")
def e6(spark, d):
    sp = T(spark, d, "source_publications")
    return R.dirty_universe(sp, R.confirmation_keys(sp))


RANK = "CASE source WHEN 'theses' THEN 1 WHEN 'crossref' THEN 2 WHEN 'datacite' THEN 3 WHEN 'hal' THEN 4 WHEN 'openalex' THEN 5 WHEN 'scanr' THEN 6 WHEN 'wos' THEN 7 ELSE 8 END"
FIRSTS = ", ".join(f"first({c} ORDER BY r, id) FILTER ({c} IS NOT NULL) AS {c}" for c in R.FIELDS)
SUB = "('review','book_review','data_paper','conference_paper','editorial','letter','erratum','retraction')"
PUBS_SQL = f"""pubs AS (WITH s AS (SELECT *, {RANK} AS r, lower(trim(oa_status)) AS o FROM source_publications WHERE publication_id IS NOT NULL), g AS (SELECT publication_id, {FIRSTS}, first(doc_type ORDER BY r, id) FILTER (doc_type IS NOT NULL) AS k, first(doc_type ORDER BY r, id) FILTER (doc_type IN {SUB}) AS u,
coalesce(arg_max(o, CASE o WHEN 'diamond' THEN 8 WHEN 'gold' THEN 7 WHEN 'hybrid' THEN 6 WHEN 'bronze' THEN 5 WHEN 'green' THEN 4 WHEN 'embargoed' THEN 3 WHEN 'closed' THEN 2 WHEN 'unknown' THEN 1 END), 'unknown') AS oa_status, bool_or(coalesce(is_retracted, false)) AS is_retracted, list_sort(list(DISTINCT source)) AS sources FROM s GROUP BY 1)
SELECT * EXCLUDE (k, u), coalesce(CASE WHEN k = 'article' AND u IS NOT NULL THEN u ELSE k END, 'other') AS doc_type FROM g)"""


@query("E7_survivorship", f"WITH {PUBS_SQL} SELECT * FROM pubs")
def e7(spark, d):
    return R.survivors(T(spark, d, "source_publications"))


@query("E7_united_lists", """WITH x AS (SELECT normalized_text, id, generate_subscripts(countries, 1) AS p, unnest(countries) AS c FROM addresses WHERE normalized_text IS NOT NULL), f AS (SELECT normalized_text, lower(c) AS l, min(struct_pack(id := id, p := p, c := c)) AS m FROM x WHERE c IS NOT NULL GROUP BY 1, 2) SELECT normalized_text, list(m.c ORDER BY m) AS countries FROM f GROUP BY 1""")
def e7b(spark, d):
    """Union of lists in the order of their rows, differences of case apart."""
    return R.united_lists(T(spark, d, "addresses"), "normalized_text", "countries", F.col("id"))


@query("E7_merged_maps", f"""WITH x AS (SELECT publication_id, {RANK} AS r, id, unnest(json_keys(external_ids)) AS k, external_ids FROM source_publications WHERE publication_id IS NOT NULL), y AS (SELECT publication_id, r, id, k, json_extract_string(external_ids, '$."' || k || '"') AS v FROM x)
SELECT publication_id, k, arg_min(v, r * 100000000 + id) AS v FROM y WHERE v IS NOT NULL GROUP BY 1, 2""")
def e7c(spark, d):
    """Shallow merge of JSON objects, the most trusted source first; one row an entry."""
    from corvina.operators.aggregates import rank_of

    m = R.merged_maps(T(spark, d, "source_publications"), "publication_id", "external_ids", rank_of(F.col("source"), R.PRIORITY), F.col("id"))
    return m.select("publication_id", F.explode("external_ids").alias("k", "v"))


@query("E15_rules", r"""SELECT p.id, CASE WHEN p.doc_type IN ('thesis','ongoing_thesis','memoir') AND p.journal_id IS NOT NULL AND p.doi IS NOT NULL AND NOT starts_with(p.doi, '10.70675/') THEN 'article' WHEN j.journal_type = 'media' THEN 'media'
WHEN j.journal_type = 'proceedings' AND p.doc_type IN ('article','book_chapter') THEN 'conference_paper' WHEN j.journal_type = 'preprint_server' AND p.doc_type IN ('article','other') THEN 'preprint'
WHEN p.doc_type IN ('article','other') AND regexp_matches(lower(p.title_normalized), '^(interview|reportage|podcast)') THEN 'media' WHEN p.doc_type IN ('article','other') AND regexp_matches(lower(p.title_normalized), '^(additional file|supplementary (material|data|information|file|dataset)|data from)') THEN 'dataset'
WHEN p.doc_type IN ('article','preprint','review','conference_paper','data_paper','letter','other') AND regexp_matches(lower(p.title_normalized), '^(erratum|errata|corrigendum|author correction|publisher correction)') THEN 'erratum' ELSE p.doc_type END AS doc_type,
CASE WHEN p.oa_status = 'hybrid' AND j.oa_model = 'full_oa' THEN 'gold' ELSE p.oa_status END AS oa_status, p.doc_type AS raw_doc_type FROM source_publications p LEFT JOIN journals j ON j.id = p.journal_id""")
def e15(spark, d):
    j = T(spark, d, "journals").select(F.col("id").alias("journal_id"), "journal_type", "oa_model")
    sp = T(spark, d, "source_publications").select("id", "title", "title_normalized", "doc_type", "doi", "journal_id", "oa_status").join(j, "journal_id", "left")
    return RU.correct(sp).select("id", "doc_type", "oa_status", "raw_doc_type")


@query("E16_provenance", SQL["E15_rules"])
def e16(spark, d):
    """Running the rules on their own result gives what running them once gives."""
    j = T(spark, d, "journals").select(F.col("id").alias("journal_id"), "journal_type", "oa_model")
    sp = T(spark, d, "source_publications").select("id", "title", "title_normalized", "doc_type", "doi", "journal_id", "oa_status").join(j, "journal_id", "left")
    return RU.correct(RU.correct(sp)).select("id", "doc_type", "oa_status", "raw_doc_type")


@query("E17_dissertation_keys", """WITH h AS (SELECT id, regexp_extract_all(lower(external_ids->>'$.hal_id'), '([a-z][a-z0-9]*-\\d{8,})') AS a FROM source_publications), f AS (SELECT id, list_filter(a, lambda x: NOT (starts_with(x, 'tel-') OR starts_with(x, 'dumas-'))) AS kept FROM h)
SELECT id, kept FROM f WHERE len(kept) > 0""")
def e17(spark, d):
    h = F.regexp_extract_all(F.lower(F.from_json("external_ids", "map<string,string>")["hal_id"]), F.lit(r"([a-z][a-z0-9]*-\d{8,})"), 1)
    return T(spark, d, "source_publications").select("id", RU.strip_dissertation_keys(h).alias("kept")).where("kept is not null")


# Declared relations stand in no test table, so they are made of the related DOIs, one name by the type of the record.
META_SQL = """meta AS (SELECT s.id, s.publication_id, s.doc_type, lower(s.doi) AS doi, s.title_normalized, lower(x.r) AS rdoi, CASE s.doc_type WHEN 'dataset' THEN 'IsPartOf' WHEN 'book_chapter' THEN 'IsPartOf' WHEN 'preprint' THEN 'IsVariantFormOf' WHEN 'article' THEN 'IsVersionOf' ELSE 'IsSupplementTo' END AS rt FROM source_publications s LEFT JOIN (SELECT id, unnest(from_json(json_extract(external_ids, '$.related_dois'), '["VARCHAR"]')) AS r FROM source_publications) x ON x.id = s.id)"""


def _with_meta(spark, d):
    sp = T(spark, d, "source_publications").select("id", "publication_id", "doc_type", "doi", "title_normalized", "external_ids")
    name = F.when(F.col("doc_type").isin("dataset", "book_chapter"), "IsPartOf").when(F.col("doc_type") == "preprint", "IsVariantFormOf").when(F.col("doc_type") == "article", "IsVersionOf").otherwise("IsSupplementTo")
    related = F.transform(F.from_json(F.get_json_object("external_ids", "$.related_dois"), "array<string>"), lambda x: F.struct(F.lower(x).alias("doi"), name.alias("relation_type")))
    return sp.select("id", "publication_id", F.lit("datacite").alias("source"), "doc_type", F.lower("doi").alias("doi"), "title_normalized", F.to_json(F.struct(related.alias("related_identifiers"))).alias("meta"))


CHAPTER = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(title_normalized, ''), '\\d+', ' ', 'g'), '\\b(chapitre|chapter|chap|ch|section|sec|partie|part|vol|tome|pp|p)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("E18_doi_clusters", f"""WITH {META_SQL}, s AS (SELECT DISTINCT id, doc_type, doi, title_normalized FROM meta WHERE doi IS NOT NULL), sets AS (SELECT DISTINCT doi FROM s WHERE doc_type = 'dataset'),
f AS (SELECT doi, rdoi, CASE rt WHEN 'IsVersionOf' THEN 'version_to_concept' WHEN 'IsVariantFormOf' THEN 'variant_to_primary' WHEN 'IsPartOf' THEN CASE WHEN doc_type = 'dataset' AND rdoi IN (SELECT doi FROM sets) THEN 'package_piece' END END AS c FROM meta WHERE rdoi <> doi), sw AS (SELECT doi, min(struct_pack(c := c, t := rdoi)) AS m FROM f WHERE c IS NOT NULL GROUP BY 1),
ch AS (SELECT DISTINCT doi, {CHAPTER} AS t FROM s WHERE doc_type = 'book_chapter'), ap AS (SELECT DISTINCT a.doi FROM ch a JOIN ch b ON a.doi = b.doi AND a.t <> '' AND b.t <> '' AND NOT contains(a.t, b.t) AND NOT contains(b.t, a.t)),
g AS (SELECT s.doi, bool_or(coalesce(doc_type = 'book', false)) AS b, bool_or(coalesce(doc_type = 'book_chapter', false)) AS c FROM s GROUP BY 1),
k AS (SELECT g.doi, sw.m.t AS t, CASE WHEN sw.doi IS NOT NULL THEN sw.m.c WHEN b AND c THEN 'book_and_chapters' WHEN c AND NOT b AND ap.doi IS NOT NULL THEN 'chapters' END AS "case", sw.doi IS NOT NULL AS conv FROM g LEFT JOIN sw ON sw.doi = g.doi LEFT JOIN ap ON ap.doi = g.doi)
SELECT s.id, CASE WHEN conv THEN t END AS new_doi, k."case" FROM s JOIN k ON k.doi = s.doi WHERE k."case" IS NOT NULL AND (conv OR s.doc_type = 'book_chapter')""")
def e18(spark, d):
    r = _with_meta(spark, d)
    canonical = RU.same_work(r).withColumnRenamed("case", "same_work")
    return RU.correct_clusters(r.join(canonical, "doi", "left").select("id", "doi", "doc_type", "title_normalized", "canonical_doi", "same_work"))


DECLARED_SQL = f"""{META_SQL}, decl AS (SELECT DISTINCT publication_id AS source_id, d AS target_doi, CASE rt WHEN 'IsPartOf' THEN 'is_part_of' WHEN 'IsSupplementTo' THEN 'is_supplement_to' END AS type FROM (SELECT publication_id, rt, {DOI1.replace('doi,', 'rdoi,', 1)} AS d FROM meta WHERE publication_id IS NOT NULL AND rt IN ('IsPartOf', 'IsSupplementTo')) WHERE regexp_matches(d, '^10\\.\\d{{4,9}}/\\S+$'))"""


@query("E19_declared_relations", f"WITH {DECLARED_SQL} SELECT * FROM decl")
def e19(spark, d):
    return R.declared_relations(_with_meta(spark, d))


KEYS_SQL = r"""pk AS (SELECT DISTINCT * FROM (SELECT publication_id, 'hal_id' AS type, unnest(regexp_extract_all(lower(external_ids->>'$.hal_id'), '([a-z][a-z0-9]*-\d{8,})')) AS value FROM source_publications WHERE publication_id IS NOT NULL UNION ALL
SELECT publication_id, 'pmid', regexp_extract(trim(json_extract_string(external_ids, '$.pmid')), '(?i)^(?:https?://\S*?/|pmid:?\s*)?([1-9]\d*)/?$', 1) FROM source_publications WHERE publication_id IS NOT NULL UNION ALL
SELECT publication_id, 'arxiv_id', regexp_extract(lower(trim(json_extract_string(external_ids, '$.arxiv_id'))), '(?:arxiv:|/abs/|^)(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?$', 1) FROM source_publications WHERE publication_id IS NOT NULL UNION ALL
SELECT publication_id, 'nnt', regexp_extract(upper(trim(json_extract_string(external_ids, '$.nnt'))), '^[0-9A-Z]+$') FROM source_publications WHERE publication_id IS NOT NULL) WHERE value <> '')"""
SHARED_SQL = f"""{PUBS_SQL}, {KEYS_SQL}, pp AS (SELECT DISTINCT x.publication_id AS a, y.publication_id AS b FROM pk x JOIN pk y ON x.type = y.type AND x.value = y.value AND x.publication_id < y.publication_id),
sp AS (SELECT a, b, p.doc_type AS ta, q.doc_type AS tb FROM pp JOIN pubs p ON p.publication_id = a JOIN pubs q ON q.publication_id = b WHERE p.doi IS NOT NULL AND q.doi IS NOT NULL AND lower(p.doi) <> lower(q.doi) AND p.doc_type <> 'peer_review' AND q.doc_type <> 'peer_review'),
sk AS (SELECT a, b, CASE WHEN (ta = 'preprint') <> (tb = 'preprint') THEN 'is_preprint_of' WHEN (ta = 'erratum') <> (tb = 'erratum') THEN 'is_correction_of' WHEN (ta = 'dataset') <> (tb = 'dataset') THEN 'is_supplement_to' WHEN ta IN ('book', 'book_chapter') AND tb IN ('book', 'book_chapter') AND ta <> tb THEN 'is_part_of' ELSE 'is_related_to' END AS type,
CASE WHEN (ta = 'preprint') <> (tb = 'preprint') THEN tb = 'preprint' WHEN (ta = 'erratum') <> (tb = 'erratum') THEN tb = 'erratum' WHEN (ta = 'dataset') <> (tb = 'dataset') THEN tb = 'dataset' WHEN ta IN ('book', 'book_chapter') AND tb IN ('book', 'book_chapter') AND ta <> tb THEN tb = 'book_chapter' ELSE false END AS turn FROM sp),
shared AS (SELECT CASE WHEN turn THEN b ELSE a END AS source_id, CASE WHEN turn THEN a ELSE b END AS target_id, type FROM sk)"""


def _shared(spark, d, pubs):
    return R.shared_key_relations(pubs.select("publication_id", "doc_type", "doi"), R.publication_keys(T(spark, d, "source_publications")))


@query("E20_shared_key_relations", f"WITH {SHARED_SQL} SELECT * FROM shared")
def e20(spark, d):
    return _shared(spark, d, R.survivors(T(spark, d, "source_publications")))


ERRATA_SQL = """er AS (SELECT c.publication_id AS source_id, p.publication_id AS target_id FROM pubs c JOIN pubs p ON c.doc_type = 'erratum' AND p.doc_type <> 'erratum' AND p.publication_id <> c.publication_id AND length(p.title_normalized) > 30 AND p.pub_year BETWEEN c.pub_year - 2 AND c.pub_year AND ends_with(c.title_normalized, p.title_normalized) WHERE p.doc_type NOT IN ('preprint', 'dataset')),
pr AS (SELECT c.publication_id AS source_id, p.publication_id AS target_id FROM pubs c JOIN pubs p ON c.doc_type = 'preprint' AND p.doc_type NOT IN ('preprint', 'dataset') AND length(p.title_normalized) > 30 AND p.title_normalized = c.title_normalized AND p.pub_year BETWEEN c.pub_year AND c.pub_year + 2),
tit AS (SELECT source_id, min(target_id) AS target_id, 'is_correction_of' AS type FROM er GROUP BY 1 HAVING count(DISTINCT target_id) = 1 UNION ALL SELECT source_id, min(target_id), 'is_preprint_of' FROM pr GROUP BY 1 HAVING count(DISTINCT target_id) = 1)"""


@query("E21_title_relations", f"WITH {PUBS_SQL}, {ERRATA_SQL} SELECT * FROM tit")
def e21(spark, d):
    return R.title_relations(R.survivors(T(spark, d, "source_publications")))


RELATIONS_SQL = f"""{SHARED_SQL}, {ERRATA_SQL}, {DECLARED_SQL}, kn AS (SELECT lower(doi) AS target_doi, min(publication_id) AS target_id FROM pubs WHERE doi IS NOT NULL GROUP BY 1), d0 AS (SELECT source_id, target_id, decl.target_doi, type, 0 AS signal FROM decl LEFT JOIN kn ON kn.target_doi = decl.target_doi),
allr AS (SELECT * FROM d0 UNION ALL SELECT source_id, target_id, NULL, type, 1 FROM shared s WHERE type <> 'is_related_to' OR NOT EXISTS (SELECT 1 FROM d0 WHERE d0.target_id IS NOT NULL AND least(d0.source_id, d0.target_id) = least(s.source_id, s.target_id) AND greatest(d0.source_id, d0.target_id) = greatest(s.source_id, s.target_id)) UNION ALL SELECT source_id, target_id, NULL, type, 2 FROM tit),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, CASE WHEN target_id IS NULL THEN target_doi END ORDER BY signal, type, target_doi) AS rn FROM allr WHERE target_id IS NULL OR source_id <> target_id), rel AS (SELECT source_id, target_id, target_doi, type, signal::int AS signal FROM rk WHERE rn = 1)"""


def _relations(spark, d):
    pubs = R.survivors(T(spark, d, "source_publications"))
    return R.rebuild_relations(R.declared_relations(_with_meta(spark, d)), _shared(spark, d, pubs), R.title_relations(pubs), pubs)


@query("E22_relations", f"WITH {RELATIONS_SQL} SELECT * FROM rel")
def e22(spark, d):
    return _relations(spark, d)


DUPLICATES_SQL = f"""{PUBS_SQL}, dup AS (SELECT a.publication_id AS id_a, b.publication_id AS id_b FROM pubs a JOIN pubs b ON a.title_normalized = b.title_normalized AND a.publication_id < b.publication_id WHERE length(a.title_normalized) > 30 AND NOT coalesce(lower(a.doi) <> lower(b.doi) AND NOT (lower(a.doi) LIKE '10.5281/zenodo.%' AND lower(b.doi) LIKE '10.5281/zenodo.%'), false)
AND NOT (a.doc_type IN ('article', 'review') AND b.doc_type = 'conference_paper') AND NOT (b.doc_type IN ('article', 'review') AND a.doc_type = 'conference_paper') AND NOT list_has_any(list_intersect(a.sources, b.sources), ['hal', 'openalex', 'wos']))"""


@query("E34_duplicate_pairs", f"WITH {DUPLICATES_SQL} SELECT * FROM dup")
def e34(spark, d):
    return R.duplicate_pairs(R.survivors(T(spark, d, "source_publications")))


# --- texts -------------------------------------------------------------------------------------

def _forms(spark, d):
    j = T(spark, d, "addresses")
    town = F.regexp_extract("normalized_text", r"(?:universite|institut) (?:de )?([a-z]{5,})", 1)
    return j.select(town.alias("form")).where("form <> ''").distinct().withColumn("form_id", F.xxhash64("form"))


FORM_SQL = "f AS (SELECT DISTINCT regexp_extract(normalized_text, '(?:universite|institut) (?:de )?([a-z]{5,})', 1) AS form FROM addresses WHERE regexp_extract(normalized_text, '(?:universite|institut) (?:de )?([a-z]{5,})', 1) <> '')"


@query("J17_E8_matcher", f"WITH {FORM_SQL} SELECT a.id, f.form FROM addresses a JOIN f ON contains(' ' || a.normalized_text || ' ', ' ' || f.form || ' ')")
def e8(spark, d):
    f = _forms(spark, d)
    return MA.contained(T(spark, d, "addresses"), "id", "normalized_text", f, "form_id", "form").join(f, "form_id").select("id", "form")


def _matched(spark, d):
    """Forms in addresses; short ones must be whole words."""
    f = _forms(spark, d).withColumn("is_word_boundary", F.length("form") <= MA.SHORT)
    return MA.matched_forms(T(spark, d, "addresses"), "id", "normalized_text", f, "form_id", "form", "is_word_boundary")


@query("E8_matched_forms", f"WITH {FORM_SQL} SELECT a.id, f.form FROM addresses a JOIN f ON CASE WHEN length(f.form) <= 6 THEN contains(' ' || a.normalized_text || ' ', ' ' || f.form || ' ') ELSE contains(a.normalized_text, f.form) END")
def e8c(spark, d):
    return _matched(spark, d).join(_forms(spark, d), "form_id").select("id", "form")


@query("E8_structures", f"""WITH {FORM_SQL}, m AS (SELECT DISTINCT a.id, f.form FROM addresses a JOIN f ON CASE WHEN length(f.form) <= 6 THEN contains(' ' || a.normalized_text || ' ', ' ' || f.form || ' ') ELSE contains(a.normalized_text, f.form) END),
r AS (SELECT form, left(form, 2) AS s, length(form) % 7 = 0 AS x, length(form) % 5 = 0 AS site, length(form) % 3 = 0 AS need FROM f), h AS (SELECT m.id, r.* FROM m JOIN r ON r.form = m.form), o AS (SELECT DISTINCT id, s FROM h WHERE x), c AS (SELECT DISTINCT id FROM h WHERE s IN ('sa', 'le', 'mo', 'pa'))
SELECT id, s AS structure_id, min(form) AS form_id FROM h WHERE NOT x AND NOT site AND NOT EXISTS (SELECT 1 FROM o WHERE o.id = h.id AND o.s = h.s) AND (NOT need OR id IN (SELECT id FROM c)) GROUP BY 1, 2""")
def e8b(spark, d):
    """Structures by the first two letters of their forms; by their length forms exclude, belong to a site, or need a context."""
    n = F.length("form")
    f = _forms(spark, d)
    rules = f.select(
        F.col("form").alias("form_id"), F.left("form", F.lit(2)).alias("structure_id"), (n % 7 == 0).alias("is_excluding"), F.when(n % 3 == 0, F.array(*map(F.lit, ("sa", "le", "mo", "pa")))).alias("requires_context_of"),
        F.when(n % 5 == 0, "site").otherwise("lab").alias("structure_type"),
    )
    matched = _matched(spark, d).join(f, "form_id").select("id", F.col("form").alias("form_id"))
    return MA.match_structures(matched, rules, "id")


@query("E9_detection_delta", """WITH ok AS (SELECT x.address_id AS k, bool_or(coalesce(s.in_perimeter, false)) AS is_confirmed FROM source_authorship_addresses x LEFT JOIN source_authorships s ON s.id = x.source_authorship_id GROUP BY 1), n AS (SELECT id AS k FROM addresses WHERE countries_dirty)
SELECT coalesce(ok.k, n.k) AS k, CASE WHEN ok.k IS NULL THEN 'insert' WHEN n.k IS NOT NULL THEN 'keep' WHEN is_confirmed THEN 'unflag' ELSE 'delete' END AS action FROM ok FULL JOIN n ON ok.k = n.k""")
def e9b(spark, d):
    """The delta against all links; a detection is confirmed where a signature of it lies inside the perimeter."""
    s = T(spark, d, "source_authorships").select(F.col("id").alias("source_authorship_id"), "in_perimeter")
    o = T(spark, d, "source_authorship_addresses").join(s, "source_authorship_id", "left").groupBy(F.col("address_id").alias("k")).agg(F.bool_or(F.coalesce("in_perimeter", F.lit(False))).alias("is_confirmed"))
    return MA.delta(o, T(spark, d, "addresses").where("countries_dirty").select(F.col("id").alias("k")), ["k"])


COUNTRY = [("france", "FR"), ("fr", "FR"), ("germany", "DE"), ("spain", "ES"), ("cote d ivoire", "CI")]


@query("E10_trailing_country", "WITH n AS (SELECT * FROM (VALUES ('france','FR'), ('fr','FR'), ('germany','DE'), ('spain','ES'), ('cote d ivoire','CI')) t(name, code)) SELECT a.id, arg_max(code, length(name)) AS code FROM addresses a JOIN n ON a.normalized_text = name OR ends_with(a.normalized_text, ' ' || name) GROUP BY 1")
def e10(spark, d):
    return MA.trailing(T(spark, d, "addresses"), "id", "normalized_text", spark.createDataFrame(COUNTRY, "name string, code string"), "name", "code")


@query("E11_single_place", f"WITH {FORM_SQL}, p AS (SELECT form, CASE WHEN form < 'm' THEN 'A' ELSE 'B' END AS code FROM f), h AS (SELECT a.id, p.code FROM addresses a JOIN p ON contains(' ' || a.normalized_text || ' ', ' ' || p.form || ' ')) SELECT id, min(code) AS code FROM h GROUP BY 1 HAVING count(DISTINCT code) = 1")
def e11(spark, d):
    p = _forms(spark, d).select("form", F.when(F.col("form") < "m", "A").otherwise("B").alias("code"))
    return MA.single_place(T(spark, d, "addresses"), "id", "normalized_text", p, "form", "code")


@query("E12_suggest", f"""WITH {FORM_SQL}, pool AS (SELECT DISTINCT normalized_text AS t, countries FROM addresses WHERE len(countries) > 0), v AS (SELECT f.form, unnest(list_distinct(pool.countries)) AS c FROM f JOIN pool ON contains(' ' || pool.t || ' ', ' ' || f.form || ' ')),
n AS (SELECT form, c, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY form ORDER BY n DESC) AS k FROM n) SELECT form, list_sort(list(c)) AS "values", any_value(n) AS n FROM r WHERE k = 1 GROUP BY 1""")
def e12(spark, d):
    f = _forms(spark, d)
    pool = T(spark, d, "addresses").where("size(countries) > 0").select(F.col("normalized_text").alias("t"), "countries").distinct()
    return MA.suggest(f, "form_id", "form", pool, "t", "countries").join(f, "form_id").select("form", "values", "n")


@query("E13_country_propagation", """SELECT s.source_publication_id AS p, list_sort(list(DISTINCT c)) AS countries FROM (SELECT source_authorship_id AS sid, address_id FROM source_authorship_addresses) x JOIN (SELECT id, unnest(countries) AS c FROM addresses) a ON a.id = x.address_id JOIN source_authorships s ON s.id = x.sid GROUP BY 1""")
def e13(spark, d):
    x = T(spark, d, "source_authorship_addresses").select(F.col("source_authorship_id").alias("sid"), F.col("address_id").alias("aid"))
    s = T(spark, d, "source_authorships").select(F.col("id").alias("sid"), F.col("source_publication_id").alias("p"))
    return MA.propagate(x.join(s, "sid").select("aid", "p").distinct(), T(spark, d, "addresses").select(F.col("id").alias("aid"), "countries"), "aid", "p", "countries")


@query("E14_twins", """WITH h AS (SELECT normalized_text AS t, list_sort(list(DISTINCT c)) AS countries FROM (SELECT normalized_text, unnest(countries) AS c FROM addresses) GROUP BY 1) SELECT a.id, h.countries FROM addresses a JOIN h ON a.normalized_text = h.t WHERE coalesce(len(a.countries), 0) = 0""")
def e14(spark, d):
    return MA.twins(T(spark, d, "addresses"), "id", "normalized_text", "countries")


# --- persons -----------------------------------------------------------------------------------

def _signatures(spark, d):
    p = T(spark, d, "source_publications").select(F.col("id").alias("source_publication_id"), "publication_id")
    k = T(spark, d, "author_identifying_keys").select(F.col("id").alias("identity_id"), F.col("author_name_normalized").alias("name"), F.from_json("person_identifiers", "map<string,string>").alias("ids"))
    s = T(spark, d, "source_authorships").select("id", "source", "source_publication_id", "identity_id", "author_position", "person_id", "in_perimeter", "is_corresponding", "roles")
    return s.join(p, "source_publication_id").join(k, "identity_id", "left")


def _owners(spark, d, s):
    """The person of each ORCID and its name: the person's most frequent one."""
    from corvina.operators.aggregates import consensus

    top = consensus(s.where("person_id is not null"), ["person_id"], "name").select("person_id", N.parse_name(F.col("name")).alias("p"))
    known = s.where("person_id is not null").select(s["ids"]["orcid"].alias("value"), "person_id").where("value is not null").distinct()
    return known.join(top, "person_id", "left").select("value", "person_id", "p.last", "p.first")


@query("E23_cascade")
def e23(spark, d):
    """Every signature without a person: match, create or skip, with the reason; the test tables hold no HAL account or IdRef."""
    raw = T(spark, d, "source_authorships").select("id", F.col("raw_author_name").alias("raw_name"))
    s = _signatures(spark, d).join(raw, "id")
    none = F.lit(None).cast("string")
    sigs = s.select("id", "source", "publication_id", "author_position", "name", "raw_name", "in_perimeter", "roles", "person_id", s["ids"]["orcid"].alias("orcid"), none.alias("hal_person_id"), none.alias("idref"))
    return PE.match_persons(sigs, {"orcid": _owners(spark, d, s)}, T(spark, d, "person_name_forms"))


@query("E23_name_form_rung", """WITH f AS (SELECT DISTINCT name_form, person_id FROM person_name_forms WHERE status <> 'rejected'), c AS (SELECT DISTINCT k.id, f.person_id FROM author_identifying_keys k JOIN f ON k.author_name_normalized = f.name_form) SELECT id, min(person_id) AS person_id, 'name_form' AS rung FROM c GROUP BY 1 HAVING count(*) = 1""")
def e23b(spark, d):
    return PE.name_form_rung(T(spark, d, "author_identifying_keys"), "id", "author_name_normalized", T(spark, d, "person_name_forms"))


@query("E24_identifier_consensus", """WITH s AS (SELECT json_extract_string(k.person_identifiers, '$.orcid') AS orcid, a.person_id FROM source_authorships a JOIN author_identifying_keys k ON k.id = a.identity_id), n AS (SELECT orcid, person_id, count(*) AS n FROM s WHERE orcid IS NOT NULL AND person_id IS NOT NULL GROUP BY 1, 2)
SELECT 'orcid' AS kind, orcid AS value, person_id, n FROM (SELECT *, row_number() OVER (PARTITION BY orcid ORDER BY n DESC, person_id) AS k FROM n) WHERE k = 1""")
def e24(spark, d):
    s = _signatures(spark, d)
    return PE.identifier_consensus(s.select(F.lit("orcid").alias("kind"), s["ids"]["orcid"].alias("value"), "person_id"), "kind", "value")


@query("E25_ambiguous_forms", "SELECT name_form, list_sort(list(DISTINCT person_id)) AS persons FROM person_name_forms WHERE status <> 'rejected' AND person_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT person_id) >= 2")
def e25(spark, d):
    return PE.ambiguous_forms(T(spark, d, "person_name_forms"))


@query("E26_sync_forms", """WITH o AS (SELECT name_form, person_id, min(status) AS status FROM person_name_forms GROUP BY 1, 2), n AS (SELECT DISTINCT k.author_name_normalized AS name_form, a.person_id FROM source_authorships a JOIN author_identifying_keys k ON k.id = a.identity_id WHERE a.person_id IS NOT NULL AND k.author_name_normalized IS NOT NULL)
SELECT coalesce(o.name_form, n.name_form) AS name_form, coalesce(o.person_id, n.person_id) AS person_id, CASE WHEN o.status IS NULL THEN 'insert' WHEN n.name_form IS NOT NULL THEN 'keep' WHEN o.status = 'pending' THEN 'delete' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.name_form = n.name_form AND o.person_id = n.person_id""")
def e26(spark, d):
    new = _signatures(spark, d).where("person_id is not null and name is not null").select(F.col("name").alias("name_form"), "person_id")
    return PE.sync_forms(T(spark, d, "person_name_forms"), new)


@query("E27_authorships", f"""WITH s AS (SELECT a.*, p.publication_id, {RANK.replace('source', 'a.source')} AS r FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id WHERE a.person_id IS NOT NULL AND p.publication_id IS NOT NULL)
SELECT publication_id, person_id, first(author_position ORDER BY r, id) FILTER (author_position IS NOT NULL) AS author_position, bool_or(in_perimeter) AS in_perimeter, bool_or(is_corresponding) AS is_corresponding, list_sort(list_distinct(flatten(list(roles)))) AS roles, count(*) AS signatures FROM s GROUP BY 1, 2""")
def e27(spark, d):
    from corvina.operators.aggregates import rank_of

    return M.build_authorships(_signatures(spark, d), rank_of(F.col("source"), R.PRIORITY))


@query("E29_purge_orphans", "SELECT id FROM author_identifying_keys WHERE id IN (SELECT identity_id FROM source_authorships)")
def e29(spark, d):
    return M.purge_orphans(T(spark, d, "author_identifying_keys").select("id"), "id", T(spark, d, "source_authorships"), "identity_id")


@query("E30_dubious", """WITH s AS (SELECT a.source_publication_id AS record, json_extract_string(k.person_identifiers, '$.orcid') AS value FROM source_authorships a JOIN author_identifying_keys k ON k.id = a.identity_id) SELECT record, 'orcid' AS kind, value, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY 1, 3 HAVING count(*) >= 2""")
def e30(spark, d):
    s = _signatures(spark, d)
    return PE.dubious(s.select(F.col("source_publication_id").alias("record"), F.lit("orcid").alias("kind"), s["ids"]["orcid"].alias("value")), "record", "kind", "value")


@query("E30_marked_identifiers", """WITH s AS (SELECT a.id, a.source_publication_id AS record, k.person_identifiers AS j FROM source_authorships a JOIN author_identifying_keys k ON k.id = a.identity_id), e AS (SELECT id, record, unnest(json_keys(j)) AS k, j FROM s), v AS (SELECT id, record, k, json_extract_string(j, '$."' || k || '"') AS v FROM e),
n AS (SELECT record, k, v FROM v WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT id) >= 2) SELECT v.id, v.k || CASE WHEN n.record IS NOT NULL THEN '_dubious' ELSE '' END AS k, v.v FROM v LEFT JOIN n ON n.record = v.record AND n.k = v.k AND n.v = v.v WHERE v.v IS NOT NULL""")
def e30b(spark, d):
    """Identifiers of signatures, those that a record's authors share marked; one row an entry."""
    s = _signatures(spark, d)
    m = PE.mark_dubious(s.select("id", "source_publication_id", "ids"), "source_publication_id", "id", "ids")
    return m.select("id", F.explode("ids").alias("k", "v"))


@query("E29_purge_publications", """SELECT DISTINCT s.publication_id FROM source_publications s JOIN source_authorships a ON a.source_publication_id = s.id WHERE s.publication_id IS NOT NULL AND a.in_perimeter""")
def e29b(spark, d):
    """Publications that keep a signature inside the perimeter."""
    sp = T(spark, d, "source_publications").where("publication_id is not null")
    a = T(spark, d, "source_authorships").where("in_perimeter").select(F.col("source_publication_id").alias("id")).distinct()
    return M.purge_orphans(sp.select("publication_id").distinct(), "publication_id", sp.join(a, "id", "left_semi"), "publication_id")


@query("E32_address_dedupe", "SELECT md5(raw_text) AS h, min(id) AS id, count(*) AS n FROM addresses GROUP BY 1")
def e32(spark, d):
    return T(spark, d, "addresses").groupBy(F.md5("raw_text").alias("h")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


@query("E33_subjects", "SELECT lower(trim(s)) AS label, count(DISTINCT id) AS n FROM (SELECT id, unnest(from_json(json_extract(raw_data, '$.static_data.fullrecord_metadata.keywords.keyword'), '[\"VARCHAR\"]')) AS s FROM staging WHERE json_valid(raw_data) AND json_type(raw_data, '$.static_data.fullrecord_metadata.keywords.keyword') = 'ARRAY') GROUP BY 1")
def e33(spark, d):
    k = F.from_json(F.get_json_object("raw_data", "$.static_data.fullrecord_metadata.keywords.keyword"), "array<string>")
    # Payloads that are no complete JSON object are read by no one here; try_parse_json decides.
    s = T(spark, d, "staging").where(F.try_parse_json("raw_data").isNotNull()).select("id", F.explode(k).alias("s"))
    return s.groupBy(F.lower(F.trim("s")).alias("label")).agg(F.count_distinct("id").alias("n"))


PERSON_PAIRS_SQL = f"""nf AS (SELECT DISTINCT person_id, name_form AS n, {TOKENS.format('name_form')} AS t FROM person_name_forms WHERE person_id IS NOT NULL AND name_form IS NOT NULL),
dp AS (SELECT DISTINCT least(a.person_id, b.person_id) AS id_a, greatest(a.person_id, b.person_id) AS id_b FROM nf a JOIN nf b ON a.person_id <> b.person_id AND len(list_filter(list_intersect(a.t, b.t), lambda w: length(w) >= 2)) > 0 WHERE {FITS.format('a.t', 'b.t')})"""


@query("E35_duplicate_persons", f"WITH {PERSON_PAIRS_SQL} SELECT * FROM dp")
def e35(spark, d):
    return PE.duplicate_persons(T(spark, d, "person_name_forms").where("person_id is not null"), "person_id", "name_form")


@query("E35_ranked_duplicates")
def e35b(spark, d):
    """Pairs with the network they share; order by coauthors + shared_pubs, then journals, all descending."""
    s = _signatures(spark, d).where("person_id is not null and publication_id is not null").select("person_id", "publication_id").distinct()
    other = s.select("publication_id", F.col("person_id").alias("value"))
    journals = T(spark, d, "source_publications").select("publication_id", F.col("journal_id").alias("value"))
    links = {
        "coauthors": s.join(other, "publication_id").where("person_id <> value"),
        "shared_pubs": s.withColumnRenamed("publication_id", "value"),
        "journals": s.join(journals, "publication_id"),
    }
    return PE.rank_duplicates(e35(spark, d), links)


INTRUDERS_SQL = f"""WITH s AS (SELECT a.person_id, k.author_name_normalized AS name FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id JOIN author_identifying_keys k ON k.id = a.identity_id WHERE a.person_id IS NOT NULL AND k.author_name_normalized IS NOT NULL), n AS (SELECT person_id, name, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT person_id, name AS top FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, name) AS rn FROM n) WHERE rn = 1), q AS (SELECT n.person_id, n.name, {TOKENS.format('n.name')} AS a, {TOKENS.format('t.top')} AS b FROM n JOIN t ON t.person_id = n.person_id) SELECT person_id, name FROM q WHERE NOT {FITS.format('a', 'b')}"""


@query("E36_conflicts", """SELECT json_extract_string(k.person_identifiers, '$.orcid') AS orcid, list_sort(list(DISTINCT a.person_id)) AS persons, list_sort(list(DISTINCT k.author_name_normalized) FILTER (k.author_name_normalized IS NOT NULL)) AS names FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id JOIN author_identifying_keys k ON k.id = a.identity_id
WHERE a.person_id IS NOT NULL AND json_extract_string(k.person_identifiers, '$.orcid') IS NOT NULL GROUP BY 1 HAVING count(DISTINCT a.person_id) >= 2""")
def e36b(spark, d):
    s = _signatures(spark, d)
    return PE.identifier_conflicts(s.select(s["ids"]["orcid"].alias("orcid"), "person_id", "name"), "orcid", "name")


@query("E36_intruders", INTRUDERS_SQL)
def e36(spark, d):
    return PE.intruders(_signatures(spark, d), "person_id", "name")


@query("E37_repeated_doi", "SELECT lower(doi) AS doi, count(DISTINCT id) AS n FROM source_publications WHERE source = 'hal' AND doi LIKE '10.%/%' GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def e37(spark, d):
    return T(spark, d, "source_publications").where("source = 'hal' and doi like '10.%/%'").groupBy(F.lower("doi").alias("doi")).agg(F.count_distinct("id").alias("n")).where("n >= 2")


@query("E37_affiliation_conflicts", """WITH x AS (SELECT p.publication_id, s.author_position AS pos, bool_or(s.in_perimeter) AS a, bool_and(s.in_perimeter) AS b FROM source_authorships s JOIN source_publications p ON p.id = s.source_publication_id WHERE author_position IS NOT NULL AND publication_id IS NOT NULL GROUP BY 1, 2)
SELECT publication_id, pos FROM x WHERE a AND NOT b""")
def e37b(spark, d):
    s = _signatures(spark, d).where("author_position is not null and publication_id is not null")
    return s.groupBy("publication_id", F.col("author_position").alias("pos")).agg(F.bool_or("in_perimeter").alias("a"), F.bool_and("in_perimeter").alias("b")).where("a and not b").select("publication_id", "pos")


@query("E37_repeated_accounts", """SELECT a.person_id, list_sort(list(DISTINCT json_extract_string(k.person_identifiers, '$.researcher_id'))) AS accounts FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id JOIN author_identifying_keys k ON k.id = a.identity_id WHERE a.person_id IS NOT NULL AND json_extract_string(k.person_identifiers, '$.researcher_id') IS NOT NULL GROUP BY 1 HAVING count(DISTINCT json_extract_string(k.person_identifiers, '$.researcher_id')) >= 2""")
def e37c(spark, d):
    """Persons with two or more accounts; the test tables hold researcher ids only."""
    s = _signatures(spark, d)
    return PE.repeated_accounts(s.select("person_id", s["ids"]["researcher_id"].alias("account")), "account")


@query("E37_metadata_duplicates", f"""WITH {PUBS_SQL}, n AS (SELECT s.id, s.publication_id, count(a.id) AS n FROM source_publications s LEFT JOIN source_authorships a ON a.source_publication_id = s.id WHERE s.source = 'hal' AND s.publication_id IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT p.publication_id AS id_a, q.publication_id AS id_b FROM pubs p JOIN pubs q ON p.title_normalized = q.title_normalized AND p.publication_id < q.publication_id AND p.pub_year = q.pub_year AND p.doc_type = q.doc_type JOIN n x ON x.publication_id = p.publication_id JOIN n y ON y.publication_id = q.publication_id
WHERE length(p.title_normalized) > 30 AND NOT coalesce(lower(p.doi) <> lower(q.doi), false) AND abs(x.n - y.n) <= 2""")
def e37d(spark, d):
    """Publications with HAL records of the same title, year and type, no different DOIs, and about as many authors."""
    pubs = R.survivors(T(spark, d, "source_publications")).where(F.length("title_normalized") > R.TITLE_KEY).where("pub_year is not null")
    a = T(spark, d, "source_authorships").groupBy(F.col("source_publication_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = T(spark, d, "source_publications").where("source = 'hal' and publication_id is not null").select("id", "publication_id").join(a, "id", "left").select("publication_id", F.coalesce("n", F.lit(0)).alias("n")).distinct()
    p = pubs.join(n.select("publication_id").distinct(), "publication_id", "left_semi").select("publication_id", F.lower("doi").alias("doi"), F.xxhash64("title_normalized", "pub_year", "doc_type").alias("h"))
    pairs = G.class_pairs(p, "h", "publication_id").select("a", "b")
    side = lambda x: p.select(F.col("publication_id").alias(x), F.col("doi").alias(f"d{x}"))
    count = lambda x: n.select(F.col("publication_id").alias(x), F.col("n").alias(f"n{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").where(~F.coalesce(F.col("da") != F.col("db"), F.lit(False)))
    return j.join(count("a"), "a").join(count("b"), "b").where(F.abs(F.col("na") - F.col("nb")) <= 2).select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()


@query("E38_orphans", "SELECT id, raw_author_name FROM source_authorships WHERE in_perimeter AND person_id IS NULL AND raw_author_name IS NOT NULL AND trim(raw_author_name) <> ''")
def e38(spark, d):
    return PE.orphans(T(spark, d, "source_authorships")).select("id", "raw_author_name")


@query("E39_merge_repoint", """WITH m AS (SELECT name_form, min(person_id) AS new_id FROM person_name_forms WHERE status <> 'rejected' GROUP BY 1 HAVING count(DISTINCT person_id) >= 2), o AS (SELECT f.person_id AS old_id, min(m.new_id) AS new_id FROM person_name_forms f JOIN m ON m.name_form = f.name_form WHERE f.status <> 'rejected' GROUP BY 1)
SELECT DISTINCT a.source_publication_id, coalesce(o.new_id, a.person_id) AS person_id FROM source_authorships a LEFT JOIN o ON o.old_id = a.person_id WHERE a.person_id IS NOT NULL""")
def e39(spark, d):
    f = T(spark, d, "person_name_forms").where("status <> 'rejected'")
    m = f.groupBy("name_form").agg(F.min("person_id").alias("new_id"), F.count_distinct("person_id").alias("n")).where("n >= 2").select("name_form", "new_id")
    o = f.join(m, "name_form").groupBy(F.col("person_id").alias("old_id")).agg(F.min("new_id").alias("new_id"))
    return M.repoint(T(spark, d, "source_authorships").where("person_id is not null").select("source_publication_id", "person_id"), "person_id", o, ["source_publication_id", "person_id"])


@query("E39_merge_journals", """WITH m AS (SELECT j.id AS old_id, g.new_id FROM journals j JOIN (SELECT publisher_id, min(id) AS new_id FROM journals WHERE publisher_id IS NOT NULL GROUP BY 1) g ON g.publisher_id = j.publisher_id WHERE j.id <> g.new_id), x AS (SELECT coalesce(m.new_id, j.id) AS k, m.old_id IS NOT NULL AS moved, j.* FROM journals j LEFT JOIN m ON m.old_id = j.id)
SELECT k AS id, first(title ORDER BY moved, id) FILTER (title IS NOT NULL) AS title, first(issn ORDER BY moved, id) FILTER (issn IS NOT NULL) AS issn, first(oa_model ORDER BY moved, id) FILTER (oa_model IS NOT NULL) AS oa_model FROM x GROUP BY 1""")
def e39b(spark, d):
    """Journals of one publisher merged into the first: what the survivor lacks is taken from the others."""
    j = T(spark, d, "journals")
    g = j.where("publisher_id is not null").groupBy("publisher_id").agg(F.min("id").alias("new_id"))
    m = j.join(g, "publisher_id").where("id <> new_id").select(F.col("id").alias("old_id"), "new_id")
    return M.merge_rows(j.select("id", "title", "issn", "oa_model"), "id", m)


@query("E39_merge_publications", f"""WITH RECURSIVE {DUPLICATES_SQL}, de AS (SELECT id_a AS a, id_b AS b FROM dup UNION SELECT id_b, id_a FROM dup), dc(id, label) AS (SELECT a, a FROM de UNION SELECT de.b, dc.label FROM dc JOIN de ON de.a = dc.id), dm AS (SELECT id AS old_id, min(label) AS new_id FROM dc GROUP BY 1 HAVING min(label) <> id)
SELECT s.id, coalesce(dm.new_id, s.publication_id) AS publication_id FROM source_publications s LEFT JOIN dm ON dm.old_id = s.publication_id""")
def e39c(spark, d):
    """All groups of possible duplicates merged into their first publication: where each record then belongs."""
    sp = T(spark, d, "source_publications").select("id", "publication_id")
    pairs = e34(spark, d)
    m = G.connected_components(spark, pairs, "id_a", "id_b").where("node <> label").select(F.col("node").alias("old_id"), F.col("label").alias("new_id"))
    none = spark.createDataFrame([], "publication_id bigint, person_id bigint")
    return M.merge_publications(sp, none, spark.createDataFrame([], "id_a bigint, id_b bigint"), m)[0]


@query("E40_find_journal", """WITH l AS (SELECT title_normalized AS t, min(id) AS j FROM journals GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT v.id, coalesce(a.id, l.j) AS journal_id, CASE WHEN a.id IS NOT NULL THEN 'title' WHEN l.j IS NOT NULL THEN 'norm' END AS matched_by
FROM (SELECT id, journal_title AS title, trim(regexp_replace(lower(journal_title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM venue_mentions) v LEFT JOIN (SELECT title, min(id) AS id FROM journals GROUP BY 1 HAVING count(DISTINCT id) = 1) a ON a.title = v.title LEFT JOIN l ON l.t = v.norm""")
def e40(spark, d):
    j = T(spark, d, "journals")
    v = T(spark, d, "venue_mentions").select("id", F.col("journal_title").alias("title"), F.trim(F.regexp_replace(F.lower("journal_title"), "[^a-z0-9]+", " ")).alias("norm"))
    return M.find_journal(v, "id", [("title", j.select("title", F.col("id").alias("journal_id"))), ("norm", j.select(F.col("title_normalized").alias("norm"), F.col("id").alias("journal_id")))])


@query("E40_find_or_create", """WITH v AS (SELECT DISTINCT id AS rid, trim(journal_title) AS title, trim(regexp_replace(lower(journal_title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM venue_mentions WHERE trim(journal_title) <> ''), f AS (SELECT title_normalized AS norm, min(id) AS j FROM journals GROUP BY 1), a AS (SELECT v.rid, v.norm, f.j FROM v LEFT JOIN f ON f.norm = v.norm),
n AS (SELECT norm, row_number() OVER (ORDER BY min(rid)) + (SELECT max(id) FROM journals) AS j FROM a WHERE j IS NULL GROUP BY 1) SELECT a.rid, coalesce(a.j, n.j) AS journal_id, CASE WHEN a.j IS NOT NULL THEN 'name' ELSE 'created' END AS matched_by FROM a LEFT JOIN n ON n.norm = a.norm""")
def e40b(spark, d):
    """Journals of the mentions by name form; those unknown are created, one for each title."""
    j = T(spark, d, "journals").select("id", "title", F.lit(None).cast("string").alias("openalex_id"), "issn", F.lit(None).cast("string").alias("eissn"), F.lit(None).cast("string").alias("issnl"), "publisher_id")
    forms = T(spark, d, "journals").select(F.col("title_normalized").alias("norm"), "publisher_id", F.col("id").alias("journal_id"))
    v = T(spark, d, "venue_mentions").select(F.col("id").alias("rid"), F.col("journal_title").alias("title"), F.trim(F.regexp_replace(F.lower("journal_title"), "[^a-z0-9]+", " ")).alias("norm"), F.lit(None).cast("string").alias("openalex_id"), F.array().cast("array<string>").alias("issns"), F.lit(None).cast("bigint").alias("publisher_id"))
    return M.find_or_create_journals(v.distinct(), j, forms)[0]


@query("E41_oa_decision", """SELECT p.id, CASE WHEN f IS NULL OR coalesce(c = f OR (c = 'diamond' AND f = 'gold') OR (c = 'embargoed' AND f IN ('closed','unknown')) OR (dep AND f IN ('closed','unknown')), false) THEN c ELSE f END AS decided
FROM (SELECT p.id, p.oa_status AS c, q.o AS f, coalesce(p.source = 'hal' AND p.oa_status = 'green', false) AS dep FROM source_publications p LEFT JOIN (SELECT doi, min(oa_status) AS o FROM source_publications WHERE source = 'openalex' AND doi IS NOT NULL GROUP BY 1) q ON q.doi = p.doi) p""")
def e41(spark, d):
    sp = T(spark, d, "source_publications")
    q = sp.where("source = 'openalex' and doi is not null").groupBy("doi").agg(F.min("oa_status").alias("f"))
    deposit = F.col("source").isin(*V.ARCHIVES) & (F.col("oa_status") == "green")
    return sp.select("id", "doi", "source", "oa_status").join(q, "doi", "left").select("id", D.decide_oa(F.col("oa_status"), F.col("f"), deposit).alias("decided"))


@query("E42_dump_flags", "SELECT id, coalesce(issn IN (SELECT issn FROM journals WHERE oa_model = 'full_oa' AND issn IS NOT NULL), false) AS in_dump FROM journals")
def e42(spark, d):
    j = T(spark, d, "journals")
    return M.flag_from_dump(j.select("id", F.array_compact(F.array("issn")).alias("issns")), j.where("oa_model = 'full_oa' and issn is not null").select("issn"))


# --- staging and maintenance -------------------------------------------------------------------

@query("S7_to_fetch", """SELECT DISTINCT doi FROM source_publications WHERE doi LIKE '10.%' AND doi NOT IN (SELECT doi FROM staging WHERE doi IS NOT NULL) AND doi NOT IN (SELECT doi FROM staging WHERE doi IS NOT NULL AND not_found_at >= timestamp '2024-12-01')""")
def s7(spark, d):
    st = T(spark, d, "staging")
    return M.to_fetch(T(spark, d, "source_publications").where("doi like '10.%'"), st, st.select("doi", F.col("not_found_at").cast("date").alias("tried_at")).where("tried_at is not null"), F.lit("2024-12-31").cast("date"), 30)


@query("S9_staging_merge", """WITH o AS (SELECT source, source_id, doi, raw_hash, entry_mode FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY id) AS k FROM staging) WHERE k = 1), n AS (SELECT source, source_id, doi, raw_hash, entry_mode FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY id DESC) AS k FROM staging WHERE id % 3 > 0) WHERE k = 1)
SELECT source, source_id, coalesce(o.doi, n.doi) AS doi, CASE WHEN o.raw_hash IS DISTINCT FROM n.raw_hash AND n.source IS NOT NULL THEN n.raw_hash ELSE o.raw_hash END AS raw_hash, o.entry_mode, CASE WHEN n.source IS NULL THEN 'old' WHEN o.raw_hash IS NOT DISTINCT FROM n.raw_hash THEN 'same' ELSE 'update' END AS action FROM o LEFT JOIN n USING (source, source_id)""")
def s9(spark, d):
    from corvina.operators.aggregates import distinct_on

    st = T(spark, d, "staging").select("id", "source", "source_id", "doi", "raw_hash", "entry_mode")
    old = distinct_on(st, ["source", "source_id"], [F.col("id")]).drop("id")
    new = distinct_on(st.where("id % 3 > 0"), ["source", "source_id"], [-F.col("id")]).drop("id")
    return M.merge_staging(old, new, ["source", "source_id"], keep=("entry_mode",), fill=("doi",))


@query("S10_stale", "SELECT id FROM staging WHERE last_seen_at IS NULL OR last_seen_at < timestamp '2024-12-31' - INTERVAL 90 DAY")
def s10(spark, d):
    return M.stale(T(spark, d, "staging").select("id", "last_seen_at"), "last_seen_at", F.lit("2024-12-31").cast("date"), 90).select("id")


@query("S11_content_hash", "SELECT event_id, md5(props) AS h FROM (SELECT event_id, '{\"k\":\"' || (json_extract(props, '$.k')::bigint) || '\"}' AS props FROM events)")
def s11(spark, d):
    return T(spark, d, "events").select("event_id", M.content_hash(F.col("props")).alias("h"))


@query("S15_keyset_chunk", "SELECT id, normalized_text FROM addresses WHERE id > 100 ORDER BY id LIMIT 50")
def s15(spark, d):
    return T(spark, d, "addresses").where("id > 100").select("id", "normalized_text").orderBy("id").limit(50)


@query("S20_json_batch", """SELECT event_id, event_type, (json_extract(props, '$.k'))::int AS k FROM events""")
def s20(spark, d):
    batch = T(spark, d, "events").select(F.to_json(F.array(F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")))).alias("b"))
    return batch.select(F.inline(F.from_json("b", "array<struct<event_id:bigint,event_type:string,k:int>>")))


@query("M_changes", """SELECT count(*) FILTER (o.c_custkey IS NULL) AS inserted, count(*) FILTER (n.c_custkey IS NULL) AS deleted, count(*) FILTER (o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND o.c_mktsegment <> n.seg) AS updated, count(*) FILTER (o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND o.c_mktsegment = n.seg) AS unchanged
FROM (SELECT * FROM customer WHERE c_custkey % 10 > 0) o FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 > 0) n ON o.c_custkey = n.c_custkey""")
def m_changes(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 11 > 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return M.changes(c.where("c_custkey % 10 > 0"), new, ["c_custkey"])


@query("Z4_out_of_window", "SELECT id FROM source_publications WHERE pub_year < 2005 OR pub_year > 2022")
def z4(spark, d):
    return T(spark, d, "source_publications").where("pub_year < 2005 or pub_year > 2022").select("id")


@query("Z7_common_prefix", """WITH g AS (SELECT journal_id, min(doi) AS a, max(doi) AS b, count(DISTINCT doi) AS n FROM source_publications WHERE doi LIKE '10.%' AND journal_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doi) >= 2)
SELECT journal_id, a[1:len(list_filter(range(1, length(a) + 1), lambda i: i <= length(b) AND a[1:i] = b[1:i]))] AS prefix, n FROM g""")
def z7(spark, d):
    return M.longest_common_prefix(T(spark, d, "source_publications").where("doi like '10.%' and journal_id is not null"), "journal_id", "doi")


@query("Z8_bracketed_places", r"SELECT lower(p) AS place, count(DISTINCT id) AS n FROM (SELECT id, unnest(regexp_extract_all(full_address, '\(([^()]+)\)', 1)) AS p FROM addresses) GROUP BY 1")
def z8(spark, d):
    return T(spark, d, "addresses").select("id", F.explode(F.regexp_extract_all("full_address", F.lit(r"\(([^()]+)\)"), 1)).alias("p")).groupBy(F.lower("p").alias("place")).agg(F.count_distinct("id").alias("n"))


@query("Z9_repeated_person", "SELECT source_publication_id, person_id, count(*) AS n FROM source_authorships WHERE person_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def z9(spark, d):
    return PE.repeated_person(T(spark, d, "source_authorships"), "source_publication_id", "person_id")


@query("Z1_link_by_name", """WITH s AS (SELECT a.id, a.source, p.publication_id, a.author_position AS pos, k.author_name_normalized AS name, a.person_id FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id JOIN author_identifying_keys k ON k.id = a.identity_id WHERE p.publication_id IS NOT NULL AND a.author_position IS NOT NULL AND k.author_name_normalized IS NOT NULL)
SELECT o.id, min(h.person_id) AS person_id FROM s o JOIN s h ON h.publication_id = o.publication_id AND h.pos = o.pos AND h.name = o.name WHERE o.person_id IS NULL AND h.person_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT h.person_id) = 1""")
def z1(spark, d):
    """Orphan signatures linked to the only person of the same name at the same place of the publication."""
    s = _signatures(spark, d).where("publication_id is not null and author_position is not null and name is not null").select("id", "publication_id", "author_position", "name", "person_id")
    at = ["publication_id", "author_position", "name"]
    have = s.where("person_id is not null").select(*at, F.col("person_id").alias("p")).distinct()
    j = s.where("person_id is null").select("id", *at).join(have, at).select("id", F.col("p").alias("person_id"))
    return PE.unique_person(j, "id", "name").select("id", "person_id")


@query("Z2_homonyms_by_place", f"""WITH x AS (SELECT DISTINCT a.person_id, l.address_id FROM source_authorships a JOIN source_authorship_addresses l ON l.source_authorship_id = a.id WHERE a.person_id IS NOT NULL), {PERSON_PAIRS_SQL}
SELECT DISTINCT id_a, id_b FROM dp JOIN x a ON a.person_id = id_a JOIN x b ON b.person_id = id_b AND b.address_id = a.address_id""")
def z2(spark, d):
    """Persons with compatible names that signed from one address (laboratories are absent from the test tables)."""
    links = T(spark, d, "source_authorship_addresses").select(F.col("source_authorship_id").alias("id"), F.col("address_id").alias("value"))
    x = T(spark, d, "source_authorships").where("person_id is not null").select("id", "person_id").join(links, "id").select("person_id", "value").distinct()
    return PE.rank_duplicates(e35(spark, d), {"places": x}).where("places > 0").select("id_a", "id_b")


@query("Z3_merge_conflicts", f"""WITH {PERSON_PAIRS_SQL}, c AS (SELECT DISTINCT p.publication_id, a.author_position AS pos, a.person_id FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id WHERE a.person_id IS NOT NULL AND p.publication_id IS NOT NULL AND a.author_position IS NOT NULL)
SELECT DISTINCT id_a AS new_id, id_b AS old_id FROM dp JOIN c a ON a.person_id = id_a JOIN c b ON b.person_id = id_b AND a.publication_id = b.publication_id AND a.pos = b.pos""")
def z3(spark, d):
    """Persons with compatible names at one place of one publication: which is merged into which."""
    c = _signatures(spark, d).where("person_id is not null and publication_id is not null and author_position is not null")
    x = c.select("person_id", F.concat_ws("|", "publication_id", "author_position").alias("value")).distinct()
    return PE.rank_duplicates(e35(spark, d), {"places": x}).where("places > 0").select(F.col("id_a").alias("new_id"), F.col("id_b").alias("old_id"))


@query("Z4_idle_persons", "SELECT DISTINCT f.person_id FROM person_name_forms f WHERE f.person_id IS NOT NULL AND f.person_id NOT IN (SELECT person_id FROM source_authorships WHERE person_id IS NOT NULL)")
def z4b(spark, d):
    """Persons without a signature."""
    used = T(spark, d, "source_authorships").where("person_id is not null").select("person_id").distinct()
    return T(spark, d, "person_name_forms").where("person_id is not null").select("person_id").distinct().join(used, "person_id", "left_anti")


@query("Z5_redirty", "SELECT s.id, coalesce(s.keys_dirty, false) OR coalesce(j.journal_type = 'proceedings', false) AS keys_dirty FROM source_publications s LEFT JOIN journals j ON j.id = s.journal_id")
def z5(spark, d):
    """Records of journals of one type marked for another run."""
    j = T(spark, d, "journals").select(F.col("id").alias("journal_id"), "journal_type")
    sp = T(spark, d, "source_publications").select("id", "journal_id", "keys_dirty").join(j, "journal_id", "left")
    return sp.select("id", (F.coalesce("keys_dirty", F.lit(False)) | F.coalesce(F.col("journal_type") == "proceedings", F.lit(False))).alias("keys_dirty"))


@query("Z9_name_corroboration", f"""WITH t AS (SELECT a.id, a.person_id, {TOKENS.format('k.author_name_normalized')} AS x, k.author_name_normalized AS name FROM source_authorships a JOIN source_publications p ON p.id = a.source_publication_id JOIN author_identifying_keys k ON k.id = a.identity_id WHERE a.person_id IS NOT NULL AND k.author_name_normalized IS NOT NULL),
f AS (SELECT person_id, {TOKENS.format('name_form')} AS y FROM person_name_forms WHERE status <> 'rejected' AND person_id IS NOT NULL), ok AS (SELECT DISTINCT t.id FROM t JOIN f ON f.person_id = t.person_id WHERE {FITS.format('t.x', 'f.y')}), kn AS (SELECT DISTINCT person_id FROM f)
SELECT t.person_id, count(*) AS signatures, count(*) FILTER (t.id NOT IN (SELECT id FROM ok)) AS doubtful FROM t JOIN kn ON kn.person_id = t.person_id GROUP BY 1""")
def z9b(spark, d):
    """For each person with curated names the signatures that none of them fits."""
    t = _signatures(spark, d).where("person_id is not null and name is not null").select("id", "person_id", N.name_tokens(F.col("name")).alias("x"))
    f = T(spark, d, "person_name_forms").where("status <> 'rejected' and person_id is not null").select("person_id", N.name_tokens(F.col("name_form")).alias("y")).distinct()
    j = t.join(f, "person_id").groupBy("person_id", "id").agg(F.bool_or(N.compatible(F.col("x"), F.col("y"))).alias("ok"))
    return j.groupBy("person_id").agg(F.count(F.lit(1)).alias("signatures"), F.count(F.when(~F.col("ok"), 1)).alias("doubtful"))


@query("Z10_backfill_dois", f"""WITH c AS (SELECT id, doi, {DOI1} AS d FROM source_publications), q AS (SELECT id, doi, CASE WHEN regexp_matches(d, '^10\\.\\d{{4,9}}/\\S+$') THEN d END AS clean FROM c) SELECT id, doi AS old, clean AS new FROM q WHERE doi IS DISTINCT FROM clean""")
def z10(spark, d):
    """Records whose DOI a repeated normalisation would change; after it there are none."""
    sp = T(spark, d, "source_publications").select("id", F.col("doi").alias("old"), I.clean_doi(F.col("doi")).alias("new"))
    return sp.where(~F.col("old").eqNullSafe(F.col("new")))
