"""Queries of the read models, exports, per-source normalisers and the stream twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.operators import aggregates as A
from corvina.operators import filters as P
from corvina.operators import resolution as R
from corvina.session import table as T
from corvina.plans.resolving import DUPLICATES_SQL, _relations
from corvina.sources import normalize as NZ
from corvina.sources.io import csv_rows, mark_done
from corvina.streaming.staging import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("Q1_publication_list", """WITH s AS (SELECT publication_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, min(title) AS title, max(pub_year) AS year, count(*) AS n FROM source_publications WHERE publication_id IS NOT NULL GROUP BY 1)
SELECT * FROM s ORDER BY year DESC NULLS LAST, publication_id LIMIT 50""")
def q1(spark, d):
    s = T(spark, d, "source_publications").where("publication_id is not null").groupBy("publication_id").agg(A.joined_set(F.col("source")).alias("sources"), F.min("title").alias("title"), F.max("pub_year").alias("year"), F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.desc_nulls_last("year"), "publication_id").limit(50)


@query("Q2_publication_detail", """SELECT p.id, p.title, j.title AS journal, u.name AS publisher, split_part(p.doi, '/', 1) AS prefix, (SELECT count(*) FROM source_authorships a WHERE a.source_publication_id = p.id) AS authors FROM source_publications p LEFT JOIN journals j ON j.id = p.journal_id LEFT JOIN publishers u ON u.id = j.publisher_id""")
def q2(spark, d):
    j = T(spark, d, "journals").select(F.col("id").alias("journal_id"), F.col("title").alias("journal"), "publisher_id")
    u = T(spark, d, "publishers").select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher"))
    n = T(spark, d, "source_authorships").groupBy(F.col("source_publication_id").alias("id")).agg(F.count(F.lit(1)).alias("authors"))
    p = T(spark, d, "source_publications").select("id", "title", "journal_id", F.split_part("doi", F.lit("/"), F.lit(1)).alias("prefix"))
    return p.join(j, "journal_id", "left").join(u, "publisher_id", "left").join(n, "id", "left").select("id", "title", "journal", "publisher", "prefix", F.coalesce("authors", F.lit(0)).alias("authors"))


@query("Q2_signatures_with_addresses", """SELECT s.id, count(DISTINCT x.address_id) AS n, list_sort(list(DISTINCT x.address_id)) AS addresses FROM source_authorships s JOIN source_authorship_addresses x ON x.source_authorship_id = s.id GROUP BY 1""")
def q2b(spark, d):
    x = T(spark, d, "source_authorship_addresses").select(F.col("source_authorship_id").alias("id"), "address_id")
    return T(spark, d, "source_authorships").select("id").join(x, "id").groupBy("id").agg(F.count_distinct("address_id").alias("n"), A.sorted_set(F.col("address_id")).alias("addresses"))


@query("Q3_relations_both_ways")
def q3(spark, d):
    return R.both_ways(_relations(spark, d).where("target_id is not null"))


@query("Q4_external_ids", """WITH k AS (SELECT publication_id, unnest(['pmid','nnt']) AS kind, external_ids, source FROM source_publications WHERE publication_id IS NOT NULL), v AS (SELECT publication_id, kind, json_extract_string(external_ids, '$.' || kind) AS value, source FROM k)
SELECT DISTINCT publication_id, kind, value FROM v WHERE value IS NOT NULL AND value <> '' AND NOT (kind = 'nnt' AND publication_id IN (SELECT publication_id FROM source_publications WHERE source = 'theses' AND publication_id IS NOT NULL))""")
def q4(spark, d):
    sp = T(spark, d, "source_publications").where("publication_id is not null").select("publication_id", "source", "external_ids")
    m = F.from_json("external_ids", "map<string,string>")
    v = sp.select("publication_id", F.explode(F.array(F.struct(F.lit("pmid").alias("kind"), m["pmid"].alias("value")), F.struct(F.lit("nnt").alias("kind"), m["nnt"].alias("value")))).alias("s")).select("publication_id", "s.*").where("value is not null and value <> ''").distinct()
    theses = sp.where("source = 'theses'").select("publication_id").distinct().withColumn("kind", F.lit("nnt"))
    return v.join(theses, ["publication_id", "kind"], "left_anti")


@query("Q5_subjects", """WITH w AS (SELECT publication_id, source, unnest(string_split(title_normalized, ' ')) AS s FROM source_publications WHERE publication_id IS NOT NULL AND title_normalized IS NOT NULL) SELECT publication_id, s AS subject, list_sort(list(DISTINCT source)) AS sources FROM w WHERE length(s) > 6 GROUP BY 1, 2""")
def q5(spark, d):
    w = T(spark, d, "source_publications").where("publication_id is not null and title_normalized is not null").select("publication_id", "source", F.explode(F.split("title_normalized", " ")).alias("subject"))
    return w.where("length(subject) > 6").groupBy("publication_id", "subject").agg(A.sorted_set(F.col("source")).alias("sources"))


@query("Q6_next_duplicate", f"WITH {DUPLICATES_SQL} SELECT * FROM dup ORDER BY 1, 2 LIMIT 1 OFFSET 5")
def q6(spark, d):
    return R.duplicate_pairs(R.survivors(T(spark, d, "source_publications"))).orderBy("id_a", "id_b").offset(5).limit(1)


@query("Q7_autocomplete", "SELECT DISTINCT name_form FROM person_name_forms WHERE contains(name_form, 'mar') AND contains(name_form, 'de') ORDER BY 1 LIMIT 20")
def q7(spark, d):
    f = T(spark, d, "person_name_forms").select("name_form").distinct()
    return P.fold(f, [P.search("q", F.col("name_form"), "mar de")]).orderBy("name_form").limit(20)


@query("Q8_person_list", """SELECT person_id, count(*) AS signatures, count(DISTINCT source_publication_id) AS records, bool_or(in_perimeter) AS inside FROM source_authorships WHERE person_id IS NOT NULL GROUP BY 1 ORDER BY records DESC, person_id LIMIT 50""")
def q8(spark, d):
    return T(spark, d, "source_authorships").where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("signatures"), F.count_distinct("source_publication_id").alias("records"), F.bool_or("in_perimeter").alias("inside")).orderBy(F.desc("records"), "person_id").limit(50)


@query("Q9_name_forms", """WITH f AS (SELECT name_form, person_id, min(status) AS status FROM person_name_forms GROUP BY 1, 2) SELECT person_id, name_form, status, count(*) OVER (PARTITION BY name_form) AS shared, count(*) OVER (PARTITION BY name_form) > 1 AS ambiguous FROM f""")
def q9(spark, d):
    f = T(spark, d, "person_name_forms").groupBy("name_form", "person_id").agg(F.min("status").alias("status"))
    n = f.groupBy("name_form").agg(F.count(F.lit(1)).alias("shared"))
    return f.join(n, "name_form").select("person_id", "name_form", "status", "shared", (F.col("shared") > 1).alias("ambiguous"))


@query("Q10_person_profile", "SELECT person_id, min(raw_author_name) FILTER (source = 'hal') AS hal_name, max(raw_author_name) FILTER (source = 'openalex') AS openalex_name, min(created_at) AS first_seen FROM source_authorships WHERE person_id IS NOT NULL GROUP BY 1")
def q10(spark, d):
    n = lambda s: F.when(F.col("source") == s, F.col("raw_author_name"))
    return T(spark, d, "source_authorships").where("person_id is not null").groupBy("person_id").agg(F.min(n("hal")).alias("hal_name"), F.max(n("openalex")).alias("openalex_name"), F.min("created_at").alias("first_seen"))


@query("Q11_theses_by_role", """SELECT CASE WHEN list_contains(roles, 'author') THEN 'author' WHEN list_contains(roles, 'thesis_director') THEN 'director' ELSE 'jury' END AS role, count(DISTINCT source_publication_id) AS n FROM source_authorships WHERE source = 'theses' AND roles IS NOT NULL GROUP BY 1""")
def q11(spark, d):
    r = F.when(F.array_contains("roles", "author"), "author").when(F.array_contains("roles", "thesis_director"), "director").otherwise("jury")
    return T(spark, d, "source_authorships").where("source = 'theses' and roles is not null").groupBy(r.alias("role")).agg(F.count_distinct("source_publication_id").alias("n"))


@query("Q12_person_addresses", "SELECT s.person_id, count(DISTINCT x.address_id) AS addresses FROM source_authorships s JOIN source_authorship_addresses x ON x.source_authorship_id = s.id WHERE s.person_id IS NOT NULL GROUP BY 1")
def q12(spark, d):
    x = T(spark, d, "source_authorship_addresses").select(F.col("source_authorship_id").alias("id"), "address_id")
    return T(spark, d, "source_authorships").where("person_id is not null").select("id", "person_id").join(x, "id").groupBy("person_id").agg(F.count_distinct("address_id").alias("addresses"))


@query("Q13_person_identifiers", "SELECT s.person_id, list_sort(list(DISTINCT json_extract_string(k.person_identifiers, '$.orcid'))) AS orcids FROM source_authorships s JOIN author_identifying_keys k ON k.id = s.identity_id WHERE s.person_id IS NOT NULL AND json_extract_string(k.person_identifiers, '$.orcid') IS NOT NULL GROUP BY 1")
def q13(spark, d):
    k = T(spark, d, "author_identifying_keys").select(F.col("id").alias("identity_id"), F.get_json_object("person_identifiers", "$.orcid").alias("o")).where("o is not null")
    return T(spark, d, "source_authorships").where("person_id is not null").select("person_id", "identity_id").join(k, "identity_id").groupBy("person_id").agg(A.sorted_set(F.col("o")).alias("orcids"))


@query("Q14_person_stats", "SELECT count(DISTINCT person_id) AS persons, count(*) FILTER (person_id IS NULL) AS orphan_signatures, count(*) FILTER (in_perimeter) AS inside FROM source_authorships")
def q14(spark, d):
    return T(spark, d, "source_authorships").agg(F.count_distinct("person_id").alias("persons"), F.count(F.when(F.col("person_id").isNull(), 1)).alias("orphan_signatures"), F.count(F.when(F.col("in_perimeter"), 1)).alias("inside"))


@query("Q15_form_authorships", "SELECT f.name_form, count(DISTINCT a.id) AS n FROM (SELECT DISTINCT name_form FROM person_name_forms) f JOIN author_identifying_keys k ON k.author_name_normalized = f.name_form JOIN source_authorships a ON a.identity_id = k.id GROUP BY 1")
def q15(spark, d):
    f = T(spark, d, "person_name_forms").select("name_form").distinct()
    k = T(spark, d, "author_identifying_keys").select(F.col("id").alias("identity_id"), F.col("author_name_normalized").alias("name_form"))
    return T(spark, d, "source_authorships").select("id", "identity_id").join(k, "identity_id").join(f, "name_form").groupBy("name_form").agg(F.count_distinct("id").alias("n"))


@query("Q16_structures", "SELECT n_regionkey, r_name, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS members FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def q16(spark, d):
    r = T(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return T(spark, d, "nation").join(r, "n_regionkey").groupBy("n_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"), A.joined_set(F.col("n_name")).alias("members"))


@query("Q17_structure_detail", "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def q17(spark, d):
    c = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = T(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return T(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("Q18_neighbours", """WITH d AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem), p AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM d a JOIN d b ON a.g = b.g AND a.i <> b.i GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a AS item, b AS neighbour, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p) WHERE k <= 5""")
def q18(spark, d):
    p = A.co_occurrence(T(spark, d, "lineitem"), "l_suppkey", "l_orderkey")
    both = p.select(F.col("a").alias("item"), F.col("b").alias("neighbour"), "n").unionByName(p.select(F.col("b").alias("item"), F.col("a").alias("neighbour"), "n"))
    return A.top_n(both, ["item"], [F.desc("n"), F.col("neighbour")], 5).drop("rn")


@query("Q19_address_publications", "SELECT x.address_id, count(DISTINCT p.publication_id) AS publications FROM source_authorship_addresses x JOIN source_authorships s ON s.id = x.source_authorship_id JOIN source_publications p ON p.id = s.source_publication_id GROUP BY 1")
def q19(spark, d):
    x = T(spark, d, "source_authorship_addresses").select(F.col("source_authorship_id").alias("sid"), "address_id")
    s = T(spark, d, "source_authorships").select(F.col("id").alias("sid"), F.col("source_publication_id").alias("pid"))
    p = T(spark, d, "source_publications").select(F.col("id").alias("pid"), "publication_id")
    return x.join(s, "sid").join(p, "pid").groupBy("address_id").agg(F.count_distinct("publication_id").alias("publications"))


@query("Q20_feedback_page", "SELECT id, raw_author_name FROM source_authorships WHERE in_perimeter AND coalesce(is_corresponding, false) = false ORDER BY id LIMIT 50 OFFSET 100")
def q20(spark, d):
    return T(spark, d, "source_authorships").where(F.col("in_perimeter") & ~F.coalesce("is_corresponding", F.lit(False))).select("id", "raw_author_name").orderBy("id").offset(100).limit(50)


@query("Q21_publishers", "SELECT u.id, u.name, count(j.id) AS journals FROM publishers u LEFT JOIN journals j ON j.publisher_id = u.id GROUP BY 1, 2 ORDER BY journals DESC, u.id LIMIT 30")
def q21(spark, d):
    n = T(spark, d, "journals").groupBy(F.col("publisher_id").alias("id")).agg(F.count(F.lit(1)).alias("journals"))
    return T(spark, d, "publishers").select("id", "name").join(n, "id", "left").fillna(0, ["journals"]).orderBy(F.desc("journals"), "id").limit(30)


@query("Q22_runs", "SELECT entry_mode, count(*) AS rows, min(imported_at) AS first, max(imported_at) AS last, count(*) FILTER (processed) AS done FROM staging GROUP BY 1")
def q22(spark, d):
    return T(spark, d, "staging").groupBy("entry_mode").agg(F.count(F.lit(1)).alias("rows"), F.min("imported_at").alias("first"), F.max("imported_at").alias("last"), F.count(F.when(F.col("processed"), 1)).alias("done"))


@query("Q23_labels", "SELECT 'journal' AS kind, id, title AS label FROM journals UNION ALL SELECT 'publisher', id, name FROM publishers")
def q23(spark, d):
    j = T(spark, d, "journals").select(F.lit("journal").alias("kind"), "id", F.col("title").alias("label"))
    return j.unionByName(T(spark, d, "publishers").select(F.lit("publisher").alias("kind"), "id", F.col("name").alias("label")))


@query("Q24_years", "SELECT DISTINCT pub_year FROM source_publications WHERE pub_year IS NOT NULL ORDER BY 1 DESC")
def q24(spark, d):
    return T(spark, d, "source_publications").where("pub_year is not null").select("pub_year").distinct().orderBy(F.desc("pub_year"))


@query("S17_mark_done", "SELECT id, processed OR id % 2 = 0 AS processed, CASE WHEN id % 2 = 0 THEN '{}' ELSE raw_data END AS raw_data FROM staging")
def s17(spark, d):
    st = T(spark, d, "staging")
    return mark_done(st, st.where("id % 2 = 0")).select("id", "processed", "raw_data")


@query("S18_export", """SELECT p.id AS "Id", trim(regexp_replace(regexp_replace(p.title, '</?[A-Za-z][^>]*>', ' ', 'g'), '[\\s\\x{00A0}\\x{202F}\\x{2009}\\x{3000}\\x{2003}]+', ' ', 'g')) AS "Title", array_to_string(r.sources, '; ') AS "Sources" FROM source_publications p LEFT JOIN (SELECT publication_id, list_sort(list(DISTINCT source)) AS sources FROM source_publications WHERE publication_id IS NOT NULL GROUP BY 1) r ON r.publication_id = p.publication_id""")
def s18(spark, d):
    sp = T(spark, d, "source_publications")
    r = sp.where("publication_id is not null").groupBy("publication_id").agg(A.sorted_set(F.col("source")).alias("sources"))
    return csv_rows(sp.select("id", "title", "publication_id").join(r, "publication_id", "left"), {"Id": F.col("id"), "Title": F.col("title"), "Sources": F.col("sources")})


@query("S19_export_theses", "SELECT id, title_normalized AS title, pub_year AS year FROM source_publications WHERE doc_type = 'thesis'")
def s19(spark, d):
    sp = T(spark, d, "source_publications").where("doc_type = 'thesis'")
    return csv_rows(sp, {"id": F.col("id"), "title": F.col("title_normalized"), "year": F.col("pub_year")})


RECORDS = ("id", "source", "source_id", "doi", "title", "pub_year", "doc_type", "oa_status", "language", "container_title", "publisher")


@query("E31_normalize_openalex", """WITH p AS (SELECT id, raw_data AS r FROM staging WHERE source = 'openalex' AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT') SELECT id, regexp_extract(r ->> '$.id', '[^/]*$') AS source_id, coalesce(nullif(trim(r ->> '$.title'), ''), nullif(trim(r ->> '$.display_name'), '')) AS title, try_cast(r ->> '$.publication_year' AS int) AS pub_year, coalesce((r ->> '$.is_retracted')::boolean, false) AS is_retracted
FROM p WHERE r ->> '$.id' IS NOT NULL""")
def e31(spark, d):
    r = NZ.normalise(T(spark, d, "staging"), ["openalex"], F.lit("2025-01-01").cast("date"))
    return r.select("id", "source_id", "title", "pub_year", "is_retracted")


@query("E31_openalex_locations", """WITH p AS (SELECT id, raw_data AS r FROM staging WHERE source = 'openalex' AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT' AND raw_data ->> '$.id' IS NOT NULL), l AS (SELECT id, unnest(CASE json_type(r, '$.locations') WHEN 'ARRAY' THEN from_json(json_extract(r, '$.locations'), '["JSON"]') WHEN 'OBJECT' THEN [json_extract(r, '$.locations')] ELSE [] END) AS x FROM p),
u AS (SELECT DISTINCT id, unnest([x ->> '$.landing_page_url', x ->> '$.pdf_url']) AS url FROM l WHERE json_type(x) = 'OBJECT') SELECT id, url FROM u WHERE url <> ''""")
def e31c(spark, d):
    """The pages and files of all locations, one row each."""
    r = NZ.normalise(T(spark, d, "staging"), ["openalex"], F.lit("2025-01-01").cast("date"))
    return r.select("id", F.explode("urls").alias("url"))


WOS_SQL = """p AS (SELECT id, doi, raw_data AS r FROM staging WHERE source = 'wos' AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT' AND nullif(trim(raw_data ->> '$.UID'), '') IS NOT NULL), tt AS (SELECT id, unnest(CASE json_type(r, '$.static_data.summary.titles.title') WHEN 'ARRAY' THEN from_json(json_extract(r, '$.static_data.summary.titles.title'), '["JSON"]') WHEN 'OBJECT' THEN [json_extract(r, '$.static_data.summary.titles.title')] ELSE [] END) AS x, generate_subscripts(CASE json_type(r, '$.static_data.summary.titles.title') WHEN 'ARRAY' THEN from_json(json_extract(r, '$.static_data.summary.titles.title'), '["JSON"]') ELSE [json_extract(r, '$.static_data.summary.titles.title')] END, 1) AS n FROM p),
ti AS (SELECT id, arg_min(coalesce(x ->> '$.content', ''), n) FILTER (x ->> '$.type' = 'item') AS item, arg_min(coalesce(x ->> '$.content', ''), n) FILTER (x ->> '$.type' = 'source') AS src FROM tt GROUP BY 1)"""


@query("E31_normalize_wos", f"""WITH {WOS_SQL} SELECT p.id, trim(r ->> '$.UID') AS source_id, coalesce(nullif(trim(item), ''), '(sans titre)') AS title, nullif(trim(src), '') AS container_title, try_cast(trim(r ->> '$.static_data.summary.pub_info.pubyear') AS int) AS pub_year FROM p LEFT JOIN ti ON ti.id = p.id""")
def e31b(spark, d):
    r = NZ.normalise(T(spark, d, "staging"), ["wos"], F.lit("2025-01-01").cast("date"))
    return r.select("id", "source_id", "title", "container_title", "pub_year")


@query("E31_wos_authors")
def e31d(spark, d):
    """Authors of wos payloads with their addresses, one row each."""
    r = NZ.normalise(T(spark, d, "staging"), ["wos"], F.lit("2025-01-01").cast("date"))
    return r.select("id", F.explode("authors").alias("a")).select("id", "a.position", "a.raw_name", "a.roles", "a.is_corresponding", F.map_keys("a.ids").alias("id_kinds"), "a.addresses")


@query("E33_normalised_subjects")
def e33b(spark, d):
    """Subjects of all normalised payloads with their use."""
    s = NZ.subjects(NZ.normalise(T(spark, d, "staging"), ["openalex", "wos"], F.lit("2025-01-01").cast("date")))
    return s.groupBy("label").agg(F.count_distinct("id").alias("n"))


@query("T_windowed_counts", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2")
def t_windows(spark, d):
    """The batch run of the streaming aggregate; a stream adds only the watermark."""
    w = windowed_counts(T(spark, d, "events").select("ts", "event_type", "value"))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))
