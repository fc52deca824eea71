"""The declarative correction rules: a rule set compiles to one CASE chain a field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.domain import chapter_title
from corvina.operators.graph import lookup


@dataclass(frozen=True)
class Rule:
    """``when`` is a SQL predicate over the record; the first rule of a ``field`` that holds sets ``value``."""

    name: str
    field: str
    when: str
    value: str


# The conditions below and their order.
AO = "doc_type in ('article', 'other')"
ARO = "doc_type in ('article', 'review', 'other')"
T = "lower(title_normalized)"
#: The order counts: the first rule that holds wins, field by field.
RULES = (
    Rule("thesis_by_url", "doc_type", "exists(urls, u -> contains(u, 'theses.fr/')) and journal_id is null", "thesis"),
    Rule("memoir_by_url", "doc_type", "exists(urls, u -> contains(u, 'dumas.ccsd')) and journal_id is null", "memoir"),
    Rule("thesis_in_journal", "doc_type", "doc_type in ('thesis', 'ongoing_thesis', 'memoir') and journal_id is not null and doi is not null and not startswith(doi, '10.70675/')", "article"),
    Rule("journal_media", "doc_type", "journal_type = 'media'", "media"),
    Rule("journal_proceedings", "doc_type", "journal_type = 'proceedings' and doc_type in ('article', 'book_chapter')", "conference_paper"),
    Rule("journal_preprints", "doc_type", f"journal_type = 'preprint_server' and {AO}", "preprint"),
    Rule("declared_preprint", "doc_type", "self_declared_preprint", "preprint"),
    Rule("title_media", "doc_type", f"{AO} and rlike({T}, '^(interview|reportage|podcast)')", "media"),
    Rule("figshare_collection", "doc_type", f"{AO} and contains(doi, 'm9.figshare.c.')", "dataset"),
    Rule("title_supplement", "doc_type", f"{AO} and rlike({T}, '^(additional file|supplementary material|supplementary data|supplementary information|supplementary file|supplementary dataset|data from)')", "dataset"),
    Rule("title_erratum", "doc_type", f"doc_type in ('article', 'preprint', 'review', 'conference_paper', 'data_paper', 'letter', 'other') and rlike({T}, '^(erratum|errata|corrigendum|author correction|publisher correction)')", "erratum"),
    Rule("title_retraction", "doc_type", f"{AO} and rlike({T}, '^retraction (notice|note)')", "retraction"),
    Rule("title_editorial", "doc_type", AO + r" and rlike(title, '(?i)^\\s*editorial\\s*:')", "editorial"),
    Rule("title_letter", "doc_type", AO + r" and rlike(title, '(?i)^\\s*letter\\s*:')", "letter"),
    Rule("title_systematic", "doc_type", r"doc_type = 'article' and rlike(title, '(?i)(^|:\\s*)(a\\s+)?systematic reviews?\\b')", "review"),
    Rule("title_isbn", "doc_type", ARO + r" and rlike(title, '(?i)\\bisbn\\b|\\b97[89][-\\s0-9]{10,17}\\b')", "book_review"),
    Rule("title_year_pages", "doc_type", ARO + r" and rlike(title, '(?i)(19|20)\\d{2}[\\s,.]+\\d{1,4}\\s*(pp|pages?|p)\\.?\\s*$')", "book_review"),
    Rule("title_recension", "doc_type", r"doc_type in ('article', 'review', 'other', 'preprint') and rlike(title, '(?i)^\\s*(recension|comptes?\\s+rendus?\\s*:)')", "book_review"),
    Rule("embargo_over", "oa_status", "oa_status = 'embargoed' and embargo_until <= today", "green"),
    Rule("hybrid_full_oa", "oa_status", "oa_status = 'hybrid' and oa_model = 'full_oa'", "gold"),
)
#: Facts a rule may read, with the value that stands in where a table lacks them.
FACTS = {
    "title": "string", "title_normalized": "string", "doc_type": "string", "doi": "string", "journal_id": "bigint", "oa_status": "string", "urls": "array<string>",
    "journal_type": "string", "oa_model": "string", "embargo_until": "date", "today": "date", "self_declared_preprint": "boolean",
}


def correct(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with corrected fields, ``raw_<field>`` beside each and ``corrected_by`` (field to rule).

    Idempotent: a second run reads the raw values of the first. Missing facts are null.
    """
    fields = list(dict.fromkeys(r.field for r in rules))
    for f in fields:
        if f"raw_{f}" in df.columns:
            df = df.withColumn(f, F.col(f"raw_{f}")).drop(f"raw_{f}")
    df = df.drop("corrected_by")
    extra = [f for f in FACTS if f not in df.columns]
    full = df.withColumns({f: F.lit(None).cast(FACTS[f]) for f in extra})
    names, values = {}, {}
    for f in fields:
        name, value = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
        for r in (r for r in rules if r.field == f):
            name, value = name.when(F.expr(r.when), F.lit(r.name)), value.when(F.expr(r.when), F.lit(r.value))
        names[f], values[f] = name, value
    full = full.withColumns({f"__n_{f}": names[f] for f in fields} | {f"__v_{f}": values[f] for f in fields})
    full = full.withColumns({f"raw_{f}": F.col(f) for f in fields})
    full = full.withColumns({f: F.coalesce(F.col(f"__v_{f}"), F.col(f"raw_{f}")) for f in fields})
    entries = F.array_compact(F.array(*[F.when(F.col(f"__n_{f}").isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"__n_{f}").alias("value"))) for f in fields]))
    full = full.withColumn("corrected_by", F.map_from_entries(entries))
    return full.drop(*extra, *[f"__n_{f}" for f in fields], *[f"__v_{f}" for f in fields])


def strip_dissertation_keys(ids: Column) -> Column:
    """Deposit ids without those of thesis and memoir collections; an empty list becomes null."""
    kept = F.filter(ids, lambda x: ~x.rlike(r"^(tel|dumas)-"))
    return F.when(F.size(kept) > 0, kept)


def same_work(records: DataFrame) -> DataFrame:
    """(doi, canonical_doi, case): what a secondary form of a work is declared to be a form of.

    ``records``: source, doi, doc_type, meta. A version or variant (datacite) is a form of what it names; a
    part of a dataset is a piece of it if that is known as a dataset. A form names something else than itself;
    of several the smallest counts.
    """
    r = records.where("source = 'datacite' and doi is not null").select(F.lower("doi").alias("doi"), "doc_type", F.explode(F.from_json(F.get_json_object("meta", "$.related_identifiers"), "array<struct<doi:string,relation_type:string>>")).alias("r"))
    r = r.select("doi", "doc_type", F.lower("r.doi").alias("canonical_doi"), F.col("r.relation_type").alias("t")).where("canonical_doi <> doi")
    sets = records.where("doc_type = 'dataset' and doi is not null").select(F.lower("doi").alias("canonical_doi")).distinct()
    form = F.when(F.col("t") == "IsVersionOf", "version_to_concept").when(F.col("t") == "IsVariantFormOf", "variant_to_primary")
    forms = r.withColumn("case", form).where("case is not null").select("doi", "canonical_doi", "case")
    pieces = r.where("doc_type = 'dataset' and t = 'IsPartOf'").join(sets, "canonical_doi", "left_semi").select("doi", "canonical_doi", F.lit("package_piece").alias("case"))
    return forms.unionByName(pieces).groupBy("doi").agg(F.min(F.struct("case", "canonical_doi")).alias("m")).select("doi", "m.canonical_doi", "m.case")


def correct_clusters(df: DataFrame) -> DataFrame:
    """(id, new_doi, case) of the records whose DOI is decided by the records that share it.

    A canonical DOI that a record of the group declares is taken by all; else, beside a book, chapters lose
    theirs; else chapters alone with two really different titles all lose it. Titles are cleaned of numbers
    and part words, and are really different if neither contains the other. Titles that contain each other
    form a chain by length, so neighbours decide and no pairs are listed.
    ``df``: id, doi, doc_type, title_normalized, canonical_doi, same_work (both nullable).
    """
    d = df.where("doi is not null").select("id", "doi", "doc_type", "canonical_doi", "same_work", chapter_title(F.col("title_normalized")).alias("t"))
    is_chapter = F.coalesce(F.col("doc_type") == "book_chapter", F.lit(False))
    declared = F.when(F.col("canonical_doi").isNotNull(), F.col("id"))
    g = d.groupBy("doi").agg(F.min_by(F.struct("canonical_doi", "same_work"), declared).alias("c"), F.bool_or(F.coalesce(F.col("doc_type") == "book", F.lit(False))).alias("book"), F.bool_or(is_chapter).alias("chapter"))
    titles = d.where(is_chapter & (F.col("t") != "")).select("doi", "t").distinct()
    before = F.lag("t").over(Window.partitionBy("doi").orderBy(F.length("t"), "t"))
    apart = titles.withColumn("before", before).where("before is not null and not contains(t, before)").select("doi").distinct().withColumn("apart", F.lit(True))
    case = (
        F.when(F.col("c.same_work").isNotNull(), F.col("c.same_work")).when(F.col("book") & F.col("chapter"), "book_and_chapters")
        .when(F.col("chapter") & ~F.col("book") & F.coalesce("apart", F.lit(False)), "chapters")
    )
    g = g.join(apart, "doi", "left").select("doi", F.col("c.canonical_doi").alias("target"), F.col("c.same_work").isNotNull().alias("converges"), case.alias("case")).where("case is not null")
    hit = lookup(d.select("id", "doi", is_chapter.alias("is_chapter")), g, "doi").where("case is not null and (converges or is_chapter)")
    return hit.select("id", F.when(F.col("converges"), F.col("target")).alias("new_doi"), "case")
