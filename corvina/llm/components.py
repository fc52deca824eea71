"""Problem 1: consolidating pairwise matches into groups.

Every identifier becomes star edges between the records that carry it; minimum labels are propagated
across the edges and the label forest is shortened by pointer jumping (``operators.graph``), each round
written to the shared scratch folder, until no label changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.graph import connected_components, lookup, star_edges
from corvina.session import Cut, table

# --- identifiers -------------------------------------------------------------------------------

# What stands for no identifier after a registrant.
NO_SUFFIX = ("", "0", "unknown", "none", "null", "n/a", "na", "nan", "-", "xxx", "xxxx", "inconnu", "undefined", "test", "tbd", "tba")


def doi_key(c: Column) -> Column:
    """A DOI in one spelling, null if the value identifies nothing.

    Case, blanks, URL or ``doi:`` forms, percent-encoded slash, query strings and trailing
    punctuation do not matter. The registrant must not be all zeros, and the suffix must not be a word
    that stands for none.
    """
    s = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    s = F.replace(s, F.lit("%2f"), F.lit("/"))
    s = F.regexp_replace(s, r"^.*?(?=10\.\d)", "")
    s = F.regexp_replace(s, r"[?#].*$", "")
    s = F.regexp_replace(s, r"[.,;/)\]]+$", "")
    suffix = F.regexp_replace(s, r"^10\.\d{4,9}(?:\.\d+)*/*", "")
    return F.when(s.rlike(r"^10\.(?!0+(/|$))\d{4}") & ~suffix.isin(*NO_SUFFIX), s)


def external_tokens(c: Column) -> Column:
    """array<string> of ``type:value`` tokens (nnt, pmid, every hal deposit) of an ``external_ids`` JSON text.

    Lists, single texts and numbers are read alike; versions, URL and OAI forms of a deposit give
    one token; empty, zero or unreadable values give none. ``arxiv_id`` and ``related_dois`` are not read.
    """
    m = F.from_json(c, "map<string,string>")
    hal = F.array_distinct(
        F.regexp_extract_all(F.lower(m["hal_id"]), F.lit(r"([a-z][a-z0-9]*-(?=\d*[1-9])\d{6,})"), 1)
    )
    pmid = F.regexp_extract(F.regexp_replace(m["pmid"], r"(?U)\s+", ""), r"(?:^|[^\d.])0*([1-9]\d*)(?=\D*$)", 1)
    nnt = F.regexp_extract(F.upper(F.regexp_replace(m["nnt"], r"(?U)\s+", "")), r"((?:19|20)\d{2}[A-Z0-9]{4}[A-Z0-9]+)", 1)
    one = lambda kind, v: F.when(v != "", F.concat(F.lit(kind), v))
    return F.array_compact(
        F.concat(
            F.coalesce(F.transform(hal, lambda x: F.concat(F.lit("hal:"), x)), F.array().cast("array<string>")),
            F.array(one("pmid:", pmid), one("nnt:", nnt)),
        )
    )


def record_tokens(sp: DataFrame) -> DataFrame:
    """(id, token): every key by which a record of ``source_publications`` can be the same item as another."""
    doi = doi_key(F.col("doi"))
    pub = F.when(F.col("publication_id").isNotNull(), F.concat(F.lit("pub:"), F.col("publication_id").cast("string")))
    keys = F.array_compact(
        F.concat(F.array(pub, F.concat(F.lit("doi:"), doi)), external_tokens(F.col("external_ids")))
    )
    return sp.select("id", F.explode(F.array_distinct(keys)).alias("token"))


def publication_groups(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(sp_id, group_id) of every record whose group has two or more records (p1_found)."""
    edges = star_edges(record_tokens(sp), "id", "token")
    return connected_components(spark, edges).select(
        F.col("node").alias("sp_id"), F.col("label").alias("group_id")
    )


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return publication_groups(spark, table(spark, base, "source_publications"))


def p1_groups(spark: SparkSession, base: str) -> DataFrame:
    """One row for every record: (sp_id, group_id, group_size); a record without a match is its own group."""
    sp = table(spark, base, "source_publications")
    g = publication_groups(spark, sp)
    out = sp.select(F.col("id").alias("sp_id")).distinct().join(g, "sp_id", "left")
    out = Cut(spark)(out.select("sp_id", F.coalesce("group_id", "sp_id").alias("group_id")))
    sizes = out.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return lookup(out, sizes, "group_id").select("sp_id", "group_id", "group_size")
