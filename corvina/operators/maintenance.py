"""Incremental maintenance as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.operators.aggregates import first_by_priority


def content_hash(c: Column) -> Column:
    """md5 of a JSON text in canonical form (keys sorted, no blanks), so equal contents have equal hashes."""
    return F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>"))))))


def merge_staging(old: DataFrame, new: DataFrame, keys: list[str], hashed: str = "raw_hash", keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """The staging snapshot after an upsert, with ``action`` (insert, update, same, old).

    A row is rewritten only if its hash differs; ``keep`` columns stay as first seen, ``fill`` columns are
    taken from the new row only where they were null.
    """
    cols = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*cols).alias("o"))
    n = new.select(*keys, F.struct(*cols).alias("n"))
    j = o.join(n, keys, "full")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "old").when(F.col(f"o.{hashed}").eqNullSafe(F.col(f"n.{hashed}")), "same").otherwise("update")

    def value(c: str) -> Column:
        if c in keep:
            return F.when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c in fill:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(F.col("action").isin("insert", "update"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    j = j.withColumn("action", action)
    return j.select(*keys, *[value(c).alias(c) for c in cols], "action")


def stale(df: DataFrame, seen: str, today: Column, days: int) -> DataFrame:
    """Rows not seen for ``days`` days, or never."""
    return df.where(F.col(seen).isNull() | (F.col(seen) < F.date_sub(today, days)))


def to_fetch(candidates: DataFrame, have: DataFrame, tried: DataFrame, today: Column, retry_days: int) -> DataFrame:
    """Keys known elsewhere that a target lacks and that weren't tried within ``retry_days``. ``tried``: doi, tried_at."""
    recent = tried.where(F.col("tried_at") >= F.date_sub(today, retry_days)).select("doi")
    return candidates.where("doi is not null").select("doi").distinct().join(have.where("doi is not null").select("doi"), "doi", "left_anti").join(recent, "doi", "left_anti")


def build_authorships(sigs: DataFrame, priority: Column) -> DataFrame:
    """One authorship for each (publication, person), rebuilt whole: a rerun or an incremental run gives the same.

    ``sigs``: publication_id, person_id, id, author_position, in_perimeter, is_corresponding, roles.
    """
    s = sigs.where("publication_id is not null and person_id is not null")
    return s.groupBy("publication_id", "person_id").agg(
        first_by_priority(F.col("author_position"), priority, F.col("id")).alias("author_position"), F.bool_or("in_perimeter").alias("in_perimeter"),
        F.bool_or("is_corresponding").alias("is_corresponding"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"), F.count(F.lit(1)).alias("signatures"),
    )


def purge_orphans(parents: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """The parents that still have a child."""
    return parents.join(children.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias(key)).distinct(), key, "left_semi")


def repoint(df: DataFrame, column: str, mapping: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """``column`` moved from merged ids to their survivors (mapping: old_id, new_id); repeated rows by ``unique`` are merged."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    out = df.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)
    return out.dropDuplicates(unique) if unique else out


def repoint_pairs(pairs: DataFrame, a: str, b: str, mapping: DataFrame) -> DataFrame:
    """Unordered pairs after a merge: both ends moved, the smaller first, pairs of one entity and repeated ones gone."""
    p = repoint(repoint(pairs.select(a, b), a, mapping), b, mapping).where(F.col(a) != F.col(b))
    return p.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def merge_rows(df: DataFrame, key: str, mapping: DataFrame, any_of: tuple[str, ...] = ()) -> DataFrame:
    """Entities after a merge: a survivor keeps its values and takes what it lacks from those merged into it, the smallest id first.

    Columns of ``any_of`` are true if any of the rows is. ``mapping``: old_id, new_id; chains must be resolved before.
    """
    m = mapping.select(F.col("old_id").alias(key), F.col("new_id").alias("__new"))
    d = df.join(m, key, "left").withColumn("__own", F.col("__new").isNotNull().cast("int"))
    order = F.struct("__own", F.col(key))
    cols = [c for c in df.columns if c != key]
    aggs = [F.max(c).alias(c) if c in any_of else F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    return d.groupBy(F.coalesce("__new", key).alias("__k")).agg(*aggs).select(F.col("__k").alias(key), *cols)


def merge_publications(sp: DataFrame, authorships: DataFrame, apart: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, authorships and distinct pairs after publications were merged; the survivor's authorship of a person is kept.

    The publications themselves are aggregated anew from their records.
    """
    m = mapping.select(F.col("old_id").alias("publication_id"), F.lit(1).alias("__moved"))
    a = repoint(authorships.join(m, "publication_id", "left").withColumn("__m", F.coalesce("__moved", F.lit(0))).drop("__moved"), "publication_id", mapping)
    rest = [c for c in authorships.columns if c not in ("publication_id", "person_id")]
    one = a.where("person_id is not null").groupBy("publication_id", "person_id").agg(F.min_by(F.struct(*rest), "__m").alias("r")).select("publication_id", "person_id", "r.*") if rest else a.select("publication_id", "person_id").distinct()
    whole = one.unionByName(a.where("person_id is null").drop("__m").select(*one.columns)) if rest else one
    return repoint(sp, "publication_id", mapping), whole.select(*authorships.columns), repoint_pairs(apart, "id_a", "id_b", mapping)


def find_journal(records: DataFrame, rid: str, by: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rid, journal_id, matched_by): the first lookup, in order, that knows the record's key. Lookups: key column, journal_id (unambiguous keys only)."""
    out, hits = records, []
    for i, (key, look) in enumerate(by):
        one = look.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("journal_id").alias("__n"), F.min("journal_id").alias(f"__j{i}")).where("__n = 1").drop("__n")
        out = out.join(one, key, "left")
        hits.append((f"__j{i}", key))
    matched = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for c, k in hits])
    return out.select(rid, F.coalesce(*[F.col(c) for c, _ in hits]).alias("journal_id"), matched.alias("matched_by"))


def find_or_create_journals(records: DataFrame, journals: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, journals, forms) after records looked for their journal; null and blank titles have none.

    A record is known by its id in a catalogue, else by one of its ISSNs in any ISSN column of a journal,
    in the order given, else by its title among the name forms (of its publisher first, then of any). What is
    found takes the record's values where its own are null; what is not is created, one for each title and
    publisher, numbered after the last. Titles matched by another key become name forms.
    ``records``: rid, title, norm, openalex_id, issns (array), publisher_id; ``journals``: id, title, openalex_id, issn, eissn, issnl,
    publisher_id; ``forms``: norm, publisher_id, journal_id. Assigned: rid, journal_id, matched_by.
    """
    r = records.where("title is not null and trim(title) <> ''")
    smallest = lambda df, k: df.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("journal_id").alias("journal_id"))
    by_id = smallest(journals.select("openalex_id", F.col("id").alias("journal_id")), "openalex_id").withColumnRenamed("journal_id", "j1")
    codes = smallest(journals.select(F.explode(F.array_compact(F.array("issn", "eissn", "issnl"))).alias("code"), F.col("id").alias("journal_id")), "code")
    seen = r.select("rid", F.posexplode("issns").alias("p", "code")).join(codes, "code").groupBy("rid").agg(F.min_by("journal_id", "p").alias("j2"))
    own = forms.groupBy("norm", "publisher_id").agg(F.min("journal_id").alias("j3"))
    anyone = forms.groupBy("norm").agg(F.min("journal_id").alias("j4"))
    j = r.join(by_id, "openalex_id", "left").join(seen, "rid", "left").join(own, ["norm", "publisher_id"], "left").join(anyone, "norm", "left")
    j = j.withColumn("found", F.coalesce("j1", "j2", "j3", "j4"))
    how = F.when(F.col("j1").isNotNull(), "openalex_id").when(F.col("j2").isNotNull(), "issn").when(F.col("found").isNotNull(), "name").otherwise("created")
    last = journals.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    fresh = j.where("found is null").groupBy("norm", "publisher_id").agg(
        F.min_by(F.trim("title"), "rid").alias("title"), F.min("openalex_id").alias("openalex_id"), F.min_by("issns", F.when(F.size("issns") > 0, F.col("rid"))).alias("issns"), F.min("rid").alias("first")
    )
    number = F.row_number().over(Window.orderBy("first"))  # only journals that are new, at most a few per run
    fresh = fresh.withColumn("id", number).crossJoin(F.broadcast(last)).withColumn("id", (F.col("id") + F.col("last")).cast("bigint"))
    new = fresh.select("norm", F.coalesce("publisher_id", F.lit(-1)).alias("__p"), F.col("id").alias("made"))
    assigned = j.withColumn("__p", F.coalesce("publisher_id", F.lit(-1))).join(new, ["norm", "__p"], "left").select("rid", "norm", "title", "publisher_id", "openalex_id", "issns", F.coalesce("found", "made").alias("journal_id"), how.alias("matched_by"))
    facts = assigned.where("matched_by <> 'created'").groupBy(F.col("journal_id").alias("id")).agg(
        F.min_by("openalex_id", F.when(F.col("openalex_id").isNotNull() & (F.col("matched_by") != "openalex_id"), F.col("rid"))).alias("f1"),
        F.min_by(F.get("issns", 0), F.when(F.size("issns") > 0, F.col("rid"))).alias("f2"), F.min_by("publisher_id", F.when(F.col("publisher_id").isNotNull(), F.col("rid"))).alias("f3"),
    )
    richer = journals.join(facts, "id", "left").withColumn("openalex_id", F.coalesce("openalex_id", "f1")).withColumn("issn", F.coalesce("issn", "f2")).withColumn("publisher_id", F.coalesce("publisher_id", "f3")).select(*journals.columns)
    made = fresh.select("id", "title", "openalex_id", F.get("issns", 0).alias("issn"), F.get("issns", 1).alias("eissn"), F.lit(None).cast("string").alias("issnl"), "publisher_id")
    learnt = forms.unionByName(assigned.where("matched_by <> 'name'").select("norm", "publisher_id", "journal_id")).distinct()
    return assigned.select("rid", "journal_id", "matched_by"), richer.unionByName(made, allowMissingColumns=True), learnt


def flag_from_dump(journals: DataFrame, dump: DataFrame) -> DataFrame:
    """(id, in_dump): journals one of whose ISSNs stands in the dump. ``journals``: id, issns; ``dump``: issn."""
    hit = journals.select("id", F.explode("issns").alias("issn")).join(dump.select("issn").distinct(), "issn", "left_semi").select("id").distinct().withColumn("__h", F.lit(True))
    return journals.select("id").join(hit, "id", "left").select("id", F.coalesce("__h", F.lit(False)).alias("in_dump"))


def refresh_from_dump(journals: DataFrame, dump: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """(id, in_dump, facts) after a whole dump was read: all flags and facts are set anew.

    An ISSN that several journals have means the one with the smallest id. Of the dump's rows that mean one
    journal the first counts; a row means the journal of its first known ISSN.
    ``journals``: id, issns; ``dump``: row, issns and the facts.
    """
    index = journals.select("id", F.explode("issns").alias("issn")).where("issn is not null").groupBy("issn").agg(F.min("id").alias("id"))
    d = dump.select("row", F.posexplode("issns").alias("p", "issn")).join(index, "issn").groupBy("row").agg(F.min_by("id", "p").alias("id"))
    first = d.groupBy("id").agg(F.min("row").alias("row")).join(dump.select("row", *facts), "row").drop("row").withColumn("__h", F.lit(True))
    return journals.select("id").join(first, "id", "left").select("id", F.coalesce("__h", F.lit(False)).alias("in_dump"), *facts)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M: counts of inserted, updated, deleted and unchanged rows between two snapshots."""
    cols = [c for c in old.columns if c not in keys]
    j = old.select(*keys, F.struct(*cols).alias("o"), F.lit(1).alias("__o")).join(new.select(*keys, F.struct(*cols).alias("n"), F.lit(1).alias("__n")), keys, "full")
    w = lambda c, a: F.count(F.when(c, 1)).alias(a)
    both = F.col("__o").isNotNull() & F.col("__n").isNotNull()
    return j.agg(w(F.col("__o").isNull(), "inserted"), w(F.col("__n").isNull(), "deleted"), w(both & ~F.col("o").eqNullSafe(F.col("n")), "updated"), w(both & F.col("o").eqNullSafe(F.col("n")), "unchanged"))


def longest_common_prefix(df: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(key, prefix, n): the longest common beginning of a group's texts is that of its smallest and largest."""
    g = df.where(F.col(text).isNotNull()).groupBy(key).agg(F.min(text).alias("a"), F.max(text).alias("b"), F.count_distinct(text).alias("n")).where(F.col("n") >= least)
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda i: (F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)) & (i <= F.length("b"))))
    return g.select(key, F.substring("a", F.lit(1), n).alias("prefix"), "n")
