"""Dictionary matching of texts: n-gram equi-joins instead of a nested loop of LIKE.

Texts are normalised ([a-z0-9 ]); a whole-word form of n words can only be one of the text's n-grams, so
both sides meet by equality. Forms that may stand within a word are met by letter n-grams (``matched_forms``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.aggregates import modes

#: Forms of up to this many letters must be whole words.
SHORT = 6
#: Letters of the window of a form that a text must hold before the form is looked for in it.
GRAM = 8


def word_ngrams(c: Column, n: Column | int) -> Column:
    """All runs of ``n`` words, distinct."""
    n = F.lit(n) if isinstance(n, int) else n
    w = F.split(c, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))


def contained(texts: DataFrame, tid: str, text: str, forms: DataFrame, fid: str, form: str) -> DataFrame:
    """(tid, fid) of every form that stands, as whole words, in a text. Empty and null sides match nothing."""
    f = forms.where(F.col(form).isNotNull() & (F.col(form) != "")).select(fid, F.col(form).alias("__g"), F.size(F.split(form, " ")).alias("__n"))
    lengths = f.agg(F.collect_set("__n").alias("__l"))  # the few lengths of forms, one row
    t = texts.where(F.col(text).isNotNull()).crossJoin(F.broadcast(lengths))
    grams = t.select(tid, F.explode(F.array_distinct(F.flatten(F.transform("__l", lambda n: word_ngrams(F.col(text), n))))).alias("__g"))
    return grams.join(f, "__g").select(tid, fid).distinct()


def matched_forms(texts: DataFrame, tid: str, text: str, forms: DataFrame, fid: str, form: str, boundary: str) -> DataFrame:
    """(tid, fid) of every form a text holds; a form with ``boundary`` true must stand there as whole words.

    Forms without it are met by runs of letters: of a form's windows of ``GRAM`` letters (the whole form, if
    shorter) the one that the fewest texts hold is its key, then the whole form is looked for. Texts are
    distinct before they meet.
    """
    f = forms.where(F.col(form).isNotNull() & (F.col(form) != ""))
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    free = f.where(~F.coalesce(boundary, F.lit(False))).select(fid, F.col(form).alias("__f"), F.least(F.length(form), F.lit(GRAM)).alias("__n"))
    lengths = free.agg(F.collect_set("__n").alias("__l"))  # at most GRAM numbers, one row
    t = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("__t")).distinct().crossJoin(F.broadcast(lengths))
    grams = t.select("__t", F.explode(F.array_distinct(F.flatten(F.transform("__l", lambda n: runs(F.col("__t"), n))))).alias("__g"))
    windows = free.select("__f", F.explode(runs(F.col("__f"), F.col("__n"))).alias("__g")).distinct()
    counts = grams.join(windows.select("__g").distinct(), "__g", "left_semi").groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    rarest = windows.join(counts, "__g").groupBy("__f").agg(F.min_by("__g", F.struct("__c", "__g")).alias("__g"))
    hit = grams.join(rarest, "__g").where(F.contains("__t", "__f")).select("__t", "__f").join(free.select("__f", fid), "__f")
    within = texts.select(tid, F.col(text).alias("__t")).join(hit, "__t").select(tid, fid)
    return contained(texts, tid, text, f.where(F.col(boundary)), fid, form).unionByName(within).distinct()


def match_structures(matched: DataFrame, forms: DataFrame, tid: str) -> DataFrame:
    """(tid, structure_id, form_id): one row for each recognised structure, by its first form.

    ``matched``: tid, form_id. ``forms``: form_id, structure_id, is_excluding, requires_context_of
    (array of structures), structure_type. A structure with a matched excluding form is out, a ``site``
    only serves as context, and a form that needs context counts if one of its structures is matched.
    """
    m = matched.join(forms, "form_id")
    per = m.groupBy(tid).agg(F.collect_set("structure_id").alias("seen"), F.collect_set(F.when(F.col("is_excluding"), F.col("structure_id"))).alias("out"))
    ok = m.join(per, tid).where(~F.col("is_excluding") & (F.coalesce("structure_type", F.lit("")) != "site") & ~F.array_contains("out", F.col("structure_id")))
    free = F.coalesce(F.size("requires_context_of"), F.lit(0)) <= 0
    ok = ok.where(free | F.coalesce(F.arrays_overlap("requires_context_of", F.col("seen")), F.lit(False)))
    return ok.groupBy(tid, "structure_id").agg(F.min("form_id").alias("form_id"))


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert, keep and delete between two sets of detections; confirmed ones are kept without detection.

    ``old``: keys, is_confirmed (nullable).
    """
    o, n = old.select(*keys, "is_confirmed").withColumn("__o", F.lit(1)), new.select(*keys).distinct().withColumn("__n", F.lit(1))
    both = o.join(n, keys, "full")
    action = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNotNull(), "keep").when(F.coalesce("is_confirmed", F.lit(False)), "unflag").otherwise("delete")
    return both.select(*keys, action.alias("action"))


def trailing(texts: DataFrame, tid: str, text: str, names: DataFrame, name: str, code: str) -> DataFrame:
    """(tid, code) of the longest name, in words, that a text ends with. The lengths looked for are those that names have."""
    n = names.where(F.col(name).isNotNull() & (F.col(name) != "")).select(F.col(name).alias("__g"), code, F.size(F.split(name, " ")).alias("__n"))
    lengths = n.agg(F.collect_set("__n").alias("__l"))  # the few lengths of names, one row
    w = F.split(text, " ")
    ends = F.transform(F.filter("__l", lambda k: k <= F.size(w)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(w, -k, k), " ").alias("g")))
    e = texts.where(F.col(text).isNotNull()).crossJoin(F.broadcast(lengths)).select(tid, F.explode(ends).alias("e"))
    return e.join(n.select("__g", code), F.col("e.g") == F.col("__g")).groupBy(tid).agg(F.max_by(code, "e.n").alias(code))


def single_place(texts: DataFrame, tid: str, text: str, places: DataFrame, place: str, code: str) -> DataFrame:
    """(tid, code) of texts whose place names all mean one code."""
    hit = contained(texts, tid, text, places.withColumn("__f", F.col(place)), "__f", place)
    c = hit.join(places.select(F.col(place).alias("__f"), code), "__f").groupBy(tid).agg(F.count_distinct(code).alias("n"), F.min(code).alias(code))
    return c.where("n = 1").select(tid, code)


def suggest(targets: DataFrame, tid: str, text: str, pool: DataFrame, pool_text: str, values: str) -> DataFrame:
    """(tid, values, n): for each target text, the most frequent values of the pool texts that contain it; ties are all kept."""
    pool = pool.where(F.col(pool_text).isNotNull()).withColumn("__p", F.xxhash64(pool_text, values))
    hit = contained(pool, "__p", pool_text, targets, tid, text)
    votes = hit.join(pool.select("__p", F.explode(F.array_distinct(values)).alias("__v")), "__p")
    return modes(votes, [tid], "__v")


def propagate(links: DataFrame, values: DataFrame, child: str, parent: str, column: str) -> DataFrame:
    """(parent, column): sorted union of an array column over the children of each parent."""
    v = links.join(values.select(child, F.explode(column).alias("__v")), child)
    return v.groupBy(parent).agg(F.array_sort(F.collect_set("__v")).alias(column))


def twins(df: DataFrame, ident: str, text: str, column: str) -> DataFrame:
    """Rows without a value take the sorted union of their twins' (same text): (ident, column)."""
    have = df.where(F.size(column) > 0).select(text, F.explode(column).alias("__v")).groupBy(text).agg(F.array_sort(F.collect_set("__v")).alias(column))
    lack = df.where((F.coalesce(F.size(column), F.lit(0)) <= 0) & F.col(text).isNotNull()).select(ident, text)
    return lack.join(have, text).select(ident, column)
