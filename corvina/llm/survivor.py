"""Problem 6: the best representative of each duplicate group.

A latent two-sided quality model judges the values: every source has a sensitivity (it states a value
that is true) and a specificity (it doesn't state one that is false), learnt by expectation-maximisation
together with the share of true values in each class of defects. ``p6_values`` keeps every value judged
true, several of a field where several are; the one survivor of a field is chosen by the field's rule, with
the posterior deciding where the rule leaves a choice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.text import normalize_text, unaccent
from corvina.llm.canonical import GARBLED
from corvina.operators.graph import lookup
from corvina.session import Cut, table

# Sources in the order of trust.
TRUST = ("theses", "crossref", "datacite", "hal", "openalex", "scanr", "wos")
# Openness of a status; statuses that are not here are not known.
OA_RANK = {"diamond": 8, "gold": 7, "hybrid": 6, "bronze": 5, "green": 4, "embargoed": 3, "closed": 2}
# Texts that stand for no title or abstract, once folded.
EMPTY_TEXTS = (
    "", "n a", "na", "sans titre", "untitled", "no title", "titre non disponible", "title not available", "unknown", "none", "null", "see full text",
    "abstract not provided by the publisher", "no abstract available", "no abstract", "abstract not available", "abstract", "resume non disponible", "resume", "not available",
    "voir le texte integral", "without abstract", "pas de resume",
)
#: A sentence is boilerplate if it stands in at least this many publications, with at most this share in one language.
BOILER_LEAST, BOILER_SHARE = 3, 0.85


def em_two_sided(patterns: list[tuple[int, int, int, int]], sources: int, classes: int, rounds: int = 30) -> tuple[dict[tuple[int, int, int], float], list[float], list[float], list[float]]:
    """Posterior that a value is true for each pattern; sensitivities, specificities, class priors.

    A pattern is (sources that state the value, sources that cover the item, class of defects, count),
    the first two as bit masks, so there are at most 3 ** sources * classes of them.
    """
    sens, spec, prior = [0.7] * sources, [0.8] * sources, [0.8] + [0.2] * (classes - 1)
    post: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        num, den, neg, nden = [1.4] * sources, [2.0] * sources, [1.6] * sources, [2.0] * sources
        cnum, cden = [1.6] + [0.4] * (classes - 1), [2.0] * classes
        for says, covers, k, n in patterns:
            logit = math.log(prior[k] / (1 - prior[k]))
            for s in range(sources):
                if covers >> s & 1:
                    logit += math.log(sens[s] / (1 - spec[s])) if says >> s & 1 else math.log((1 - sens[s]) / spec[s])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
            post[says, covers, k] = p
            cnum[k] += n * p
            cden[k] += n
            for s in range(sources):
                if covers >> s & 1:
                    den[s] += n * p
                    nden[s] += n * (1 - p)
                    num[s] += n * p * (says >> s & 1)
                    neg[s] += n * (1 - p) * (1 - (says >> s & 1))
        clip = lambda x: min(0.99, max(0.01, x))
        sens, spec = [clip(a / b) for a, b in zip(num, den)], [clip(a / b) for a, b in zip(neg, nden)]
        prior = [clip(a / b) for a, b in zip(cnum, cden)]
        # A source that would state false values more often than true ones is read as uninformative.
        spec = [max(b, 1 - a + 0.01) for a, b in zip(sens, spec)]
    return post, sens, spec, prior


def judge(spark: SparkSession, claims: DataFrame, classes: int) -> DataFrame:
    """``posterior`` of each (item, value) of ``claims``: item, value, source, defect (0 .. classes - 1).

    The values are reduced to patterns of sources before anything reaches the driver; the list of
    patterns is bounded by the number of trusted sources (others count as one), not by the rows.
    """
    bit = F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), F.col("source")).cast("int"), F.lit(0))
    c = claims.withColumn("bit", F.pow(F.lit(2), bit).cast("int"))
    cut = Cut(spark)
    says = cut(c.groupBy("item", "value").agg(F.bit_or("bit").alias("says"), F.min("defect").alias("defect")))
    covers = says.groupBy("item").agg(F.bit_or("says").alias("covers"))
    v = cut(lookup(says, covers, "item"))
    rows = v.groupBy("says", "covers", "defect").agg(F.count(F.lit(1)).alias("n")).collect()
    post, *_ = em_two_sided([(r["says"], r["covers"], r["defect"], r["n"]) for r in rows], len(TRUST) + 1, classes)
    found = spark.createDataFrame([(*k, p) for k, p in post.items()] or [(0, 0, 0, 0.0)], "says int, covers int, defect int, posterior double")
    return v.join(F.broadcast(found), ["says", "covers", "defect"]).select("item", "value", "posterior")  # at most 3 ** 8 * classes rows


def _usable(c: Column) -> Column:
    return F.coalesce(~normalize_text(c).isin(*EMPTY_TEXTS), F.lit(False))


def _garbled(c: Column) -> Column:
    return c.rlike(GARBLED.pattern.replace("[AÂ", "[Â").replace("\\", "\\\\")) | c.contains("�")


def title_claims(sp: DataFrame) -> DataFrame:
    """(item, sp_id, source, value, defect) of the usable titles: 0 sound, 1 retyped in capitals, 2 marked up, 3 cut or garbled."""
    t = F.trim(F.col("title"))
    defect = (
        F.when(_garbled(t) | t.rlike(r"(…|\.\.\.)$") | t.rlike(r"[:,;–-]$"), 3)
        .when(t.rlike(r"</?[A-Za-z][^>]*>|&#?[A-Za-z0-9]+;"), 2)
        .when((F.upper(t) == t) & (F.length(F.regexp_replace(t, r"\P{L}", "")) >= 8), 1)
        .otherwise(0)
    )
    return sp.where(_usable(t)).select(F.col("publication_id").alias("item"), F.col("id").alias("sp_id"), "source", t.alias("value"), defect.alias("defect"))


def _quality(titles: DataFrame) -> DataFrame:
    """(value, quality): how usual the rarest letter triple and the word pairs of a title are in all titles; retyped ones are less usual."""
    v = titles.select("value").distinct().withColumn("t", F.concat(F.lit(" "), unaccent(F.col("value")), F.lit(" ")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.concat(F.lit("g"), F.substring(F.col("t"), i, F.lit(3))))
    words = F.split(F.trim("t"), r"[^\p{L}\p{N}]+")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat(F.lit("w"), F.get(words, i), F.lit(" "), F.coalesce(F.get(words, i + 1), F.lit(""))))
    e = v.select("value", F.explode(F.array_distinct(F.concat(grams, pairs))).alias("f"))
    n = e.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    log = F.log(F.col("n") + 1.0)
    return e.join(n, "f").groupBy("value").agg(
        (F.coalesce(F.min(F.when(F.col("f").startswith("g"), log)), F.lit(0.0)) + F.coalesce(F.avg(F.when(F.col("f").startswith("w"), log)), F.lit(0.0))).alias("quality")
    )


def _trust(c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TRUST)), c)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(TRUST) + 1).otherwise(at).cast("int")


def surviving_titles(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(publication_id, sp_id, source, value). Sound titles only; retyped and cut forms of the likeliest one are left out, the most trusted source decides among the rest."""
    cut = Cut(spark)
    claims = cut(title_claims(sp))
    post = judge(spark, claims, 4)
    sound = claims.where("defect = 0")
    values = (
        sound.groupBy("item", "value").agg(F.min(_trust(F.col("source"))).alias("trust"), F.countDistinct("source").alias("sources"), F.min("sp_id").alias("sp_id"))
        .join(post, ["item", "value"]).join(_quality(sound), "value")
    )
    p = F.least(F.greatest("posterior", F.lit(1e-6)), F.lit(1 - 1e-6))
    values = cut(values.withColumn("score", F.log(p / (1 - p)) * 0.5 + F.col("quality")))
    lead = cut(values.groupBy("item").agg(F.max(F.struct("score", (-F.col("trust")).alias("t"), (-F.col("sp_id")).alias("i"), "value")).alias("l")).select("item", F.col("l.value").alias("lead")))
    bag = lambda c: F.array_sort(F.split(normalize_text(F.col(c)), " "))
    a, b = normalize_text(F.col("value")), normalize_text(F.col("lead"))
    variant = (F.col("value") != F.col("lead")) & ((F.levenshtein(a, b, 4) >= 0) | (bag("value") == bag("lead")) | (F.startswith(b, a)))
    kept = lookup(values, lead, "item").where(~F.coalesce(variant, F.lit(False)))
    best = kept.groupBy("item").agg(F.min(F.struct("trust", (-F.col("score")).alias("s"), "sp_id", "value")).alias("b")).select("item", F.col("b.value").alias("value"))
    return _carriers(claims, best)


def _carriers(claims: DataFrame, best: DataFrame) -> DataFrame:
    """The smallest record that carries the surviving value of each item."""
    best = Cut(claims.sparkSession)(best)
    hit = lookup(claims, best.withColumnRenamed("value", "best"), "item").where("value = best").groupBy("item", "value").agg(F.min(F.struct("sp_id", "source")).alias("m"))
    return hit.select(F.col("item").alias("publication_id"), F.col("m.sp_id").alias("sp_id"), F.col("m.source").alias("source"), "value")


def abstract_claims(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(item, sp_id, source, value, h, updated_at, defect) of the usable abstracts, a table: 0 sound, 1 flawed, 2 with matter of others.

    Flawed are cut texts (an ellipsis, no closing mark), texts given twice, titles, garbled and marked-up
    texts; matter of others are sentences that publications of several languages share.
    """
    cut = Cut(spark)
    a = F.trim(F.regexp_replace("abstract", r"(?U)\s+", " "))
    c = cut(
        sp.where(_usable(F.col("abstract"))).select(
            F.col("publication_id").alias("item"), F.col("id").alias("sp_id"), "source", a.alias("value"), "title", "language", "updated_at", F.xxhash64(a).alias("h")
        )
    )
    sentences = F.filter(F.split("value", r"(?<=[.!?»”])\s+"), lambda s: F.length(s) > 0)
    s = cut(c.select("item", "h", "language", F.explode(F.transform(F.array_distinct(sentences), lambda x: F.xxhash64(x))).alias("s")).distinct())
    tongues = s.where("language is not null").groupBy("s", "language").agg(F.countDistinct("item").alias("n")).groupBy("s").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    boiler = tongues.where((F.col("n") >= BOILER_LEAST) & (F.col("top") <= BOILER_SHARE * F.col("n"))).select("s")
    foreign = s.join(boiler, "s", "left_semi").select("item", "h").distinct().withColumn("boiler", F.lit(True))
    half = (F.length("value") / 2).cast("int")
    twice = (F.length("value") > 60) & (F.trim(F.substring(F.col("value"), F.lit(1), half)) == F.trim(F.substring(F.col("value"), half + 1, F.length("value"))))
    flawed = (
        twice
        | _garbled(F.col("value"))
        | F.col("value").rlike(r"</?[A-Za-z][^>]*>|&#?[A-Za-z0-9]+;")
        | ~F.col("value").rlike(r"[.!?»”\")\]]$")
        | F.col("value").rlike(r"(…|\.\.\.|[(\[](more|suite|\.\.\.|…)[)\]])$")
        | F.coalesce(normalize_text(F.col("value")) == normalize_text(F.col("title")), F.lit(False))
    )
    defect = F.when(F.coalesce("boiler", F.lit(False)), 2).when(flawed, 1).otherwise(0)
    return cut.keep(c.join(foreign, ["item", "h"], "left").withColumn("defect", defect).select("item", "sp_id", "source", "value", "h", "updated_at", "defect"))


def surviving_abstracts(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(publication_id, sp_id, source, value): sound abstracts, no beginning of the longest one; the one updated last wins, then the likelier one."""
    c = abstract_claims(spark, sp)
    cut = Cut(spark)
    longest = cut(c.where("defect = 0").groupBy("item").agg(F.max_by("value", F.length("value")).alias("longest")))
    sound = lookup(c.where("defect = 0"), longest, "item").where((F.col("value") == F.col("longest")) | ~F.startswith(F.col("longest"), F.col("value")))
    post = judge(spark, c.select("item", "source", "h", "defect").withColumnRenamed("h", "value"), 3)
    late = F.coalesce(F.col("updated_at").cast("string"), F.lit(""))
    best = (
        sound.join(post.withColumnRenamed("value", "h"), ["item", "h"])
        .groupBy("item")
        .agg(F.max(F.struct(late.alias("u"), "posterior", (-F.col("sp_id")).alias("i"), "value")).alias("b"))
        .select("item", F.col("b.value").alias("value"))
    )
    return _carriers(c, best)


def oa_claims(sp: DataFrame) -> DataFrame:
    """(item, sp_id, source, value, rank, defect) of the known statuses, apart from case and outer blanks; 0 open, 1 closed or embargoed."""
    v = F.lower(F.trim(F.regexp_replace("oa_status", r"(?U)\s+", " ")))
    rank = F.create_map(*[F.lit(x) for kv in OA_RANK.items() for x in kv])
    c = sp.select(F.col("publication_id").alias("item"), F.col("id").alias("sp_id"), "source", v.alias("value"), F.try_element_at(rank, v).alias("rank")).where("rank is not null")
    return c.withColumn("defect", (F.col("rank") <= OA_RANK["embargoed"]).cast("int"))


def surviving_oa(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(publication_id, sp_id, source, value): the most open known status."""
    c = Cut(spark)(oa_claims(sp))
    best = c.groupBy("item").agg(F.max(F.struct("rank", "value")).alias("b")).select("item", F.col("b.value").alias("value"))
    return _carriers(c, best)


def _groups(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """The records of publications with two or more, a table; rows without publication_id belong to no group."""
    cut = Cut(spark)
    sp = cut(sp.select("id", "source", "publication_id", "title", "abstract", "oa_status", "language", "updated_at").where("publication_id is not null"))
    n = sp.groupBy("publication_id").agg(F.count(F.lit(1)).alias("n"))
    return cut.keep(lookup(sp, n, "publication_id").where("n > 1").drop("n"))


def true_values(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(publication_id, field, value, sources, posterior, kept): every usable value of each field with its posterior.

    kept are the values judged true (posterior of 0.5 or more); a field may keep several, or none.
    """
    sp = _groups(spark, sp)
    cut = Cut(spark)
    out = None
    for field, claims, classes in (("title", title_claims(sp), 4), ("abstract", abstract_claims(spark, sp), 3), ("oa_status", oa_claims(sp), 2)):
        c = cut(claims.select("item", F.xxhash64("value").alias("h"), "value", "source", "defect"))
        post = judge(spark, c.select("item", F.col("h").alias("value"), "source", "defect"), classes).withColumnRenamed("value", "h")
        v = c.groupBy("item", "h").agg(F.first("value").alias("value"), F.array_sort(F.collect_set("source")).alias("sources"))
        v = v.join(post, ["item", "h"]).select(F.col("item").alias("publication_id"), F.lit(field).alias("field"), "value", "sources", F.round("posterior", 6).alias("posterior"))
        out = v if out is None else out.unionByName(v)
    return out.withColumn("kept", F.col("posterior") >= 0.5)


def survivors(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """(publication_id, field, sp_id, source, value) of each publication with two or more records and each field with a usable value.

    Rows without publication_id belong to no group. A publication held by a third of all rows is met
    only by hash aggregates and joins on (item, value).
    """
    sp = _groups(spark, sp)
    parts = [("title", surviving_titles(spark, sp)), ("abstract", surviving_abstracts(spark, sp)), ("oa_status", surviving_oa(spark, sp))]
    out = None
    for field, df in parts:
        df = df.select("publication_id", F.lit(field).alias("field"), "sp_id", "source", "value")
        out = df if out is None else out.unionByName(df)
    return out


def p6_survivors(spark: SparkSession, base: str) -> DataFrame:
    """The golden record, one row a field, with the source and the value."""
    return survivors(spark, table(spark, base, "source_publications"))


def p6_values(spark: SparkSession, base: str) -> DataFrame:
    """Every value of each field with the posterior that it is true, and whether it is kept."""
    return true_values(spark, table(spark, base, "source_publications"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_survivors(spark, base).select("publication_id", "field", "sp_id")
