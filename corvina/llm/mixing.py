"""Problem 9: mixing sources to target weights by capped water-filling.

Every source gets its weight of the goal; what exceeds its cap (most uses of one document times its
tokens) is redistributed to the others in proportion to their weights until all fit. A source's
allotment is then drawn as whole repetitions of all its documents plus a seeded fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.llm.tokenize import count_tokens
from corvina.session import Cut, table

SEED = 20_240_601
#: Hash buckets of the fractional draw; only one bucket a source is ever put in order.
BUCKETS = 4096


def water_fill(goal: float, weights: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Allotment by source: proportional to ``weights``, never above ``caps``, summing to ``goal`` if the caps allow.

    Sources without weight get nothing. Ends after at most one round a source.
    """
    given = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0}
    left = float(goal)
    while free and left > 0:
        total = sum(weights[s] for s in sorted(free))
        over = {s for s in free if left * weights[s] / total >= caps[s]}
        if not over:
            for s in free:
                given[s] = left * weights[s] / total
            break
        for s in sorted(over):
            given[s] = caps[s]
        left -= sum(caps[s] for s in sorted(over))
        free -= over
    return given


def plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """One dict for each source of ``targets`` (a parameter table, one row a source) with its allotment.

    ``sized``: doc_id, source, tokens. The goal is the token count of all rows, those of other and of
    null sources included. A null share counts as 0, null repeats as 1; repeated sources add their
    shares and take the larger number of repeats.
    """
    t = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"),
    )
    by = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    goal = by.agg(F.sum("tokens").alias("g")).first()["g"] or 0
    rows = [r.asDict() for r in t.join(by, "source", "left").fillna(0, ["docs", "tokens"]).orderBy("source").collect()]
    given = water_fill(goal, {r["source"]: max(0.0, r["target_share"]) for r in rows}, {r["source"]: float(max(0, r["max_repeats"]) * r["tokens"]) for r in rows})
    for r in rows:
        r["allotted"] = given[r["source"]]
        r["whole"] = int(r["allotted"] // r["tokens"]) if r["tokens"] else 0
        r["fraction"] = r["allotted"] - r["whole"] * r["tokens"]
    return rows


PLAN = "source string, target_share double, max_repeats int, docs bigint, tokens bigint, allotted double, whole int, fraction double"


def draw(spark: SparkSession, sized: DataFrame, rows: list[dict], seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every document drawn at least once.

    The fractional part takes documents in the order of a seeded hash until their tokens reach it, to
    the nearest document. Bucket sums find the one bucket in which a source's border lies, so only
    1 / BUCKETS of a source is ordered in one task, however large the source. Documents of no token change
    no share, so the fraction passes them by: no document is ever used more than ``whole`` + 1 times, and
    never more than the source's cap allows.
    """
    names = [f.split()[0] for f in PLAN.split(", ")]
    p = F.broadcast(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PLAN).select("source", "whole", "fraction"))  # one row a target
    d = sized.join(p, "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    sums = d.groupBy("source", "b").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "b", before.alias("before"), "n").join(p, "source")
    state = F.when(F.col("before") >= F.col("fraction"), 0).when(F.col("before") + F.col("n") <= F.col("fraction"), 1).otherwise(2)
    d = d.join(F.broadcast(sums.select("source", "b", "before", state.alias("state"))), ["source", "b"])  # at most BUCKETS rows a target
    settled = d.where("state < 2").select("doc_id", "source", "tokens", (F.col("whole") + F.col("state") * (F.col("tokens") > 0).cast("int")).alias("repeats"))
    run = F.sum("tokens").over(Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    border = d.where("state = 2").withColumn("run", F.col("before") + run)
    inside = ((F.col("tokens") > 0) & (F.col("run") - F.col("tokens") / 2 <= F.col("fraction"))).cast("int")
    border = border.select("doc_id", "source", "tokens", (F.col("whole") + inside).alias("repeats"))
    return settled.unionByName(border).where("repeats > 0").withColumn("repeats", F.col("repeats").cast("int"))


def _sized(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "source", "text")
    return Cut(spark)(count_tokens(docs, ["doc_id", "source"]))


def p9_draws(spark: SparkSession, base: str) -> DataFrame:
    """The mix: every drawn document with its number of uses. Documents of no token are never drawn short of whole repetitions."""
    sized = _sized(spark, base)
    return draw(spark, sized, plan(sized, table(spark, base, "mix_targets")))


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """The report: target and reached share of each source, and whether the target is met to half a percent of the mix."""
    sized = _sized(spark, base)
    rows = plan(sized, table(spark, base, "mix_targets"))
    names = [f.split()[0] for f in PLAN.split(", ")]
    p = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PLAN)
    got = draw(spark, sized, rows).groupBy("source").agg(
        F.count(F.lit(1)).alias("drawn_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_uses")
    )
    out = p.join(got, "source", "left").fillna(0, ["drawn_docs", "drawn_tokens", "most_uses"])
    total = F.sum("drawn_tokens").over(Window.partitionBy())  # one row a target
    reached = F.coalesce(F.try_divide(F.col("drawn_tokens"), total), F.lit(0.0))
    return out.select(
        "source", "target_share", "max_repeats", "docs", "tokens", F.round("allotted", 3).alias("allotted_tokens"),
        "drawn_docs", "drawn_tokens", "most_uses", F.round(reached, 6).alias("reached_share"),
        (F.abs(reached - F.col("target_share")) <= 0.005).alias("target_met"),
    )
