"""Graph operators: components, joins that hot keys don't hurt, closures, cycle checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.session import Cut

#: Members of one key are hashed into this many sub-stars, so that a key held by a third of all rows
#: puts at most rows / SALTS edges on one node.
SALTS = 64
#: A key is hot if it holds at least one row in so many; so at most this many keys are hot, whatever the size.
HOT = 1000
#: Members of a class whose pairs are expanded by one task.
BLOCK = 1000


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key), null where the key is missing.

    Hot keys get theirs by a broadcast of at most ``HOT`` rows, so none sends its rows to one task; the
    others are joined as usual. ``left`` is read three times and should be a table.
    """
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"))  # one row
    hot = n.crossJoin(F.broadcast(total)).where(F.col("__n") * HOT >= F.col("__t")).select(key)
    known = F.broadcast(hot.join(right, key, "left").withColumn("__hot", F.lit(True)))  # at most HOT rows
    near = left.join(known, key).drop("__hot")
    far = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return near.unionByName(far.select(*near.columns))


def class_pairs(members: DataFrame, cls: str, node: str) -> DataFrame:
    """(c, a, b) of all pairs of members of one class c, a < b; a large class is split over many tasks.

    One side of a class of n members is hashed into n / BLOCK parts, the other is given to each part, so
    what is shuffled stays a BLOCK-th of the pairs that come out.
    """
    m = members.select(F.col(cls).alias("c"), F.col(node).alias("n")).distinct()
    size = m.groupBy("c").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    m = lookup(m, size, "c").where("size > 1").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    a = m.select("c", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int").alias("s"), F.col("n").alias("a"))
    b = m.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), F.col("n").alias("b"))
    return a.join(b, ["c", "s"]).where("a < b").select("c", "a", "b")


def star_edges(tokens: DataFrame, node: str, key: str, salts: int = SALTS) -> DataFrame:
    """Edges (src, dst) with dst < src that link all nodes of each key, in number linear in the rows.

    Two levels: node -> smallest node of its (key, salt), and that one -> smallest node of its key.
    Both minima are hash aggregates with map-side combine; no pair within a key is ever listed.
    Rows with a null node or key give no edge.
    """
    t = tokens.select(F.col(node).alias("n"), F.col(key).alias("k")).where("n is not null and k is not null")
    t = t.withColumn("s", F.pmod(F.xxhash64("n"), F.lit(salts)).cast("int"))
    sub = t.groupBy("k", "s").agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("c"))
    top = sub.groupBy("k").agg(F.min("m").alias("r"), F.sum("c").alias("kc"))
    low = (
        t.join(sub.where("c > 1").select("k", "s", "m"), ["k", "s"])
        .where("n > m")
        .select(F.col("n").alias("src"), F.col("m").alias("dst"))
    )
    high = (
        sub.join(top.where("kc > 1").select("k", "r"), "k")
        .where("m > r")
        .select(F.col("m").alias("src"), F.col("r").alias("dst"))
    )
    return low.unionByName(high).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node of its component.

    Each round: every node takes the smallest label among itself and its neighbours (hooking, also
    of the neighbour's root), then its label's label (pointer jumping), so that chains of length n
    settle in about log n rounds; the round is written to shared storage and the loop ends when no label
    changes. The root of a giant component is a hot key of the jump, hence ``lookup``. Self loops,
    repeated and null edges do no harm; an empty input gives an empty result.
    """
    cut = Cut(spark)
    e = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where(
        "u is not null and v is not null and u <> v"
    )
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # First hook: the smallest neighbour, straight from the edges.
    labels = cut(
        e.unionByName(e.select(F.col("v").alias("u"), F.col("v")))
        .groupBy("u")
        .agg(F.min("v").alias("label"))
        .select(F.col("u").alias("node"), F.least("u", "label").alias("label"))
    )
    while True:
        # Labels of both ends of each edge; the end with the larger label is hooked to the smaller.
        lu = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        lv = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        ends = e.join(lu, "u").join(lv, "v").where("lu <> lv")
        low = F.least("lu", "lv")
        hooks = ends.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("node"), low.alias("cand")),
                    F.struct(F.col("v").alias("node"), low.alias("cand")),
                    F.struct(F.greatest("lu", "lv").alias("node"), low.alias("cand")),
                )
            ).alias("h")
        ).select("h.*")
        best = hooks.groupBy("node").agg(F.min("cand").alias("cand"))
        hooked = cut(labels.join(best, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("cand", "label")).alias("label")
        ))
        changed = hooked.where("old <> label").limit(1).count()
        parent = hooked.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = cut(lookup(hooked.select("node", "label"), parent, "label").select("node", F.coalesce("up", "label").alias("label")))
        cut.drop(labels, hooked)
        labels = jumped
        if not changed:
            cut.drop(e)
            return labels


def components(spark: SparkSession, nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, label) of every node; nodes that share a token, also through others, get the smallest id.

    Tokens become star edges, linear in the rows also for hot tokens. ``nodes``: id; ``tokens``: id,
    token. Null ids and tokens link nothing; a node without a token is its own component.
    """
    found = connected_components(spark, star_edges(tokens, "id", "token")).withColumnRenamed("node", "id")
    return nodes.select("id").where("id is not null").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def closure(spark: SparkSession, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth) of all nodes reachable from each root, the root itself at depth 0; cycles end.

    Only the frontier of new pairs is joined in each round, until it is empty. ``roots``: node;
    ``edges``: parent, child.
    """
    cut = Cut(spark)
    e = cut(edges.where("parent is not null and child is not null").select("parent", "child").distinct())
    seen = front = cut(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        new = front.join(e, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        front = cut(new.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def ancestors(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth) upward, the start left out."""
    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return closure(spark, nodes, up).where("depth > 0")


def would_cycle(spark: SparkSession, edges: DataFrame, parent: int, child: int) -> bool:
    """Whether the edge parent -> child would close a cycle."""
    if parent == child:
        return True
    start = spark.createDataFrame([(child,)], "node bigint")
    return closure(spark, start, edges).where(F.col("node") == parent).limit(1).count() > 0
