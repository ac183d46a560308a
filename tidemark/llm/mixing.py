"""Mixing sources to target weights by Pareto order sampling.

Targets are shares of all words by source weight, held under ``cap`` times what a source has, the excess going to the
others (water filling). Within a source every document gets an expected number of copies that falls slowly with its
length and sums to the target. Whole copies are certain; the fraction left is an inclusion probability p, and documents
are ranked by Pareto's ratio (u / (1 - u)) / (p / (1 - p)) of random odds to inclusion odds. The lowest ranks whose words
fill what is left of the target get one copy more: a sample of fixed size in words with unequal probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: A document of b-bit length has weight GENTLE - 2 b in the expected copies.
GENTLE = 64
#: Ranks are looked for by a histogram of this many cells before any exact order is made.
CELLS = 1 << 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``; weights repeat over the sources in code point order."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    placed = cut(ranked(sizes, order).withColumn("w", w))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # those at their cap stay there as the level rises
        free = F.lit(True) if level is None else F.col("w") * level[0] / level[1] <= F.col("source_size") * cap
        row = placed.agg(
            F.sum(F.when(free, F.lit(0)).otherwise(F.col("source_size") * cap)).alias("held"), F.sum(F.when(free, F.col("w")).otherwise(F.lit(0))).alias("w")
        ).first()
        new = (total - (row["held"] or 0), row["w"] or 0)
        if new == level or not new[1]:
            break
        level = new
    if level is None:
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("w") * F.lit(float(level[0])) / F.lit(float(level[1]))
    return placed.select("source", "source_size", F.least(share, (F.col("source_size") * cap).cast("double")).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A random number in (0, 1) that only the key and the seed decide, of 52 bits."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _expected(sized: DataFrame, cap: int) -> DataFrame:
    """Per source the factor theta with sum(words * least(cap, theta * g)) = target, from words by size class."""
    classes = sized.groupBy("source", "source_size", "target", "g").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy(F.desc("g"))
    held = F.coalesce(F.sum(F.col("words")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("g")).over(up.rowsBetween(0, Window.unboundedFollowing))
    steps = classes.withColumns({"held": held, "rest": rest})  # at most 64 classes a source
    theta = F.when(F.col("rest") > 0, (F.col("target") - F.col("held") * cap) / F.col("rest")).otherwise(F.lit(0.0))
    steps = steps.withColumn("theta", theta)
    # the classes above this one are at the cap; the first that isn't decides. Null where every class is at the cap.
    free = F.col("theta") * F.col("g") <= cap
    return steps.groupBy("source").agg(F.max_by(F.when(free, F.col("theta")), F.when(free, F.col("g"))).alias("theta"))


def _by_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` beside the one row its source has in ``b``; that side is sent to all while it is small, else AQE splits hot sources."""
    few = b.count() <= 100_000
    small = b.withColumnRenamed("source", "_s")
    return a.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _odds(seed: str, cap: int) -> dict[str, Column]:
    """Of a row of ``id, size, theta``: whole copies, Pareto's ratio for one more (null where none is due) and its histogram cell."""
    g = F.greatest(F.lit(GENTLE) - 2 * F.length(F.bin("size")), F.lit(1)).cast("long")
    e = F.coalesce(F.col("theta") * g, F.lit(float(cap)))
    p = F.when(e >= cap, F.lit(0.0)).otherwise(e - F.floor(e))
    u = uniform(F.col("id"), seed)
    q = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    return {"whole": F.least(F.floor(e), F.lit(cap)), "q": q, "cell": F.floor(q / (q + 1) * CELLS)}


def _sizes(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    size = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    return [docs[key].alias("id"), docs[source].alias("source"), size.alias("size")]


def _plan(base: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """All that a row's copies depend on, a row a source: ``source, source_size, target, theta, edge, last``.

    Rows in a cell under ``edge`` are in the sample, and those in the edge cell up to ``last``, a (q, id).
    """
    goals = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    g = F.greatest(F.lit(GENTLE) - 2 * F.length(F.bin("size")), F.lit(1)).cast("long")
    theta = _expected(_by_source(base, goals).withColumn("g", g), cap)
    plan = cut(goals.join(theta.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    drawn = cut(_by_source(base, plan).withColumns(_odds(seed, cap)).select("id", "source", "size", "target", "whole", "q", "cell"))

    left = drawn.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    cells = drawn.where("q is not null").groupBy("source", "cell").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("words").over(run))  # at most CELLS rows a source
    ends = _by_source(cells, left).where("upto > left").groupBy("source").agg(F.min("cell").alias("edge"), F.min(F.col("upto") - F.col("words")).alias("before"))
    bounds = cut(left.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    # the order is made within the edge cell alone, 1 / CELLS of the ranks
    inner = _by_source(drawn.where("q is not null"), bounds).where("edge is not null and cell = edge")
    fine = Window.partitionBy("source").orderBy("q", "id")
    inner = inner.withColumn("reach", F.col("before") + F.sum("size").over(fine.rowsBetween(Window.unboundedPreceding, 0)))
    prior = F.col("reach") - F.col("size")
    within = (F.col("reach") <= F.col("left")) | ((prior <= F.col("left")) & (F.col("reach") - F.col("left") < F.col("left") - prior))
    last = inner.where(within).groupBy("source").agg(F.max(F.struct("q", "id")).alias("last"))
    found = bounds.select("source", "edge").join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return cut(plan.join(found.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def _copies(rows: DataFrame, plan: DataFrame, cap: int, seed: str) -> DataFrame:
    """Rows of ``id, source, size`` with the plan of their source and ``copies``; what a row gets depends on nothing but its own values."""
    drawn = _by_source(rows, plan).withColumns(_odds(seed, cap))
    one_more = (F.col("edge").isNull() | (F.col("cell") < F.col("edge"))) | ((F.col("cell") == F.col("edge")) & (F.struct("q", "id") <= F.col("last")))
    extra = F.when(F.col("q").isNotNull() & F.coalesce(one_more, F.lit(False)), 1).otherwise(0)
    return drawn.withColumn("copies", (F.col("whole") + extra).cast("long")).drop("whole", "q", "cell", "theta", "edge", "last")


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix-1"
) -> DataFrame:
    """``key, size, source_size, target, taken, copies, source`` per row.

    ``size`` counts words; a null text has none. A null source is a source, the last. Each source's taken words differ from
    its target by less than half of one of its documents at the rank where the sample ends, and no document is taken more
    than ``cap`` times. An empty table gives no rows; rows that repeat a key and size in a source are rows of their own that
    are taken alike. The key and the seed alone decide the random numbers, so reruns agree. Other columns are ignored.
    """
    base = cut(docs.select(*_sizes(docs, key, text, source)))
    found = _copies(base, _plan(base, weights, cap, seed), cap, seed)
    return found.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


#: What ``take_mix`` adds.
ADDED = ("copies", "size", "source_size", "target", "taken")


def take_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix-1"
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns and ``copies, size, source_size, target, taken``.

    The plan of a row a source goes to the rows: texts stay where they are read, and a row that repeats a key is judged by
    its own text and source. Columns of ``docs`` by the added names give way. Null texts have no words, and of those, as of
    others, as many are taken as the odds say; an empty table gives no rows.
    """
    plan = _plan(cut(docs.select(*_sizes(docs, key, text, source))), weights, cap, seed)
    kept = [c for c in docs.columns if c not in ADDED]
    whole = F.struct(*[docs[c] for c in kept]).alias("_row")
    taken = _copies(docs.select(whole, *_sizes(docs, key, text, source)), plan, cap, seed).where("copies > 0")
    return taken.select("_row.*", "copies", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
