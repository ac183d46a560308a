"""Crawl state in batches: the URL queue, the visit history, rates and hooks, folded from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, ranked

MAX_RETRIES = 3


def queue_state(log: DataFrame, url: str = "url", event: str = "event", order: str = "ord", priority: str | None = None, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``url, state, priority, retries, added``: the queue after a log of add, next, done, failed and requeue events.

    Each URL's events are folded in order. A failure is put back with its retries + 1 as priority until it has been retried
    ``max_retries`` times; it is failed after that. Events of URLs that were never added, and such as don't fit the state,
    change nothing.
    """
    level = F.col(priority) if priority else F.lit(0)
    events = log.groupBy(url).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e"), level.cast("int").alias("p")))).alias("events"))
    kind = "struct<state:string,priority:int,retries:int,added:bigint>"
    start = F.from_json(F.lit('{"state":"","priority":0,"retries":0,"added":-1}'), kind)

    def state(name: str, p, r, at):
        return F.struct(F.lit(name).alias("state"), p.cast("int").alias("priority"), r.cast("int").alias("retries"), at.cast("long").alias("added"))

    def step(acc, x):
        again = acc["retries"] + 1
        return (
            F.when((x["e"] == "add") & (acc["state"] == ""), state("pending", x["p"], F.lit(0), x["o"]))
            .when((x["e"] == "next") & (acc["state"] == "pending"), state("processing", acc["priority"], acc["retries"], acc["added"]))
            .when((x["e"] == "done") & acc["state"].isin("processing", "pending"), state("done", acc["priority"], acc["retries"], acc["added"]))
            .when((x["e"] == "failed") & (acc["state"] == "processing") & (acc["retries"] < max_retries), state("pending", again, again, x["o"]))
            .when((x["e"] == "failed") & (acc["state"] == "processing"), state("failed", acc["priority"], acc["retries"], acc["added"]))
            .when((x["e"] == "requeue") & (acc["state"] == "failed"), state("pending", F.lit(0), F.lit(0), x["o"]))
            .otherwise(acc)
        )

    folded = events.select(F.col(url).alias("url"), F.aggregate("events", start, step).alias("s"))
    return folded.select("url", "s.*").where("state <> ''")


def queue_stats(state: DataFrame) -> DataFrame:
    """Counts by state and of all."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("pending", "processing", "done", "failed")]
    return state.agg(*counts, F.count("*").alias("total"))


def queue_next(state: DataFrame, k: int) -> DataFrame:
    """The k pending URLs to take next: by priority, then by when they were added."""
    return state.where("state = 'pending'").orderBy("priority", "added", "url").limit(k)


def admit(candidates: DataFrame, state: DataFrame, cap: int = 50_000) -> DataFrame:
    """New URLs, the first of each, while there is room for them among the pending."""
    known = candidates.groupBy("url").agg(F.min_by(F.struct("priority", "ord"), "ord").alias("c")).select("url", "c.*").join(state.select("url"), "url", "left_anti")
    room = max(0, cap - state.where("state = 'pending'").count())
    return known.orderBy("priority", "ord").limit(room)


def recover(state: DataFrame) -> DataFrame:
    """After a restart what was being processed is pending again, at the front, its retries kept."""
    lost = F.col("state") == "processing"
    return state.withColumns({"priority": F.when(lost, 0).otherwise(F.col("priority")), "state": F.when(lost, "pending").otherwise(F.col("state"))})


def mark_visited(history: DataFrame, visits: DataFrame) -> DataFrame:
    """``url, hash, ts, title``: the latest visit of each URL."""
    return history.unionByName(visits).groupBy("url").agg(F.max_by(F.struct("hash", "ts", "title"), "ts").alias("v")).select("url", "v.*")


def expire(history: DataFrame, now, days: int = 30) -> DataFrame:
    """Without entries older than so many days; entries without a time stay, and 0 or less expires nothing."""
    return history if days <= 0 else history.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(now) - F.expr(f"interval {days} days")))


def evict_oldest(history: DataFrame, most: int = 10_000) -> DataFrame:
    """The ``most`` entries of the latest times."""
    return history.orderBy(F.col("ts").desc_nulls_last(), "url").limit(most)


def content_changed(pages: DataFrame, history: DataFrame, mode: str = "content_hash", tolerance: int = 50, on: tuple[str, ...] = ("url",)) -> DataFrame:
    """``url, changed``, a row a page: by MD5, or by a length that differs by more than ``tolerance`` (the true length is kept). Unknown pages are changed.

    ``on`` is what a page is known by, where several pages have one URL. Where the history has several entries of a page,
    it is unchanged if it is like any of them. Digests and lengths are joined, not contents.
    """
    keys = list(dict.fromkeys((*on, "url")))
    if mode == "length":
        seen = pages.select(*keys, F.length("content").alias("_n"))
        old = history.where("length is not null").groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.collect_set("length").alias("_old"))  # at most as many as there are lengths
        like, differs = F.lit(True), F.coalesce(~F.exists("_old", lambda x: F.abs(x - F.col("_n")) <= tolerance), F.lit(True))
    else:
        seen = pages.select(*keys, F.md5(F.col("content").cast("binary")).alias("_n"))
        old = history.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("hash").alias("_h")).distinct().withColumn("_known", F.lit(True))
        like, differs = F.col("_n").eqNullSafe(F.col("_h")), F.col("_known").isNull()
    for c in on:
        like = like & (F.col(c) == F.col(f"_{c}"))
    return seen.join(old, like, "left").select("url", differs.alias("changed"))


def rate_gate(log: DataFrame, domain: str, ts: str, seconds: float, tie: str | None = None) -> DataFrame:
    """Each request with whether its domain's interval had passed since the request before.

    Only the gap to the one before counts, as every request is recorded; of requests of one time that with the smallest
    ``tie`` is first. The order is made by a range sort over all domains, and each request is joined with the rank before
    it, so a hot domain is spread over tasks. Requests without a domain are of one domain.
    """
    placed = cut(ranked(log, [F.col(c) for c in (domain, ts, *([tie] if tie else []))]))
    before = placed.select((F.col("rank") + 1).alias("rank"), F.col(domain).alias("_d"), F.col(ts).alias("_t"), F.lit(True).alias("_same"))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp"))
    same = F.col("_same") & F.col(domain).eqNullSafe(F.col("_d"))
    joined = placed.join(before, "rank", "left").withColumn("allowed", F.coalesce(F.when(same, gap >= int(seconds * 1e6)), F.lit(True)))
    return joined.select(*log.columns, "allowed")


def adaptive_interval(log: DataFrame, response: str, order: str, start: float = 1.0, least: float = 1.0, most: float = 30.0, target: float = 2.0, stretch: int = 5000) -> DataFrame:
    """The interval after all responses: half as long again when slow, a fifth less when quick, within bounds.

    The fold is a chain of clamped multiplications x -> min(hi, max(lo, a x)). Such maps are closed under composition, so
    each ``stretch`` of the log by rank is folded into one map by itself, then each stretch of maps, until one is left.
    """
    rows = log.where(F.col(response) > 0).select(F.col(order).alias("o"), F.col(response).cast("double").alias("r"))
    factor = F.when(F.col("r") > 2 * target, 1.5).when(F.col("r") < 0.5 * target, 0.8).otherwise(1.0)
    one = F.struct(F.lit(1.0).alias("a"), F.lit(float(least)).alias("lo"), F.lit(float(most)).alias("hi"))
    step = F.struct(factor.alias("a"), F.lit(float(least)).alias("lo"), F.lit(float(most)).alias("hi"))
    maps = cut(ranked(rows, [F.col("o")]).select("rank", step.alias("m")))

    def then(first, second):
        def through(x):
            return F.least(second["hi"], F.greatest(second["lo"], second["a"] * x))

        return F.struct((first["a"] * second["a"]).alias("a"), through(first["lo"]).alias("lo"), through(first["hi"]).alias("hi"))

    while maps.count() > 1:
        groups = maps.groupBy(F.floor(F.col("rank") / stretch).alias("rank")).agg(F.array_sort(F.collect_list(F.struct("rank", "m"))).alias("ms"))
        maps = cut(groups.select("rank", F.aggregate("ms", one, lambda acc, x: then(acc, x["m"])).alias("m")))
    value = F.least(F.col("m")["hi"], F.greatest(F.col("m")["lo"], F.col("m")["a"] * F.lit(float(start))))
    return maps.agg(F.coalesce(F.max(value), F.lit(float(start))).alias("interval"))


def hook_stats(log: DataFrame, success: str, elapsed: str) -> DataFrame:
    """Calls, successes, failures, the rate and the mean time of the successes."""
    ok = F.col(success)
    n = F.count("*")
    good = F.count_if(ok)
    return log.agg(
        n.alias("total"), good.alias("success"), (n - good).alias("failed"), F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col(elapsed))), F.lit(0.0)).alias("avg_time"),
    )


def history_stats(history: DataFrame) -> DataFrame:
    """URLs visited and distinct contents."""
    hashes = history.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n")).agg(F.count("*").alias("total_hashes"))
    return history.agg(F.count("*").alias("total_visited")).join(F.broadcast(hashes))  # one row each
