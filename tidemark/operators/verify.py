"""Verification of a dataset: fields, duplicates, quality, blocked pages, pagination, snapshots and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.simhash import hash_last
from tidemark.functions.text import strip
from tidemark.functions.urls import page_number
from tidemark.session import cut, ranked, ship


def alias_chain(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist whose text isn't empty; null where all are."""
    there = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _empty(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def _length(field: T.StructField) -> Column:
    """Of text; of anything else, of what it is written as: JSON with spaces for nested values, True and False for booleans."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.length(c)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.length(F.regexp_replace(F.to_json(c), r'("(?:[^"\\]|\\.)*")|([,:])', "$1$2 ")) - F.regexp_count(F.to_json(c), F.lit(r'"(?:[^"\\]|\\.)*"'))
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c, 4).otherwise(5)
    return F.length(c.cast("string"))


def field_stats(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """A row a field: counts and rates of filled and null, lengths, and whether it is required (by default, all columns).

    All fields are folded in one pass: one aggregate of a struct a field, then turned on its side.
    """
    cols = []
    for f in df.schema.fields:
        n = _length(f).cast("long")
        n = F.when(~_empty(f), n)
        cols.append(
            F.struct(
                F.lit(f.name).alias("field"), F.count(n).alias("fill"), F.count("*").alias("rows"), F.sum(n).alias("total"), F.min(n).alias("low"), F.max(n).alias("high"),
                F.lit(required is None or f.name in required).alias("is_required"),
            )
        )
    one = df.agg(F.array(*cols).alias("f")).select(F.explode("f").alias("f")).select("f.*").where("rows > 0")
    rate = F.bround(F.col("fill") / F.col("rows"), 4)
    return one.select(
        "field", F.col("fill").alias("fill_count"), (F.col("rows") - F.col("fill")).alias("null_count"), rate.alias("fill_rate"),
        F.bround(1 - F.col("fill") / F.col("rows"), 4).alias("null_rate"), F.coalesce(F.round(F.col("total") / F.col("fill"), 1), F.lit(0.0)).alias("avg_length"),
        F.coalesce("low", F.lit(0)).cast("long").alias("min_length"), F.coalesce("high", F.lit(0)).cast("long").alias("max_length"), "is_required",
    )


def null_alerts(stats: DataFrame, threshold: float = 0.3) -> DataFrame:
    return stats.where(F.col("null_rate") > threshold)


def key_presence(lines: DataFrame, column: str) -> DataFrame:
    """Keys of JSON objects, in how many rows each is, and whether in more than half."""
    total = lines.agg(F.count("*").alias("n"))
    keys = lines.select(F.explode(F.array_distinct(F.json_object_keys(column))).alias("key")).groupBy("key").agg(F.count("*").alias("present"))
    return keys.join(F.broadcast(total)).select("key", "present", (F.col("present") * 2 > F.col("n")).alias("is_core"))


def _lookback(hashed: DataFrame, threshold: int, rows: int = 200) -> DataFrame:
    """How many hashes (``o, h``) are 1 to ``threshold`` bits from one of the ``rows`` before them.

    Ranks are cut into stretches, and each stretch also gets the ``rows`` ranks before it, so no single task orders all.
    """
    placed = ranked(hashed, [F.col("o")]).select(F.col("rank").alias("r"), "h")
    stretch = max(10 * rows, 1)
    home = F.floor(F.col("r") / stretch)
    halo = F.floor((F.col("r") + rows) / stretch)
    spread = placed.select("r", "h", F.explode(F.array_distinct(F.array(home, halo))).alias("s"))
    frame = Window.partitionBy("s").orderBy("r").rowsBetween(-rows, -1)
    prior = spread.withColumn("prior", F.collect_list("h").over(frame)).where(F.floor(F.col("r") / stretch) == F.col("s"))
    gap = lambda x: F.bit_count(F.col("h").bitwiseXOR(x))
    return prior.agg(F.count_if(F.exists("prior", lambda x: gap(x).between(1, threshold))).alias("near"))


def dup_counts(df: DataFrame, order: str = "ord", threshold: int = 5, min_length: int = 20) -> DataFrame:
    """URL and content duplicates, rows near to one of the 200 before, unique rows and the total."""
    url = strip(alias_chain(df, "url", "link", "href"))
    content = alias_chain(df, "content", "text", "body", "title")
    # one pass over the texts: what goes on is a row of digests and a hash
    ship(df.sparkSession)
    seen = df.select(F.col(order).alias("o"), F.md5(url.cast("binary")).alias("u"), F.md5(content.cast("binary")).alias("c"), F.when(F.length(content) > min_length, content).alias("t"))
    kind = df.schema[order].dataType.simpleString()
    rows = cut(seen.mapInArrow(hash_last, f"o {kind}, u string, c string, h long"))

    def repeated(x: str) -> DataFrame:
        groups = rows.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n"))
        return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(x))

    u, c = repeated("u"), repeated("c")
    near = _lookback(rows.where("h is not null").select("o", "h"), threshold)
    one = rows.agg(F.count("*").alias("n")).join(F.broadcast(u)).join(F.broadcast(c)).join(F.broadcast(near))  # one row each
    return one.select(
        F.col("u").alias("url_duplicates"), F.col("c").alias("content_duplicates"), F.col("near").alias("near_duplicates"),
        (F.col("n") - F.greatest("u", "c")).alias("unique_count"), F.col("n").alias("total"),
    )


GARBLED = "[\\x0e-\\x1f\\x0b\\x0c\\x00-\\x08]{3,}|\ufffd{2,}"
CUT_SHORT = "(?d)[a-zA-Z一-鿿][,;:，、；：]$|…$|\\\\$"


def quality_counts(df: DataFrame, min_length: int = 50) -> DataFrame:
    """Too short, residual markup, garbled and cut short; one pass."""
    t = F.coalesce(alias_chain(df, "content", "text", "body", "description", "summary"), F.lit(""))
    return df.select(t.alias("t")).agg(
        F.count_if((F.length("t") > 0) & (F.length("t") < min_length)).alias("too_short"), F.count_if(F.col("t").rlike("<[/A-Za-z][^>]*>")).alias("has_html_residue"),
        F.count_if(F.col("t").rlike(GARBLED)).alias("has_garbled"), F.count_if((F.length("t") > 200) & F.col("t").substr(F.length("t") - 4, F.lit(5)).rlike(CUT_SHORT)).alias("suspected_truncated"),
        F.count("*").alias("total"),
    )


BLOCK_WORDS = (
    "403", "429", "access denied", "blocked", "captcha", "forbidden", "please verify", "rate limit", "robot check", "too many requests",
    "人机验证", "安全验证", "访问受限", "请求过于频繁", "验证码",
)
ERROR_PAGE = r"404|50[023]|not\s+found|server\s+error|service\s+unavailable|页面不存在|服务器错误|服务不可用"
CJK = "[一-鿿぀-ヿ가-힯]"


def suspect_page(title: Column, content: Column) -> Column:
    """Words of a blocked or error page in the title or the first 500 characters, or next to nothing."""
    low, t = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    seen = F.concat(t, F.lit(" "), F.substring(low, 1, 500))
    words = seen.rlike("|".join([*BLOCK_WORDS, ERROR_PAGE]))
    return words | ((F.length(low) < 30) & ~low.rlike(CJK) & (F.length(strip(low)) < 10))


def antibot_counts(df: DataFrame, order: str = "ord", samples: int = 5) -> DataFrame:
    """Suspected pages, the first few of them and the total; the samples come of a bounded top-k aggregate."""
    content = alias_chain(df, "content", "text", "body")
    title = alias_chain(df, "title")
    flagged = df.select(F.col(order).alias("o"), suspect_page(title, content).alias("bad"), F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(content, F.lit(""))).alias("c"))
    shown = F.substring(F.when(F.col("t") != "", F.col("t")).when(F.col("c") != "", F.col("c")).otherwise("(empty)"), 1, 80)
    first = flagged.where("bad").orderBy("o").limit(samples).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", shown.alias("s")))), lambda x: x["s"]).alias("samples"))
    counts = flagged.agg(F.count_if("bad").alias("suspected_pages"), F.count("*").alias("total"))
    return counts.join(F.broadcast(first)).select("suspected_pages", "samples", "total")


def page_counts(df: DataFrame) -> DataFrame:
    """``page, rows``: rows of each page number, from a page column or else the URL; rows without one are left out."""
    aliases = [F.when(F.try_to_number(F.col(n).cast("string"), F.lit("9" * 18)) != 0, F.try_to_number(F.col(n).cast("string"), F.lit("9" * 18)).cast("long")) for n in ("page", "page_num", "pageNum") if n in df.columns]
    by_url = page_number(F.coalesce(alias_chain(df, "url", "link"), F.lit("")))
    return df.select(F.coalesce(*aliases, by_url).alias("page")).where("page is not null").groupBy("page").agg(F.count("*").alias("rows"))


def page_gaps(df: DataFrame) -> DataFrame:
    """``first, last``: the ranges of page numbers that are missing between others, however wide they are."""
    placed = cut(ranked(page_counts(df).select("page"), [F.col("page")]))
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("page").alias("next"))
    return placed.join(after, "rank").where(F.col("next") > F.col("page") + 1).select((F.col("page") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def page_summary(df: DataFrame) -> DataFrame:
    """One row: pages, the first, the last and how many are missing between; nulls where no row has a page number."""
    missing = F.col("last_page") - F.col("first_page") + 1 - F.col("total_pages")
    one = page_counts(df).agg(F.count("*").alias("total_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return one.select("total_pages", "first_page", "last_page", missing.alias("missing"))


def snapshot_diff(base: DataFrame, current: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keys added, removed and changed, and the rows of both sides. Of repeated keys the last counts; empty keys are left out."""
    cols = [c for c in base.columns if c in current.columns and c != order]

    def last(df: DataFrame, name: str) -> DataFrame:
        k = alias_chain(df, *key)
        picked = df.select(k.alias("_k"), F.struct(*cols).alias("_v"), F.col(order).alias("_o")).where("_k is not null")
        return picked.groupBy("_k").agg(F.max_by("_v", "_o").alias(name))

    both = last(base, "a").join(last(current, "b"), "_k", "full_outer")
    counts = both.agg(
        F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
    )
    rows = base.agg(F.count("*").alias("baseline_count")).join(F.broadcast(current.agg(F.count("*").alias("current_count"))))
    return counts.join(F.broadcast(rows))


def reconcile(df: DataFrame, expected: int) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("actual"), F.lit(expected).cast("long").alias("expected"), (F.lit(expected) - n).alias("missing"), F.when(n == expected, "ok").otherwise("warning").alias("status"))


def verify(df: DataFrame, order: str = "ord", expected: int | None = None, baseline: DataFrame | None = None, key: tuple[str, ...] = ("url", "id", "link"), null_rate: float = 0.3, gaps: int = 100) -> dict:
    """The whole report as a dictionary: status, warnings, errors and the sections above, with the first ``gaps`` ranges of missing pages."""
    df = cut(df)
    stats = [r.asDict() for r in field_stats(df).collect()]
    total = stats[0]["fill_count"] + stats[0]["null_count"] if stats else 0
    if not total:
        return {"status": "error", "errors": ["no rows"], "warnings": [], "details": {}}
    details = {"fields": stats}
    for name, section in (("duplicates", dup_counts(df, order)), ("quality", quality_counts(df)), ("blocked", antibot_counts(df, order)), ("pagination", page_summary(df))):
        details[name] = section.first().asDict()
    warnings = [f"null rate of {s['field']}: {s['null_rate']}" for s in stats if s["null_rate"] > null_rate]
    warnings += [f"{k}: {details['duplicates'][k]}" for k in ("url_duplicates", "content_duplicates", "near_duplicates") if details["duplicates"][k]]
    warnings += [f"{k}: {v}" for k, v in details["quality"].items() if k != "total" and v]
    if details["pagination"]["missing"]:
        details["pagination"]["gaps"] = [tuple(r) for r in page_gaps(df).orderBy("first").limit(gaps).collect()]
        warnings.append(f"missing pages: {details['pagination']['missing']}, the first of them {details['pagination']['gaps']}")
    errors = [f"suspected pages: {details['blocked']['suspected_pages']}"] if details["blocked"]["suspected_pages"] else []
    if expected is not None and expected != total:
        details["reconciliation"] = {"expected": expected, "actual": total, "missing": expected - total}
        warnings.append(f"expected {expected} rows, found {total}")
    if baseline is not None:
        details["diff"] = snapshot_diff(baseline, df, list(key), order).first().asDict()
    return {"status": "error" if errors else "warning" if warnings else "ok", "errors": errors, "warnings": warnings, "details": details}
