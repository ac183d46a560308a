"""Cleaning, rules, projections and the choice of an output format."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules in order: rename, remove, replace, truncate, lowercase, uppercase, extract. Fields that are absent are passed over."""
    for rule in rules:
        name, action = rule["field"], rule["action"]
        if name not in df.columns:
            continue
        c = F.col(f"`{name}`")
        if action == "rename":
            if rule.get("new_name"):
                df = (df.drop(rule["new_name"]) if rule["new_name"] != name else df).withColumnRenamed(name, rule["new_name"])
            continue
        if action == "remove":
            df = df.drop(name)
            continue
        if not isinstance(df.schema[name].dataType, T.StringType):
            continue
        if action == "replace":
            given = re.sub(r"\\(\d+)", r"$\1", rule.get("replacement", "").replace("$", r"\$"))
            df = df.withColumn(name, F.regexp_replace(c, rule["pattern"], given))
        elif action == "truncate":
            df = df.withColumn(name, X.truncate(c, rule.get("max_length", 100), rule.get("suffix", "...")))
        elif action in ("lowercase", "uppercase"):
            df = df.withColumn(name, F.lower(c) if action == "lowercase" else F.upper(c))
        elif action == "extract":
            groups = re.compile(rule["pattern"]).groups
            if groups >= 2:
                df = df.withColumn(name, F.array(*[F.regexp_extract(c, rule["pattern"], i) for i in range(1, groups + 1)]))
            else:
                df = df.withColumn(name, F.regexp_extract(c, rule["pattern"], groups))
    return df


def clean(df: DataFrame, rules: list[dict] | None = None, strip_html: bool = True, fix_encoding: bool = True, normalize: bool = True) -> DataFrame:
    """Every text column without markup (where it has some), composed and with ordinary white space; then the rules."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            c = raw = F.col(f"`{f.name}`")
            if strip_html:
                c = F.when(c.contains("<") & c.contains(">"), X.strip_html(c)).otherwise(c)
            if fix_encoding:
                c = X.fix_encoding(c)
            if normalize:
                c = X.normalize_whitespace(c)
            out[f.name] = F.when(raw.isNotNull(), c)
    return apply_rules(df.withColumns(out) if out else df, rules or [])


def remove_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which anything is left; white space is something."""
    kept = F.lit(False)
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            c = F.col(f"`{f.name}`")
            kept = kept | (c.isNotNull() & (c != "") if isinstance(f.dataType, T.StringType) else c.isNotNull())
    return df.where(kept)


def quality_filter(df: DataFrame, fields: list[str], threshold: float = 0.3) -> DataFrame:
    return df.where(X.quality_score(*[F.col(c) for c in fields]) >= threshold)


def clean_batch(df: DataFrame, rules: list[dict] | None = None, fields: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Cleaned, of enough quality if fields are given, and not empty."""
    out = clean(df, rules)
    return remove_empty(quality_filter(out, fields, threshold) if fields else out)


def clean_stats(df: DataFrame, text: str, threshold: float = 0.3) -> DataFrame:
    """Counts of one pass: processed, stripped of markup, of low quality, removed."""
    c = F.col(text)
    marked = df.select(c.alias("t"), (c.contains("<") & c.contains(">")).alias("html"), X.quality_score(c).alias("q"))
    return marked.agg(
        F.count("*").alias("processed"), F.count_if("html").alias("html_stripped"), F.lit(0).cast("long").alias("encoding_fixed"),
        F.count_if(F.col("q") < threshold).alias("low_quality"), F.count_if((F.coalesce("t", F.lit("")) == "") | (F.col("q") < threshold)).alias("items_removed"),
    )


def project(df: DataFrame, fields: list[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """The fields asked for that exist, in that order; renamed ones go to the end and replace those of that name."""
    names = [(c, c) for c in (fields or df.columns) if c in df.columns]
    for old, new in (mapping or {}).items():
        at = next((i for i, (_, shown) in enumerate(names) if shown == old), None)
        if at is not None and old != new:
            source = names.pop(at)[0]
            names = [(s, shown) for s, shown in names if shown != new] + [(source, new)]
    return df.select(*[F.col(f"`{s}`").alias(shown) for s, shown in names])


IMAGE = r"(?i)https?://\S+?\.(?:bmp|gif|jpe?g|png|svg|webp)"
MARKDOWN = r"(?m)```|\[[^\n]+?\]\([^\n]+?\)|__|\*\*|^(?:[*>]|#{1,6}|[0-9]+\.)\s"


def _features(df: DataFrame, order: str, sample: int, long_text: int) -> DataFrame:
    """One row of what the choice of a format rests on, from at most ``sample`` rows at even strides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "ord"]
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    fields = [c for c in df.columns if c != "ord"]  # a column of that name is only there for the order
    n = df.count()
    step = max(1, n // sample) if n > sample else 1
    # the rows at ranks 0, step, 2 step, ...: a range sort, then the ranks of what is at most the sample's reach
    placed = df.orderBy(order).limit(step * (min(sample, n) - 1) + 1 if n else 0) if step == 1 else _at_ranks(df, order, [i * step for i in range(sample)])

    def total(f) -> Column:
        return sum((F.coalesce(f(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0))

    row = placed.select(
        F.lit(bool(nested)).alias("nested"), total(lambda c: (X.strip(c) != "").cast("int")).alias("filled"), F.lit(len(fields)).alias("fields"), total(F.length).alias("size"),
        total(lambda c: (F.length(c) > long_text).cast("int")).alias("long"), total(lambda c: c.rlike(IMAGE).cast("int")).alias("images"),
        total(lambda c: F.length(c) - F.length(F.translate(c, ",\n", ""))).alias("special"), total(lambda c: F.regexp_count(c, F.lit("<[^>]+>"))).alias("tags"),
        total(lambda c: F.regexp_count(c, F.lit(MARKDOWN))).alias("marks"), (F.coalesce(F.length("text"), F.lit(0)) > 200 if "text" in texts else F.lit(False)).alias("article"),
    )
    sums = row.agg(*[F.sum(c).alias(c) for c in ("filled", "fields", "size", "long", "images", "special", "tags", "marks")], F.count("*").alias("rows"), F.max("nested").alias("nested"), F.max("article").alias("article"))
    return sums.withColumns({"n": F.lit(n), "width": F.lit(len(fields))})


def _at_ranks(df: DataFrame, order: str, ranks: list[int]) -> DataFrame:
    """Rows at the given ranks by ``order``; the order of the keys alone is made, and the rows fetched by key."""
    from tidemark.session import cut

    placed = cut(df.select(order).orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, wanted = 0, []
    for p in sorted(sizes):
        wanted += [(p << 33) + r - before for r in ranks if before <= r < before + sizes[p]]
        before += sizes[p]
    return df.join(F.broadcast(placed.where(F.col("_at").isin(wanted)).select(order)), order, "left_semi")  # as many rows as ranks


def auto_format(df: DataFrame, order: str = "ord", prefer: str = "balanced", sample: int = 30, long_text: int = 500, readable: int = 200, fill: float = 0.8, special: float = 0.05, disabled: tuple[str, ...] = ()) -> DataFrame:
    """``format``: json, csv, markdown, txt or docx, by the decision tree or, with ``prefer='weighted'``, by scores."""
    f = _features(df, order, sample, long_text)
    n, size, rows = F.col("n"), F.coalesce("size", F.lit(0)), F.greatest("rows", F.lit(1))
    avg, texty = size / rows, F.greatest(size, F.lit(1))
    rate, cells = F.coalesce("filled", F.lit(0)), F.greatest(F.coalesce("fields", F.lit(0)), F.lit(1))
    html, marks, commas = F.col("tags") / texty, F.col("marks") / rows, F.col("special") / texty

    def pick(*names: str) -> str:
        return next((x for x in names if x not in disabled), "json")

    if prefer == "weighted":
        points = {
            "json": F.when(avg < 50, 1).otherwise(0) + F.when(rate / cells > 0.8, 1).otherwise(0) + F.when(n > 200, 2).otherwise(0) + F.when(F.col("width") > 15, 2).otherwise(0) + F.when(html > 0.1, 3).otherwise(0),
            "csv": F.when(avg > 300, -2).when(avg < 50, 2).otherwise(0) + F.when(rate / cells > 0.8, 3).otherwise(0) + F.when(n > 200, 2).otherwise(0) - F.when(F.col("width") > 15, 1).otherwise(0) - F.when(commas > 0.05, 3).otherwise(0),
            "markdown": F.when(avg > 300, 3).otherwise(0) + F.when((F.col("images") > 0) & (n <= 50), 2).otherwise(0) - F.when(n > 200, 2).otherwise(0) + F.when(commas > 0.05, 1).otherwise(0)
            - F.when(html > 0.1, 1).otherwise(0) + F.when(marks > 0.3, 3).otherwise(0) + F.when(F.col("long") >= 2, 2).otherwise(0),
            "txt": F.when(avg > 300, 2).otherwise(0) + F.when(F.col("long") >= 2, 1).otherwise(0),
            "docx": F.when((F.col("images") > 0) & (n <= 50), 5).otherwise(0),
        }
        ranked = [F.struct(p.alias("p"), F.lit(-i).alias("i"), F.lit(name).alias("f")) for i, (name, p) in enumerate(points.items()) if name not in disabled]
        best = F.array_max(F.array(*ranked))["f"] if ranked else F.lit("json")
        return f.select(F.when(F.coalesce("rows", F.lit(0)) == 0, "json").when(F.col("nested"), "json").otherwise(best).alias("format"))
    long_ = (avg > 300) | (F.col("long") >= 2)
    tree = (
        F.when(F.coalesce("rows", F.lit(0)) == 0, "json")
        .when(F.col("nested"), F.when(F.col("article") & (n <= 100), pick("markdown")).otherwise("json"))
        .when((F.col("images") > 0) & (n <= 50), pick("docx", "markdown"))
        .when(long_ & (html > 0.1), "json")
        .when(long_ & (marks > 0.3) & F.lit("markdown" not in disabled), "markdown")
    )
    if prefer == "readability":
        tree = tree.when(long_, F.when((n <= readable) & F.lit("markdown" not in disabled), "markdown").otherwise("json"))
    tree = tree.when(long_, F.when((n <= 100) & (F.col("width") <= 10), pick("markdown")).otherwise("json"))
    return f.select(tree.when((avg <= 200) & (rate / cells >= fill) & (commas < special), pick("csv")).otherwise("json").alias("format"))
