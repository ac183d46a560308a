"""Walks over a table of pages in place of a fetcher: next pages, and lists with their details."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import next_page_url, page_pattern
from tidemark.html.parser import parse_pages
from tidemark.session import cut, ship


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str | None], url: str = "url") -> DataFrame:
    """``url, html, error`` of every distinct URL by an injected fetcher, called where the rows are; null html where it gives none or fails."""
    ship(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for u in frame["url"]:
                try:
                    rows.append((u, fetch(u), None))
                except Exception as e:  # a fetch that fails is data
                    rows.append((u, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"], dtype=object)

    return urls.select(F.col(url).alias("url")).where("url is not null").distinct().mapInPandas(run, "url string, html string, error string")


def paginate_walk(
    starts: DataFrame, pages: DataFrame | Callable[[str], str | None], next_url: str | None = None, max_pages: int = 20, max_empty: int = 2, mode: str = "auto", go_on: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """``start, step, url, stop``: the pages of each start (column ``url``), and on the last row why the walk stopped.

    ``pages`` is a table (url, html) or a fetcher, which is asked for the frontier's pages alone. The next page comes of the
    column ``next_url`` of the table, or, of fetched pages in the mode ``next_link``, of their links, or of the URL's pattern. ``go_on`` is a
    condition on (url, html) under which a walk goes on behind a page. Each round joins the frontier with the pages: all
    walks go a page on at a time. Reasons: max_pages, duplicate_url, fetch_failed, consecutive_empty, callback_stopped, and
    where there is no next page no_more_pages, or in the modes ``pattern`` pattern_lost and ``next_link`` no_next_link.
    """
    ended = {"pattern": "pattern_lost", "next_link": "no_next_link"}.get(mode, "no_more_pages")
    onward = F.coalesce(go_on(F.col("url"), F.col("html")), F.lit(False)) if go_on else F.lit(True)

    def known(front: DataFrame) -> DataFrame:
        table, to = pages, F.col(next_url) if next_url else next_page_url(F.col("url"))
        if not isinstance(pages, DataFrame):
            table = cut(fetch_pages(front, pages).where("html is not null"))
            if mode == "next_link":
                table, to = parse_pages(table.withColumn("_p", F.col("url")), ("next_link",), "_p").select(F.col("_p").alias("url"), "next_link").join(table, "url"), F.col("next_link")
        rows = table.select(F.col("url").alias("p"), F.struct(F.length("html").alias("size"), to.alias("to"), onward.alias("onward")).alias("r"))
        return rows.groupBy("p").agg(F.max("r").alias("r")).select("p", "r.*")  # of pages of one URL the longest, whichever is read first

    front = starts.select(F.col("url").alias("start"), "url", F.array(F.col("url")).alias("seen"), F.lit(0).alias("empty"))
    out = None
    for step in range(max_pages):
        got = front.join(known(front), F.col("url") == F.col("p"), "left")
        empty = F.when(F.coalesce("size", F.lit(0)) == 0, F.col("empty") + 1).otherwise(0)
        stop = (
            F.when(F.col("p").isNull(), "fetch_failed").when(empty >= max_empty, "consecutive_empty").when(~F.col("onward"), "callback_stopped").when(F.col("to").isNull(), ended)
            .when(F.array_contains("seen", F.col("to")), "duplicate_url").when(F.lit(step + 1 >= max_pages), "max_pages")
        )
        got = cut(got.select("start", F.lit(step).alias("step"), "url", stop.alias("stop"), "to", "seen", empty.alias("empty")))
        rows = got.select("start", "step", "url", "stop")
        out = rows if out is None else out.union(rows)
        front = got.where("stop is null").select("start", F.col("to").alias("url"), F.concat("seen", F.array("to")).alias("seen"), "empty")
        if front.isEmpty():
            break
    return out


def list_detail(lists: DataFrame, pages: DataFrame, links: str = "links", most: int = 20) -> DataFrame:
    """``list_url, rank, url, html``: of each list (``url, links``) the first so many distinct links, with the pages that exist."""
    each = lists.select(F.col("url").alias("list_url"), F.posexplode(F.array_distinct(links)).alias("rank", "url")).where(F.col("rank") < most)
    return each.join(pages.select("url", "html"), "url").select("list_url", "rank", "url", "html")


def top_details(edges: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first so many rows of each group."""
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def detect_pagination(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, method, next_url, pagination_urls, page_number, total_pages`` of each page.

    The URL's pattern says first; a rel=next link of the head overrides it; links that look like next ones count where
    neither is there.
    """
    found = parse_pages(pages, ("pagination", "head_next", "next_link", "total_pages"), key, url, html)
    pattern = page_pattern(F.col("url"))
    by_url = next_page_url(F.col("url"))
    method = F.when(F.col("head_next").isNotNull(), "link_rel").when(pattern.isNotNull(), "url_pattern").when(F.col("next_link").isNotNull(), "selector").otherwise("none")
    following = F.coalesce("head_next", F.when(pattern.isNotNull(), by_url).otherwise(F.col("next_link")))
    return found.select(
        key, "url", method.alias("method"), following.alias("next_url"), F.array_sort(F.array_distinct("pagination.all_pages")).alias("pagination_urls"),
        F.coalesce(pattern["current_page"], F.lit(1)).cast("long").alias("page_number"), "total_pages",
    )
