"""Every page extractor over a page a customer, made of a template: the SQL says what was put in. And real pages where SQL can read them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.html import parser as P
from tidemark.operators import crawl
from tidemark.plans.corpus import table
from tidemark.session import spread

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


#: {k} is the customer's key, {n} its nation, {s} its segment, {t} its name, {q} a number from 2 to 6.
TEMPLATE = """<html><head><base href="http://b.example/n{n}/"><title>{t} | Shop</title><meta name="description" content=" about {t} "><meta name="keywords" content="{s},k">
<meta property="article:author" content="A{n}"><meta name="twitter:card" content="card{k}"><meta property="og:image" content="i{k}.png"><link rel="next" href="/next/{k}">
<script type="application/ld+json">{{"@type":"VideoObject","name":"V{k}","contentUrl":"/v{k}.mp4"}}</script><script type="application/ld+json">{{bad</script></head><body>
<nav><a href="/home">Home</a></nav><div itemscope itemtype="http://schema.org/Person"><span itemprop="name">{t}</span></div>
<article><h1>{t} &amp; co</h1><p>Of {t} in the segment {s} there is enough to say here that the text is taken as it stands and is not looked for again.</p><h2>{s}</h2><h2></h2><h3>n{n}</h3>
<img src="a{k}.png" srcset="b{k}.png 1x, c{k}.png 2x" data-src="l{k}.png"><img src="data:x"><a href="item/{k}">buy</a><a href="#x">x</a><a href="javascript:1">j</a><a href="mailto:m">m</a><a href="f{k}.mp4">clip</a>
<table><thead><tr><th>key</th><th>segment</th></tr></thead><tbody><tr><td>{k}<td>{s}</tr><tr><td>n</td><td>{n}</td></tr></tbody></table></article>
<ul class="comments"><li class="comment"><cite>{t}</cite><p>said {k}</p><time datetime="2024-01-{n}">x</time></li></ul>
<div class="pagination"><a href="?p=1">1</a><span class="active">{q}</span><a href="?p={q}9">more</a></div><a class="next" href="/after/{k}">on</a>
<iframe src="https://www.youtube.com/embed/y{k}" title="T{k}"></iframe></body></html>"""


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x.replace("{{", "{").replace("}}", "}")) for i, x in enumerate(parts)])


def shop(spark, d: str) -> DataFrame:
    """``page_id, url, html``: a page a customer."""
    c = table(spark, d, "customer")
    html = filled(TEMPLATE, k=F.col("c_custkey"), n=F.col("c_nationkey"), s=F.col("c_mktsegment"), t=F.col("c_name"), q=F.pmod(F.col("c_custkey"), F.lit(5)) + 2)
    url = F.concat(F.lit("http://shop.example/c/"), "c_custkey", F.lit("?page="), F.pmod(F.col("c_custkey"), F.lit(7)) + 1)
    return spread(c.select(F.col("c_custkey").alias("page_id"), url.alias("url"), html.alias("html")))


def _of_shop(name: str, extractor: str, cols, sql: str) -> None:
    def run(spark, d):
        return P.parse_pages(shop(spark, d), (extractor,)).select("page_id", *cols())

    query(name, f"SELECT c_custkey AS page_id, {sql} FROM customer")(run)


B = "'http://b.example/n' || c_nationkey || '/'"
K, T, S, Q = "c_custkey", "c_name", "c_mktsegment", "(c_custkey % 5 + 2)"

_of_shop(
    "parse_links", "links", lambda: [F.array_join("links", " ").alias("links")],
    f"""'http://b.example/after/' || {K} || ' http://b.example/home ' || array_to_string(list_sort([{B} || '?p=1', {B} || '?p=' || {Q} || '9', {B} || 'f' || {K} || '.mp4', {B} || 'item/' || {K}]), ' ') AS links""",
)
_of_shop(
    "parse_images", "images", lambda: [F.array_join("images", " ").alias("images")],
    f"""{B} || 'a' || {K} || '.png ' || {B} || 'l' || {K} || '.png ' || {B} || 'b' || {K} || '.png ' || {B} || 'c' || {K} || '.png' AS images""",
)
_of_shop("parse_metadata", "metadata", lambda: ["metadata.*"], f"'about ' || {T} AS description, {S} || ',k' AS keywords, 'A' || c_nationkey AS author")
_of_shop(
    "parse_headings", "headings", lambda: [F.array_join(F.col(f"headings.{h}"), "|").alias(h) for h in ("h1", "h2", "h3")],
    f"{T} || ' & co' AS h1, {S} AS h2, 'n' || c_nationkey AS h3",
)
_of_shop(
    "parse_schema_org", "schema_org", lambda: [F.array_join("schema_org", "|").alias("found")],
    f"""'{{"@type": "VideoObject", "contentUrl": "/v' || {K} || '.mp4", "name": "V' || {K} || '"}}|{{"@type": "Person", "name": "' || {T} || '"}}' AS found""",
)
_of_shop("parse_open_graph", "open_graph", lambda: [F.col("open_graph")["og:image"].alias("image"), F.size("open_graph").alias("n")], f"'i' || {K} || '.png' AS image, 1::INT AS n")
_of_shop("parse_twitter_card", "twitter_card", lambda: [F.col("twitter_card")["twitter:card"].alias("card"), F.size("twitter_card").alias("n")], f"'card' || {K} AS card, 1::INT AS n")
_of_shop(
    "parse_tables", "tables", lambda: [F.size("tables").alias("n"), F.array_join(F.col("tables")[0]["headers"], "|").alias("headers"), F.array_join(F.transform(F.col("tables")[0]["rows"], lambda r: F.array_join(r, "|")), "/").alias("rows")],
    f"1::INT AS n, 'key|segment' AS headers, {K} || '|' || {S} || '/n|' || c_nationkey AS rows",
)
_of_shop(
    "parse_comments", "comments", lambda: [F.size("comments").alias("n"), *[F.col("comments")[0][x].alias(x) for x in ("author", "text", "date")]],
    f"1::INT AS n, {T} AS author, 'said ' || {K} AS text, '2024-01-' || c_nationkey AS date",
)
_of_shop(
    "parse_pagination", "pagination", lambda: ["pagination.next_url", "pagination.prev_url", F.array_join("pagination.all_pages", " ").alias("all_pages"), "pagination.current_page"],
    f"'http://b.example/next/' || {K} AS next_url, NULL::VARCHAR AS prev_url, {B} || '?p=1 ' || {B} || '?p=' || {Q} || '9' AS all_pages, {Q}::INT AS current_page",
)
_of_shop(
    "parse_srcset", "srcset_images", lambda: [F.array_join(F.transform("srcset_images", lambda x: F.concat_ws(" ", x["url"], x["descriptor"], x["source_img_src"])), "|").alias("found")],
    f"{B} || 'b' || {K} || '.png 1x a' || {K} || '.png|' || {B} || 'c' || {K} || '.png 2x a' || {K} || '.png' AS found",
)
_of_shop(
    "parse_videos", "videos", lambda: [F.array_join(F.transform("videos", lambda x: F.concat_ws(" ", x["url"], x["type"], x["title"], x["source"])), "|").alias("found")],
    f"'https://www.youtube.com/embed/y' || {K} || ' embed/youtube T' || {K} || ' iframe|' || {B} || 'f' || {K} || '.mp4 direct_link clip a_tag|http://b.example/v' || {K} || '.mp4 schema_org V' || {K} || ' json_ld' AS found",
)
_of_shop("parse_next_link", "next_link", lambda: ["next_link"], f"'http://b.example/after/' || {K} AS next_link")
_of_shop("parse_head_next", "head_next", lambda: ["head_next"], f"'http://b.example/next/' || {K} AS head_next")
_of_shop("parse_total_pages", "total_pages", lambda: ["total_pages"], f"({Q} * 10 + 9)::INT AS total_pages")

@query("parse_text", f"SELECT c_custkey AS page_id, true AS whole, substr({T} || ' & co' || chr(10) || chr(10) || 'Of ' || {T} || ' in the segment ' || {S} || ' there', 1, 40) AS head, true AS long FROM customer")
def _text(spark, d):
    """The body from its heading on, without the menu, the comments and the pager."""
    t = F.col("text")
    furniture = t.contains("Home") | t.contains("said ") | t.contains("more")
    return P.parse_pages(shop(spark, d), ("text",)).select("page_id", (t.contains("not looked for again.") & ~furniture).alias("whole"), F.substring(t, 1, 40).alias("head"), (F.length(t) > 150).alias("long"))


@query("parse_text_cut", f"SELECT c_custkey AS page_id, substr({T} || ' & co' || chr(10) || chr(10) || 'Of ' || {T} || ' in the segment', 1, 30) || chr(10) || '... [text cut, ' AS head FROM customer")
def _cut(spark, d):
    """``max_chars``: the first 30 characters and a note of the whole length."""
    return P.parse_pages(shop(spark, d), ("text",), max_chars=30).select("page_id", F.substring("text", 1, 46).alias("head"))


@query("parse_main_html", "SELECT c_custkey AS page_id, true AS article, true AS holds, true AS alone FROM customer")
def _html(spark, d):
    h = F.col("html")
    return P.parse_pages(shop(spark, d), ("html",)).select("page_id", h.startswith("<article>").alias("article"), h.contains("<h3>n").alias("holds"), (~h.contains("said ") & ~h.contains("Home")).alias("alone"))


@query("extract_attribute", f"SELECT c_custkey AS page_id, {T} AS cite, {B} || 'item/' || {K} || ' ' || {B} || '#x javascript:1 mailto:m ' || {B} || 'f' || {K} || '.mp4' AS hrefs, 'T' || {K} AS frame FROM customer")
def _attribute(spark, d):
    fields = {"cite": (".comment cite", "text"), "hrefs": ("article a", "href"), "frame": ("iframe", "title")}
    return P.parse_pages(shop(spark, d), (), fields=fields).select("page_id", *[F.array_join(n, " ").alias(n) for n in fields])


@query("quick_extract", f"SELECT c_custkey AS page_id, {T} || ' & co' AS head, {B} || 'f' || {K} || '.mp4' AS file_url, '' AS bad FROM customer")
def _quick(spark, d):
    paths = {"head": "//h1", "file_url": "//article/a[5]/@href", "bad": "//["}
    return P.parse_pages(shop(spark, d), (), paths=paths).select("page_id", *[F.array_join(n, " ").alias(n) for n in paths])


@query("detail_links_shop", f"SELECT c_custkey AS page_id, {B} || 'item/' || {K} AS links FROM customer")
def _detail(spark, d):
    return P.parse_pages(shop(spark, d), (), detail={"selector": "article a", "include": (r"/item/", r"\.mp4$"), "exclude": (r"\.mp4$",)}).select("page_id", F.array_join("detail_links", " ").alias("links"))


@query("detect_pagination", f"SELECT c_custkey AS page_id, 'link_rel' AS method, 'http://b.example/next/' || {K} AS next_url, (c_custkey % 7 + 1)::BIGINT AS page_number, ({Q} * 10 + 9)::INT AS total_pages FROM customer")
def _detect(spark, d):
    return crawl.detect_pagination(shop(spark, d)).select("page_id", "method", "next_url", "page_number", "total_pages")


@query("content_by_type", f"""SELECT c_custkey AS page_id, '"' || {T} || '"' AS title, '{{"og":{{"og:image":"i' || {K} || '.png"}},"twitter":{{"twitter:card":"card' || {K} || '"}}}}' AS open_graph, '{{}}' AS custom_fields, NULL::VARCHAR AS nothing FROM customer""")
def _by_type(spark, d):
    types = ("title", "open_graph", "custom_fields", "nothing")
    return P.by_type(shop(spark, d), types).select("page_id", *[F.col("content")[t].alias(t) for t in types])


_HOST = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("page_links", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1), lambda h: {_HOST} || h))), ' ') AS links FROM pages")
def _plinks(spark, d):
    return P.parse_pages(spread(table(spark, d, "pages")), ("links",)).select("page_id", F.array_join("links", " ").alias("links"))


_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


@query("page_headings", rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace({_H1}, '&quot;', '"'), '&amp;', '&'), '&copy;', '©'), '\s+', ' ', 'g')) AS h1 FROM pages""")
def _pheads(spark, d):
    return P.parse_pages(spread(table(spark, d, "pages")), ("headings",)).select("page_id", F.array_join("headings.h1", "|").alias("h1"))


def _site(url: str) -> str | None:
    """A fetcher of our own: customer k's list goes on by next links for k % 4 pages; every fifth can't be fetched."""
    k, page = map(int, re.search(r"/c/(\d+)/(\d+)$", url).groups())
    if k % 5 == 0:
        raise ValueError("down")
    return f'<p>page {page} of {k}</p>' + (f'<a rel="next" href="/c/{k}/{page + 1}">on</a>' if page < k % 4 else "")


@query(
    "fetch_walk",
    """SELECT 'http://s.example/c/' || c_custkey || '/0' AS start, p::INT AS step, 'http://s.example/c/' || c_custkey || '/' || p AS url,
CASE WHEN c_custkey % 5 = 0 THEN 'fetch_failed' WHEN p = c_custkey % 4 THEN 'no_next_link' END AS stop FROM customer, unnest(range(4)) AS r(p) WHERE p <= CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 4 END""",
)
def _fetch(spark, d):
    starts = table(spark, d, "customer").select(F.concat(F.lit("http://s.example/c/"), "c_custkey", F.lit("/0")).alias("url"))
    return crawl.paginate_walk(starts, _site, mode="next_link")


@query("stopped_walk", "SELECT page_id, 'callback_stopped' AS stop FROM pages WHERE html LIKE '%</b>%' UNION ALL SELECT page_id, 'pattern_lost' FROM pages WHERE html NOT LIKE '%</b>%'")
def _stopped(spark, d):
    """Each page a walk of its own: a condition on the page ends it, or that no page number follows."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("http://w.example/x"), "page_id").alias("url"), "html")
    got = crawl.paginate_walk(p.select("url"), p.select("url", "html"), mode="pattern", go_on=lambda url, html: ~html.contains("</b>"))
    return got.join(p.select("page_id", "url"), "url").select("page_id", "stop")
