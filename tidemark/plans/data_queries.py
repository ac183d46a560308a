"""URL, verification, frontier and crawl queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as L
from tidemark.html.parser import parse_pages
from tidemark.operators import crawl, dedup, frontier, schedule, verify
from tidemark.plans.corpus import items, table
from tidemark.session import spread
from tidemark.plans.text_queries import ITEMS, _B, simhash_sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@query(
    "url_parts",
    f"SELECT page_id, r.scheme, r.netloc, r.path, r.query, r.fragment FROM (SELECT page_id, regexp_extract(url, '{_RFC}', ['scheme', 'netloc', 'path', 'query', 'fragment']) AS r FROM pages)",
)
def _parts(spark, d):
    return table(spark, d, "pages").select("page_id", L.parts(F.col("url")).alias("r")).select("page_id", "r.*")


@query("url_domain", f"SELECT regexp_extract(url, '{_RFC}', 2) AS domain, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def _domain(spark, d):
    return table(spark, d, "pages").groupBy(L.netloc(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


#: One URL a rule of the gate, with what is expected of it.
GATE = [
    ("javascript:void(0)", "blocked", 0.95), ("#top", "blocked", 0.95), ("cloudreve://x/y", "netdisk_share", 0.95), ("https://pan.baidu.com/x", "netdisk_share", 0.9),
    ("https://a.lanzou.com/", "netdisk_share", 0.9), ("https://disk.example.com/s/abc", "netdisk_share", 0.8), ("https://ads.bad.example/x.zip", "blocked", 0.95),
    ("https://www.python.org/ftp/python-3.8.8.exe", "blocked", 0.95), ("https://www.python.org/ftp/python-3.14.7-amd64.exe", "direct_file", 0.99),
    ("https://www.python.org/ftp/python-3.15.0a8-amd64.exe", "blocked", 0.95), ("https://www.python.org/ftp/python-3.7.5rc1-embed-amd64.zip", "blocked", 0.95),
    ("https://www.python.org/downloads/release/python-326/", "blocked", 0.9), ("https://hg.python.org/x", "blocked", 0.95), ("https://docs.python.org/3/", "blocked", 0.85),
    ("https://www.python.org/ftp/x.tgz.asc", "blocked", 0.9), ("https://www.python.org/a.html", "blocked", 0.85), ("https://e.example/app-debug-1.zip", "blocked", 0.8),
    ("https://e.example/app.ZIP", "direct_file", 0.9), ("https://e.example/download/x", "html_middle", 0.8), ("https://e.example/x?action=getfile", "html_middle", 0.8),
    ("https://e.example/docxyz", "blocked", 0.8), ("https://e.example/support-us", "blocked", 0.8), ("https://e.example/download", "download_page", 0.6),
    ("https://e.example/download/", "html_middle", 0.8), ("https://e.example/downloads/", "download_page", 0.6), ("https://e.example/x", "html_middle", 0.3),
]
_GATE = ", ".join(f"('{u}', '{c}', {x}::DOUBLE)" for u, c, x in GATE)


@query("classify_url", f"SELECT * FROM (VALUES {_GATE}) AS t(url, category, confidence) UNION ALL SELECT url, 'html_middle', 0.3::DOUBLE FROM pages")
def _classify(spark, d):
    given = spark.createDataFrame([(u,) for u, _, _ in GATE], "url string").union(table(spark, d, "pages").select("url"))
    return given.select("url", L.classify_url(F.col("url"), blocked=("bad.example",)).alias("c")).select("url", "c.category", "c.confidence")


@query("domain_allowed", f"SELECT page_id, NOT coalesce(h = 'example.org' OR ends_with(h, '.example.org'), false) AND (h = 'example.com' OR ends_with(h, '.example.com')) AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '{_RFC}', 2)) AS h FROM pages)")
def _allowed(spark, d):
    return table(spark, d, "pages").select("page_id", L.domain_allowed(F.col("url"), "allow_list", allowed=("example.com",), blocked=("example.org",)).alias("allowed"))


_CASES = ["https://e.example/l?p=3", "https://e.example/l?a=1&offset=20&z=2", "https://e.example/page/4/x", "https://e.example/list-7.html", "https://e.example/none"]
_CVALUES = ", ".join(f"('{u}')" for u in _CASES)
_PATTERN_SQL = f"""t AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_CVALUES}) AS v(url)),
p AS (SELECT url, CASE WHEN regexp_matches(url, '[&?]page=[0-9]+') THEN 'page' WHEN regexp_matches(url, '[&?]p=[0-9]+') THEN 'p' WHEN regexp_matches(url, '[&?]offset=[0-9]+') THEN 'offset'
  WHEN regexp_matches(url, '/page/[0-9]+') THEN 'path_page' WHEN regexp_matches(url, '-[0-9]+\\.html?$') THEN 'suffix_page' END AS param FROM t),
n AS (SELECT url, param, CASE WHEN param IN ('page', 'p', 'offset') THEN regexp_extract(url, '[&?](?:page|p|offset)=([0-9]+)', 1) WHEN param = 'path_page' THEN regexp_extract(url, '/page/([0-9]+)', 1)
  WHEN param = 'suffix_page' THEN regexp_extract(url, '-([0-9]+)\\.html?$', 1) END::BIGINT AS current_page FROM p),
x AS (SELECT url, param, current_page, CASE WHEN param = 'offset' THEN 10 ELSE 1 END AS step FROM n)"""


def _next_sql(value: str) -> str:
    return (
        f"CASE WHEN param IN ('page', 'p', 'offset') THEN regexp_replace(url, '([&?](?:page|p|offset)=)[0-9]+', '\\1' || ({value})) WHEN param = 'path_page' THEN regexp_replace(url, '/page/[0-9]+', '/page/' || ({value}))"
        f" WHEN param = 'suffix_page' THEN regexp_replace(url, '-[0-9]+(\\.html?)$', '-' || ({value}) || '\\1') END"
    )


def _page_urls(spark, d):
    return table(spark, d, "pages").select("url").union(spark.createDataFrame([(u,) for u in _CASES], "url string"))


@query("page_pattern", f"WITH {_PATTERN_SQL} SELECT url, param, current_page FROM x")
def _pattern(spark, d):
    return _page_urls(spark, d).select("url", L.page_pattern(F.col("url")).alias("p")).select("url", "p.param", "p.current_page")


@query("next_page_url", f"WITH {_PATTERN_SQL} SELECT url, {_next_sql('current_page + step')} AS next_url FROM x")
def _next(spark, d):
    return _page_urls(spark, d).select("url", L.next_page_url(F.col("url")).alias("next_url"))


@query("paginate_urls", f"WITH {_PATTERN_SQL} SELECT url, i, CASE WHEN param IS NULL THEN url ELSE {_next_sql('current_page + step * i')} END AS page_url FROM x, unnest(range(4)) AS r(i) WHERE param IS NOT NULL OR i = 0")
def _paginate(spark, d):
    return _page_urls(spark, d).select("url", F.posexplode(L.paginate_urls(F.col("url"), 4)).alias("i", "page_url")).select("url", F.col("i").cast("long").alias("i"), "page_url")


@query(
    "route_url",
    "SELECT page_id, concat_ws(',', CASE WHEN url LIKE '%/en/%' THEN 'english' END, CASE WHEN regexp_matches(url, '/[0-9]+\\.html$') THEN 'article' END, CASE WHEN url LIKE '%spam%' THEN 'spam' END) AS routes FROM pages",
)
def _route(spark, d):
    named = {"english": "*/en/*", "article": r"/[0-9]+\.html$", "spam": "spam"}
    return table(spark, d, "pages").select("page_id", F.array_join(L.routes(F.col("url"), named), ",").alias("routes"))


@query("filter_new_urls", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE '%/en/%')")
def _new(spark, d):
    p = table(spark, d, "pages")
    return dedup.unseen(p.select("page_id", "url"), p.where(F.col("url").contains("/en/")), "url").select("page_id", "url")


@query("content_seen", "SELECT d.doc_id FROM documents d WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'en' UNION ALL SELECT md5(text) FROM benchmark)")
def _cseen(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))
    state = docs.where("lang = 'en'").select("h").union(table(spark, d, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("h")))
    return dedup.seen(docs, state, "h").select("doc_id")


@query("content_changed", "SELECT url, NOT (url LIKE '%/en/%' AND html NOT LIKE '%</b>%') AS changed FROM pages")
def _changed(spark, d):
    p = table(spark, d, "pages").select("url", F.col("html").alias("content"))
    old = p.where(F.col("url").contains("/en/")).select("url", F.md5(F.when(F.col("content").contains("</b>"), "old").otherwise(F.col("content")).cast("binary")).alias("hash"))
    return frontier.content_changed(p, old)


@query("detail_links", "SELECT page_id, list_sort(list_distinct(list_filter(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1), lambda h: regexp_matches(h, '^/[a-z]') AND NOT regexp_matches(h, '[.,]$')))) AS links FROM pages")
def _dlinks(spark, d):
    """The operator's links, shown without their host as the SQL has them."""
    found = parse_pages(spread(table(spark, d, "pages")), (), detail={"include": (r"^https?://[^/]+/[a-z]",), "exclude": ("[.,]$",)})
    return found.select("page_id", F.array_sort(F.transform("detail_links", lambda u: F.regexp_replace(u, "^https?://[^/]+", ""))).alias("links"))


@query("rate_gate", "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000, true) AS allowed FROM events")
def _gate(spark, d):
    return frontier.rate_gate(table(spark, d, "events"), "user_id", "ts", 3600.0, "event_id").select("event_id", "allowed")


def _field_sql(name: str, kind: str) -> str:
    n = {"text": f"length({name})", "long": f"length({name}::VARCHAR)"}[kind]
    empty = f"{name} IS NULL" + (f" OR {name} = ''" if kind == "text" else "")
    f = f"CASE WHEN NOT ({empty}) THEN {n} END"
    return (
        f"SELECT '{name}' AS field, count({f})::BIGINT AS fill_count, (count(*) - count({f}))::BIGINT AS null_count, count({f}) / count(*) AS fill_rate, 1 - count({f}) / count(*) AS null_rate, "
        f"coalesce(round(sum({f})::DOUBLE / count({f}), 1), 0) AS avg_length, coalesce(min({f}), 0)::BIGINT AS min_length, coalesce(max({f}), 0)::BIGINT AS max_length, true AS is_required FROM documents"
    )


@query("field_stats", " UNION ALL ".join(_field_sql(n, k) for n, k in (("doc_id", "long"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "long"))))
def _fields(spark, d):
    return verify.field_stats(table(spark, d, "documents"))


@query("key_presence", "SELECT key, count(*)::BIGINT AS present, count(*) * 2 > (SELECT count(*) FROM events) AS is_core FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def _keys(spark, d):
    return verify.key_presence(table(spark, d, "events"), "props")


@query(
    "dup_counts",
    f"""WITH {ITEMS}, {simhash_sql("SELECT ord AS o, text AS t FROM items WHERE length(text) > 20")},
rn AS (SELECT h, row_number() OVER (ORDER BY o) AS r FROM sh),
nr AS (SELECT count(DISTINCT a.r) AS n FROM rn a JOIN rn b ON b.r BETWEEN a.r - 200 AND a.r - 1 AND bit_count(xor(a.h, b.h)) BETWEEN 1 AND 5)
SELECT (count(*) - count(DISTINCT url))::BIGINT AS url_duplicates, (count(text) FILTER (text <> '') - count(DISTINCT text) FILTER (text <> ''))::BIGINT AS content_duplicates, (SELECT n FROM nr)::BIGINT AS near_duplicates,
(count(*) - greatest(count(*) - count(DISTINCT url), count(text) FILTER (text <> '') - count(DISTINCT text) FILTER (text <> '')))::BIGINT AS unique_count, count(*)::BIGINT AS total FROM items""",
)
def _dups(spark, d):
    return verify.dup_counts(spread(items(spark, d).select("ord", "url", "title", "text")))


@query(
    "quality_counts",
    r"""SELECT count_if(length(text) > 0 AND length(text) < 50)::BIGINT AS too_short, count_if(regexp_matches(text, '<[a-zA-Z/][^>]*>'))::BIGINT AS has_html_residue,
count_if(regexp_matches(text, '[\x0e-\x1f\x0b\x0c\x00-\x08]{3,}|\x{FFFD}{2,}'))::BIGINT AS has_garbled,
count_if(length(text) > 200 AND regexp_matches(substr(text, length(text) - 4, 5), '[a-zA-Z\x{4e00}-\x{9fff}][,;:，、；：]\n?$|…\n?$|\\\n?$'))::BIGINT AS suspected_truncated, count(*)::BIGINT AS total FROM documents""",
)
def _qcounts(spark, d):
    return verify.quality_counts(spread(table(spark, d, "documents").select("doc_id", "text")))


_SUSPECT = (
    "regexp_matches(lower(title) || ' ' || substr(lower(text), 1, 500), '403|429|access denied|blocked|captcha|forbidden|please verify|rate limit|robot check|too many requests|人机验证|安全验证|访问受限|请求过于频繁|验证码|"
    "404|50[023]|not\\s+found|server\\s+error|service\\s+unavailable|页面不存在|服务器错误|服务不可用') "
    f"OR (length(text) < 30 AND NOT regexp_matches(text, '[一-鿿぀-ヿ가-힯]') AND length(regexp_replace(text, '^[\\n{_B}]+|[\\n{_B}]+$', '', 'g')) < 10)"
)


@query("antibot_counts", f"WITH {ITEMS}, s AS (SELECT *, {_SUSPECT} AS bad FROM items) SELECT count_if(bad)::BIGINT AS suspected_pages, array_to_string(list_slice(list(title ORDER BY ord) FILTER (bad), 1, 5), '|') AS samples, count(*)::BIGINT AS total FROM s")
def _antibot(spark, d):
    found = verify.antibot_counts(spread(items(spark, d).select("ord", "title", "text")))
    return found.select("suspected_pages", F.array_join("samples", "|").alias("samples"), "total")


_PAGES = """p AS (SELECT TRY_CAST(nullif(coalesce(nullif(regexp_extract(url, '(?i)[&?](?:page|pagenum|pg|pn|p)=([0-9]+)', 1), ''), nullif(regexp_extract(url, '(?i)/page/([0-9]+)', 1), ''), nullif(regexp_extract(url, '-([0-9]+)\\.html?', 1), '')), '') AS BIGINT) AS page FROM pages),
c AS (SELECT page, count(*)::BIGINT AS rows FROM p WHERE page IS NOT NULL GROUP BY page)"""


@query("page_gaps", f"WITH {_PAGES}, n AS (SELECT page, lead(page) OVER (ORDER BY page) AS nxt FROM c) SELECT page + 1 AS first, nxt - 1 AS last FROM n WHERE nxt > page + 1")
def _gaps(spark, d):
    return verify.page_gaps(table(spark, d, "pages").select("url"))


@query("page_counts", f"WITH {_PAGES} SELECT page, rows FROM c")
def _pcounts(spark, d):
    return verify.page_counts(table(spark, d, "pages").select("url"))


@query("page_summary", f"WITH {_PAGES} SELECT count(*)::BIGINT AS total_pages, min(page) AS first_page, max(page) AS last_page, max(page) - min(page) + 1 - count(*)::BIGINT AS missing FROM c")
def _psummary(spark, d):
    return verify.page_summary(table(spark, d, "pages").select("url"))


@query(
    "snapshot_diff",
    """WITH a AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT count_if(a.o_orderkey IS NULL)::BIGINT AS added, count_if(b.o_orderkey IS NULL)::BIGINT AS removed, count_if(a.o_totalprice <> b.o_totalprice)::BIGINT AS changed, (SELECT count(*) FROM a)::BIGINT AS baseline_count, (SELECT count(*) FROM b)::BIGINT AS current_count
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def _diff(spark, d):
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string")).withColumn("ord", F.col("o_orderkey"))
    current = o.where("o_orderpriority <> '5-LOW'").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return verify.snapshot_diff(o.where("o_orderstatus <> 'P'"), current, ["url", "id", "link"], "ord")


@query("reconcile", "SELECT count(*)::BIGINT AS actual, 1000000::BIGINT AS expected, (1000000 - count(*))::BIGINT AS missing, CASE WHEN count(*) = 1000000 THEN 'ok' ELSE 'warning' END AS status FROM lineitem")
def _reconcile(spark, d):
    return verify.reconcile(table(spark, d, "lineitem"), 1_000_000)


@query(
    "verify_summary",
    f"""WITH {ITEMS}, s AS (SELECT *, {_SUSPECT} AS bad FROM items)
SELECT CASE WHEN count_if(bad) > 0 THEN 'error' ELSE 'warning' END AS status, count(*)::BIGINT AS total, (count(*) - count(DISTINCT url))::BIGINT AS url_duplicates, count_if(bad)::BIGINT AS suspected_pages FROM s""",
)
def _summary(spark, d):
    report = verify.verify(spread(items(spark, d).select("ord", "url", "title", "text")))
    details = report["details"]
    row = (report["status"], details["quality"]["total"], details["duplicates"]["url_duplicates"], details["blocked"]["suspected_pages"])
    return spark.createDataFrame([row], "status string, total long, url_duplicates long, suspected_pages long")


_EVENT = {"signup": "add", "click": "next", "purchase": "done", "error": "failed", "view": "requeue"}


def _log(spark, d):
    named = F.create_map(*[F.lit(x) for pair in _EVENT.items() for x in pair])
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), named[F.col("event_type")].alias("event"), F.col("event_id").alias("ord"))


_FOLD = """RECURSIVE q AS (SELECT user_id, event_id AS o, CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'next' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'requeue' END AS e,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f(user_id, i, state, priority, retries, added) AS (SELECT DISTINCT user_id, 0::BIGINT, '', 0, 0, -1::BIGINT FROM q UNION ALL
  SELECT f.user_id, q.i,
    CASE WHEN e = 'add' AND state = '' THEN 'pending' WHEN e = 'next' AND state = 'pending' THEN 'processing' WHEN e = 'done' AND state IN ('processing', 'pending') THEN 'done'
      WHEN e = 'failed' AND state = 'processing' THEN CASE WHEN retries < 3 THEN 'pending' ELSE 'failed' END WHEN e = 'requeue' AND state = 'failed' THEN 'pending' ELSE state END,
    CASE WHEN e = 'add' AND state = '' THEN 0 WHEN e = 'failed' AND state = 'processing' AND retries < 3 THEN retries + 1 WHEN e = 'requeue' AND state = 'failed' THEN 0 ELSE priority END,
    CASE WHEN e = 'add' AND state = '' THEN 0 WHEN e = 'failed' AND state = 'processing' AND retries < 3 THEN retries + 1 WHEN e = 'requeue' AND state = 'failed' THEN 0 ELSE retries END,
    CASE WHEN (e = 'add' AND state = '') OR (e = 'failed' AND state = 'processing' AND retries < 3) OR (e = 'requeue' AND state = 'failed') THEN q.o ELSE added END
  FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1),
s AS (SELECT 'u' || f.user_id AS url, state, priority::INT AS priority, retries::INT AS retries, added FROM f JOIN (SELECT DISTINCT user_id, n FROM q) z ON z.user_id = f.user_id AND z.n = f.i WHERE state <> '')"""


@query("queue_stats", f"WITH {_FOLD} SELECT count_if(state = 'pending')::BIGINT AS pending, count_if(state = 'processing')::BIGINT AS processing, count_if(state = 'done')::BIGINT AS done, count_if(state = 'failed')::BIGINT AS failed, count(*)::BIGINT AS total FROM s")
def _queue_stats(spark, d):
    return frontier.queue_stats(frontier.queue_state(_log(spark, d)))


@query("queue_state", f"WITH {_FOLD} SELECT * FROM s")
def _queue_state(spark, d):
    return frontier.queue_state(_log(spark, d))


@query("queue_recover", f"WITH {_FOLD} SELECT url, CASE WHEN state = 'processing' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'processing' THEN 0 ELSE priority END AS priority, retries, added FROM s")
def _queue_recover(spark, d):
    return frontier.recover(frontier.queue_state(_log(spark, d)))


@query("queue_admit", f"WITH {_FOLD} SELECT 'u' || (user_id * 2) AS url, (min(event_id) % 5)::INT AS priority, min(event_id) AS ord FROM events WHERE 'u' || (user_id * 2) NOT IN (SELECT url FROM s) GROUP BY user_id")
def _queue_admit(spark, d):
    """The first of each new URL, while there is room for 50,000."""
    seen = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") * 2).alias("url"), F.pmod("event_id", F.lit(5)).cast("int").alias("priority"), F.col("event_id").alias("ord"))
    return frontier.admit(seen, frontier.queue_state(_log(spark, d))).select("url", "priority", "ord")


_PENDING = "state AS (SELECT user_id, min(event_id) AS added, count(*) AS n FROM events GROUP BY user_id)"


@query("queue_next", f"WITH {_PENDING} SELECT 'u' || user_id AS url, (n % 7)::INT AS priority, added FROM state ORDER BY n % 7, added, url LIMIT 20")
def _queue_next(spark, d):
    grouped = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("added"), F.count("*").alias("n"))
    state = grouped.select(F.concat(F.lit("u"), "user_id").alias("url"), F.lit("pending").alias("state"), (F.col("n") % 7).cast("int").alias("priority"), "added")
    return frontier.queue_next(state, 20).select("url", "priority", "added")


@query("history_evict", "SELECT 'u' || user_id AS url, max(ts) AS ts FROM events GROUP BY user_id ORDER BY max(ts) DESC, url LIMIT 100")
def _evict(spark, d):
    history = table(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("url")).agg(F.max("ts").alias("ts"))
    return frontier.evict_oldest(history, 100)


@query("history_expire", "SELECT 'u' || user_id AS url, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY")
def _expire(spark, d):
    import datetime

    history = table(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("url")).agg(F.max("ts").alias("ts"))
    return frontier.expire(history, datetime.datetime(2024, 1, 30, 12), 1)


@query("hook_stats", "SELECT count(*)::BIGINT AS total, count_if(event_type <> 'error')::BIGINT AS success, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type <> 'error') / count(*) AS success_rate, round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_time FROM events")
def _hooks(spark, d):
    found = frontier.hook_stats(table(spark, d, "events").withColumn("ok", F.col("event_type") != "error"), "ok", "value")
    return found.withColumn("avg_time", F.round("avg_time", 6))


@query("adaptive_interval", "SELECT round(list_reduce(list_prepend(1.0::DOUBLE, list(value ORDER BY event_id)), lambda a, x: CASE WHEN x > 4 THEN least(a * 1.5, 30.0) WHEN x < 1 THEN greatest(a * 0.8, 1.0) ELSE a END), 6) AS interval FROM events WHERE value > 0")
def _adaptive(spark, d):
    return frontier.adaptive_interval(table(spark, d, "events"), "value", "event_id").select(F.round("interval", 6).alias("interval"))


@query("task_order", "SELECT p_partkey, greatest(1, least(10, p_size - 5))::INT AS priority, row_number() OVER (ORDER BY greatest(1, least(10, p_size - 5)), p_partkey)::INT AS place FROM part")
def _tasks(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.greatest(F.lit(1), F.least(F.lit(10), F.col("p_size") - 5)).cast("int").alias("priority"))
    return schedule.task_places(p, key="p_partkey")


@query("top_details", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 20")
def _top(spark, d):
    return crawl.top_details(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 20)


@query("list_detail", """WITH e AS (SELECT lang, url, row_number() OVER (PARTITION BY lang ORDER BY url) - 1 AS rank FROM (SELECT DISTINCT regexp_extract(url, '/([a-z]{2})/', 1) AS lang, url FROM pages))
SELECT lang AS list_url, rank::INT AS rank, e.url, html FROM e JOIN pages p ON p.url = e.url WHERE rank < 20""")
def _details(spark, d):
    p = table(spark, d, "pages").select("url", "html")
    lists = p.groupBy(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang")).agg(F.array_sort(F.collect_set("url")).alias("links"))
    return crawl.list_detail(lists.select(F.col("lang").alias("url"), "links"), p)


@query(
    "paginate_walk",
    """WITH RECURSIVE p AS (SELECT url, lead(url) OVER (PARTITION BY host ORDER BY url) AS nxt, host FROM (SELECT DISTINCT url, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages)),
w(start, step, url, nxt) AS (SELECT url, 0, url, nxt FROM p WHERE url IN (SELECT min(url) FROM p GROUP BY host) UNION ALL SELECT w.start, w.step + 1, p.url, p.nxt FROM w JOIN p ON p.url = w.nxt WHERE w.step < 19)
SELECT start, step::INT AS step, url, CASE WHEN nxt IS NULL THEN 'no_more_pages' WHEN step >= 19 THEN 'max_pages' END AS stop FROM w""",
)
def _walk(spark, d):
    from pyspark.sql import Window

    host = F.regexp_extract("url", "//([^/]*)", 1)
    p = table(spark, d, "pages").select("url", "html", host.alias("host"))
    urls = p.select("host", "url").distinct().withColumn("nxt", F.lead("url").over(Window.partitionBy("host").orderBy("url")))
    p = p.drop("host").join(urls, "url")
    starts = urls.groupBy("host").agg(F.min("url").alias("url")).select("url")
    return crawl.paginate_walk(starts, p, "nxt")


@query("parse_title", """SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '&copy;', '©'), '\\s*[-–|·•].*', ''), '^\\s+|\\s+$', '', 'g') AS title FROM pages""")
def _title(spark, d):
    return parse_pages(spread(table(spark, d, "pages")), ("title",)).select("page_id", "title")


@query("parse_pages")
def _parse(spark, d):
    wanted = ("title", "text", "links", "images", "metadata", "headings", "open_graph", "tables", "comments", "pagination", "videos", "next_link", "total_pages")
    return parse_pages(spread(table(spark, d, "pages")), wanted)
