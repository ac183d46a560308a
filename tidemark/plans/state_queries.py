"""Cleaning chains, history, routing, hooks, models, schedules and image hashes, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as L
from tidemark.operators import clean, dedup, frontier, hooks, schedule, verify
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


@query("rule_chain", r"SELECT p_partkey, p_type, upper(regexp_replace(p_name, '#.*', '')) AS label, CASE WHEN length(p_brand) > 4 THEN substr(p_brand, 1, 4) || '~' ELSE p_brand END AS p_brand FROM part")
def _chain(spark, d):
    """Rename, remove, replace, upper case and truncate; fields that are absent are passed over."""
    rules = [
        {"field": "p_name", "action": "rename", "new_name": "label"}, {"field": "p_size", "action": "remove"}, {"field": "nothing", "action": "remove"}, {"field": "label", "action": "replace", "pattern": "#.*", "replacement": ""},
        {"field": "label", "action": "uppercase"}, {"field": "p_brand", "action": "truncate", "max_length": 4, "suffix": "~"}, {"field": "p_retailprice", "action": "remove"}, {"field": "p_partkey", "action": "lowercase"},
    ]
    return clean.apply_rules(table(spark, d, "part"), rules)


@query("rule_extract_groups", r"SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number FROM pages")
def _groups(spark, d):
    got = clean.apply_rules(table(spark, d, "pages").select("page_id", "url"), [{"field": "url", "action": "extract", "pattern": "/([a-z]{2})/([0-9]+)"}])
    return got.select("page_id", F.col("url")[0].alias("lang"), F.col("url")[1].alias("number"))


@query(
    "clean_batch",
    r"""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Name ' || c_name || chr(10) || 'of ' || c_mktsegment ELSE '!' END AS text FROM customer)
SELECT c_custkey, text FROM t WHERE text NOT IN ('')""",
)
def _batch(spark, d):
    """Markup, blanks and rows of low quality or without anything go."""
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 3
    raw = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("<div>Name  "), "c_name", F.lit("</div><br>\tof "), "c_mktsegment", F.lit("<script>x</script>"))).otherwise("<b>!</b>")
    got = clean.clean_batch(c.select("c_custkey", raw.alias("text")), fields=["text"], threshold=0.3)
    return got.select("c_custkey", F.trim(F.regexp_replace("text", "\n+", "\n")).alias("text"))


@query("filter_lines", "SELECT c_custkey, c_name || chr(10) || c_mktsegment AS text FROM customer")
def _lines(spark, d):
    """Lines of three characters or fewer and fixed interface words go."""
    raw = F.concat(F.lit("  "), "c_name", F.lit(" \nab\nSubscribe\n"), "c_mktsegment", F.lit("\n1\n"))
    return table(spark, d, "customer").select("c_custkey", X.filter_lines(raw, ("Subscribe",)).alias("text"))


@query("null_alerts", "SELECT 'num' AS field, count_if(n = '')::BIGINT AS null_count FROM (SELECT regexp_extract(url, '[?&]page=([0-9]+)', 1) AS n FROM pages) HAVING count_if(n = '') > 0.3 * count(*)")
def _alerts(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("num"))
    return verify.null_alerts(verify.field_stats(p)).select("field", "null_count")


@query("part_page_gaps", "WITH c AS (SELECT p_partkey AS page FROM part WHERE p_size > 25), n AS (SELECT page, lead(page) OVER (ORDER BY page) AS nxt FROM c) SELECT page + 1 AS first, nxt - 1 AS last FROM n WHERE nxt > page + 1")
def _gaps(spark, d):
    """Small parts as missing pages."""
    return verify.page_gaps(table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("http://e/list?page="), "p_partkey").alias("url")))


@query("visited_urls", "SELECT page_id FROM pages WHERE url LIKE '%/de/%'")
def _visited(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return dedup.seen(p, p.where(F.col("url").contains("/de/")), "url").select("page_id")


_HISTORY = "struct<hash:string,ts:timestamp_ntz,title:string>"


def _visits(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.concat(F.lit("h"), "event_id").alias("hash"), F.struct("ts", "event_id").alias("ts"), "event_type")


@query("mark_visited", "SELECT 'u' || user_id AS url, arg_max('h' || event_id, (ts, event_id)) AS hash, arg_max(event_type, (ts, event_id)) AS title FROM events GROUP BY user_id")
def _mark(spark, d):
    """A history of the first half of the log, then the visits of the second; the latest of each URL stays."""
    v = _visits(spark, d).withColumnRenamed("event_type", "title")
    old = v.where(F.col("ts.event_id") % 2 == 0)
    return frontier.mark_visited(old, v.where(F.col("ts.event_id") % 2 == 1)).select("url", "hash", "title")


@query("history_stats", "SELECT count(*)::BIGINT AS total_visited, count(DISTINCT event_type)::BIGINT AS total_hashes FROM events")
def _hstats(spark, d):
    return frontier.history_stats(table(spark, d, "events").select(F.col("event_id").alias("url"), F.col("event_type").alias("hash")))


@query("length_changed", "SELECT url, abs(length(html) - (length(html) + CASE WHEN page_id % 2 = 0 THEN 60 ELSE 10 END)) > 50 AS changed FROM pages")
def _length(spark, d):
    p = table(spark, d, "pages")
    old = p.select("page_id", "url", F.lit("x").alias("hash"), (F.length("html") + F.when(F.col("page_id") % 2 == 0, 60).otherwise(10)).alias("length"))
    return frontier.content_changed(p.select("page_id", "url", F.col("html").alias("content")), old, "length", on=("page_id", "url"))


@query("url_join", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x/' || page_id AS rooted, 'https://o.example/a' AS whole FROM pages")
def _join(spark, d):
    p = spread(table(spark, d, "pages"))
    return p.select("page_id", L.join(F.col("url"), F.concat(F.lit("/x/./"), "page_id")).alias("rooted"), L.join(F.col("url"), F.lit("https://o.example/a")).alias("whole"))


@query("image_duplicates", "SELECT vec_id AS path FROM embeddings WHERE vec_id % 10 <> 0")
def _images(spark, d):
    """Ten images of one hash but for three bits; hashes of different tens are far apart."""
    ten = F.floor(F.col("vec_id") / 10)
    far = F.xxhash64(ten)
    near = F.expr("shiftleft(1L, CAST(vec_id % 10 AS INT)) - 1")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.col("vec_id").alias("ord"), far.bitwiseXOR(F.when(F.col("vec_id") % 10 == 0, F.lit(0).cast("long")).otherwise(near.bitwiseAND(F.lit(7)))).alias("phash"))
    return dedup.image_duplicates(v, threshold=3).select("path")


@query("route_dispatch", "SELECT 'english' AS route, count_if(url LIKE '%/en/%')::BIGINT AS pages FROM pages UNION ALL SELECT 'article', count_if(regexp_matches(url, '/[0-9]+\\.html$'))::BIGINT FROM pages")
def _dispatch(spark, d):
    h = hooks.Hooks()
    names = {"*/en/*": "english", r"/[0-9]+\.html$": "article"}
    for pattern in names:
        h.route(pattern, lambda df: df.agg(F.count("*").alias("pages")))
    out = None
    for pattern, got in h.dispatch(table(spark, d, "pages")).items():
        one = got.select(F.lit(names[pattern]).alias("route"), "pages")
        out = one if out is None else out.unionByName(one)
    return out


@query("hooked_run", "SELECT 3::BIGINT AS total, 2::BIGINT AS success, 1::BIGINT AS failed, 1::BIGINT AS failed_hooks, count(*)::BIGINT AS rows FROM region WHERE r_regionkey < 3")
def _hooked(spark, d):
    """Three calls, one of which fails; a hook that fails is counted and the others run."""
    h, df = hooks.Hooks(), table(spark, d, "region")
    h.on("before", lambda r: {"most": 3})
    h.on("start", lambda r: 1 / 0 if r.get("bad") else None)
    h.on("after", lambda out: out.where("r_regionkey >= 0"))
    got = h.run(lambda x, r: x.where(F.col("r_regionkey") < r["most"]), df)
    h.run(lambda x, r: 1 / 0, df, {"bad": True})
    h.run(lambda x, r: x, df)
    s = h.stats()
    return got.agg(F.lit(s["total"]).cast("long").alias("total"), F.lit(s["success"]).cast("long").alias("success"), F.lit(s["failed"]).cast("long").alias("failed"), F.lit(h.failed_hooks).cast("long").alias("failed_hooks"), F.count("*").alias("rows"))


def _ask(prompt: str) -> str:
    """A model of our own: it names the segment in the text; of some texts it answers in prose."""
    found = re.search(r"segment (\w+) of (\d+)", prompt)
    return f'```json\n{{"segment": "{found[1].lower()}", "url": "no", "page": {found[2]}}}\n```' if found and int(found[2]) % 5 else "I can't say"


def _asked(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("segment "), "c_mktsegment", F.lit(" of "), "c_custkey").alias("text"))


@query("model_extract", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) END AS ai_segment, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey::VARCHAR END AS ai_page FROM customer")
def _extract(spark, d):
    return hooks.extract_with_model(_asked(spark, d), _ask, ["segment", "page", "url"]).drop("text")


@query("model_clean", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cleaned ' || c_custkey ELSE 'raw ' || c_custkey END AS text FROM customer")
def _mclean(spark, d):
    """The model cleans every third record and leaves the others empty, which changes nothing."""

    def ask(prompt: str) -> str:
        sent = json.loads(prompt[prompt.index("[{") :])
        return "```json\n" + json.dumps([{"text": f"cleaned {x['text'].split()[1]}" if int(x["text"].split()[1]) % 3 == 0 else ""} for x in sent]) + "\n```"

    raw = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("raw "), "c_custkey").alias("text"))
    return hooks.clean_with_model(raw, ask)


@query("model_analyze", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '{\"segment\": \"' || lower(c_mktsegment) || '\", \"url\": \"no\", \"page\": ' || c_custkey || '}' ELSE '{\"raw_extraction\": \"I can''t say\"}' END AS structure FROM customer")
def _analyze(spark, d):
    return hooks.analyze_with_model(_asked(spark, d), _ask, "text").drop("text")


@query("model_config", "SELECT 'local' AS provider, 'm2' AS model, '0.5' AS temperature, '4000' AS max_tokens")
def _config(spark, d):
    got = hooks.client_config({"model": "m1", "temperature": 0.5, "base_url": ""}, {"AI_PROVIDER": "local", "AI_MODEL": "m2"})
    return spark.createDataFrame([{k: str(v) for k, v in got.items()}])


@query("scheduler_loop", "SELECT r_regionkey + 1 AS id, 2 AS runs, CASE WHEN r_regionkey = 4 THEN 'failed' ELSE 'done' END AS status, CASE WHEN r_regionkey = 4 THEN 0 ELSE 2 * (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 1) END::BIGINT AS urls FROM region")
def _schedule(spark, d):
    """A task a region over its nations' pages, two rounds; pages of even nations were visited; the last task fails."""
    now, urls = [1.0], {}
    s = schedule.Scheduler(lambda: now[0], lambda x: now.__setitem__(0, now[0] + x))
    nations = table(spark, d, "nation").collect()  # 25 rows
    for r in sorted(table(spark, d, "region").collect(), key=lambda r: r["r_regionkey"]):
        s.add(r["r_name"], [f"u{n['n_nationkey']}" for n in nations if n["n_regionkey"] == r["r_regionkey"]], 10, 9 - r["r_regionkey"])
    seen = spark.createDataFrame([(f"u{n['n_nationkey']}",) for n in nations if n["n_nationkey"] % 2 == 0], "url string")

    def note(task, out):
        if task.id == 5:
            raise ValueError("the sink is closed")
        urls[task.id] = urls.get(task.id, 0) + out.count()

    s.run(spark, lambda x: x, rounds=2, history=seen, callback=note)
    return spark.createDataFrame([(t.id, t.runs, t.status, urls.get(t.id, 0)) for t in s.tasks.values()], "id int, runs int, status string, urls long")
