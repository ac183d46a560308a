"""Main text of web pages by consensus host paths.

Each page's containers are scored on its own; the best one votes, as a generalised tag-class path, for its host. The votes
are counted in Spark, and every page is then extracted again with all containers of the path that won on its host, or of its
own best container's path where it has none of those.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, ship

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title|xmp|noembed)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?/]?[a-zA-Z](?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption tr caption".split())
ENDS_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr"}
DROPPED = frozenset(
    "nav header footer aside form button select textarea input script style noscript template iframe svg canvas object embed audio video dialog menu head title label option datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status".split())
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr
    notice notices notification alert disclaimer menu nav navbar navigation topnav subnav breadcrumb breadcrumbs sidebar sidebars aside rail footer
    header masthead comments comment disqus reply replies respond share sharing social socials related recommended recommendations popup modal overlay
    newsletter subscribe subscription signup login widget widgets toolbar pagination pager search skip paywall tags byline-share outbrain taboola""".split()
)
NEVER = frozenset("html body main article".split())
#: Open elements that a start tag ends, up to the scope named.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "thead", "tbody"), ("table",)), "option": (("option",), ("select",)),
}


def _noisy(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "") in ROLES:
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"]):
        return True
    if tag in NEVER:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if not names.strip():
        return False
    # a layout that has a sidebar isn't one
    parts = re.sub(r"\b(with|has|no|without)[-_]+\w+", " ", re.sub(r"([a-z])([A-Z])", r"\1-\2", names)).lower()
    return any(w in NOISE or w.startswith("comment") and not w.startswith("commentar") or w.startswith("advert") for w in re.split(r"[^a-z]+", parts))


def _name(tag: str, attrs: dict[str, str]) -> str:
    """A tag with its classes and id, digits generalised."""
    names = sorted(attrs.get("class", "").lower().split()) + ["#" + x for x in attrs.get("id", "").lower().split()]
    return re.sub(r"\d+", "0", ".".join([tag, *names]))


#: End tags of other elements don't reach over these.
BARRIERS = frozenset("article main body table".split())
OVER_BARRIERS = frozenset("article main body html table section div".split())
_P = (("p",), ("div", "article", "section", "td", "body", "main", "blockquote", "li"))


class Page:
    """A tolerant tree as parallel lists, and its events in page order: ints open (n) or close (~n) node n, strings are text.

    Time and memory are linear in the page, however deep it is nested: what is asked of the open elements is kept by tag,
    sizes are added up from the leaves at the end, and generalised paths are numbers whose text is made when asked for.
    """

    def __init__(self, html: str) -> None:
        self.tag, self.place, self.parent, self.drop = ["#"], [0], [0], [False]
        self.size, self.linked, self.links, self.score = [0], [0], [0], [0]
        self.block, self.link = [0], [0]  # the nearest block and the nearest link a node is in, itself included
        self.steps: list[tuple[int, str]] = [(0, "")]  # of each path the one it goes on from, and a name
        self.paths: dict[tuple[int, str], int] = {}
        self.events: list[int | str] = []
        self.stack, self.open = [0], {}
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            raw = m.group()
            if m.group(1) or raw[1] in "!?":
                continue
            if raw[1] == "/":
                self._end(raw[2:].strip("/> \t\r\n").split(None, 1)[0].lower() if len(raw) > 3 else "")
            elif raw[-1] == ">":
                self._start(raw)
        if at < len(html):
            self._text(html[at:])
        self._close(1)
        del self.stack, self.open, self.paths
        for n in range(len(self.tag) - 1, 0, -1):  # children have larger numbers
            up = self.parent[n]
            self.size[up] += self.size[n]
            self.linked[up] += self.linked[n]
            self.links[up] += self.links[n]

    def _close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        while len(self.stack) > depth:
            n = self.stack.pop()
            self.open[self.tag[n]].pop()
            self.events.append(~n)

    def _depth(self, tags: Iterable[str]) -> int:
        """Where in the stack the innermost open element of one of the tags is; 0 where none is."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _start(self, raw: str) -> None:
        body = raw[1:-1]
        head = re.match(r"[^\s/>]+", body)
        tag = head.group().lower()
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(body, head.end())} if len(body) > len(tag) + 1 else {}
        if (tag == "html" or tag == "body") and self.open.get(tag):
            return
        if tag in ENDS_P:
            self._imply(*_P)
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        if tag in VOID or body.endswith("/") and tag not in BLOCK and tag not in ("a", "span", "b", "i"):
            self.events.append(" " if tag in ("br", "wbr", "hr", "img") else "")
            return
        top = self.stack[-1]
        n = len(self.tag)
        self.tag.append(tag)
        self.parent.append(top)
        place = self.place[top]
        if tag in BLOCK or tag == "td":
            step = (place, _name(tag, attrs))
            place = self.paths.setdefault(step, len(self.steps))
            if place == len(self.steps):
                self.steps.append(step)
        self.place.append(place)
        self.drop.append(self.drop[top] or _noisy(tag, attrs))
        self.block.append(n if tag in BLOCK else self.block[top])
        self.link.append(n if tag == "a" else self.link[top])
        for x in (self.size, self.linked, self.links, self.score):
            x.append(0)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(n)
        self.events.append(n)

    def _imply(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """End open elements of ``tags`` up to the innermost of ``scope``; one may enclose another, as a row a cell."""
        edge = self._depth(scope)
        while (at := self._depth(tags)) > edge:
            self._close(at)

    def _end(self, tag: str) -> None:
        at = self._depth((tag,))
        if at and (tag in OVER_BARRIERS or self._depth(BARRIERS) <= at):
            self._close(at)

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if self.drop[top]:
            return
        self.events.append(raw)
        n = len(raw) if not raw.isspace() else 0
        if not n:
            return
        self.size[top] += n
        if link := self.link[top]:
            self.linked[link] += n
            self.links[link] += 1
            return
        block = self.block[top]
        holder = self.parent[block] if self.tag[block] in PARAGRAPH else block
        if self.tag[holder] in ("ul", "ol", "dl", "table", "tbody"):
            holder = self.parent[holder]
        self.score[holder] += 2 * n
        self.score[self.parent[holder]] += n

    def path(self, n: int) -> str:
        """The generalised path of a node."""
        names, at = [], self.place[n]
        while at:
            at, name = self.steps[at]
            names.append(name)
        return "".join("/" + x for x in reversed(names))

    def digests(self) -> list[bytes]:
        """Of each path in the page a digest that it has in every page."""
        out = [b""]
        for up, name in self.steps[1:]:
            out.append(hashlib.blake2b(out[up] + name.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        return out

    def best(self) -> int:
        """The node that holds the article: the highest score, widened to the article it is in."""
        top, most = 0, -1.0
        for n in range(len(self.tag)):
            if self.drop[n] or self.tag[n] not in BLOCK and n:
                continue
            worth = self.score[n] * (1 - self.linked[n] / max(1, self.size[n])) * (1.3 if self.tag[n] in ("article", "main") else 1)
            if worth > most:
                top, most = n, worth
        n = top
        while n:
            if self.tag[n] == "article":
                return n
            n = self.parent[n]
        n = top
        while n:
            if self.tag[n] == "main":
                return n
            n = self.parent[n]
        while self.parent[top] and self.tag[self.parent[top]] not in ("body", "html") and self.size[self.parent[top]] <= 1.25 * self.size[top]:
            top = self.parent[top]
        return top

    def find(self, digest: bytes | None) -> list[int]:
        """The nodes of a path in page order, or of the path of the page's own best; none is in another, as paths grow inward."""

        def those(place: int) -> list[int]:
            return [n for n in range(len(self.tag)) if self.place[n] == place and not self.drop[n] and (self.tag[n] in BLOCK or not n)]

        known = self.digests() if digest is not None else []
        there = those(known.index(digest)) if digest in known else []
        if there:
            return there
        best = self.best()
        return those(self.place[best]) or [best]

    def text(self, *roots: int) -> str:
        """The blocks under some nodes of which none is in another, one a line."""
        out: list[str] = []
        now: list[str] = []
        within = frozenset(roots)
        live, skip = 0 in within, 0

        def flush() -> None:
            if now:
                joined = "".join(now)
                line = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
                if line:
                    out.append(line)
                now.clear()

        for e in self.events:
            if isinstance(e, str):
                if live and not skip:
                    now.append(e)
                continue
            n = e if e >= 0 else ~e
            if n in within:
                flush()
                live = e >= 0
                continue
            if not live:
                continue
            menu = self.tag[n] in ("ul", "ol") and self.links[n] >= 3 and self.linked[n] >= 0.9 * self.size[n]
            if self.drop[n] and not self.drop[self.parent[n]] or menu:
                skip += 1 if e >= 0 else -1
            if skip == 0 or menu:
                if self.tag[n] in BLOCK:
                    flush()
                elif self.tag[n] in ("td", "th"):
                    now.append(" ")
        flush()
        return "\n".join(out)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, sizes = [], []
        for html in batch.column(1):
            page = Page(html.as_py() or "")
            digest = page.digests()[page.place[page.best()]]
            paths.append(digest)
            sizes.append(sum(page.size[n] for n in page.find(digest)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), pa.array(sizes, pa.int64())], names=["host", "path", "size"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, paths = [], []
        for html, path in zip(batch.column(2), batch.column(3)):
            page = Page(html.as_py() or "")
            roots = page.find(path.as_py())
            texts.append(page.text(*roots))
            paths.append(page.path(roots[0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())],
            names=["id", "url", "text", "n_chars", "path"],
        )


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = 100_000, salts: int = 16) -> DataFrame:
    """``key, url, text, n_chars, path`` per row: the article's blocks joined by line feeds, and the path they came from.

    A null html is an empty one and gives an empty text; pages with a null url share a host of their own. Paths vote as
    digests of 16 bytes, whatever their depth; votes tie-break by the text found, then by the digest. Repeated rows vote each. An empty table gives no rows. Other columns are ignored.
    """
    ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path binary, size long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    winners = cut(counted.groupBy("host").agg(F.max_by("path", F.struct("n", "size", "path")).alias("path")))
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:  # too many hosts to send everywhere: a hot host's pages spread over the salts
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    kind = dict(pages.dtypes)[key]
    out = joined.select("id", "url", "html", "path").mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long, path string")
    return out.withColumnRenamed("id", key)
