"""URL parts, the download gate, page patterns and routes as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import let, strip
from tidemark.functions.versions import format_version, is_stable, parse_python_version

#: RFC 3986, appendix B.
_RFC = r"\A(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?\z"


def parts(url: Column) -> Column:
    """struct<scheme, netloc, path, query, fragment>, each '' where absent."""
    names = ("scheme", "netloc", "path", "query", "fragment")
    return F.struct(*[F.coalesce(F.regexp_extract(url, _RFC, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def netloc(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _RFC, 2), F.lit(""))


@F.pandas_udf(StringType())
def _join(base: pd.Series, ref: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(b, r):
        try:
            return None if r is None else urljoin(b or "", r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


def join(base: Column, ref: Column) -> Column:
    """A reference against its base; whole http URLs stay in the JVM."""
    whole = ref.rlike(r"\Ahttps?://[^/?#]+/[^\s]*\z") & ~ref.contains("/.")
    return F.when(whole, ref).otherwise(_join(F.when(~whole, base), F.when(~whole, ref)))


FILE_SUFFIXES = ".7z .apk .avi .bz2 .docx .epub .exe .flac .gz .iso .mkv .mov .mp3 .mp4 .msi .pdf .pptx .rar .tar .wav .xlsx .zip".split()
#: Share hosts; their subdomains count too.
NETDISKS = {
    "pikpak": ("mypikpak.com",), "baidu": ("pan.baidu.com",), "aliyun": ("aliyundrive.com", "alipan.com"),
    "lanzou": ("lanzou.com", "lanzoui.com", "lanzoux.com", "lanzoup.com", "www.ilanzou.com"), "tianyi": ("cloud.189.cn",),
}
_ARTICLE = (
    "about article author bbs blob blog category commit commits doc docs documentation forum help issue issues manual misc news post posts pull pulls source src "
    "support tag tags tree wiki"
).split()
_MARKERS = "asc changelog debug embed license md5 news online pdb readme sha256 sig source sources src stub symbols webinstall".split()  # of several, the first names the reason
_PY = r"(?i)python-[0-9]+\.[0-9]+\.[0-9]+(?:(?:rc|a|b)[0-9]+)?"


def _within(host: Column, domains: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def _class(category: str, confidence: float, reason: Column | str, **meta: Column | str) -> Column:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.struct(
        F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _url_facts(url: Column, context: Column) -> Column:
    """What the rules of the gate ask of a URL, each found once."""
    u = strip(url)
    path = F.coalesce(F.regexp_extract(u, _RFC, 3), F.lit(""))
    name = F.regexp_extract(F.lower(path), "([^/]*)$", 1)
    version = parse_python_version(u)
    return F.struct(
        url.alias("url"), u.alias("u"), F.lower(u).alias("lower"), F.lower(F.coalesce(F.regexp_extract(u, _RFC, 1), F.lit(""))).alias("scheme"), F.lower(netloc(u)).alias("host"),
        path.alias("path"), name.alias("name"), F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1).alias("ext"), F.lower(context).alias("context"), version.isNotNull().alias("versioned"),
        F.coalesce(is_stable(version), F.lit(False)).alias("stable"), F.when(version.isNotNull(), F.concat(F.lit(" "), format_version(version))).otherwise(F.lit("")).alias("shown"),
    )


def _url_rules(f: Column, blocked: tuple[str, ...], files: list[str]) -> Column:
    u, lower, host, path, name, ext, shown = (f[c] for c in ("u", "lower", "host", "path", "name", "ext", "shown"))
    python = host.contains("python.org")
    direct = u.rlike(rf"{_PY}-amd64\.exe$")
    other = u.rlike(rf"{_PY}-(?:amd64-pdb|arm64|embed-amd64|embed-win32|pdb|pdb-amd64|webinstall|win32)\.(?:exe|zip)$")
    why = (
        F.when(lower.contains("webinstall"), "web installer stub").when(lower.contains("embed"), "embeddable package").when(lower.contains("arm64"), "ARM64 package")
        .when(lower.contains("win32"), "32-bit installer").when(lower.contains("pdb"), "debug symbols").otherwise("not the installer wanted")
    )
    rule = F.when(f["url"].isNull() | (f["url"] == ""), _class("blocked", 0.9, "empty URL"))
    rule = rule.when(f["scheme"].isin(*"data javascript mailto tel".split()), _class("blocked", 0.95, F.concat(F.lit("scheme: "), f["scheme"])))
    rule = rule.when(u.startswith("#"), _class("blocked", 0.95, "anchor"))
    rule = rule.when(lower.startswith("cloudreve://"), _class("netdisk_share", 0.95, "cloudreve scheme", provider="cloudreve"))
    for provider, domains in NETDISKS.items():
        rule = rule.when(_within(host, domains), _class("netdisk_share", 0.9, f"share host: {provider}", provider=provider))
    rule = rule.when(path.rlike("(?i)/s/[a-z0-9]{3,}"), _class("netdisk_share", 0.8, "share path"))
    for domain in blocked:
        rule = rule.when(_within(host, (domain,)), _class("blocked", 0.95, f"blocked domain: {domain}"))
    of_python = F.when(u.rlike(rf"{_PY}\.exe$"), _class("blocked", 0.95, F.concat(F.lit("Python"), shown, F.lit(": no architecture"))))
    of_python = of_python.when(direct & f["stable"], _class("direct_file", 0.99, F.concat(F.lit("Python"), shown, F.lit(" amd64")), python_version=F.ltrim(shown), arch="amd64", stable="true"))
    of_python = of_python.when(direct & f["versioned"], _class("blocked", 0.95, F.concat(F.lit("prerelease"), shown), python_version=F.ltrim(shown)))
    of_python = of_python.when(direct, _class("direct_file", 0.9, "Python amd64, version unknown"))
    of_python = of_python.when(other, _class("blocked", 0.95, F.concat(F.lit("Python"), shown, F.lit(": "), why), python_version=F.ltrim(shown)))
    of_python = of_python.when(u.rlike("(?i)/python-[0-9]+/?$"), _class("blocked", 0.9, "old version directory"))
    of_python = of_python.when(host.isin(*(f"{x}.python.org" for x in ("bugs", "hg", "svn"))), _class("blocked", 0.95, F.concat(F.lit("not a download host: "), host)))
    of_python = of_python.when(host.endswith(".python.org") & ~host.isin(*(f"{x}.python.org" for x in ("downloads", "www"))), _class("blocked", 0.85, F.concat(F.lit("not a download subdomain: "), host)))
    of_python = of_python.when(ext.isin(*(f".{x}" for x in "asc md5 sha1 sha256 sha512 sig txt".split())), _class("blocked", 0.9, F.concat(F.lit("checksum or signature "), ext)))
    of_python = of_python.when(((host == "python.org") | host.endswith(".python.org")) & (ext != "") & ~ext.isin(*files), _class("blocked", 0.85, "not a file type wanted of python.org"))
    is_file = ext.isin(*files)
    # the marker that stands first in the list names the reason
    marks = F.array(*[F.lit(m) for m in _MARKERS])
    marked = F.get(F.filter(marks, lambda m: F.contains(F.regexp_replace(name, "[._-]", "."), F.concat(F.lit("."), m, F.lit("."))) | F.startswith(name, F.concat(m, F.lit("-")))), F.lit(0))
    rest = F.when(is_file & name.rlike(rf"[._-](?:{'|'.join(_MARKERS)})[._-]|^(?:{'|'.join(_MARKERS)})-"), _class("blocked", 0.8, F.concat(F.lit("not the file wanted: "), marked), ext=ext))
    rest = rest.when(is_file, _class("direct_file", 0.9, F.concat(F.lit("file "), ext), ext=ext))
    interface = path.rlike("(?i)/(?:attachment|dl|down|download|fetch|file|getfile)/") | u.rlike("(?i)[&?](?:act|action|mod)=(?:dl|download|get_?file)")
    rest = rest.when(interface, _class("html_middle", 0.8, "download interface"))
    rest = rest.when(path.rlike(f"(?i)/(?:{'|'.join(_ARTICLE)})"), _class("blocked", 0.8, "not a download page"))
    rest = rest.when(F.lower(path).rlike("/downloads?/?$"), _class("download_page", 0.6, "download list"))
    rest = rest.when(f["context"].rlike("下载|download|save"), _class("html_middle", 0.6, "words of the link"))
    rest = rest.otherwise(_class("html_middle", 0.3, "nothing certain"))
    return rule.otherwise(F.coalesce(F.when(python, of_python), rest))


def classify_url(url: Column, context: Column | None = None, blocked: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> Column:
    """struct<category, confidence, reason, metadata>: the first rule that fits, over facts that are found once a URL."""
    context = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    files = [*FILE_SUFFIXES, *suffixes]
    return let(_url_facts(url, context), lambda f: _url_rules(f, blocked, files))


def domain_allowed(url: Column, policy: str = "allow_all", base: str = "", allowed: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> Column:
    """Blocked domains and URLs without a host never; then ``same_domain``, ``allow_list`` or ``allow_all``."""
    host = F.lower(netloc(strip(url)))
    rule = {"same_domain": _within(host, (base,)) if base else F.lit(True), "allow_list": _within(host, allowed), "allow_all": F.lit(True)}[policy]
    return (host != "") & ~_within(host, blocked) & rule


PAGE_PARAMS = ("page", "p", "pn", "pagenum", "pageNum", "pg", "offset", "start", "skip")
PAGE_PATTERNS = {**{n: f"[&?]{n}=([0-9]+)" for n in PAGE_PARAMS}, "path_page": "/page/([0-9]+)", "path_p": "/p/([0-9]+)", "suffix_page": r"-([0-9]+)\.html?$"}


def page_pattern(url: Column) -> Column:
    """struct<param, current_page, match> of the first pattern that fits, or null."""
    rows = [F.struct(F.lit(name).alias("param"), F.lit(pattern).alias("pattern")) for name, pattern in PAGE_PATTERNS.items()]
    first = F.get(F.filter(F.array(*rows), lambda r: F.regexp(url, r["pattern"])), F.lit(0))

    def found(r: Column) -> Column:
        page = F.try_to_number(F.regexp_substr(F.regexp_substr(url, r["pattern"]), F.lit("[0-9]+")), F.lit("9" * 18)).cast("long")
        return F.when(r.isNotNull(), F.struct(r["param"].alias("param"), page.alias("current_page"), F.regexp_substr(url, r["pattern"]).alias("match")))

    return let(first, found)


def next_page_url(url: Column, page_size: int = 0, steps: Column | int = 1) -> Column:
    """The URL ``steps`` pages on, by its pattern; null where it has none. Offsets go by the page size, 10 by default."""
    by = steps if isinstance(steps, Column) else F.lit(steps)

    def turned(p: Column) -> Column:
        step = F.when(p["param"].isin("offset", "start", "skip"), F.lit(page_size or 10)).otherwise(F.lit(1))
        match = F.regexp_replace(p["match"], "[0-9]+", (p["current_page"] + step * by).cast("string"))
        # paths are turned wherever they stand, parameters where they stand first, suffixes at the end
        at = F.when(p["param"] == "suffix_page", F.length(url) - F.length(p["match"]) + 1).otherwise(F.position(p["match"], url))
        once = F.concat(F.substring(url, F.lit(1), at - 1), match, F.substring(url, at + F.length(p["match"]), F.length(url)))
        return F.when(p["param"].isin("path_page", "path_p"), F.replace(url, p["match"], match)).when(p.isNotNull(), once)

    return let(page_pattern(url), turned)


def paginate_urls(url: Column, pages: int) -> Column:
    """The URL and those of the following pages, ``pages`` in all; a URL without a pattern alone."""
    many = F.transform(F.sequence(F.lit(0), F.lit(max(pages, 1) - 1)), lambda i: next_page_url(url, steps=i))
    return F.when(page_pattern(url).isNull(), F.array(url)).otherwise(many)


def page_number(url: Column) -> Column:
    """The page number in a URL, as the verifier reads it."""
    found = [F.regexp_extract(url, p, 1) for p in ("(?i)[&?](?:page|pagenum|pg|pn|p)=([0-9]+)", "(?i)/page/([0-9]+)", r"-([0-9]+)\.html?")]
    return F.try_to_number(F.coalesce(*[F.when(x != "", x) for x in found]), F.lit("9" * 18)).cast("long")


def _glob(pattern: str) -> str:
    import fnmatch

    return fnmatch.translate(pattern).replace("(?s:", "(?s)(?:")


def _is_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def route_matches(url: Column, pattern: str) -> Column:
    """As a glob over the whole URL, a regular expression in it, or a part of it; a bad expression counts as no match."""
    out = url.rlike(_glob(pattern)) | url.contains(pattern)
    return out | url.rlike(pattern) if _is_regex(pattern) else out


def routes(url: Column, patterns: dict[str, str]) -> Column:
    """Names of all the routes that match, in order."""
    return F.array_compact(F.array(*[F.when(route_matches(url, p), F.lit(name)) for name, p in patterns.items()]))
