"""Text cleaning and field extraction as Column expressions.

Digits in patterns are ASCII digits. White space is what Unicode calls so, with U+001C to U+001F.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java tries the members of a class one by one, through calls that don't scale over threads: common characters are ruled out
# by a class of one or two members, and what is left is looked at by a lookbehind.
_WHITE = r"\p{IsWhite_Space}\x1c-\x1f"
BLANK, BLANK_LINES = rf"[{_WHITE}&&[^\n]]", f"[{_WHITE}]"
#: Blanks but for the space.
ODD_BLANK = rf"[^ -\x84](?<=[{_WHITE}])(?<!\n)"

#: Decoded in this order, so a double-encoded entity is decoded twice.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "hellip": "…", "copy": "©", "reg": "®", "trade": "™",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A{BLANK_LINES}+|{BLANK_LINES}+\z", "")


@F.pandas_udf(StringType())
def _numeric(text: pd.Series) -> pd.Series:
    import re

    def one(m):
        n = int(m[1] or m[2], 10 if m[1] else 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return text.map(lambda t: None if t is None else re.sub("&#(?:([0-9]+)|x([0-9A-Fa-f]+));", one, t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def decode_entities(c: Column, numeric: bool = True) -> Column:
    """Named entities by plain replacement, numeric ones in Python; only texts that hold one go there."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.coalesce(_numeric(F.when(c.contains("&#"), c)), c) if numeric else c


def strip_html(c: Column, numeric: bool = True) -> Column:
    """Markup off: scripts and styles with their bodies, comments, block tags to line feeds, other tags, then entities."""
    c = F.regexp_replace(c, r"(?is)<(style|script)[^>]*>.*?</\1>", "")
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    # a prefix of the tag name is enough here: <pre> and <link> make line feeds too
    c = F.regexp_replace(c, "(?i)<(?:h[1-6]|div|br|tr|li|p)[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", "")
    return F.coalesce(strip(decode_entities(c, numeric)), F.lit(""))


#: Characters that composition leaves alone, whatever is beside them: Latin to U+02FF, punctuation, currency, ideographs, full-width forms.
COMPOSED = r"\x00-\u02ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2122\u3000-\u3020\u4e00-\u9fff\uff01-\uff60\ufffd"


def fix_encoding(c: Column) -> Column:
    """Canonical composition; texts of characters that it can't change stay in the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(rf"[^\x00-\u02ff](?<![{COMPOSED}])"), c)), c, F.lit(""))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again as UTF-8; other texts as they are. Not part of the default cleaning."""
    narrow = F.when(c.rlike(r"\A[\x00-\xff]*\z") & c.rlike(r"[\xc2-\xf4][\x80-\xbf]"), c)
    raw = F.encode(narrow, "ISO-8859-1").cast("string")
    return F.when(narrow.isNotNull() & F.is_valid_utf8(raw), raw).otherwise(c)


def normalize_whitespace(c: Column) -> Column:
    """Wide spaces narrowed, runs of blanks to one, of line feeds to two, then every line stripped."""
    c = F.replace(c, F.lit("\u3000"), F.lit(" "))
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), "  +", " "), "\n{3,}", "\n\n")

    def stripped(t: Column) -> Column:
        # with no blanks but single spaces, plain replacement strips the lines
        plain = F.trim(F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))
        return F.when(t.rlike(ODD_BLANK), F.regexp_replace(t, rf"(?:\A|(?<=\n)){BLANK}+|{BLANK}+(?=\n|\z)", "")).otherwise(plain)

    return F.coalesce(let(c, stripped), F.lit(""))


def _all(c: Column, *patterns: str) -> Column:
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns]
    union = found[0]
    for other in found[1:]:
        union = F.array_union(union, other)
    return F.array_sort(F.array_distinct(union))


EMAIL = r"[-a-zA-Z0-9._%+]+@[-a-zA-Z0-9.]+\.[a-zA-Z]{2,}"
PHONES = ("1[3-9][0-9]{9}", r"[0-9]{3,4}[\s-]?[0-9]{7,8}", r"\+?[0-9]{1,3}[\s-]?[0-9]{6,12}")
URL = r"https?://[^\s<>\"')\]]+"
DATES = ("[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?", "[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}", "[0-9]{8}")
PRICES = (r"[$£¥€]\s?[0-9]+(?:[.,][0-9]+)?", r"[0-9]+(?:[.,][0-9]+)?\s?(?:英镑|欧元|美元|元)", r"￥[0-9]+(?:\.[0-9]+)?")


def extract_emails(c: Column) -> Column:
    return _all(c, EMAIL)


def extract_phones(c: Column) -> Column:
    """Each form is looked for by itself, so parts of longer runs of digits come too."""
    return _all(c, *PHONES)


def extract_urls(c: Column) -> Column:
    """Distinct as found, then without closing punctuation: equal ones may remain."""
    return F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(URL), F.lit(0))), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


def extract_dates(c: Column) -> Column:
    return _all(c, *DATES)


def extract_prices(c: Column) -> Column:
    return _all(c, *PRICES)


MOJIBAKE = "[À-ÿ]{3,}"
#: All but the ordinary characters. The apostrophe isn't among those; the double quote is.
SPECIAL = rf"[^\p{{L}}\p{{N}} ](?<![{_WHITE}_!?:;,.\"。，、；：！？（）-])"


def has_mojibake(c: Column) -> Column:
    return c.rlike(MOJIBAKE)


def _blank(c: Column) -> Column:
    return ~c.rlike(f"[^{_WHITE}]")


def quality_tenths(c: Column, min_length: int = 10) -> Column:
    """The score of one field in tenths; 0 where it is null or blank."""
    n = F.length(c)
    unique = F.size(F.array_distinct(F.split(c, "")))
    special = F.regexp_count(c, F.lit(SPECIAL))
    points = (
        F.lit(10)
        - F.when(n < min_length, 3).otherwise(0)
        - F.when(c.rlike("<[^>]+>"), 2).otherwise(0)
        - F.when(has_mojibake(c), 3).otherwise(0)
        - F.when((n > 10) & (unique * 10 < n), 2).otherwise(0)
        - F.when(special * 10 > n * 3, 2).otherwise(0)
    )
    return F.when(c.isNull() | _blank(c), 0).otherwise(F.greatest(points, F.lit(0)))


def quality_issues(c: Column, min_length: int = 10) -> Column:
    """Names of the checks that a field fails."""
    n = F.length(c)
    checks = {
        "short": n < min_length, "html": c.rlike("<[^>]+>"), "mojibake": has_mojibake(c),
        "repetitive": (n > 10) & (F.size(F.array_distinct(F.split(c, ""))) * 10 < n), "special": F.regexp_count(c, F.lit(SPECIAL)) * 10 > n * 3,
    }
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]))
    return F.when(c.isNull(), F.array(F.lit("missing"))).when(_blank(c), F.array(F.lit("blank"))).otherwise(named)


def quality_score(*fields: Column, min_length: int = 10) -> Column:
    """Mean over the fields, to two places."""
    if not fields:
        return F.lit(0.0)
    total = sum((quality_tenths(c, min_length) for c in fields), F.lit(0))
    return F.bround(total / (10.0 * len(fields)), 2)


def filter_lines(c: Column, ui_words: tuple[str, ...] = ()) -> Column:
    """Lines stripped; those of three characters or fewer without CJK and fixed interface words dropped; single blanks between."""
    lines = F.transform(F.split(c, "\n"), strip)
    keep = F.filter(lines, lambda x: (x == "") | ~((F.length(x) <= 3) & ~x.rlike(r"[一-鿿]")) & ~x.isin(*ui_words or ("\0",)))
    return strip(F.regexp_replace(F.array_join(keep, "\n"), "\n{3,}", "\n\n"))


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(suffix))).otherwise(c)


#: Letters and digits of Unicode 14 and 15, which Java 17 doesn't know.
NEWER = (
    r"\x{870}-\x{887}\x{889}-\x{88e}\x{8b5}\x{8c8}-\x{8c9}\x{c5d}\x{cdd}\x{170d}\x{171f}\x{1b4c}\x{2c2f}\x{2c5f}"
    r"\x{9ffd}-\x{9fff}\x{a7c0}-\x{a7c1}\x{a7d0}-\x{a7d1}\x{a7d3}\x{a7d5}-\x{a7d9}\x{a7f2}-\x{a7f4}\x{10570}-\x{1057a}"
    r"\x{1057c}-\x{1058a}\x{1058c}-\x{10592}\x{10594}-\x{10595}\x{10597}-\x{105a1}\x{105a3}-\x{105b1}\x{105b3}-\x{105b9}"
    r"\x{105bb}-\x{105bc}\x{10780}-\x{10785}\x{10787}-\x{107b0}\x{107b2}-\x{107ba}\x{10f70}-\x{10f81}\x{11071}-\x{11072}"
    r"\x{11075}\x{1123f}-\x{11240}\x{11740}-\x{11746}\x{11ab0}-\x{11abf}\x{11f02}\x{11f04}-\x{11f10}\x{11f12}-\x{11f33}"
    r"\x{11f50}-\x{11f59}\x{12f90}-\x{12ff0}\x{1342f}\x{13441}-\x{13446}\x{16a70}-\x{16abe}\x{16ac0}-\x{16ac9}"
    r"\x{1aff0}-\x{1aff3}\x{1aff5}-\x{1affb}\x{1affd}-\x{1affe}\x{1b11f}-\x{1b122}\x{1b132}\x{1b155}\x{1d2c0}-\x{1d2d3}"
    r"\x{1df00}-\x{1df1e}\x{1df25}-\x{1df2a}\x{1e030}-\x{1e06d}\x{1e290}-\x{1e2ad}\x{1e4d0}-\x{1e4eb}\x{1e4f0}-\x{1e4f9}"
    r"\x{1e7e0}-\x{1e7e6}\x{1e7e8}-\x{1e7eb}\x{1e7ed}-\x{1e7ee}\x{1e7f0}-\x{1e7fe}\x{2a6de}-\x{2a6df}\x{2b735}-\x{2b739}"
    r"\x{31350}-\x{323af}"
)


def content_key(c: Column) -> Column:
    """MD5 of letters and digits alone; all texts of punctuation share one."""
    newer = F.when(c.rlike(rf"(?=[\x{{870}}-\x{{323af}}])[{NEWER}]"), F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{NEWER}]+", ""))
    return F.md5(F.coalesce(newer, F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")).cast("binary"))
