"""Column functions over text: normal forms, lengths, marks, facts, keys. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width and typographic marks with the plain form they compare as ('' drops the mark).
PLAIN_FORM = {
    "，": ",", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")", "“": '"', "”": '"', "—": "-", "–": "-", "−": "-",
    "、": ",", "！": "!", "？": "?", "｜": "|", "／": "/", "「": '"', "」": '"', "·": "", "•": "", "×": "X", "✕": "X",
}
# The second normal form, for lines as read from a page. It keeps + * # and knows more brackets.
LINE_FORM = {
    "，": ",", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")", "“": '"', "”": '"', "—": "-", "–": "-",
    "、": ",", "！": "!", "？": "?", "｜": "|", "／": "/", "丨": "|", "「": '"', "」": '"', "『": '"', "』": '"',
    "《": '"', "》": '"', "【": "(", "】": ")", "～": "~", "＋": "+", "％": "%", "×": "X", "·": "", "•": "",
}
DROPPED, DROPPED_LINE = "\"'.,;:!?()/|-~·+*#", "\"'.,;:!?()/|-~·"
# White space as Python's \s has it, spelled out because SQL engines differ.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
CJK = "\\u3400-\\u9fff"
# What counts as a fact in a text, and the title and body patterns of the deck rules.
FACT = "\\d+(?:[.,:：/]\\d+)*\\s*(?:%|‰|％)?|[A-Za-z][A-Za-z0-9&+.'’\\-]*|「[^」]*」|“[^”]*”|《[^》]*》"
THANKS = "(?i)^\\s*(谢谢|感谢(聆听|观看|您的?(聆听|观看|时间))?|thank\\s*you|thanks|q\\s*&\\s*a|问答|the\\s*end)[!！。.\\s]*$"
META = "本页|本章|本部分|本节|我们将|接下来(将|我们|介绍|看)|下面(将|我们|来看|介绍)|以下(是|为|将|几页)|如下所示"
TOPIC_END = "(概述|概况|介绍|简介|现状|分析|情况|说明|总结|一览)$"
APPENDIX_REF = "(?i)附录\\s*(A\\s*\\d+)"
# Roles whose terminal mark goes at any length, descriptive roles, and list roles.
SHORT_ROLES = (
    "deck title", "kicker", "title", "subtitle", "heading", "table caption", "table header", "table cell",
    "big number", "number label", "number", "item title", "column title", "source",
)
DESCRIPTIVE_ROLES = ("text", "quote", "callout", "item text")
LIST_ROLES = ("bullet", "step", "column item", "item text")
LONG_CHARS, DESCRIPTIVE_CHARS = 40, 30


def blank_to_null(s: Column) -> Column:
    """Absent, empty and blank are all missing."""
    return F.nullif(F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", ""), F.lit(""))


def _translated(s: Column, table: dict[str, str]) -> Column:
    kept = {k: v for k, v in table.items() if v}
    gone = "".join(k for k, v in table.items() if not v)
    return F.translate(s, "".join(kept) + gone, "".join(kept.values()))


def _class(chars: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in chars)


def normalise(s: Column) -> Column:
    """Compares texts regardless of punctuation form, white space and case."""
    return F.upper(F.regexp_replace(_translated(s, PLAIN_FORM), f"[{SPACE}{_class(DROPPED)}]", ""))


def normalise_line(s: Column) -> Column:
    """The normal form of lines read from a page; what can't be printed goes, each character folds to one."""
    gone = F.regexp_replace(_translated(s, LINE_FORM), f"[{SPACE}{_class(DROPPED_LINE)}\\p{{C}}\\p{{Zl}}\\p{{Zp}}]", "")
    return F.array_join(F.transform(F.split(gone, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def cjk_length(s: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(s, f"[^{CJK}]", "")), F.lit(0))


def visible_length(s: Column) -> Column:
    return F.length(F.regexp_replace(s, f"[{SPACE}]", ""))


def width_em(s: Column) -> Column:
    """Estimated width: a CJK character is 1 em, any other 0.55."""
    return cjk_length(s) + (F.length(s) - cjk_length(s)) * 0.55


def _end(s: Column) -> Column:
    return F.regexp_replace(s, f"[{SPACE}]+$", "")


def ends_with_stop(s: Column) -> Column:
    """A full stop of either width, or a dot after a CJK character."""
    return _end(s).rlike(f"[。．]$|[{CJK}]\\.$")


def ends_with_mark(role: Column, s: Column) -> Column:
    return ends_with_stop(s) | (role.isin(*LIST_ROLES) & _end(s).rlike("[；;]$"))


def should_strip(role: Column, s: Column, long_chars: int = LONG_CHARS, desc_chars: int = DESCRIPTIVE_CHARS) -> Column:
    """Whether a string has to lose its terminal mark: one sentence, in a short role or of few visible characters."""
    body = F.regexp_replace(_end(s), "(?s).$", "")
    limit = F.when(role.isin(*DESCRIPTIVE_ROLES), desc_chars).otherwise(long_chars)
    return ends_with_mark(role, s) & ~body.rlike("[。！？!?]") & (role.isin(*SHORT_ROLES) | (visible_length(body) < limit))


def strip_stop(s: Column) -> Column:
    return _end(F.regexp_replace(_end(s), "(?s).$", ""))


def settled(role: Column, s: Column) -> Column:
    """The string as the punctuation rules leave it."""
    return F.when(should_strip(role, s), strip_stop(s)).otherwise(s)


def category_key(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, f"[{SPACE}·・,，、/／+＋()（）\\-]", ""))


def first_hex(s: Column) -> Column:
    """The first colour that a description gives for its background."""
    return F.upper(F.nullif(F.regexp_extract(s, "(?i)background[^#\\n]*(#[0-9a-f]{6})", 1), F.lit("")))


def rgb(hex_colour: Column) -> Column:
    part = lambda i: F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def facts(s: Column) -> Column:
    """The numbers, Latin words and quoted spans of a text, as they compare."""
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(FACT), F.lit(0))
    return F.transform(found, lambda t: F.replace(F.regexp_replace(t, f"[{SPACE}]+", ""), F.lit("％"), F.lit("%")))


def grew(old: Column, new: Column) -> Column:
    """Longer by over a quarter and by over five characters."""
    return (F.length(new) > F.length(old) * 1.25) & (F.length(new) > F.length(old) + 5)


def headings_agree(a: Column, b: Column) -> Column:
    """Both normal forms have two characters or more, and one contains the other."""
    x, y = normalise(a), normalise(b)
    return (F.length(x) >= 2) & (F.length(y) >= 2) & (F.contains(x, y) | F.contains(y, x))


def keyword_hits(path: Column, cjk: list[str], latin: list[str]) -> Column:
    """CJK keywords anywhere, Latin ones as whole tokens only."""
    anywhere = F.array_compact(F.array(*(F.when(F.contains(path, F.lit(k)), F.lit(k)) for k in cjk))) if cjk else F.array().cast("array<string>")
    tokens = F.array_intersect(F.split(F.lower(path), "[^a-z0-9]+"), F.array(*map(F.lit, latin))) if latin else F.array().cast("array<string>")
    return F.concat(anywhere, F.array_sort(tokens))


def kpi_parts(v: Column) -> Column:
    """prefix, number and suffix of a value; null unless prefix or suffix has a CJK character."""
    pattern = "^\\s*(\\D*?)\\s*([+\\-−±~≈]?\\d[\\d.,]*\\s*[%‰]?)\\s*(\\D*?)\\s*$"
    part = [F.trim(F.regexp_extract(v, pattern, i)) for i in (1, 2, 3)]
    found = v.rlike(pattern) & F.concat(part[0], part[2]).rlike("[\\u4e00-\\u9fff]")
    return F.when(found, F.struct(part[0].alias("prefix"), part[1].alias("number"), part[2].alias("suffix")))


def human_bytes(n: Column) -> Column:
    """Megabytes with one digit from a million bytes on, else whole kilobytes, rounded down."""
    return F.when(n >= 1_000_000, F.concat(F.replace(F.format_number(n / 1e6, 1), F.lit(","), F.lit("")), F.lit(" MB"))).otherwise(F.format_string("%d KB", F.floor(n / 1000).cast("long")))


def quarter(v: Column) -> Column:
    """To the nearest quarter, halves to even."""
    return F.bround(v * 4) / 4


def character_class(c: Column) -> Column:
    """C for CJK, L for Latin letters, digits, % and +, P for the rest."""
    return F.when(c.rlike(f"^[{CJK}]"), "C").when(c.rlike("^[A-Za-z0-9%+]"), "L").otherwise("P")


def reserved_corner_width(corner: Column) -> Column:
    return F.when(F.endswith(corner, F.lit("l")), 0.20).otherwise(0.12)


def file_name(project: Column, suffix: Column, ext: str) -> Column:
    return F.format_string(f"%s%s.{ext}", project, F.coalesce(suffix, F.lit("")))


def clean_up(s: Column, rules: list[tuple[str, str]]) -> Column:
    """Configured replacements in order; a rule that starts with re: is a pattern."""
    for old, new in rules:
        s = F.regexp_replace(s, old[3:], new) if old.startswith("re:") else F.replace(s, F.lit(old), F.lit(new))
    return s
