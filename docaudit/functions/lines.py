"""Columns over lines as a reader of pages gives them: ornaments and icons at their ends, rare characters, character boxes,
spacing, changes of size, edits that the page speaks against. All run inside the JVM but for the alignment of edits and the walk over
character boxes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions import align
from docaudit.functions.text import CJK, SPACE

# Marks that a page reader takes for characters at a line's ends, and what may stand before one at the end.
ORNAMENTS, BEFORE_ORNAMENT = "J/+|\\\\✦✧◆◇*", "。，！？」』） "
# Marks that close or follow, and marks that open, at which full-width type is set closer.
CLOSING, OPENING = "，。、：；！？」』）》〉】”’", "「『（《〈【“‘"
HAN = "\\u4e00-\\u9fff"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_ornaments(line: Column) -> Column:
    """A line without ornaments at its ends: what stands for a moon or a swash after the last full stop, then marks after a
    closing mark, a blank or (but for +) a CJK character, then marks before a blank or a CJK character."""
    other = ORNAMENTS.replace("+", "")
    t = F.regexp_replace(stripped(line), f"(?<=[。！？」』])[{SPACE}]*[CcDd)）(（一—J+/]{{1,2}}$", "")
    t = stripped(F.regexp_replace(t, f"(?:(?:(?<=[{BEFORE_ORNAMENT}])[{ORNAMENTS}]|(?<=[{CJK}])[{other}])[{SPACE}]*)+$", ""))
    return F.regexp_replace(t, f"^(?:[{other}](?=[ {CJK}])[{SPACE}]*)+", "")


@cache
def _common_han() -> str:
    """The first level of GB 2312, by its rule: rows 16 to 55 of the code table."""
    cells = (bytes([row + 0xA0, cell + 0xA0]).decode("gb2312", "ignore") for row in range(16, 56) for cell in range(1, 95))
    return "".join(cells)


def rare_glyphs(line: Column) -> Column:
    """CJK characters outside the first level of GB 2312."""
    return F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(f"[{HAN}&&[^{_common_han()}]]"), F.lit(0))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]", "")


def _votes(readings: Column, holds) -> Column:
    """Whether all readings with text, two at least, bear something out."""
    seen = F.filter(F.transform(F.coalesce(readings, F.array().cast("array<string>")), _bare), lambda r: F.length(r) > 0)
    return (F.size(seen) >= 2) & (F.size(F.filter(seen, holds)) == F.size(seen))


def strip_icons(line: Column, readings: Column) -> Column:
    """A line without what may be an icon at its ends. Edge tokens are put to the readings: one to three characters before
    a blank, a CJK character or after a closing bracket go where every reading begins with what follows them; one or two after a
    blank (no CJK, no %) where every reading ends with what is before them. A bracket that opens after CJK near the
    end goes in any case."""
    start, rest = lambda k: F.substring(line, F.lit(1), k), lambda k: F.regexp_replace(F.substring(line, k + 1, F.length(line)), f"^[{SPACE}]+", "")

    def icon(k: Column) -> Column:
        mark, key = F.replace(start(k), F.lit(" "), F.lit("")), F.substring(_bare(rest(k)), 1, 4)
        parted = F.rlike(F.substring(line, k + 1, F.lit(1)), F.lit(f"^[ {HAN}]$")) | F.substring(line, k, F.lit(1)).isin(")", "）")
        lacking = _votes(readings, lambda r: F.position(key, r).between(1, 2) & ~F.startswith(r, mark))
        return F.length(mark).between(1, 3) & (F.length(rest(k)) >= 3) & parted & lacking

    cuts = F.filter(F.sequence(F.lit(1), F.least(F.lit(6), F.length(line) - 1)), icon)
    t = F.when((F.length(line) >= 2) & (F.size(cuts) > 0), rest(cuts[0])).otherwise(line)
    opened = f"(?s)^(.{{2,}}[{HAN}])[{SPACE}]*[（(][A-Za-z0-9（({SPACE}]{{0,4}}$"
    lone = f"(?s)^(.*)[{SPACE}]((?![{HAN}%])[^{SPACE}]{{1,2}})$"
    kept, tail = F.regexp_extract(t, lone, 1), F.regexp_extract(t, lone, 2)
    key = F.substring(_bare(kept), -3, 3)
    ended = _votes(readings, lambda r: F.position(F.reverse(key), F.reverse(r)).between(1, 2) & ~F.endswith(r, tail))
    return F.when(F.rlike(t, F.lit(opened)), F.regexp_extract(t, opened, 1)).when(F.rlike(t, F.lit(lone)) & ended, F.regexp_replace(kept, f"[{SPACE}]+$", "")).otherwise(t)


def unopposed(rows: DataFrame, page: str, fixed: str, readings: str) -> DataFrame:
    """Adds text and refused: a corrected line without the edits that the page speaks against, and those. Edits are (place, old,
    new); one that replaces or drops characters has to lie within places where some reading disagrees with the page; one
    that puts in has function characters only, two at most. Without readings all edits stay. A function character that
    came to stand after an opening quote goes before it."""
    names, readings = rows.columns, F.col(readings)
    rows = rows.withColumn("_page", F.coalesce(page, F.lit(""))).withColumn("_fixed", F.coalesce(fixed, F.lit("")))
    heard = F.filter(F.transform(readings, _bare), lambda r: F.length(r) > 0)
    rows = rows.withColumn("_edits", align.edits("_page", "_fixed")).withColumn("_heard", align.edits_of_all(_bare(F.col("_page")), heard))
    page, fixed, edits = F.col("_page"), F.col("_fixed"), F.col("_edits")
    none = F.array().cast("array<int>")
    blank = lambda i: F.rlike(F.substring(page, i + 1, F.lit(1)), F.lit(f"^[{SPACE}]$"))
    solid = F.filter(F.sequence(F.lit(0), F.greatest(F.length(page) - 1, F.lit(0))), lambda i: ~blank(i))
    against = F.flatten(F.transform("_heard", lambda e: F.when(F.length(e.old) > 0, F.sequence(e.at, e.at + F.length(e.old) - 1)).otherwise(none)))
    rows = rows.withColumn("_contested", F.transform(F.array_distinct(against), lambda k: F.get(solid, k)))
    contested = F.col("_contested")

    def stands(e: Column) -> Column:
        own = F.filter(F.sequence(e.at, e.at + F.greatest(F.length(e.old), F.lit(1)) - 1), lambda i: ~blank(i))
        few = (F.length(e.new) <= 2) & (F.translate(e.new, align.FUNCTION_CHARS, "") == "")
        return F.when(F.length(e.old) > 0, F.size(F.array_except(own, contested)) == 0).otherwise(few)

    def add(s: Column, e: Column) -> Column:
        between = F.substring(page, s.at + 1, e.at - s.at)
        return F.struct((e.at + F.length(e.old)).alias("at"), F.concat(s.out, between, F.when(stands(e), e.new).otherwise(e.old)).alias("out"))

    whole = F.aggregate(edits, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: F.concat(s.out, F.substring(page, s.at + 1, F.length(page))))
    whole = F.regexp_replace(whole, f"([「『“《（])([{align.FUNCTION_CHARS}])", "$2$1")
    refused = F.transform(F.filter(edits, lambda e: ~stands(e)), lambda e: F.struct(e.old.alias("page"), e.new.alias("draft")))
    alone = F.size(F.coalesce(readings, F.array().cast("array<string>"))) == 0
    refused = F.when(alone, F.slice(refused, 1, 0)).otherwise(refused)
    return rows.select(*names, F.when(alone, fixed).otherwise(whole).alias("text"), refused.alias("refused"))


_BLANK = re.compile(f"[{SPACE}]")
_BLANKS = frozenset(c for c in map(chr, range(0x10000)) if _BLANK.match(c))
_SIDES = ("x0", "y0", "x1", "y1")
BOXES = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in _SIDES]))
#: Bytes of lines and words that are walked at once.
PIECE = 1 << 20


def character_boxes(line: Column, words: Column) -> Column:
    """A box, or null, for each character of a line, from boxes read one a character (array of text, x0, y0, x1, y1), in order:
    blanks have none; a character takes the first of the next three that has its sign, and one misread takes the next.
    Words that are made by lambda functions go through `boxed` instead: Spark leaves a Python step over those unplanned the
    second time that a session runs it."""
    return _boxes_in_order(line, words)


def boxed(rows: DataFrame, line: str, words: str) -> DataFrame:
    """Rows with boxes, as character_boxes has them, in place of words. They go by piece, so a task holds one batch of rows and the
    boxes of a piece, as columns."""
    names = [c for c in rows.columns if c != words]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b):
                found = boxes_of_lines(piece.column(line), piece.column(words))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), found], [*names, "boxes"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("boxes", BOXES)]))


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(b.num_rows * PIECE / max(PIECE, b.nbytes)))
    return (b.slice(i, step) for i in range(0, b.num_rows, step))


def boxes_of_lines(lines: pa.Array, words: pa.Array) -> pa.Array:
    """The boxes of the characters of each line; null where the line or its words are. Boxes stay columns: only their signs and
    places become Python objects."""
    begin = words.offsets.to_numpy()
    flat = words.values.slice(begin[0], begin[-1] - begin[0])
    signs, begin = pc.struct_field(flat, "text").to_pylist(), (begin - begin[0]).tolist()
    none = pc.or_(pc.is_null(lines), pc.is_null(words))
    places, ends = [], [0]
    for i, (t, skip) in enumerate(zip(lines.to_pylist(), none.to_pylist(), strict=True)):
        if not skip:
            low = begin[i]
            places += [None if k is None else low + k for k in places_in_order(t, signs[low : begin[i + 1]])]
        ends.append(len(places))
    at = pa.array(places, pa.int32())
    sides = [pc.struct_field(flat, c).cast(pa.float64()).take(at) for c in _SIDES]
    boxes = pa.StructArray.from_arrays(sides, _SIDES, mask=pc.is_null(at))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), boxes, mask=none)


def places_in_order(line: str, signs: list[str | None]) -> list[int | None]:
    """Which box each character of a line has, by the boxes' signs; those without a sign are no boxes."""
    held = [k for k, s in enumerate(signs) if s]
    at, out = 0, []
    for c in line:
        if c in _BLANKS or at >= len(held):
            out.append(None)
            continue
        if signs[held[at]] != c:
            at = next((k for k in range(at + 1, min(at + 3, len(held))) if signs[held[k]] == c), at)
        out.append(held[at])
        at += 1
    return out


def boxes_in_order(line: str, words: list[dict]) -> list[dict | None]:
    places = places_in_order(line, [w and w["text"] for w in words])
    return [None if k is None else words[k] for k in places]


@F.arrow_udf(BOXES)
def _boxes_in_order(line: pa.Array, words: pa.Array) -> pa.Array:
    rows = pa.RecordBatch.from_arrays([line, words], ["line", "words"])
    found = [boxes_of_lines(p.column("line"), p.column("words")) for p in _pieces(rows)]
    return pa.concat_arrays(found) if found else boxes_of_lines(line, words)


def punctuation_slots(line: Column) -> Column:
    """Places (from 0) after which full-width type is set closer: after a closing mark and before an opening one, never the last."""
    at = lambda i: F.substring(line, i + 1, F.lit(1))
    near = lambda i: (F.position(at(i), F.lit(CLOSING)) > 0) | (F.position(at(i + 1), F.lit(OPENING)) > 0)
    places = F.sequence(F.lit(0), F.greatest(F.length(line) - 2, F.lit(0)))
    return F.when(F.length(line) >= 2, F.filter(places, near)).otherwise(F.array().cast("array<int>"))


def tracking(line: Column, track: Column, extra: Column, closer: Column) -> Column:
    """The space after each character: the line's own, more after a blank, less (`closer`, negative) at punctuation slots."""
    slots = punctuation_slots(line)
    places = F.when(F.length(line) > 0, F.sequence(F.lit(0), F.length(line) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: track + F.when(F.substring(line, i + 1, F.lit(1)) == " ", extra).otherwise(0.0) + F.when(F.array_contains(slots, i), closer).otherwise(0.0))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def height_split(line: Column, glyphs: Column) -> Column:
    """Where a line changes its size, as an x; null if it doesn't. glyphs: x0, x1, h in order. The gap there is 1.5 times the
    upper quartile of the line's gaps and 0.12 heights, the two glyphs on each side differ by over 1.3, what is tallest on
    each side (the median of three) by over 1.2, in the same way and without the near ones being low for their side. Of
    several the one with the greatest ratio times gap, then the first. Not where Latin meets CJK, which differ anyway."""
    return F.when((F.size(glyphs) >= 5) & (F.length(F.replace(line, F.lit(" "), F.lit(""))) >= 4), _let(glyphs, lambda g: _split_of(line, g)))


def _split_of(line: Column, glyphs: Column) -> Column:
    n = F.size(glyphs)
    h = lambda i: F.try_element_at(glyphs, i).h.cast("double")
    gap = lambda k: (F.try_element_at(glyphs, k).x0 - F.try_element_at(glyphs, k - 1).x1).cast("double")
    at = (n - 2) * 0.75
    low = F.floor(at).cast("int")
    tallest = lambda part: F.slice(F.reverse(F.array_sort(F.transform(part, lambda g: g.h.cast("double")))), 1, 3)
    middle = lambda t: F.when(F.size(t) == 2, (t[0] + t[1]) / 2).otherwise(t[1])
    struct = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))

    def quartile(gaps: Column) -> Column:
        below, above = F.try_element_at(gaps, low + 1), F.try_element_at(gaps, F.least(low + 2, n - 1))
        return below + (above - below) * (at - low)

    def sides(k: Column) -> Column:
        return struct(k=k, gap=gap(k), left=F.greatest(h(k - 2), h(k - 1)), right=F.greatest(h(k), h(k + 1)))

    def wide(s: Column, upper: Column) -> Column:
        least = F.least(s.left, s.right)
        return (s.gap >= 1.5 * upper) & (least > 0) & (s.gap >= 0.12 * least) & (F.greatest(s.left, s.right) / F.when(least > 0, least) > 1.3)

    def stands(s: Column) -> Column:
        tops = struct(left=tallest(F.slice(glyphs, F.lit(1), s.k - 1)), right=tallest(F.slice(glyphs, s.k, n)))

        def agree(three: Column) -> Column:
            ok = F.greatest(three.left, three.right) / F.greatest(F.lit(1.0), F.least(three.left, three.right)) > 1.2
            return ok & (s.left >= 0.85 * three.left) & (s.right >= 0.85 * three.right) & ((s.left > s.right) == (three.left > three.right))

        return _let(tops, lambda t: _let(struct(left=middle(t.left), right=middle(t.right)), agree))

    def best(upper: Column) -> Column:
        near = F.filter(F.transform(F.sequence(F.lit(3), n - 1), sides), lambda s: F.coalesce(wide(s, upper), F.lit(False)))
        found = F.filter(near, lambda s: F.coalesce(stands(s), F.lit(False)))
        return F.array_max(F.transform(found, lambda s: struct(v=F.greatest(s.left, s.right) / F.least(s.left, s.right) * s.gap, k=-s.k)))

    def where(b: Column) -> Column:
        x = (F.try_element_at(glyphs, -b.k - 1).x1 + F.try_element_at(glyphs, -b.k).x0) / 2.0
        first, last = F.try_element_at(glyphs, F.lit(1)).x0, F.try_element_at(glyphs, n).x1
        return F.when(b.isNotNull(), struct(x=x, cut=(x - first) / F.greatest(F.lit(1.0), (last - first).cast("double")) * F.length(line)))

    meets = lambda i: (F.rlike(F.substring(line, i, F.lit(1)), F.lit("[A-Za-z]")) & F.rlike(F.substring(line, i + 1, F.length(line)), F.lit(f"^[{SPACE}]*[{HAN}]"))) | (F.rlike(F.substring(line, i, F.lit(1)), F.lit(f"[{HAN}]")) & F.rlike(F.substring(line, i + 1, F.length(line)), F.lit(f"^[{SPACE}]*[A-Za-z]")))
    mixed = lambda cut: F.exists(F.sequence(F.lit(1), F.length(line)), lambda i: (F.abs(i - cut) <= 2.5) & meets(i))
    upper = _let(F.array_sort(F.transform(F.sequence(F.lit(2), n), gap)), quartile)
    return _let(_let(_let(upper, best), where), lambda w: F.when(~F.coalesce(mixed(w.cut), F.lit(False)), w.x.cast("double")))
