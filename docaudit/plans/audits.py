"""Registered queries over pages as they were read: renderings, sources, rooms, votes, sizes, plans and imports.

Faults are planted at places that a checksum of the row's key picks, several kinds in each query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions import lines as forms
from docaudit.functions import text
from docaudit.operators import geometry, match, medians, render, staging, vote
from docaudit.plans import rules
from docaudit.plans.catalogue import _norm_sql, _table, decks, registered
from docaudit.plans.forms import _BOXES, _boxes
from docaudit.sources import sinks

#: A number from 0 that a turn's key picks; the SQL engine's hash differs from Spark's, so it is plain arithmetic.
_PICK = "((conv_id * 7919 + turn * 104729) % 1000003)"


def _pick(n: int, salt: int = 0) -> Column:
    return F.expr(f"cast(({_PICK} + {salt}) % {n} AS int)")


def _turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


def _without(c: Column, at: Column) -> Column:
    """A text without the character at a place from 1."""
    return F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.length(c)))


def _place(salt: int) -> Column:
    """A place in a turn's text, from 1."""
    return F.expr(f"cast(({_PICK} + {salt}) % greatest(1, length(text)) + 1 AS int)")


# Renderings


def rendered(spark, sf_dir):
    """(strings: page, sid, text; lines: page, pos, text, box): each turn as a string, and as its page shows it: as it is,
    without a character, with a wrong one, cut in two lines, or with its end lost."""
    t = _turns(spark, sf_dir)
    kind, at = _pick(5), _place(3)
    shown = (
        F.when(kind == 1, F.array(_without(F.col("text"), at))).when(kind == 2, F.array(F.concat(F.substring("text", F.lit(1), at - 1), F.lit("语"), F.substring(F.col("text"), at + 1, F.length("text")))))
        .when(kind == 3, F.array(F.substring("text", F.lit(1), at), F.substring(F.col("text"), at + 1, F.length("text")))).when(kind == 4, F.array(F.substring("text", F.lit(1), F.greatest(F.lit(1), F.length("text") - at % 7)))).otherwise(F.array("text"))
    )
    strings = t.select(F.col("conv_id").alias("page"), F.col("turn").alias("sid"), "text")
    rows = t.select(F.col("conv_id").alias("page"), "turn", F.posexplode(shown).alias("k", "text"))
    pos = F.col("turn") * 2 + F.col("k")
    box = [(pos % 3 * 40).alias("x0"), (pos * 12).alias("y0"), (pos % 3 * 40 + 30).alias("x1"), (pos * 12 + 10).alias("y1")]
    return strings, rows.select("page", pos.alias("pos"), "text", *(b.cast("double") for b in box))


@registered()
def best_renderings(spark, sf_dir):
    """How well each turn is rendered on its page, among how many candidates, of which how many were aligned."""
    strings, lines = rendered(spark, sf_dir)
    return render.best_renderings(strings, lines).select(F.col("page").alias("conv_id"), F.col("sid").alias("turn"), F.round("ratio", 9).alias("ratio"), "pairs", "aligned")


@registered()
def rendering_places(spark, sf_dir):
    """Where each turn is likeliest rendered on its page."""
    strings, lines = rendered(spark, sf_dir)
    return render.locate(strings, lines).select(F.col("page").alias("conv_id"), F.col("sid").alias("turn"), "x0", "y0", "x1", "y1", F.round("score", 9).alias("score"))


@registered(f"SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND {_PICK} % 4 IN (1, 2)")
def extra_texts(spark, sf_dir):
    """Turns whose rendering has text that no string of the page has: capitals or a percentage put in count, a letter doesn't."""
    t = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    kind = _pick(4)
    shown = F.when(kind == 1, F.concat("text", F.lit(" QZXWVQZXWVQZXWV"))).when(kind == 2, F.concat(F.lit("※9876543% "), "text")).when(kind == 3, F.concat("text", F.lit(" ß"))).otherwise(F.col("text"))
    page = F.col("conv_id").alias("page")
    return render.extra_lines(t.select(page, "text"), t.select(page, "turn", shown.alias("text"))).select(F.col("page").alias("conv_id"), "turn")


# Sources

_VALUE = f"CASE {_PICK} % 6 WHEN 0 THEN substr(text, 1 + {_PICK} % 9, 12) WHEN 1 THEN substr(text, 1, 9) || ' (annex)' WHEN 2 THEN '补充：' || turn WHEN 3 THEN 'file' || conv_id WHEN 4 THEN 'file' || conv_id || 'v2 appendix' ELSE 'nowhere ' || conv_id || ' ' || turn END"
_SOURCES = f"v AS (SELECT DISTINCT conv_id, {_VALUE} AS value FROM conversations WHERE text IS NOT NULL), h AS (SELECT DISTINCT conv_id, {_norm_sql('substr(text, 1, 9)')} AS h FROM conversations WHERE turn % 2 = 0), b AS (SELECT conv_id, {_norm_sql('text')} AS b FROM conversations), n AS (SELECT DISTINCT conv_id, {_norm_sql(chr(39) + 'file' + chr(39) + ' || conv_id || ' + chr(39) + '-v2' + chr(39))} AS n FROM conversations), w AS (SELECT *, {_norm_sql('value')} AS v FROM v)"


@registered(
    f"WITH {_SOURCES} SELECT conv_id, value, starts_with(value, '补充') OR (length(v) >= 2 AND (EXISTS (SELECT 1 FROM h WHERE h.conv_id = w.conv_id AND length(h) >= 2 AND (contains(h, v) OR contains(v, h))) OR EXISTS (SELECT 1 FROM b WHERE b.conv_id = w.conv_id AND contains(b, v))"
    " OR EXISTS (SELECT 1 FROM n WHERE n.conv_id = w.conv_id AND (starts_with(n, v) OR (length(n) >= 2 AND starts_with(v, n)))))) AS found FROM w"
)
def source_validity(spark, sf_dir):
    """Whether what a page names as its source is a heading, a part of the text, a file's name or a supplement."""
    t = _table(spark, sf_dir, "conversations")
    doc = F.col("conv_id").alias("doc")
    values = t.where("text IS NOT NULL").select(doc, F.expr(_VALUE).alias("value")).distinct()
    headings = t.where("turn % 2 = 0").select(doc, F.substring("text", 1, 9).alias("text"))
    names = t.select(doc, F.concat(F.lit("file"), F.col("conv_id").cast("string"), F.lit("-v2")).alias("name")).distinct()
    return match.sources_found(values, headings, t.select(doc, "text"), names).select(F.col("doc").alias("conv_id"), "value", "found")


# Boxes


@registered(
    f"WITH b AS ({_BOXES}) SELECT a.page, a.pos, CAST(any_value(a.x0) - coalesce(max(b.x1) FILTER (b.x1 <= a.x0 AND b.y0 < a.y1 AND b.y1 > a.y0), 0) AS DOUBLE) AS left_room, CAST(coalesce(min(b.x0) FILTER (b.x0 >= a.x1 AND b.y0 < a.y1 AND b.y1 > a.y0), 1000) - any_value(a.x1) AS DOUBLE) AS right_room,"
    " CAST(any_value(a.y0) - coalesce(max(b.y1) FILTER (b.y1 <= a.y0 AND b.x0 < a.x1 AND b.x1 > a.x0), 0) AS DOUBLE) AS room_above, CAST(coalesce(min(b.y0) FILTER (b.y0 >= a.y1 AND b.x0 < a.x1 AND b.x1 > a.x0), 100) - any_value(a.y1) AS DOUBLE) AS room_below FROM b a JOIN b ON b.page = a.page WHERE a.x1 > a.x0 GROUP BY a.page, a.pos"
)
def box_rooms(spark, sf_dir):
    """The space on each side of each box of a page."""
    rows = geometry.rooms(_boxes(spark, sf_dir), 1000.0, 100.0).where("x1 > x0")
    return rows.select("page", "pos", F.col("left").alias("left_room"), F.col("right").alias("right_room"), F.col("above").alias("room_above"), F.col("below").alias("room_below"))


def crowded(spark, sf_dir):
    """Order lines as boxes, the lines of sixteen orders a page, many of which overlap."""
    page, pos = F.floor(F.col("l_orderkey") / 16), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(page.alias("page"), pos.alias("pos"), (F.col("l_partkey") % 300).cast("double").alias("x0"), (pos * 31 % 300).cast("double").alias("y0"), "l_quantity")
    return rows.select("page", "pos", "x0", "y0", (F.col("x0") + 20 + F.col("l_quantity").cast("double")).alias("x1"), (F.col("y0") + 8 + F.col("pos") % 5).cast("double").alias("y1"))


@registered()
def clipped_boxes(spark, sf_dir):
    """The box that each line of a crowded page may be read in, cut in order against its neighbours."""
    return geometry.clipped(crowded(spark, sf_dir), 400.0, 320.0, 0.01).select("page", "pos", "cx0", "cy0", "cx1", "cy1", "cut_top", "cut_bottom", "pad_left", "pad_right", "free")


def columns_of_lines(spark, sf_dir):
    """Order lines as lines of text: pages of columns, styles and pitches that change."""
    rows = _table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("style"), F.lit(10.0).alias("size"), (F.col("l_partkey") % 3 * 200 + F.col("l_suppkey") % 3).cast("double").alias("x0"), (F.col("l_orderkey") % 16 * 100 + F.col("l_linenumber") * 14).cast("double").alias("y0"))
    return rows.select("*", (F.col("x0") + 100 + F.col("pos") % 4).cast("double").alias("x1"), (F.col("y0") + 10).alias("y1"))


@registered()
def paragraph_lines(spark, sf_dir):
    """The paragraph of each line of a page, and how it is aligned."""
    return geometry.paragraphs(columns_of_lines(spark, sf_dir)).select("page", "pos", "paragraph", "align")


@registered()
def rotation_plan(spark, sf_dir):
    """Which surface, accent, framing and device each page of a deck gets: a conversation's turns as pages."""
    options = {"surface": ["plain", "card", "band"], "accent": ["a", "b"], "framing": ["f", "g", "h"], "device": ["d", "e", "i", "k"]}
    pages, _ = decks(spark, sf_dir)
    return rules.plan_variety(pages, options).groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("axis", "choice"))), lambda s: s.choice), " ").alias("choices"))


# Statistics


@registered("WITH m AS (SELECT l_returnflag, median(CAST(l_extendedprice AS DOUBLE)) AS med, count(*) AS n FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, any_value(n) AS n, round(any_value(med), 6) AS median, round(median(abs(CAST(l_extendedprice AS DOUBLE) - med)), 6) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag")
def huge_medians(spark, sf_dir):
    """Medians and the medians of distances from them in groups that no task gathers."""
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    mid = medians.group_medians(rows, ["l_returnflag"], {"median": F.col("v")}, held=1 << 12)
    apart = medians.group_medians(rows.join(mid, "l_returnflag"), ["l_returnflag"], {"mad": F.abs(F.col("v") - F.col("median"))}, held=1 << 12)
    n = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return n.join(mid, "l_returnflag").join(apart, "l_returnflag").select("l_returnflag", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


# Readings of lines


def readings(spark, sf_dir):
    """line_id, page, readings: a turn with a wrong letter or a lost one, of which a placeholder may tell, and two readings with
    faults of their own elsewhere."""
    t = _turns(spark, sf_dir).where("length(text) >= 30")
    third = F.floor(F.length("text") / 3).cast("int")
    at = lambda k: (third * k + 2 + _pick(1_000_000, 17 * k) % (third - 4)).cast("int")
    wrong = lambda p: F.concat(F.substring("text", F.lit(1), p - 1), F.lit("Ω"), F.substring(F.col("text"), p + 1, F.length("text")))
    kind = _pick(3)
    gap = F.concat(F.substring("text", F.lit(1), at(0) - 1), F.lit(forms.align.LOST), F.substring(F.col("text"), at(0) + 1, F.length("text")))
    page = F.when(kind == 0, wrong(at(0))).when(kind == 1, _without(F.col("text"), at(0))).otherwise(gap)
    return t.select(F.struct("conv_id", "turn").alias("line_id"), page.alias("page"), F.array(_without(F.col("text"), at(1)), wrong(at(2))).alias("readings"))


@registered()
def voted_readings(spark, sf_dir):
    """Turns corrected by two readings that have faults of their own."""
    return vote.voted(readings(spark, sf_dir)).select("line_id.conv_id", "line_id.turn", "merged")


@registered(f"SELECT conv_id, turn, CASE WHEN {_PICK} % 4 = 3 THEN text || '。' ELSE text END AS line FROM conversations WHERE regexp_full_match(text, '[A-Za-z](?s:.*)[a-z.]')")
def ornament_free(spark, sf_dir):
    """Turns without the ornaments that were put at their ends: several of a kind, both ends, after a full stop."""
    t = _turns(spark, sf_dir).where("text RLIKE '^[A-Za-z](?s:.*)[a-z.]$'")
    kind = _pick(4)
    shown = F.when(kind == 1, F.concat("text", F.lit(" ✦ ◆"))).when(kind == 2, F.concat(F.lit("  ◇ "), "text", F.lit("\t"))).when(kind == 3, F.concat("text", F.lit("。 J+"))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", forms.strip_ornaments(shown).alias("line"))


@registered(f"SELECT conv_id, turn, text AS line FROM conversations WHERE regexp_full_match(text, '[A-Za-z0-9]{{5}}(?s:.*) [a-z]{{5,}}[.]?')")
def icon_free(spark, sf_dir):
    """Turns without icons that were read as characters before or after them, as two readings lack those."""
    t = _turns(spark, sf_dir).where("text RLIKE '^[A-Za-z0-9]{5}(?s:.*) [a-z]{5,}[.]?$'")
    kind = _pick(3)
    shown = F.when(kind == 1, F.concat(F.lit("◎ "), "text")).when(kind == 2, F.concat("text", F.lit(" ☾"))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", forms.strip_icons(shown, F.array("text", "text")).alias("line"))


@registered(f"SELECT conv_id, turn, CASE {_PICK} % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE 'Ω' || substr(text, 2) END AS line, {_PICK} % 3 = 2 AS refused FROM conversations WHERE regexp_full_match(text, '[A-Za-z](?s:.*)')")
def upheld_edits(spark, sf_dir):
    """Corrections of a page's reading: one that another reading bears out stays, as does a function character put in at a
    blank; one that no reading bears out goes."""
    t = _turns(spark, sf_dir).where("text RLIKE '^[A-Za-z](?s:.*)$'")
    kind, wrong = _pick(3), F.concat(F.lit("Ω"), F.substring(F.col("text"), F.lit(2), F.length("text")))
    page = F.when(kind == 0, F.col("text")).otherwise(wrong)
    heard = F.array(F.when(kind == 1, F.col("text")).otherwise(page), page)
    rows = t.select("conv_id", "turn", page.alias("page"), F.col("text").alias("draft"), heard.alias("heard"))
    return forms.unopposed(rows, "page", "draft", "heard").select("conv_id", "turn", F.col("text").alias("line"), (F.size("refused") > 0).alias("refused"))


@registered(f"SELECT conv_id, turn, CASE WHEN {_PICK} % 7 = 0 THEN '龘' WHEN {_PICK} % 7 = 1 THEN '龘,鑫' ELSE '' END AS rare FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '[\\x{{4E00}}-\\x{{9FFF}}]')")
def rare_characters(spark, sf_dir):
    """Characters of each turn that are rare in print."""
    t = _turns(spark, sf_dir).where("NOT text RLIKE '[\\\\x{4E00}-\\\\x{9FFF}]'")
    kind = _pick(7)
    shown = F.when(kind == 0, F.concat("text", F.lit("品龘牌"))).when(kind == 1, F.concat(F.lit("龘的鑫"), "text")).otherwise(F.concat("text", F.lit("的一是")))
    return t.select("conv_id", "turn", F.array_join(forms.rare_glyphs(shown), ",").alias("rare"))


def boxed_characters(spark, sf_dir):
    """line, words: turns, and boxes read a character, of which one is misread and one left out."""
    t = _turns(spark, sf_dir)
    solid = F.filter(F.split("text", ""), lambda c: ~F.rlike(c, F.lit(f"^[{text.SPACE}]?$")))
    word = lambda wrong: lambda c, i: F.struct(F.when(i == wrong, F.lit("Ω")).otherwise(c).alias("text"), i.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i + 1).cast("double").alias("x1"), F.lit(2.0).alias("y1"))
    # The places are bound once a turn, not found anew for each character.
    once = F.array(F.struct(solid.alias("solid"), _place(5).alias("wrong"), _place(11).alias("lost")))
    words = F.transform(once, lambda v: F.filter(F.transform(v.solid, word(v.wrong)), lambda w: w.x0 != v.lost))[0]
    return t.select("conv_id", "turn", F.col("text").alias("line"), words.alias("words"))


@registered()
def reader_boxes(spark, sf_dir):
    """Where each character of a turn is, by boxes of which one is misread and one missing."""
    rows = forms.boxed(boxed_characters(spark, sf_dir), "line", "words")
    return rows.select("conv_id", "turn", F.array_join(F.transform("boxes", lambda b: F.coalesce(b.x0.cast("int").cast("string"), F.lit("-"))), " ").alias("places"))


_GLYPH = "SELECT l_orderkey, l_linenumber AS i, l_linenumber * 20.0 + CASE WHEN l_linenumber > 2 + l_orderkey % 3 THEN 15.0 ELSE 0.0 END AS x0, CASE WHEN l_linenumber > 2 + l_orderkey % 3 AND l_orderkey % 4 > 0 THEN 10.0 + l_partkey % 3 ELSE 20.0 + l_suppkey % 2 END AS h FROM lineitem"
_TEXT = "CASE l_orderkey % 5 WHEN 0 THEN '标题 Agent 说明' WHEN 1 THEN 'Agent说明文字' ELSE '标题与说明文字' END"


@registered(
    f"WITH g AS (SELECT l_orderkey, {_TEXT} AS t, list(x0 ORDER BY i, h) AS x0, list(x0 + 16.0 ORDER BY i, h) AS x1, list(h ORDER BY i, h) AS h, count(*) AS n FROM ({_GLYPH}) GROUP BY l_orderkey),"
    " p AS (SELECT *, list_transform(range(2, n + 1), lambda k: x0[k] - x1[k - 1]) AS gaps FROM g WHERE n >= 5),"
    " k AS (SELECT *, quantile_cont(q, 0.75) OVER (PARTITION BY l_orderkey) AS g75 FROM (SELECT *, unnest(gaps) AS q, generate_subscripts(gaps, 1) + 1 AS k FROM p)),"
    " s AS (SELECT *, greatest(h[k - 2], h[k - 1]) AS a, greatest(h[k], h[k + 1]) AS b, list_median(list_slice(list_reverse_sort(h[1:k - 1]), 1, 3)) AS a3, list_median(list_slice(list_reverse_sort(h[k:n]), 1, 3)) AS b3 FROM k WHERE k BETWEEN 3 AND n - 1),"
    " c AS (SELECT *, greatest(a, b) / least(a, b) * q AS v, (x1[k - 1] + x0[k]) / 2 AS x FROM s WHERE q >= 1.5 * g75 AND q >= 0.12 * least(a, b) AND greatest(a, b) / least(a, b) > 1.3 AND greatest(a3, b3) / greatest(1.0, least(a3, b3)) > 1.2 AND a >= 0.85 * a3 AND b >= 0.85 * b3 AND (a > b) = (a3 > b3)),"
    " o AS (SELECT l_orderkey, arg_max(x, (v, -k)) AS x, any_value(x0[1]) AS left_, any_value(x1[n]) AS right_, any_value(t) AS t FROM c GROUP BY l_orderkey),"
    " m AS (SELECT *, (x - left_) / greatest(1.0, right_ - left_) * length(t) AS cut FROM o),"
    " w AS (SELECT l_orderkey, unnest(range(1, length(t) + 1)) AS i, t, cut FROM m),"
    " bad AS (SELECT DISTINCT l_orderkey FROM w WHERE abs(i - cut) <= 2.5 AND ((regexp_matches(substr(t, i, 1), '[A-Za-z]') AND regexp_matches(substr(t, i + 1), '^ *[\\x{4E00}-\\x{9FFF}]')) OR (regexp_matches(substr(t, i, 1), '[\\x{4E00}-\\x{9FFF}]') AND regexp_matches(substr(t, i + 1), '^ *[A-Za-z]'))))"
    " SELECT l_orderkey, CAST(x AS DOUBLE) AS split_x FROM m WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad)"
)
def size_changes(spark, sf_dir):
    """Where lines change their size: orders as lines, their items as glyphs."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    later = n > 2 + key % 3
    x0 = n * 20.0 + F.when(later, 15.0).otherwise(0.0)
    h = F.when(later & (key % 4 > 0), 10.0 + F.col("l_partkey") % 3).otherwise(20.0 + F.col("l_suppkey") % 2)
    g = F.struct(n.alias("i"), x0.cast("double").alias("x0"), (x0 + 16.0).cast("double").alias("x1"), h.cast("double").alias("h"))
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(g)).alias("gs"))
    line = F.when(key % 5 == 0, "标题 Agent 说明").when(key % 5 == 1, "Agent说明文字").otherwise("标题与说明文字")
    return orders.select("l_orderkey", forms.height_split(line, F.col("gs")).alias("split_x")).where("split_x IS NOT NULL")


# Reports and imports


@registered("PIVOT (SELECT l_linenumber AS attribute, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) ON l_returnflag IN ('A', 'N', 'R') USING first(n) GROUP BY attribute")
def side_by_side(spark, sf_dir):
    """Counts of items by their place in an order, with the return flags side by side."""
    n = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("attribute"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return sinks.side_by_side(n, "attribute", "l_returnflag", "n", ["A", "N", "R"])


@registered(
    f"WITH t AS (SELECT conv_id || '.' || turn AS id, role, text AS old, CASE WHEN {_PICK} % 3 = 0 THEN translate(text, 'e', 'E') ELSE text END AS new FROM conversations WHERE text IS NOT NULL)"
    " SELECT count(*) AS n_slots, count(*) FILTER (upper(old) = upper(new)) AS n_same, count(*) FILTER (old <> new) AS n_changed FROM t"
)
def staged_import(spark, sf_dir):
    """An edited copy of all turns taken in one step (forced, as words with capitals are other facts), and taken again."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    t = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    slots = t.select(F.concat_ws(".", "conv_id", "turn").alias("id"), "role", "text")
    new = F.when(_pick(3) == 0, F.translate("text", "e", "E")).otherwise(F.col("text"))
    deck = staging.Staged(spark, f"{(top or '/tmp/docaudit-shared').rstrip('/')}/docaudit-staged-{uuid.uuid4().hex}")
    deck.start(slots)
    edited = t.select(F.concat_ws(".", "conv_id", "turn").alias("id"), new.alias("text"))
    deck.take(slots, edited, force=True)
    deck.take(slots, edited, force=True)  # the same step: nothing is taken twice
    after = deck.slots().select("id", F.col("text").alias("after")).join(slots, "id")
    return after.agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(F.upper("after") == F.upper("text")).alias("n_same"), F.lit(deck.log().count()).cast("long").alias("n_changed"))
