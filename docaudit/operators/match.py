"""Matching strings: n-gram candidates, corpus entries, statuses, sources, nearest keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import align, text
from docaudit.operators import contain, grams


def candidates(lines: DataFrame, entries: DataFrame, n: int = 5, share: float = 0.45, top: int | None = None) -> DataFrame:
    """(line_id, entry_id, n_shared): entries that share enough distinct n-grams for a line's length, by an index that is asked
    with a line's rarest grams. lines: line_id, line; entries: entry_id, entry (both normalised). `top` keeps the best
    entries of a line and is the feature of a ranked search; without it all are returned."""
    shared = grams.sharing(lines, entries, n, share)
    if top is not None:
        w = Window.partitionBy("line_id").orderBy(F.desc("n_shared"), "entry_id")
        shared = shared.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    return shared


def corpus_match(lines: DataFrame, entries: DataFrame, n: int = 2, trust_digits: bool = False) -> DataFrame:
    """(line_id, entry_id, score): the entry that may stand for a line, best score first, then the one used in full,
    then the first by id. All candidates of a line are aligned, entries of one normal form once. Exact hits never reach the
    Python side."""
    a = lines.select("line_id", text.normalise_line(F.col("line")).alias("line")).where(F.length("line") >= 3)
    b = entries.groupBy(text.normalise_line(F.col("entry")).alias("entry")).agg(F.min("entry_id").alias("entry_id"))
    exact = a.join(b, F.col("line") == F.col("entry")).groupBy("line_id").agg(F.min("entry_id").alias("entry_id")).withColumn("score", F.lit(1.0))
    rest = a.join(exact.select("line_id"), "line_id", "left_anti")
    found = candidates(rest, b, n, 0.45).join(rest, "line_id").join(b, "entry_id")
    scored = found.withColumn("s", align.align_score("line", "entry", F.lit(trust_digits))).where("s.score IS NOT NULL")
    best = scored.groupBy("line_id").agg(F.max_by(F.struct("entry_id", F.col("s.score").alias("score")), F.struct("s.score", "s.share", -F.col("entry_id"))).alias("b"))
    return exact.unionByName(best.select("line_id", "b.entry_id", "b.score"))


def matched_lines(matches: DataFrame, lines: DataFrame, entries: DataFrame) -> DataFrame:
    """line_id, entry_id, line, entry, same: matched lines with their entry, and whether they have one normal form."""
    rows = matches.select("line_id", "entry_id").join(lines.select("line_id", "line"), "line_id").join(entries.select("entry_id", "entry"), "entry_id")
    same = F.coalesce(text.normalise_line(F.col("line")) == text.normalise_line(F.col("entry")), F.lit(False))
    return rows.select("line_id", "entry_id", "line", "entry", same.alias("same"))


def corrected_lines(matches: DataFrame, lines: DataFrame, entries: DataFrame) -> DataFrame:
    """line_id, entry_id, line, text: matched lines with their entry's wording, in their own spaces and marks. Lines
    whose normal form is the entry's stay as they are; the Python side sees nulls in their stead."""
    other = lambda c: F.when(~F.col("same"), F.col(c))
    kept = F.regexp_replace("line", f"^[{text.SPACE}]+|[{text.SPACE}]+$", "")
    rows = matched_lines(matches, lines, entries).withColumn("text", align.correct_line(other("line"), other("entry")))
    return rows.select("line_id", "entry_id", "line", F.when(F.col("same"), kept).otherwise(F.col("text")).alias("text"))


def by_authority(matches: list[DataFrame]) -> DataFrame:
    """Of several corpora's matches, in falling authority, each line's first."""
    rows = None
    for rank, m in enumerate(matches):
        m = m.withColumn("authority", F.lit(rank))
        rows = m if rows is None else rows.unionByName(m)
    rest = [c for c in rows.columns if c != "line_id"]
    return rows.groupBy("line_id").agg(F.min_by(F.struct(*rest), "authority").alias("m")).select("line_id", "m.*")


def rendering_status(ratios: DataFrame) -> DataFrame:
    """MISS below 0.8, NEAR below 1, else OK."""
    return ratios.withColumn("status", F.when(F.col("ratio") < 0.8, "MISS").when(F.col("ratio") < 1, "NEAR").otherwise("OK"))


def page_status(missing: Column, corner: Column, extra: Column, drift: Column, stops: Column, near: Column) -> Column:
    """A page's one status, the gravest first."""
    return F.when(missing, "MISS").when(corner, "CORNER").when(extra, "EXTRA").when(drift, "DRIFT").when(stops, "PUNCT").when(near, "NEAR").otherwise("OK")


def extra_stops(strings: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, sid): strings without a full stop whose rendered last line ends with one; tails of up to six characters."""
    ends = F.regexp_replace(F.col("text"), f"[{text.SPACE}]+$", "").rlike("[。．]$")
    rendered = lines.where(ends).select("page", text.normalise(F.col("text")).alias("n")).where(F.length("n") >= 2).select("page", F.expr("right(n, 6)").alias("tail")).distinct()
    want = strings.where(~ends).select("page", "sid", text.normalise(F.col("text")).alias("want"))
    return want.join(rendered, "page").where(F.endswith("want", "tail")).select("page", "sid").distinct()


def missing_text(lines: DataFrame, slides: DataFrame) -> DataFrame:
    """Lines that their page's joined text doesn't contain. slides: page, pos, text."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s.text)
    whole = slides.groupBy("page").agg(text.normalise(F.array_join(order, "")).alias("whole"))
    rows = lines.join(whole, "page", "left")
    return rows.where(~F.coalesce(F.contains("whole", text.normalise(F.col("text"))), F.lit(False))).drop("whole")


def nearest(rows: DataFrame, value: str, grid: DataFrame, step: float, within: float, fallback: Column) -> DataFrame:
    """Adds `offset`: that of the grid's nearest key, the first of equally near ones; `fallback` if none is within
    reach. grid: key, offset. An equi-join on the cell and its two neighbours, not a cross product."""
    cells = grid.select(F.col("key").alias("_k"), F.col("offset").alias("_o"), F.explode(F.array(*(F.floor(F.col("key") / step + F.lit(d)).cast("long") for d in (-1, 0, 1)))).alias("_c"))
    rows = rows.withColumn("_id", F.struct(*rows.columns)).withColumn("_c", F.floor(F.col(value) / step).cast("long"))
    both = rows.join(cells, "_c", "left").where(F.col("_k").isNull() | (F.abs(F.col("_k") - F.col(value)) <= F.lit(max(within, step))))
    best = both.groupBy("_id").agg(F.min_by("_o", F.struct(F.abs(F.col("_k") - F.col(value)), "_k")).alias("_o"), F.min(F.abs(F.col("_k") - F.col(value))).alias("_d"))
    out = rows.join(best, "_id", "left").drop("_c", "_id")
    return out.withColumn("offset", F.when(F.col("_d") <= within, F.col("_o")).otherwise(fallback)).drop("_o", "_d")


def agreeing(values: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc, value, idx): values and headings of a document of which one holds the other, by two characters or more in normal
    form. values: doc, value; headings: doc, idx, heading."""
    side = lambda rows, c: rows.select(F.col("doc").alias("page"), c, text.normalise(F.col(c)).alias("t")).where(F.length("t") >= 2).distinct()
    v, h = side(values, "value"), side(headings.select("doc", "heading"), "heading")
    as_text, as_pattern = (lambda rows: rows.select("page", F.col("t").alias("tid"), F.col("t").alias("text")).distinct()), (lambda rows: rows.select("page", F.col("t").alias("pid"), F.col("t").alias("pattern")).distinct())
    one = contain.within(as_text(h), as_pattern(v)).select("page", F.col("pid").alias("v"), F.col("tid").alias("h"))
    other = contain.within(as_text(v), as_pattern(h)).select("page", F.col("tid").alias("v"), F.col("pid").alias("h"))
    pairs = one.unionByName(other).distinct()
    found = pairs.join(v.select("page", F.col("t").alias("v"), "value"), ["page", "v"]).join(h.select("page", F.col("t").alias("h"), "heading"), ["page", "h"])
    return found.select(F.col("page").alias("doc"), "value", "heading").join(headings, ["doc", "heading"]).select("doc", "value", "idx").distinct()


def sources_found(values: DataFrame, headings: DataFrame, body: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, value, found): whether a page's source is a supplement, a heading, a part of the text, or a file's name.
    values: doc, value; headings: doc, text; body: doc, text; names: doc, name. Headings and sources may hold one another,
    so each is searched in the other; a text is walked once for all sources of its document."""
    v = values.select("doc", "value", text.normalise(F.col("value")).alias("v")).distinct()
    side = lambda rows, c: rows.select(F.col("doc").alias("page"), text.normalise(F.col(c)).alias("t")).where("t <> ''").distinct()
    source, heading, name = (rows.where(F.length("t") >= n) for rows, n in ((v.select(F.col("doc").alias("page"), F.col("v").alias("t")).distinct(), 2), (side(headings, "text"), 2), (side(names, "name"), 1)))
    texts = lambda rows: rows.select("page", F.col("t").alias("tid"), F.col("t").alias("text"))
    patterns = lambda rows: rows.select("page", F.col("t").alias("pid"), F.col("t").alias("pattern"))
    whole = body.select(F.col("doc").alias("page"), text.normalise(F.col("text")).alias("text")).withColumn("tid", F.sha2("text", 256)).where("text <> ''")
    hits = [
        contain.within(texts(heading), patterns(source)).select("page", F.col("pid").alias("v")),
        contain.within(texts(source), patterns(heading)).select("page", F.col("tid").alias("v")),
        contain.within(whole.select("page", "tid", "text"), patterns(source)).select("page", F.col("pid").alias("v")),
        contain.within(texts(name), patterns(source)).where("first").select("page", F.col("pid").alias("v")),
        contain.within(texts(source), patterns(name.where(F.length("t") >= 2))).where("first").select("page", F.col("tid").alias("v")),
    ]
    hit = reduce(DataFrame.unionByName, hits).distinct().select(F.col("page").alias("doc"), "v", F.lit(True).alias("hit"))
    extra = F.startswith("value", F.lit("补充")) | F.startswith("value", F.lit("用户补充"))
    return v.join(hit, ["doc", "v"], "left").select("doc", "value", (extra | F.coalesce("hit", F.lit(False))).alias("found"))
