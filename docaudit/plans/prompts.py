"""Assembled texts and plans at the end of the flow: page prompts, neighbour notes, what to avoid, what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import align
from docaudit.operators import match
from docaudit.plans import dims
from docaudit.sources import outline

NOTES = {"bullet": "list", "step": "steps in order", "big number": "key numbers", "table cell": "table", "column item": "columns"}


def neighbours(pages: DataFrame) -> DataFrame:
    """doc, page, note: the skeletons of the pages before and after, which this one shouldn't look like."""
    w = Window.partitionBy("doc").orderBy("pos")
    near = F.array_compact(F.array(F.lag("visual.skeleton").over(w), F.lead("visual.skeleton").over(w)))
    rows = pages.withColumn("near", F.array_distinct(F.filter(near, lambda s: s.isin(*dims.SKELETONS))))
    return rows.select("doc", F.col("id").alias("page"), F.when(F.size("near") > 0, F.concat(F.lit("Unlike its neighbours: "), F.array_join("near", ", "))).alias("note"))


def verbatim(pages: DataFrame) -> DataFrame:
    """doc, page, lines: a page's strings in quotes and in order, each run of a role under its note."""
    s = outline.slots(pages)
    w = Window.partitionBy("doc", "page").orderBy("ord")
    first = ~F.col("role").eqNullSafe(F.lag("role").over(w))
    note = F.element_at(F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv)), F.col("role"))
    line = F.concat(F.when(first & note.isNotNull(), F.concat(F.lit("["), note, F.lit("]\n"))).otherwise(""), F.lit('"'), F.col("text"), F.lit('"'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line)
    return s.withColumn("line", line).groupBy("doc", "page").agg(F.array_join(ordered, "\n").alias("lines"))


def avoided(rows: DataFrame, allowed: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """key, text of what is banned: the constant rows less those a direction allows, and a project's own."""
    out = rows.join(allowed.select("key").distinct(), "key", "left_anti").select("key", "text")
    return out if extra is None else out.unionByName(extra.select(F.lit(None).cast("string").alias("key"), "text"))


def prompts(pages: DataFrame, style: Column, by_kind: dict[str, str] | None = None) -> DataFrame:
    """doc, page, tone, prompt: the parts of a page's prompt that are there, a line each."""
    rows = outline.tones(pages, by_kind or {}).withColumn("page", F.col("id"))
    rows = rows.join(neighbours(pages), ["doc", "page"], "left").join(verbatim(pages), ["doc", "page"], "left")
    part = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    v = lambda c: F.col(f"visual.{c}")
    parts = [style, part("Tone", F.col("page_tone")), part("Message", v("message")), part("Structure", v("structure")), part("Form", v("form")), part("Focal point", v("focal")), part("Composition", v("skeleton")), part("Motif", v("motif")), F.col("note"), part("Text, verbatim", F.col("lines"))]
    return rows.select("doc", "page", F.col("page_tone").alias("tone"), F.array_join(F.array_compact(F.array(*parts)), "\n").alias("prompt"))


def numbered_corners(pages: DataFrame, logos: DataFrame, number_corner: str | None) -> DataFrame:
    """page, corner, width: the widest zone by corner, with the page number's on pages that have a label.
    pages: page, label; logos: corner, width."""
    zones = logos.groupBy("corner").agg(F.max("width").alias("width"))
    every = pages.withColumn("corner", F.explode(F.array(*map(F.lit, ("bl", "br", "tl", "tr"))))).join(zones, "corner").select("page", "corner", "width")
    if number_corner:
        every = every.unionByName(pages.where("label <> ''").select("page", F.lit(number_corner).alias("corner"), F.lit(0.12).alias("width")))
    return every.groupBy("page", "corner").agg(F.max("width").alias("width"))


def sample_status(index: DataFrame, checks: DataFrame) -> DataFrame:
    """direction, n, n_bad, worst: how each direction's samples came out. index: direction, page; checks: page, status."""
    rank = F.array_position(F.array(*map(F.lit, ("OK", "NEAR", "PUNCT", "DRIFT", "EXTRA", "CORNER", "MISS"))), F.col("status"))
    return index.join(checks, "page").groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "OK").alias("n_bad"), F.max_by("status", rank).alias("worst"))


def retention(files: DataFrame, selected: DataFrame, delivered: DataFrame, deep: bool = False) -> DataFrame:
    """path, bytes, reason of what may go; nothing is deleted here. files: path, name, bytes, stage; selected: path;
    delivered: name, bytes. Attempts that weren't taken and stage files that were delivered go; with `deep`, work
    files go as well. A file named twice counts once."""
    loose = files.where("stage = 'attempt'").join(selected.select("path"), "path", "left_anti").select("path", "bytes", F.lit("not taken").alias("reason"))
    double = files.where("stage = 'output'").join(delivered.select("name", "bytes"), ["name", "bytes"], "left_semi").select("path", "bytes", F.lit("delivered").alias("reason"))
    out = loose.unionByName(double)
    out = out.unionByName(files.where("stage = 'work'").select("path", "bytes", F.lit("work file").alias("reason"))) if deep else out
    return out.groupBy("path", "bytes").agg(F.min("reason").alias("reason"))


def draft_differences(matches: DataFrame, lines: DataFrame, draft: DataFrame) -> DataFrame:
    """line_id, entry_id, line, text, changes: lines whose letters and digits aren't those of the draft's entry that
    they stand for, with the draft's wording and each part that differs."""
    rows = match.matched_lines(matches, lines, draft).where(~F.col("same"))  # the others' wording is their own
    found = rows.select("line_id", "entry_id", "line", align.correction("line", "entry").alias("c"))
    return found.select("line_id", "entry_id", "line", "c.*").where(F.size("changes") > 0)
