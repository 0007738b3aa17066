"""Several readings of a line correct one another: a vote for each place of the line, counted as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions.align import DASHES, LOST, ballots
from docaudit.functions.text import CJK

_KINDS = {"at": T.IntegerType(), "old": T.StringType(), "new": T.StringType(), "start": T.IntegerType(), "stop": T.IntegerType(), "lost": T.BooleanType(), "edge": T.BooleanType()}
BALLOT = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()]))
#: A letter, digit or CJK character, but no number in a circle, which is a badge.
_DASH = "".join(f"\\{c}" for c in DASHES)
LETTER = f"(?:(?![\\u2460-\\u24ff\\u2776-\\u2793])[\\p{{L}}\\p{{N}}{CJK}])"


def placed(page: str, reading: str, solid: np.ndarray) -> list[dict]:
    """A reading's ballots on the page's characters that aren't blank (`solid` has their places), and which stretch of the page
    each would take: a character, the first sign of a lost one in a gap, else the gap's last blank or nothing."""
    out = []
    for at, old, new in ballots(page.replace(" ", "").replace(LOST, ""), reading):
        start, stop, lost = (int(solid[at - 1]) + 1 if at else 0), (int(solid[at]) if at < len(solid) else len(page)), False
        if old:
            start, stop = stop, stop + 1
        elif lost := (sign := page.find(LOST, start, stop)) >= 0:
            start, stop = sign, sign + 1
        else:
            start = max(start, stop - 1)
        out.append({"at": at, "old": old, "new": new, "start": start, "stop": stop, "lost": lost, "edge": not old and at in (0, len(solid))})
    return out


@F.pandas_udf(BALLOT)
def cast_votes(page: pd.Series, reading: pd.Series) -> pd.Series:
    """What a reading puts at places of the page. Readings of a page come one after the other; equal ones are aligned once."""
    out, last, solid, done = [], None, None, {}
    for p, r in zip(page, reading, strict=True):
        if p != last:
            signs = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            last, solid, done = p, np.flatnonzero((signs != ord(" ")) & (signs != ord(LOST))), {}
        if r not in done:
            done[r] = placed(p, r, solid)
        out.append(done[r])
    return pd.Series(out, dtype=object)


def _solid(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(LOST), F.lit(""))


def ballots_of(lines: DataFrame) -> DataFrame:
    """(line_id, at, old, new, start, stop, lost, edge, votes): the line's places as nodes, what readings put there, which
    stretch of the page that takes, and how many do. lines: line_id, page, readings."""
    rows = lines.select("line_id", "page", F.explode(F.transform("readings", _solid)).alias("reading"))
    rows = rows.where((_solid(F.col("page")) != "") & (F.col("reading") != "") & (F.col("reading") != _solid(F.col("page"))))
    cast = rows.select("line_id", F.inline(cast_votes("page", "reading")))
    return cast.groupBy("line_id", *_KINDS).agg(F.count(F.lit(1)).alias("votes"))


def _folded(page: Column, edits: Column) -> Column:
    """The page with what was carried, stretch by stretch; signs of lost characters that nothing took become blanks."""
    done = lambda i: F.coalesce(F.get(edits, i)["stop"], F.lit(0))
    kept = lambda start, stop: F.replace(F.substring(page, start + 1, stop - start), F.lit(LOST), F.lit(" "))
    parts = F.transform(edits, lambda e, i: F.concat(kept(done(i - 1), e["start"]), e["new"]))
    return F.concat(F.array_join(parts, ""), kept(done(F.size(edits) - 1), F.length(page)))


def voted(lines: DataFrame, need: int = 2) -> DataFrame:
    """(line_id, page, merged): lines corrected by `need` of any number of readings. A letter is replaced where so many put the
    same other letter; letters and dashes that so many put in are taken, at an end one letter at most, in place of a blank
    before them or of a placeholder for a lost character, where an end may get more; nothing is deleted and no mark is
    swapped. Placeholders that nothing fills become blanks. Of two texts for a place the one with more votes wins, then
    the first by code points. Null lines stay null; line_id is a line's own."""
    votes = ballots_of(lines).where(F.col("votes") >= need)
    swap = (F.col("old") != "") & F.rlike("old", F.lit(f"^{LETTER}$")) & F.rlike("new", F.lit(f"^{LETTER}$"))
    edge, dashed = F.col("edge"), F.rlike("new", F.lit(f"[{_DASH}]"))
    insert = (F.col("old") == "") & F.rlike("new", F.lit(f"^(?:{LETTER}|[{_DASH}])+$")) & ~(edge & dashed)
    fits = ~edge | F.col("lost") | (F.length("new") == 1)
    best = votes.where(swap | insert).groupBy("line_id", "at", swap.alias("swap")).agg(F.min_by(F.struct("start", "stop", "new", fits.alias("fits")), F.struct(-F.col("votes"), "new")).alias("w"))
    carried = best.where("w.fits").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("w.start", "w.stop", "w.new"))).alias("edits"))
    rows = lines.select("line_id", "page").join(carried, "line_id", "left")
    merged = F.when(F.col("edits").isNull(), F.replace("page", F.lit(LOST), F.lit(" "))).otherwise(_folded(F.col("page"), F.col("edits")))
    return rows.select("line_id", "page", merged.alias("merged"))
