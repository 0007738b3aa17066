"""How a page renders the strings that it should have: best renderings, their places, and text that no string has.

Strings and lines of a page are cut in parts of PART, and parts meet in pairs, so that no task holds a page. Within a pair
candidates come in falling order of what they can reach at most, by shared characters, and aligning stops as soon as none
can do better than the best so far: results are those of aligning all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text
from docaudit.functions.align import common_lengths, matched
from docaudit.functions.automaton import Pool

PART = 128
BOX = ["x0", "y0", "x1", "y1"]


def reach(wanted: list[str], found: list[str]) -> np.ndarray:
    """For each pair how many characters an alignment can match at most: those that both have, counted with repeats."""
    chars = {c: i for i, c in enumerate(sorted(set("".join(wanted))))}

    def counts(strings: list[str]) -> np.ndarray:
        out = np.zeros((len(chars), len(strings)), np.int32)
        for k, s in enumerate(strings):
            at = [chars[c] for c in s if c in chars]
            np.add.at(out[:, k], at, 1)
        return out

    a, b = counts(wanted), counts(found)
    out = np.zeros((len(wanted), len(found)), np.int32)
    for x, y in zip(a, b, strict=True):
        i, j = np.flatnonzero(x), np.flatnonzero(y)
        if len(j):
            out[np.ix_(i, j)] += np.minimum.outer(x[i], y[j])
    return out


def best_shares(wanted: list[str], found: list[str]) -> list[tuple[float, int]]:
    """(best share of each wanted string's characters found in order, alignments made); whole ones need none."""
    found = list(dict.fromkeys(found))
    whole = [not w or any(w in f for f in found) for w in wanted]
    rest = [w for w, done in zip(wanted, whole, strict=True) if not done]
    most, out, k = reach(rest, found), [], 0
    for w, done in zip(wanted, whole, strict=True):
        if done:
            out.append((1.0, 0))
            continue
        out.append(_best_share(w, found, most[k]))
        k += 1
    return out


def _likely(w: str, found: list[str], among: list[int]) -> int:
    """The candidate that has most of some grams of a string."""
    grams = {w[i : i + 8] for i in range(0, len(w), max(1, len(w) // 16))}
    return max(among, key=lambda j: sum(g in found[j] for g in grams))


def _best_share(w: str, found: list[str], most: np.ndarray) -> tuple[float, int]:
    """The best share, and how many candidates come before none that is left can reach more, in falling order of `most`. What the
    candidates have in common with the string at all, in order, says which of them need an alignment."""
    order = np.argsort(-most, kind="stable")
    order = order[: np.searchsorted(-most[order], 0)]  # the others share no character
    if not len(order):
        return 0.0, 0
    made: dict[int, int] = {}

    def share(j: int) -> int:
        if j not in made:
            made[j] = matched(w, found[j])
        return made[j]

    # A candidate with many grams of the string gives a bound from below, so that few need a closer look.
    best = share(_likely(w, found, order.tolist()))
    held = [j for j in order.tolist() if most[j] >= best]
    common = dict(zip(held, common_lengths(w, [found[j] for j in held]), strict=True))
    for j in sorted(held, key=lambda j: -common[j]):
        if common[j] <= best:
            break
        best = max(best, share(j))
    # Candidates that could have more come first; those that could have as much count up to the first that has.
    before = [j for j in held if most[j] > best]
    if any(common[j] >= best and share(j) == best for j in before):
        return best / len(w), len(before)
    for n, j in enumerate((j for j in held if most[j] == best), len(before) + 1):
        if common[j] >= best and share(j) == best:
            return best / len(w), n
    return best / len(w), len(before)


def best_places(wanted: list[str], found: list[str], boxes: list[tuple]) -> list[tuple[float, int | None, int]]:
    """(score, place of the best candidate, alignments made). Candidates longer than 1.43 times the wish count less;
    of equal scores the topmost wins, then the leftmost."""
    most, out = reach(wanted, found), []
    for k, w in enumerate(wanted):
        weight = np.array([min(1.0, len(w) / len(f) + 0.3) for f in found])
        bound = most[k] / len(w) * weight
        order = [j for j in np.argsort(-bound, kind="stable").tolist() if bound[j] > 0]
        made: dict[int, tuple[float, float, float]] = {}

        def score(j: int) -> tuple[float, float, float]:
            if j not in made:
                made[j] = (matched(w, found[j]) / len(w) * weight[j], -boxes[j][1], -boxes[j][0])  # noqa: B023
            return made[j]

        if not order:
            out.append((0.0, None, 0))
            continue
        best = score(_likely(w, found, order))
        held = [j for j in order if bound[j] >= best[0]]
        common = np.array(common_lengths(w, [found[j] for j in held])) / len(w) * weight[held]
        for n in np.argsort(-common, kind="stable").tolist():
            if common[n] < best[0]:
                break
            best = max(best, score(held[n]))
        place = next((j for j in order if made.get(j) == best), None) if best[0] > 0 else None
        out.append((float(best[0]), place, len(made)))
    return out


def parts(rows: DataFrame, columns: list[str], order: list[str], name: str, size: int = PART) -> DataFrame:
    """(page, name): the rows of each page in order, as arrays of at most `size`."""
    at = F.row_number().over(Window.partitionBy("page").orderBy(*order))
    cut = rows.withColumn("_at", at).withColumn("_part", F.floor((F.col("_at") - 1) / size))
    return cut.groupBy("page", "_part").agg(F.array_sort(F.collect_list(F.struct(F.col("_at"), *columns))).alias(name)).drop("_part")


def line_groups(lines: DataFrame) -> DataFrame:
    """(page, found): single lines and pairs of neighbours of a page, normalised. lines: page, pos, text."""
    w = Window.partitionBy("page").orderBy("pos")
    rows = lines.select("page", text.normalise(F.col("text")).alias("one"), F.lead(text.normalise(F.col("text"))).over(w).alias("next"))
    return rows.select("page", F.explode(F.array_compact(F.array("one", F.when(F.col("next").isNotNull(), F.concat("one", "next"))))).alias("found"))


def best_renderings(strings: DataFrame, lines: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """(page, sid, ratio, pairs, aligned): the best share of a string found on its page, among how many candidates, and
    how many of them were aligned. strings: page, sid, text; lines: page, pos, text; stacks: page, text. A string without
    characters has 1, a page without lines 0."""
    want = strings.select("page", "sid", F.coalesce(text.normalise(F.col("text")), F.lit("")).alias("want"))
    found = line_groups(lines)
    if stacks is not None:
        found = found.unionByName(stacks.select("page", text.normalise(F.col("text")).alias("found")))
    both = parts(want, ["sid", "want"], ["sid"], "ws").join(parts(found.where("found IS NOT NULL"), ["found"], ["found"], "fs"), "page", "left")
    kinds = {f.name: f.dataType.simpleString() for f in want.schema}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, ws, fs in zip(pdf["page"], pdf["ws"], pdf["fs"], strict=True):
                fs = [f["found"] for f in fs] if fs is not None else []
                shares = best_shares([w["want"] for w in ws], fs)
                out += [(page, w["sid"], ratio, len(fs), made) for w, (ratio, made) in zip(ws, shares, strict=True)]
            yield pd.DataFrame(out, columns=["page", "sid", "ratio", "pairs", "aligned"])

    rows = both.mapInPandas(run, f"page {kinds['page']}, sid {kinds['sid']}, ratio double, pairs long, aligned long")
    return rows.groupBy("page", "sid").agg(F.max("ratio").alias("ratio"), F.sum("pairs").alias("pairs"), F.sum("aligned").alias("aligned"))


def best_ratio(strings: DataFrame, lines: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """(page, sid, ratio): the best share of a string found on its page."""
    return best_renderings(strings, lines, stacks).select("page", "sid", "ratio")


def locate(strings: DataFrame, lines: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(page, sid, x0, y0, x1, y1, score): where a string's likeliest rendering is; longer candidates count less, and
    below 0.45 there is none. lines: page, pos, text, x0, y0, x1, y1; chains: page, text, x0, y0, x1, y1."""
    w = Window.partitionBy("page").orderBy("pos")
    one = lines.select("page", "text", *BOX)
    ahead = {c: F.lead(c).over(w) for c in ["text", *BOX]}
    two = lines.select("page", "text", *BOX, *(v.alias(f"n_{c}") for c, v in ahead.items())).where(F.abs(F.col("y0") - F.col("n_y0")) < F.col("y1") - F.col("y0"))
    two = two.select("page", F.concat("text", "n_text").alias("text"), F.least("x0", "n_x0").alias("x0"), F.least("y0", "n_y0").alias("y0"), F.greatest("x1", "n_x1").alias("x1"), F.greatest("y1", "n_y1").alias("y1"))
    found = one.unionByName(two) if chains is None else one.unionByName(two).unionByName(chains.select("page", "text", *BOX))
    found = found.select("page", text.normalise(F.col("text")).alias("found"), *(F.col(c).cast("double").alias(c) for c in BOX)).where("found <> ''")
    want = strings.select("page", "sid", text.normalise(F.col("text")).alias("want")).where(F.length("want") >= 2)
    both = parts(want, ["sid", "want"], ["sid"], "ws").join(parts(found, ["found", *BOX], ["y0", "x0", "found"], "fs"), "page")
    kinds = {f.name: f.dataType.simpleString() for f in want.schema}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, ws, fs in zip(pdf["page"], pdf["ws"], pdf["fs"], strict=True):
                boxes = [tuple(f[c] for c in BOX) for f in fs]
                places = best_places([w["want"] for w in ws], [f["found"] for f in fs], boxes)
                out += [(page, w["sid"], *boxes[at], score) for w, (score, at, _) in zip(ws, places, strict=True) if at is not None]
            yield pd.DataFrame(out, columns=["page", "sid", *BOX, "score"])

    rows = both.mapInPandas(run, f"page {kinds['page']}, sid {kinds['sid']}, x0 double, y0 double, x1 double, y1 double, score double")
    top = rows.groupBy("page", "sid").agg(F.max_by(F.struct(*BOX, "score"), F.struct("score", -F.col("y0"), -F.col("x0"))).alias("b"))
    return top.select("page", "sid", "b.*").where("score >= 0.45")


def _lines_and_pools(strings: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, ls, pool): parts of a page's distinct normalised lines, and the page's strings."""
    pool = strings.groupBy("page").agg(F.collect_set(text.normalise(F.col("text"))).alias("pool"))
    norms = lines.select("page", text.normalise(F.col("text")).alias("norm")).where("norm IS NOT NULL").distinct()
    return parts(norms, ["norm"], ["norm"], "ls", 16 * PART).join(pool, "page", "left")


def covered_shares(strings: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, norm, covered, lacks): of each distinct line of a page how many characters its strings have, and whether it
    has text that none has. The strings make up one automaton for a part of the page's lines, and a line is walked once."""
    kind = lines.select("page").schema[0].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, ls, pool in zip(pdf["page"], pdf["ls"], pdf["pool"], strict=True):
                have = Pool(pool if pool is not None else [])
                out += [(page, r["norm"], sum(have.covered(r["norm"])), have.lacks(r["norm"])) for r in ls]
            yield pd.DataFrame(out, columns=["page", "norm", "covered", "lacks"])

    return _lines_and_pools(strings, lines).mapInPandas(run, f"page {kind}, norm string, covered long, lacks boolean")


def extra_lines(strings: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with text that none of their page's strings has. A page's strings are a short list."""
    extra = covered_shares(strings, lines).where("lacks").select("page", "norm")
    return lines.withColumn("norm", text.normalise(F.col("text"))).join(extra, ["page", "norm"], "left_semi").select(*lines.columns)


def close_earlier(rows: DataFrame, least: float) -> DataFrame:
    """(page, sid, other): texts of a page that are close to an earlier one (twice the matching characters over both lengths), and
    the earliest. Lengths and shared characters say for most pairs that they can't be. rows: page, pos, sid, text."""
    cut = parts(rows.where("text <> ''"), ["pos", "sid", "text"], ["pos"], "ws")
    both = cut.join(cut.withColumnRenamed("ws", "fs"), "page")
    both = both.where(F.array_min(F.transform("fs", lambda f: f.pos)) < F.array_max(F.transform("ws", lambda w: w.pos)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, ws, fs in zip(pdf["page"], pdf["ws"], pdf["fs"], strict=True):
                most = reach([w["text"] for w in ws], [f["text"] for f in fs])
                for w, row in zip(ws, most, strict=True):
                    for f, n in zip(fs, row.tolist(), strict=True):  # in order of pos: the first that is close is the earliest
                        both = len(w["text"]) + len(f["text"])
                        if f["pos"] < w["pos"] and 2.0 * n / both >= least and 2.0 * matched(w["text"], f["text"]) / both >= least:
                            out.append((page, w["sid"], f["pos"], f["sid"]))
                            break
            yield pd.DataFrame(out, columns=["page", "sid", "pos", "other"])

    found = both.mapInPandas(run, f"page {kinds['page']}, sid {kinds['sid']}, pos {kinds['pos']}, other {kinds['sid']}")
    return found.groupBy("page", "sid").agg(F.min_by("other", "pos").alias("other"))
