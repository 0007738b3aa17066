"""Quality rules and an isolation forest over their statistics.

Rule statistics of a whole text are counted exactly. A forest of random trees is grown on the plain statistics of
labelled good documents and a few bad ones; a document's anomaly is 2^(-mean path length / expected path length), near 1 for one
that few random splits set apart. The threshold is calibrated on labelled rows that the forest hasn't seen. No
statistic has a limit of its own: splits and threshold come from the rows alone.

The fit takes at most SAMPLE labelled rows, those of least hash of their id; rows that fail the base rule, which
decides about them anyway, teach nothing. Everything else covers all rows.

Cases: null text has no words and fails the base rule; without labelled good documents there is no forest, the
anomaly is null and the base rule alone decides; ids are of any type that labels can be joined by; a document labelled more than once counts as good only if all
its labels say so; null labels are ignored; equal texts get equal verdicts. Other columns aren't read by
`judge`, and pass through `keep`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .words import windows, word_hashes

#: Labelled rows that the fit takes at most; trees; rows a tree is grown on; share of good rows that may go at most.
SAMPLE, TREES, TREE_ROWS, MAY_GO, SEED = 20_000, 200, 256, 0.005, 1
#: Bad rows that one good row that goes has to be worth.
WORTH = 3
#: Bad rows among those that trees are grown on: few, so that they stay anomalies, but random splits reach them.
BAD_SHARE = 0.03
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES, SYMBOLS, DIGITS, MARKS = b" \t\n\v\f\r", b"#*$%&|<>", b"0123456789", b"!?.,;:-_()[]{}\"'/\\@=+~^`"
#: Fixed limits of the base rule.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: What the forest splits on: shares of symbols and of what is neither digit nor ASCII mark in the words' characters,
#: length of a word, share of words equal to the one before, and logarithm of distinct words to that of words.
N_STATS = 5


def counts(text: str) -> tuple[list[int], list[float]]:
    """The counts named in COUNTS, and the statistics that the forest splits on."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, SPACES)
    chars = len(text) - (len(raw) - len(solid))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n:
        w = windows(word_hashes(words), 5)
        s = np.sort(w)
        again = s[1:][s[1:] == s[:-1]]
        if len(again):
            starts = np.isin(w, np.unique(again))
            covered = np.zeros(n, bool)
            for i in range(5):
                covered[i : n - 4 + i] |= starts
            repeated = int(covered.sum())
    found = [n, chars, symbols, len(lines) - len(set(lines)), repeated]
    marks = len(solid) - len(solid.translate(None, DIGITS + MARKS + SYMBOLS))
    low = raw.lower().split()
    same = sum(map(eq, low, islice(low, 1, None)))
    variety = math.log(max(1, len(set(low)))) / math.log(max(2, n))
    return found, [symbols / max(1, chars), 1 - marks / max(1, chars), chars / max(1, n), same / max(1, n - 1), variety]


@dataclass
class Forest:
    """Complete binary trees in arrays: a node i has children 2i+1 and 2i+2; a leaf holds its path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    scale: float
    threshold: float = np.inf

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] >= split[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
    size = 2 ** (depth + 1) - 1
    f = Forest(np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size)), depth, max(1e-9, expected_path(max(2, rows))))

    def build(t: int, node: int, part: np.ndarray, at: int) -> None:
        low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
        can = np.flatnonzero(high > low)
        if at == depth or len(part) <= 1 or not len(can):
            f.length[t, node] = at + expected_path(len(part))
            return
        k = int(rng.choice(can))
        cut = rng.uniform(low[k], high[k])
        f.feature[t, node], f.split[t, node] = k, cut
        build(t, 2 * node + 1, part[part[:, k] < cut], at + 1)
        build(t, 2 * node + 2, part[part[:, k] >= cut], at + 1)

    for t in range(trees):
        build(t, 0, x[rng.choice(len(x), rows, replace=False)], 0)
    return f


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, may_go: float = MAY_GO) -> float:
    """The threshold that most of the bad rows less WORTH times the good rows are above, of those that let at most a
    share `may_go` of the good rows go; half-way to the next row, and the least of equals. Without bad rows, the one that just lets that share go."""
    if not len(good):
        return np.inf
    a, z = np.sort(forest.anomaly(good)), np.sort(forest.anomaly(bad)) if len(bad) else np.zeros(0)
    least = a[min(len(a) - 1, max(0, math.ceil(len(a) * (1 - may_go)) - 1))]
    if not len(z):
        return float(least)
    at = np.unique(np.concatenate([[least], a[a >= least], z[z >= least]]))
    worth = (len(z) - np.searchsorted(z, at, "right")) - WORTH * (len(a) - np.searchsorted(a, at, "right"))
    best = int(worth.argmax())
    return float(at[best : best + 2].mean())


def _statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with COUNTS and the statistics as an array."""
    names = [*columns, *COUNTS, "stats"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{c} long" for c in COUNTS), "stats array<double>"])

    def run(batches):
        for block in text_blocks(batches):
            found = [counts(t or "") for t in block.column(len(columns)).to_pylist()]
            flat = pa.array([y for _, x in found for y in x], pa.float64())
            stats = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, N_STATS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(block.column(i) for i in range(len(columns))), *(pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(COUNTS))), stats], names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Grows the forest on one half of the sample and calibrates it on the other half."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("long").alias("good"))
    turn = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = docs.select("doc_id").join(marks, "doc_id").groupBy("doc_id").agg(F.first("good").alias("good")).orderBy(turn, "doc_id").limit(sample).collect()
    if not chosen:
        return None
    # At most `sample` ids and marks: a proven bound for the broadcast.
    ids = spark.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, good long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    passed = (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words"))
    found = _statistics(rows, ["doc_id", "good"]).where(passed).groupBy("doc_id").agg(F.first("good").alias("good"), F.min("stats").alias("stats")).orderBy("doc_id").collect()
    if not found:
        return None
    x, good = np.array([r.stats for r in found]), np.array([r.good > 0 for r in found])
    half = np.random.default_rng(SEED).permutation(len(found)) % 2 == 0
    if not (good & half).any():
        half = ~half
    if not (good & half).any():
        return None
    bad = np.flatnonzero(~good & half)[: int(np.ceil(BAD_SHARE * (good & half).sum()))]
    forest = grow(np.concatenate([x[good & half], x[bad]]))
    forest.threshold = calibrate(forest, x[good & ~half] if (good & ~half).any() else x[good], x[~good & ~half])
    return forest


def judge(docs: DataFrame, forest: Forest | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns with COUNTS, base_failed, kept, anomaly."""
    names = [*columns, *COUNTS, "base_failed", "kept", "anomaly"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, anomaly double"])

    def run(batches):
        for block in text_blocks(batches):
            found = [counts(t or "") for t in block.column(len(columns)).to_pylist()]
            c = np.array([f[0] for f in found], np.int64)
            failed = (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEATED * c[:, 0])
            anomaly = forest.anomaly(np.array([f[1] for f in found])) if forest else None
            kept = ~failed & (anomaly <= forest.threshold if forest else True)
            yield pa.RecordBatch.from_arrays([*(block.column(i) for i in range(len(columns))), *(pa.array(c[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(anomaly) if forest else pa.nulls(len(c), pa.float64())], names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that the rules and the forest keep, with all their columns."""
    def run(batches):
        for block in text_blocks(batches):
            found = [counts(t or "") for t in block.column(block.schema.get_field_index("text")).to_pylist()]
            c = np.array([f[0] for f in found], np.int64)
            kept = (c[:, 0] >= LEAST_WORDS) & (100 * c[:, 4] <= MOST_REPEATED * c[:, 0])
            if forest:
                kept &= forest.anomaly(np.array([f[1] for f in found])) <= forest.threshold
            yield block.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
