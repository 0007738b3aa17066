"""Robust statistics, pair similarity, histograms and fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.medians import group_medians


def median_deviation(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Rows with `median` of their group and `mad`, the median of absolute distances from it. The two medians are
    tables with a row a group, joined back, so no group is gathered with its rows."""
    med = group_medians(rows, by, {"median": value})
    rows = rows.join(med, by)
    mad = group_medians(rows, by, {"mad": F.abs(value - F.col("median"))})
    return rows.join(mad, by)


def outliers(rows: DataFrame, by: list[str], value: Column, times: float) -> DataFrame:
    """Rows that are over `times` the median away from it."""
    return rows.join(group_medians(rows, by, {"median": value}), by).where(F.abs(value - F.col("median")) > times * F.col("median"))


def title_drift(titles: DataFrame) -> DataFrame:
    """Titles of a tone (4 at least; hero and asym pages apart) that are off in place or size.
    titles: page, tone, kind, skeleton, x0, y0, h as shares of the page."""
    used = titles.where(F.coalesce("kind", F.lit("content")).isin("content", "summary", "agenda", "appendix") & ~F.coalesce("skeleton", F.lit("")).isin("hero", "asym"))
    used = used.withColumn("tone", F.coalesce("tone", F.lit("light")))
    mid = group_medians(used, ["tone"], {"mx": F.col("x0"), "my": F.col("y0"), "mh": F.col("h")})
    mid = mid.join(used.groupBy("tone").agg(F.count(F.lit(1)).alias("n")), "tone").where("n >= 4")
    used = used.join(mid, "tone")
    left = group_medians(used, ["tone"], {"spread": F.abs(F.col("x0") - F.col("mx"))})
    used = used.join(left, "tone")
    y, x = F.abs(F.col("y0") - F.col("my")) > 0.03, (F.col("spread") < 0.01) & (F.abs(F.col("x0") - F.col("mx")) > 0.03)
    size = (F.col("mh") != 0) & ~(F.col("h") / F.col("mh")).between(0.85, 1.18)
    return used.select("page", "tone", y.alias("off_y"), x.alias("off_x"), size.alias("off_size")).where("off_y OR off_x OR off_size")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column, centred: bool = False) -> Column:
    """The vector at length 1, less its mean if centred."""
    v = F.transform(v, lambda x: x.cast("double"))
    if centred:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        v = F.transform(v, lambda x: x - mean)
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def histogram_overlap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)


#: Vectors that are multiplied at once with as many others, and vectors of a block, which is what a task gets two of. Up to BLOCKS
#: blocks a table of any size is cut in, so what moves grows with the table; beyond BLOCKS * MOST_ROWS vectors it takes more.
BLOCK_ROWS, BLOCKS, MOST_ROWS = 2048, 16, 32768


def n_blocks(rows: int) -> int:
    return max(1, min(BLOCKS, -(-rows // BLOCK_ROWS)), -(-rows // MOST_ROWS))


def block_products(rows: DataFrame, key: str, vector: str, schema: str, reduce) -> DataFrame:
    """`reduce`(a, b, similarity) of every two tiles of vectors, as arrays of all pairs a < b of the two: a stated set
    against itself. Each row goes to the pairs of blocks that hold it, so a task multiplies two blocks of a bounded size,
    tile by tile, no pair is made twice, and only what `reduce` keeps leaves it."""
    blocks = n_blocks(rows.count())
    rows = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("blk"))
    spread = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("k", "v", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        k, blk, vectors = table["k"].to_numpy(), table["blk"].to_numpy(), table["v"].combine_chunks()
        if vectors.null_count or len(set(vectors.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors have to be there, and of one length")
        v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)
        same = table["lo"][0] == table["hi"][0]
        tiles = lambda at: [at[i : i + BLOCK_ROWS] for i in range(0, len(at), BLOCK_ROWS)]
        first, second = (tiles(np.flatnonzero(blk == table[c][0].as_py())) for c in ("lo", "hi"))
        out = []
        for n, one in enumerate(first):
            for m, other in enumerate(second):
                if same and m < n:
                    continue
                s = v[one] @ v[other].T
                a, b = k[one][:, None], k[other][None, :]
                i, j = np.nonzero((a < b) if same and m == n else (a != b) if same else np.ones(s.shape, bool))
                a, b = k[one][i], k[other][j]
                out.append(reduce(np.minimum(a, b), np.maximum(a, b), s[i, j]))
        none = np.zeros(0, k.dtype)
        return pa.concat_tables(out) if out else reduce(none, none, np.zeros(0))

    return spread.groupBy("lo", "hi").applyInArrow(run, schema)


def _kind(rows: DataFrame, key: str) -> str:
    return rows.schema[key].dataType.simpleString()


def _pairs_schema(rows: DataFrame, key: str) -> str:
    return f"a {_kind(rows, key)}, b {_kind(rows, key)}, similarity double"


def _pairs_table(a, b, s) -> pa.Table:
    return pa.table({"a": a, "b": b, "similarity": s})


def close_pairs(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs a < b of the threshold or more."""
    def reduce(a, b, s):
        near = s >= threshold
        return _pairs_table(a[near], b[near], s[near])

    return block_products(rows, key, vector, _pairs_schema(rows, key), reduce)


def close_counts(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(key, n_close) of the rows that have a pair of the threshold or more: counted tile by tile, so that no pair leaves its task."""
    def reduce(a, b, s):
        near = s >= threshold
        k, n = np.unique(np.concatenate([a[near], b[near]]), return_counts=True)
        return pa.table({key: k, "n": n.astype(np.int64)})

    return block_products(rows, key, vector, f"{key} {_kind(rows, key)}, n long", reduce).groupBy(key).agg(F.sum("n").alias("n_close"))


def top_pairs(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k most similar pairs, the greatest keys first among equals: each two tiles give their best k."""
    def reduce(a, b, s):
        near = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, -k)[-k])
        best = near[np.lexsort((-b[near], -a[near], -s[near]))[:k]]  # of equal ones, however many, only k go on
        return _pairs_table(a[best], b[best], s[best])

    return block_products(rows, key, vector, _pairs_schema(rows, key), reduce).orderBy(F.desc("similarity"), F.desc("a"), F.desc("b")).limit(k)


def similarity_report(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """n_pairs, mean, n_close of all pairs."""
    def reduce(a, b, s):
        return pa.table({"n": [len(s)], "total": [float(s.sum())], "close": [int((s >= threshold).sum())]})

    found = block_products(rows, key, vector, "n long, total double, close long", reduce)
    return found.agg(F.sum("n").alias("n_pairs"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("close").alias("n_close"))


def conflicts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups that give one thing several values, and how many."""
    return rows.groupBy(*by).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def histogram(rows: DataFrame, by: list[str], bin_of: Column) -> DataFrame:
    """Shares of a group's rows by bin."""
    n = rows.groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    return n.join(total, by).select(*by, "bin", (F.col("n") / F.col("total")).alias("share"))


def fit_two(rows: DataFrame, x: Column, y: Column, z: Column, by: list[str] | None = None) -> DataFrame:
    """Least squares of z on x and y without intercept, from sums: coefficients a and b."""
    s = {n: F.sum(p) for n, p in {"xx": x * x, "xy": x * y, "yy": y * y, "xz": x * z, "yz": y * z}.items()}
    sums = rows.groupBy(*(by or [])).agg(*(c.alias(n) for n, c in s.items()))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return sums.select(*(by or []), ((F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).alias("a"), ((F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det).alias("b"))


def largest_residual(rows: DataFrame, fit: DataFrame, x: Column, y: Column, z: Column, by: list[str]) -> DataFrame:
    return rows.join(fit, by).groupBy(*by).agg(F.max(F.abs(z - F.col("a") * x - F.col("b") * y)).alias("max_residual"))


def best_by_weight(rows: DataFrame, by: list[str], choice: str, weight: Column, score: Column) -> DataFrame:
    """The choice of least weighted total, ties to the first by name."""
    totals = rows.groupBy(*by, choice).agg(F.sum(weight * score).alias("total"))
    return totals.groupBy(*by).agg(F.min_by(choice, F.struct("total", choice)).alias(choice), F.min("total").alias("total"))


def two_probe_median(rows: DataFrame, by: list[str], value: str, near: Column, limit: float = 0.3) -> DataFrame:
    """The median of a group's probes; of two that disagree by over the limit, the one closest to `near`."""
    agg = rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("m"), F.min_by(value, F.struct(F.abs(F.col(value) - near), F.col(value))).alias("closest"), F.count(F.lit(1)).alias("n"), (F.max(value) - F.min(value)).alias("spread"))
    return agg.select(*by, F.when((F.col("n") == 2) & (F.col("spread") > limit), F.col("closest")).otherwise(F.col("m")).alias("offset"))


def colour_bin(r: Column, g: Column, b: Column) -> Column:
    """One of 39 bins: 12 hues by 3 saturations, then 3 greys; channels from 0 to 255."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    saturation = F.when(high > 0, span / high).otherwise(0.0)
    hue = F.when(span == 0, 0.0).when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    grey = 36 + F.least(F.floor(high / 256 * 3), F.lit(2))
    return F.when(saturation < 0.12, grey).otherwise(F.least(F.floor(hue * 12), F.lit(11)) * 3 + F.least(F.floor((saturation - 0.12) / 0.88 * 3), F.lit(2))).cast("int")


def corner_tone(pixels: DataFrame, by: list[str]) -> DataFrame:
    """dark, busy: whether a corner's mean luminance is below 110, and whether its deviation is over 22, so that a
    number on it needs a backing and counts as on dark. pixels: r, g, b from 0 to 255."""
    # Weights of the channels in 65,536ths, rounded.
    lum = F.floor((F.col("r").cast("long") * 19595 + F.col("g").cast("long") * 38470 + F.col("b").cast("long") * 7471 + 32768) / 65536)
    found = pixels.groupBy(*by).agg(F.avg(lum).alias("mean"), F.stddev_pop(lum).alias("spread"))
    busy = F.col("spread") > 22
    return found.select(*by, "mean", ((F.col("mean") < 110) | busy).alias("dark"), busy.alias("busy"))


def logo_class(pixels: DataFrame, by: list[str]) -> DataFrame:
    """light, dark or colour by the neutral pixels' share and mean luminance. pixels: r, g, b."""
    lum = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    neutral = F.greatest("r", "g", "b") - F.least("r", "g", "b") < 30
    agg = pixels.groupBy(*by).agg(F.avg(neutral.cast("int")).alias("share"), F.avg(F.when(neutral, lum)).alias("mean"))
    return agg.select(*by, F.when((F.col("share") >= 0.3) & (F.col("mean") > 200), "light").when((F.col("share") >= 0.3) & (F.col("mean") < 120), "dark").otherwise("colour").alias("logo_class"))


def pixel_difference(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the largest channel difference, and the share of pixels over 40. pixels: r, g, b, r2, g2, b2."""
    d = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"))
    return pixels.groupBy(*by).agg(F.avg(d).alias("mean_diff"), F.avg((d > 40).cast("int")).alias("share_over_40"))
