"""Components, hierarchies and ordered set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, key: str = "id", rounds: int = 100) -> DataFrame:
    """(key, component): the least key that each node reaches. Every round a node takes the least label among its
    neighbours and then that label's own, so labels travel fast; it ends when none changes. Rounds are cut by
    checkpoints in the shared folder."""
    spark = nodes.sparkSession
    _shared(spark)
    label = nodes.select(F.col(key).alias("n")).distinct().withColumn("c", F.col("n")).checkpoint()
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    for _ in range(rounds):
        near = both.join(label, F.col("y") == F.col("n")).groupBy("x").agg(F.min("c").alias("m"))
        step = label.join(near, F.col("n") == F.col("x"), "left").select("n", "c", F.least("c", F.coalesce("m", "c")).alias("s"))
        jump = step.select(F.col("n").alias("s"), F.col("s").alias("j"))
        new = step.join(jump, "s", "left").select("n", "c", F.least("s", F.coalesce("j", "s")).alias("d")).checkpoint()
        changed = not new.where("c <> d").isEmpty()
        label = new.select("n", F.col("d").alias("c"))
        if not changed:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return label.select(F.col("n").alias(key), F.col("c").alias("component"))


def _shared(spark) -> None:
    """checkpoint() needs a folder that all executors share; one is set here only where none is."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/docaudit-checkpoints")  # one process here, as in tests


def settled(rows: DataFrame) -> DataFrame:
    """Rows computed once, in the shared folder: what is made of them several times doesn't repeat their plan. They are as large as
    what they came from, whatever Spark makes of its size, so they are never broadcast."""
    _shared(rows.sparkSession)
    return rows.checkpoint().hint("merge")


def similar_style_edges(lines: DataFrame) -> DataFrame:
    """(a, b): lines of a page whose sizes are within 10 % and whose colours are less than 50 apart.
    lines: page, id, px, r, g, b. Sizes join by cells of their logarithm, so only near ones meet."""
    cell = F.floor(F.log(F.col("px")) / 0.1).cast("long")
    rows = lines.withColumn("cell", cell)
    a = rows.select(*(F.col(c).alias(f"{c}_a") for c in rows.columns))
    b = rows.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    both = a.join(b, (F.col("page_a") == F.col("page_b")) & (F.col("cell_a") == F.col("cell_b")) & (F.col("id_a") < F.col("id_b")))
    far = F.sqrt(sum((F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), 2) for c in "rgb"), F.lit(0.0)))
    near = F.abs(F.col("px_a") - F.col("px_b")) <= 0.1 * F.greatest("px_a", "px_b")
    return both.where(near & (far < 50)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def heading_tree(headings: DataFrame, max_level: int = 2) -> DataFrame:
    """(doc, idx, level, text, parent): levels count from the document's top one; deeper ones than max_level go.
    A heading's parent is the last before it of a lower level, found by a window for each level above."""
    top = headings.groupBy("doc").agg(F.min("level").alias("top"))
    rows = headings.join(top, "doc").withColumn("level", F.col("level") - F.col("top") + 1).where(F.col("level") <= max_level).drop("top")
    before = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    parents = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("idx")), ignorenulls=True).over(before)) for k in range(1, max_level)]
    return rows.select("doc", "idx", "level", "text", (F.greatest(*parents) if len(parents) > 1 else parents[0] if parents else F.lit(None).cast("int")).alias("parent"))


def covered_headings(tree: DataFrame, used: DataFrame) -> DataFrame:
    """(doc, idx, covered): a heading is covered if it, one above it or one below it is used. used: doc, idx.
    A closure over levels, by a step for each, not over rows. All sides are as large as the tree, so none is broadcast."""
    up = tree.select("doc", "idx", "parent").join(used.select("doc", "idx").distinct().withColumn("own", F.lit(True)), ["doc", "idx"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    flag = up.withColumn("above", F.col("own")).withColumn("below", F.col("own"))
    for _ in range(2):
        over = flag.select("doc", F.col("idx").alias("parent"), F.col("above").alias("p_above"))
        under = flag.where("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("idx")).agg(F.bool_or("below").alias("c_below"))
        flag = flag.join(over.hint("merge"), ["doc", "parent"], "left").join(under.hint("merge"), ["doc", "idx"], "left")
        flag = flag.select("doc", "idx", "parent", "own", (F.col("above") | F.coalesce("p_above", F.lit(False))).alias("above"), (F.col("below") | F.coalesce("c_below", F.lit(False))).alias("below"))
    return flag.select("doc", "idx", (F.col("above") | F.col("below")).alias("covered"))


def first_seen(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place where each comes first."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias("n")).select(*by, value, "n", *(F.col(f"_f.{c}").alias(f"first_{c}") for c in order))


def pairwise_equal(rows: DataFrame, key: str, by: list[str], value: str, also: list[str] | None = None) -> DataFrame:
    """(by, value, a, b): pairs of keys a < b that have the same value. Rows are made distinct before they meet, so pairs need not
    be, and those of groups of one key don't meet at all."""
    cols = [*by, value, *(also or [])]
    rows = rows.where(F.col(value).isNotNull()).select(*cols, F.col(key).alias("a"))
    several = rows.groupBy(*cols).agg(F.min("a").alias("_low"), F.max("a").alias("_high")).where("_low < _high").select(*cols)
    rows = rows.join(several, cols, "left_semi").distinct()
    return rows.join(rows.withColumnRenamed("a", "b"), cols).where("a < b").select(*cols, "a", "b")
