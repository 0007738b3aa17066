"""Mixing sources to target weights by exact block quotas and a multivariate-hypergeometric splitting tree.
DataFrame functions only.

Every document has a keyed 64-bit place; the leading BITS of it name its block within the source. A source's
target says how often the whole source is taken, how many of its blocks (in a permuted order) are taken once
more, and how far into one last block the mix goes; that block is opened level by level, so the cut falls at a
document and no task sees more than one block of one level. The block copies taken are then dealt over the
output shards: a tree halves the shards, and at each node the left half's quota of every source is a draw from
the multivariate hypergeometric distribution of the copies at the node. A shard draws its quota from the
source's permuted blocks, next after those of the shard before it, and shuffles its documents by a local key: `mix`
writes them in the order of shard and key, `report` tells the place in it.

Cases: null text has size 0; documents of size 0 are taken with their block and count for nothing; a null source
is a source of its own, last in order; sources without words have target 0; equal rows share a place, so they
are taken alike; an empty table gives an empty result. Other columns, whatever their names, pass through `mix`;
where one has the name of an added column, the added one's name gets underscores until it is free. Windows over all
sources hold a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS, CAP = (1.0, 2.0, 3.0), 3.0
#: Leading bits of a place at each level: blocks of a source, then what the last block taken is opened into.
BITS = (8, 8, 8)
SHARDS = 16
#: Leading bits of a local key that make a piece of a shard; pieces are ordered by themselves.
PIECE_BITS = 8
#: Equal rows that one task numbers.
SLICE = 1 << 16
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text") -> Column:
    """63 bits from id and text, so that rows without ids differ too."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[key], docs[text]), 1)


def _block(place: Column, level: int) -> Column:
    """The place's digit at a level."""
    return F.shiftrightunsigned(place, 63 - sum(BITS[: level + 1])).bitwiseAND(2 ** BITS[level] - 1).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target from (source, size) totals. Shares by weight, capped at `cap` times a
    source's size; what is over goes to the others by weight, until none is above. The sources at their cap are
    those of least cap to weight, so running sums in that order find the level that the others share."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    rows = rows.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(*ALL)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    rows = rows.withColumn("water", level["level"])
    return rows.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def cuts(sizes: DataFrame, goal: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """What of each source is taken beyond whole passes: (source, block, full: taken once more as a whole) for
    its blocks, and (source, edge, below): documents of block `edge` are taken if their place is below `below`."""
    rest = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    rest = rest.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    blocks = sizes.groupBy("source", _block(F.col("place"), 0).alias("block")).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    upto = F.sum("n").over(order)
    blocks = blocks.withColumn("turn", F.row_number().over(order)).withColumn("upto", upto)
    goals = rest.select(F.col("source").alias("s"), "passes", "rest")
    blocks = blocks.join(goals, _same("source", "s")).drop("s").withColumn("full", F.col("upto") <= F.col("rest"))
    inside = ~F.col("full") & (F.col("upto") - F.col("n") < F.col("rest"))
    edge = blocks.where(inside).select(F.col("source").alias("s"), F.col("block").alias("edge"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    # The edge block is opened: at each level the digits before the one in which the rest runs out are taken.
    rows = sizes.join(edge, _same("source", "s") & (_block(F.col("place"), 0) == F.col("edge"))).select("source", "edge", "rest", "place", "size")
    for level in range(1, len(BITS)):
        digits = rows.groupBy("source", "edge", "rest", _block(F.col("place"), level).alias("digit")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("digit"))
        last = digits.withColumn("upto", run).withColumn("rest", F.col("rest") - F.col("upto") + F.col("n")).where((F.col("rest") > 0) & (F.col("rest") <= F.col("n")))
        last = last.select(F.col("source").alias("s"), "digit", F.col("rest").alias("left"))
        rows = rows.join(last, _same("source", "s") & (_block(F.col("place"), level) == F.col("digit"))).select("source", "edge", F.col("left").alias("rest"), "place", "size")
    # Whole documents from here: one is taken if at least half of it lies before the cut.
    run = F.sum("size").over(Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("taken", run - F.col("size") / 2 <= F.col("rest"))
    first_left = F.min(F.when(~F.col("taken"), F.col("place")))
    below = rows.groupBy("source", "edge").agg(F.coalesce(first_left, F.max("place") + 1).alias("below"))
    return blocks.select("source", "block", "n", "turn", "passes", "full"), below


def tree(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, drawn, shard) from (source, units): each source's copies dealt over the shards. A node's copies
    are put in a keyed order and the left half of its shards gets its share of them, which draws the sources'
    quotas of the left half from the multivariate hypergeometric distribution."""
    rows = units.select("source", F.explode(F.sequence(F.lit(1), F.col("units"))).alias("i")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    for level in range(max(1, shards - 1).bit_length()):
        node = Window.partitionBy("lo", "hi")
        turn = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "i"), F.col("source").asc_nulls_last(), "i"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        share = F.round(F.count(F.lit(1)).over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        rows = rows.withColumn("mid", mid).withColumn("go_left", (turn <= share) & (F.col("hi") - F.col("lo") > 1))
        split = F.col("hi") - F.col("lo") > 1
        rows = rows.withColumns({"lo": F.when(split & ~F.col("go_left"), F.col("mid")).otherwise(F.col("lo")), "hi": F.when(split & F.col("go_left"), F.col("mid")).otherwise(F.col("hi"))}).drop("mid", "go_left")
    drawn = F.row_number().over(Window.partitionBy("source").orderBy("lo", "i"))
    return rows.select("source", drawn.alias("drawn"), F.col("lo").alias("shard"))


def plan(sizes: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mix's decisions from (source, place, size): a row a source (target, passes, edge, below) and a row a
    block (shards: of its copies in turn). Both are tables with a row for each source or block of a source."""
    goal = scratch.write(targets(sizes))
    blocks, below = cuts(sizes, goal, seed)
    below = scratch.write(below)
    edge = below.select(F.col("source").alias("s"), "edge")
    blocks = blocks.join(edge, _same("source", "s") & (F.col("block") == F.col("edge")), "left")
    blocks = scratch.write(blocks.withColumn("copies", F.col("passes") + F.when(F.col("full") | F.col("edge").isNotNull(), 1).otherwise(0)).drop("s", "edge"))
    copies = blocks.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    pos = F.row_number().over(Window.partitionBy("source").orderBy("copy", "turn"))
    copies = copies.withColumn("pos", pos)
    dealt = tree(copies.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("units")), shards, seed).withColumnRenamed("source", "s")
    dealt = copies.join(dealt, _same("source", "s") & (F.col("pos") == F.col("drawn")))
    dealt = dealt.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x.shard).alias("shards"))
    whole = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "passes", "full")
    dealt = whole.join(dealt, _same("source", "s") & (F.col("block") == F.col("b")), "left").select(F.col("s").alias("source"), F.col("b").alias("block"), "passes", "full", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    cut = below.withColumnRenamed("source", "s")
    return scratch.write(goal.join(cut, _same("source", "s"), "left").drop("s")), scratch.write(dealt)


def copies(rows: DataFrame, by_source: DataFrame, by_block: DataFrame) -> DataFrame:
    """Adds mix_source_size, mix_target and mix_shards (the shard of each copy, none if not taken) to rows with
    mix_source, mix_place. The joined tables are as small as the sources and their blocks; Spark broadcasts them
    only below its threshold."""
    s = by_source.select(F.col("source").alias("mix_s"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("edge").alias("mix_edge"), F.col("below").alias("mix_below"))
    b = by_block.select(F.col("source").alias("mix_b"), F.col("block").alias("mix_block"), F.col("passes").alias("mix_passes"), F.col("full").alias("mix_full"), F.col("shards").alias("mix_all"))
    own = _block(F.col("mix_place"), 0)
    rows = rows.join(s, _same("mix_source", "mix_s")).join(b, _same("mix_source", "mix_b") & (own == F.col("mix_block")))
    more = F.col("mix_full") | F.coalesce((F.col("mix_edge") == own) & (F.col("mix_place") < F.col("mix_below")), F.lit(False))
    n = F.col("mix_passes") + more.cast("int")
    return rows.withColumn("mix_shards", F.when(n > 0, F.slice("mix_all", F.lit(1), n)).otherwise(F.array().cast("array<int>"))).drop("mix_s", "mix_edge", "mix_below", "mix_b", "mix_block", "mix_passes", "mix_full", "mix_all")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source"), size_of(docs["text"]).alias("size"), place_of(docs, seed).alias("place"))


EQUAL = ["doc_id", "source", "place"]


def repeated(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source, place, n of rows that are there several times."""
    return scratch.write(sizes.groupBy(*EQUAL).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def parted(rows: DataFrame, equal: DataFrame, scratch: Scratch, seed: int, names: list[str] = EQUAL, size: int = SLICE) -> DataFrame:
    """Rows with a place of their own each. Equal rows are written, so that their order is fixed, and numbered in slices of about
    `size`; the first keeps its place, the others' follow from it and their numbers. `names`: the rows' id, source, place."""
    if equal.isEmpty():
        return rows
    e = equal.select(*(F.col(c).alias(f"mix_e{i}") for i, c in enumerate(EQUAL)), F.greatest(F.lit(1), F.ceil(F.col("n") / size)).alias("mix_slices"))
    same = _same(names[0], "mix_e0") & _same(names[1], "mix_e1") & (F.col(names[2]) == F.col("mix_e2"))
    many = scratch.write(rows.join(e, same).withColumn("mix_row", F.monotonically_increasing_id()))
    many = many.withColumn("mix_slice", F.pmod(F.xxhash64("mix_row"), F.col("mix_slices")))
    key = [f"mix_e{i}" for i in range(3)]
    n = many.groupBy(*key, "mix_slice").agg(F.count(F.lit(1)).alias("mix_n"))
    n = n.select(*(F.col(c).alias(f"{c}_") for c in [*key, "mix_slice"]), (F.sum("mix_n").over(Window.partitionBy(*key).orderBy("mix_slice")) - F.col("mix_n")).alias("mix_before"))
    inside = F.row_number().over(Window.partitionBy(*key, "mix_slice").orderBy("mix_row")) - 1
    on = _same("mix_e0", "mix_e0_") & _same("mix_e1", "mix_e1_") & (F.col("mix_e2") == F.col("mix_e2_")) & (F.col("mix_slice") == F.col("mix_slice_"))
    many = many.withColumn("mix_inside", inside).join(n, on).withColumn("mix_number", F.col("mix_before") + F.col("mix_inside"))
    own = F.when(F.col("mix_number") == 0, F.col(names[2])).otherwise(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(names[2]), F.col("mix_number"), F.col(names[1])), 1))
    many = many.withColumn(names[2], own).select(*rows.columns)
    return rows.join(e, same, "left_anti").unionByName(many)


def local_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), "mix_place", "mix_copy")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """The mixed documents: a row for each copy taken, with all columns of docs and mix_copy, mix_shard and mix_key.
    Rows are in the order of mix_shard and mix_key, over and within partitions."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(sized(docs, seed))
    equal = repeated(sizes, scratch)
    by_source, by_block = plan(parted(sizes, equal, scratch, seed), scratch, shards, seed)
    scratch.keep(by_source, by_block, equal)
    own, added = {c.lower() for c in docs.columns}, []
    for name in ("mix_copy", "mix_shard", "mix_key"):
        while name in own:
            name += "_"
        added.append(name)
    # The input's columns travel as one, so that their names can't meet those of the plan.
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), docs["doc_id"].alias("mix_id"), docs["source"].alias("mix_source"), place_of(docs, seed).alias("mix_place"))
    rows = parted(rows, equal, scratch, seed, ["mix_id", "mix_source", "mix_place"])
    rows = copies(rows, by_source, by_block).select("row", "mix_place", F.posexplode("mix_shards").alias("mix_copy", "mix_shard")).withColumn("mix_key", local_key(seed))
    rows = rows.repartitionByRange("mix_shard", "mix_key").sortWithinPartitions("mix_shard", "mix_key")
    return rows.select("row.*", *(F.col(c).alias(a) for c, a in zip(("mix_copy", "mix_shard", "mix_key"), added, strict=True)))


def places(taken: DataFrame, seed: int) -> DataFrame:
    """row, places: where each copy is in its shard's order, from 0. A shard is numbered piece by piece, by the keys'
    leading bits, after a table of what is before each piece."""
    each = taken.select("row", "mix_source", "mix_place", F.posexplode("mix_shards").alias("mix_copy", "shard")).withColumn("key", local_key(seed))
    each = each.withColumn("piece", F.shiftright("key", 64 - PIECE_BITS))
    n = each.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    n = n.select(F.col("shard").alias("s"), F.col("piece").alias("p"), (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key", F.col("mix_source").asc_nulls_last(), "row")) - 1
    at = each.withColumn("inside", inside).join(n, (F.col("shard") == F.col("s")) & (F.col("piece") == F.col("p"))).withColumn("at", F.col("before") + F.col("inside"))
    at = at.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("mix_copy", "at"))).alias("found"))
    return at.select("row", F.array_join(F.transform("found", lambda x: x["at"].cast("string")), ",").alias("places"))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """Every document with its size, its source's size and target, the words taken, and the shards of its copies with
    their places in the shards' orders."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(sized(docs, seed).withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    sizes = parted(sizes, repeated(sizes, scratch), scratch, seed)
    by_source, by_block = plan(sizes, scratch, shards, seed)
    rows = sizes.select("row", "doc_id", "size", F.col("source").alias("mix_source"), F.col("place").alias("mix_place"))
    taken = copies(rows, by_source, by_block)
    found = taken.join(places(taken, seed), "row", "left")
    n = F.size("mix_shards")
    return found.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * n).alias("taken"), n.alias("copies"), F.array_join("mix_shards", ",").alias("shards"), F.coalesce("places", F.lit("")).alias("places"))
