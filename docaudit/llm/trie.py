"""The prefix trie of conversations: turn arrays sorted over the whole cluster, swept with a stack, stitched at the seams.

A conversation is cut in blocks of BLOCK turns, a row each: the hash of all turns before the block, the block's own turns
as an array of 128-bit hashes, and the conversation's id. Rows are range-partitioned and sorted by these. A task
walks its rows once; the longest common prefix of a row with the one before says how many levels of the stack, which is
the path of the last row, close: each closed level is a node with all its members seen. Levels on the path of
a partition's first or last row may go on in its neighbours: they are given out as open pieces (at most two paths a
partition) and stitched by their prefix. What a node sums over its subtree is summed along paths: within a block by
the stack, over later blocks by the least member of each block's rows, over open pieces by their prefixes.

Distribution: no row is longer than a block, equal conversations are parted by id, and the ids that end at a node are hashed
as they stream by. The parent's id joins only where a branch was still open; parents of over 1/HEAVY of all nodes,
of which there are HEAVY at most, by broadcast, the others by shuffle.

Cases: turns of one number are in order of role and text; repeated turns stay; null role and text are empty;
rows of null conv_id are one conversation, first in order, written as '' and never a least member beside others; a table
without rows gives no node; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_crc

BLOCK, NUMBERS, HEAVY = 32, 256, 10_000
#: Ids of an open node's ends are handed on in strings of about so many characters.
PIECE = 1 << 16
#: What a sweep gives: nodes whose members are all known ('node'), open ones ('open'), and ids that end at open ones.
SWEPT = (
    "kind string, block long, p1 long, p2 long, depth long, h1 long, h2 long, parent1 long, parent2 long, conv_id long, parent_conv_id long, "
    "known_parent boolean, n_convs long, n_children long, n_leaves long, saved long, turn_bytes long, n_more long, path array<long>, ends string, first_end long"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.strip().split(" ")[0], _KINDS[c.strip().split(" ")[1]]) for c in SWEPT.split(",")])
#: Rows that a sweep gives out at once.
_OUT = 4096


def _joined(rows: DataFrame, other: DataFrame, on: list[str], heavy: DataFrame, how: str) -> DataFrame:
    """rows joined with other, a row for each key, nulls equal: heavy keys by broadcast, which HEAVY bounds, others by shuffle."""
    renamed = lambda df: df.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in df.columns))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    few = F.broadcast(renamed(heavy.select(*on)))
    hot = rows.join(few, same, "left_semi").join(F.broadcast(renamed(other.join(few, same, "left_semi"))), same, how)
    rest = rows.join(few, same, "left_anti").join(renamed(other), same, how)
    return hot.unionByName(rest).drop(*(f"_{c}" for c in on))


def ranked(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns with their place in their conversation (from 0), the conversations with their numbers of turns, and those
    with over 1/HEAVY of all turns. Places are found in two steps, by blocks of turn numbers and within them."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / NUMBERS).alias("numbers"))
    before = scratch.write(rows.groupBy("conv_id", "numbers").agg(F.count(F.lit(1)).alias("n")))
    convs = scratch.write(before.groupBy("conv_id").agg(F.sum("n").alias("n")))
    total = convs.agg(F.sum("n").alias("n")).first().n or 0
    heavy = convs.where(F.col("n") * HEAVY > total).select("conv_id")
    w = Window.partitionBy("conv_id").orderBy(F.col("numbers").asc_nulls_first())
    before = before.select(F.col("conv_id").alias("c"), F.col("numbers").alias("b"), (F.sum("n").over(w) - F.col("n")).alias("before"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.withColumn("inside", F.row_number().over(Window.partitionBy("conv_id", "numbers").orderBy(*order)))
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("numbers").eqNullSafe(F.col("b")))
    return rows.select("conv_id", "role", "text", (F.col("before") + F.col("inside") - 1).cast("long").alias("rank")), convs, heavy


def rebuilt(turns: DataFrame, scratch: Scratch, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth (from 1), role, text: every conversation with the head of its group's first one in place of its own;
    and all conversations with their lengths. A head has fewer than `heads` turns, and `group` conversations share it."""
    rows, convs, heavy = ranked(turns, scratch)
    rows = scratch.write(rows)
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = convs.select("conv_id", (id_crc(F.col("conv_id")) % heads).alias("head"), base.alias("base"), "n")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    convs = scratch.write(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))))
    shared = rows.where(F.col("rank") < heads - 1).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "head").join(shared, "base").where(F.col("rank") < F.col("head"))
    taken = taken.select("conv_id", (F.col("rank") + 1).alias("depth"), "role", "text")
    own = _joined(rows, convs.select("conv_id", "head", "taken"), ["conv_id"], heavy, "inner").where(F.col("rank") >= F.col("head"))
    own = own.select("conv_id", (F.col("taken") + F.col("rank") - F.col("head") + 1).alias("depth"), "role", "text")
    return taken.unionByName(own), convs.select("conv_id", "length")


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, p1, p2 (hash of the turns before), k (two hashes a turn), sizes (bytes of each text), more (whether
    turns follow): a row for each block of a conversation, and one for each conversation without turns."""
    place = F.floor((F.col("depth") - 1) / block)
    g = [F.xxhash64(F.lit(seed), F.col("depth"), "role", "text").alias(f"g{seed}") for seed in (1, 2)]
    rows = turns.select("conv_id", place.alias("block"), F.struct(F.col("depth"), *g, F.octet_length("text").cast("long").alias("size")).alias("t"))
    cut = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.bit_xor("t.g1").alias("x1"), F.bit_xor("t.g2").alias("x2"))
    w = Window.partitionBy("conv_id").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select(
        "conv_id", "block", F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("p1"), F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("p2"),
        F.flatten(F.transform("ts", lambda t: F.array(t.g1, t.g2))).alias("k"), F.transform("ts", lambda t: t["size"]).alias("sizes"), F.lead("block").over(w).isNotNull().alias("more"),
    )
    nothing = F.array().cast("array<long>")
    zero = F.lit(0).cast("long")
    return cut.unionByName(convs.where("length = 0").select("conv_id", zero.alias("block"), zero.alias("p1"), zero.alias("p2"), nothing.alias("k"), nothing.alias("sizes"), F.lit(False).alias("more")))


class _Level:
    """A node on the stack: the prefix of the rows that are being read, and what is known of its members."""

    __slots__ = ("children", "convs", "end", "ended", "first_end", "h1", "h2", "leaves", "least", "more", "open", "pieces", "saved", "size", "text", "text_n")

    def __init__(self, h1: int, h2: int, size: int, open_: bool):
        self.h1, self.h2, self.size, self.open = h1, h2, size, open_
        self.convs = self.children = self.leaves = self.saved = self.more = 0
        self.least: int | None = None
        self.end = None if open_ else hashlib.sha256()
        self.ended, self.text, self.text_n, self.first_end = False, [], 0, None


class _Sweep:
    """Walks sorted rows and gives nodes. `open` levels are those that may have members in another partition."""

    def __init__(self, block: int):
        self.block, self.levels, self.key, self.k, self.out, self.first = block, [], None, [], [], True

    def add(self, conv, key, k, sizes, more, extra) -> None:
        same = 0
        if key != self.key:
            self.close(0)
            self.key = key
            self.levels = [_Level(key[1], key[2], 0, self.first)]
        else:
            low = min(len(k), len(self.k))
            while same < low and k[same] == self.k[same]:
                same += 1
            same //= 2
            self.close(same + 1)
        for d in range(same, len(k) // 2):
            up = self.levels[-1]
            self.levels.append(_Level(up.h1 ^ k[2 * d], up.h2 ^ k[2 * d + 1], sizes[d], self.first))
        self.k, self.first = k, False
        here = self.levels[-1]
        here.convs += 1
        if conv is not None and (here.least is None or conv < here.least):
            here.least = conv
        here.more += more
        here.saved += extra[0]
        here.leaves += extra[1]
        here.children += extra[2]
        if not more:
            self.ends(here, conv)

    def ends(self, level: _Level, conv) -> None:
        text = "" if conv is None else str(conv)
        if not level.open:
            level.end.update(f",{text}".encode() if level.ended else text.encode())
        if not level.text:
            level.first_end = conv
        level.ended = True
        level.text.append(text)
        level.text_n += 1 + len(text)
        if level.text_n >= PIECE:  # a level may still be open at the partition's end, so its ids go out as pieces
            self.piece(level)

    def piece(self, level: _Level) -> None:
        """Hands on the ids that end at the deepest level."""
        if level.text:
            at = self.block * self.key[0] + len(self.levels) - 1
            self.out.append({"kind": "ends", "block": self.key[0], "depth": at, "h1": level.h1, "h2": level.h2, "ends": ",".join(level.text), "first_end": level.first_end})
            level.text, level.text_n = [], 0

    def row(self, level: _Level, at: int, kind: str) -> dict:
        b, p1, p2 = self.key
        up = self.levels[at - 1] if at else None
        row = {
            "kind": kind, "block": b, "p1": p1, "p2": p2, "depth": self.block * b + at, "h1": level.h1, "h2": level.h2, "conv_id": level.least, "n_convs": level.convs, "n_children": level.children,
            "n_leaves": level.leaves, "saved": level.saved, "turn_bytes": level.size, "n_more": level.more, "known_parent": False,
        }
        return row | ({"parent1": up.h1, "parent2": up.h2} if up else {})

    def close(self, down_to: int, at_end: bool = False) -> None:
        """Closes all levels from the deepest down to this one."""
        child = None
        while len(self.levels) > down_to:
            at, level = len(self.levels) - 1, self.levels[-1]
            if level.open or at_end:
                self.piece(level)
                if child is not None:
                    self.out.append(child)
                    child = None
                self.out.append(self.row(level, at, "open") | {"path": [x for v in self.levels for x in (v.h1, v.h2)]})
                self.levels.pop()
                continue
            if not level.children and not level.more:
                level.leaves += 1
            level.saved += (level.convs - 1) * level.size
            row = self.row(level, at, "node") | {"ends": level.end.hexdigest()}
            if child is not None:
                if at or not self.key[0]:  # its parent closes now; a later block's group isn't the parent itself
                    child |= {"known_parent": True, "parent_conv_id": level.least}
                self.out.append(child)
            child = row
            self.levels.pop()
            if self.levels:
                up = self.levels[-1]
                up.convs += level.convs
                up.children += 1
                up.leaves += level.leaves
                up.saved += level.saved
                if level.least is not None and (up.least is None or level.least < up.least):
                    up.least = level.least
        if child is not None:
            self.out.append(child)

    def batch(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def sweep(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes and open pieces of block rows (with extra_saved, extra_leaves and extra_children of what follows the block)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Sweep(block)
        for b in batches:
            for r in b.to_pylist():
                s.add(r["conv_id"], (r["block"], r["p1"], r["p2"]), r["k"], r["sizes"], int(r["more"]), (r["extra_saved"], r["extra_leaves"], r["extra_children"]))
                if len(s.out) >= _OUT:
                    yield s.batch()
        s.close(0, at_end=True)
        if s.out:
            yield s.batch()

    order = ["block", "p1", "p2", "k", "conv_id"]
    rows = rows.select(*order, "sizes", "more", "extra_saved", "extra_leaves", "extra_children")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SWEPT)


ID = ["depth", "h1", "h2"]


def stitched(opened: DataFrame) -> DataFrame:
    """Open pieces as whole nodes, without the ids that end there. A path has at most BLOCK + 1 nodes, and a partition two."""
    one = opened.groupBy("block", "p1", "p2", *ID).agg(
        F.first("parent1").alias("parent1"), F.first("parent2").alias("parent2"), F.first("path").alias("path"), F.first("turn_bytes").alias("turn_bytes"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "n_more")),
    )
    level = F.size("path") / 2 - 1

    def along(rows: DataFrame) -> DataFrame:
        """Rows repeated for each node of their path, with how far up it is."""
        return rows.withColumn("up", F.explode(F.sequence(F.lit(0), level.cast("int")))).select(
            "*", (F.col("depth") - F.col("up")).alias("d"), F.element_at("path", ((level - F.col("up")) * 2 + 1).cast("int")).alias("u1"), F.element_at("path", ((level - F.col("up")) * 2 + 2).cast("int")).alias("u2")
        )

    same = [F.col("d").alias("depth"), F.col("u1").alias("h1"), F.col("u2").alias("h2")]
    # Members and children first: an open child counts once.
    up = along(one.select("block", *ID, "path", "n_convs", "conv_id")).groupBy("block", *same)
    up = up.agg(F.sum("n_convs").alias("all_convs"), F.min("conv_id").alias("least"), F.count(F.when(F.col("up") == 1, 1)).alias("open_children"))
    one = one.join(up, ["block", *ID]).withColumn("n_children", F.col("n_children") + F.col("open_children"))
    leaf = ((F.col("n_children") == 0) & (F.col("n_more") == 0)).cast("long")
    one = one.withColumn("n_leaves", F.col("n_leaves") + leaf).withColumn("saved", F.col("saved") + (F.col("all_convs") - 1) * F.col("turn_bytes"))
    sums = along(one.select("block", *ID, "path", "n_leaves", "saved")).groupBy("block", *same).agg(F.sum("n_leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    return one.join(sums, ["block", *ID]).select("block", "p1", "p2", *ID, "parent1", "parent2", F.col("least").alias("conv_id"), F.col("all_convs").alias("n_convs"), "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved"))


def hashed_ends(pieces: DataFrame) -> DataFrame:
    """depth, h1, h2, ends: the checksum of all ids that end at an open node, from its pieces in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        schema = pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("ends", pa.string())])
        give = lambda: pa.RecordBatch.from_pylist([{"depth": key[0], "h1": key[1], "h2": key[2], "ends": h.hexdigest()}], schema)
        for b in batches:
            for r in b.to_pylist():
                now = (r["depth"], r["h1"], r["h2"])
                if now != key:
                    if key is not None:
                        yield give()
                    key, h = now, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(r["ends"].encode())
        if key is not None:
            yield give()

    rows = pieces.select(*ID, "first_end", "ends").repartition(*ID).sortWithinPartitions(*ID, F.col("first_end").asc_nulls_first())
    return rows.mapInArrow(run, "depth long, h1 long, h2 long, ends string")


def _later(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Block rows with what their conversation stands for in later blocks: each block's rows of one prefix are summed up
    under their least member."""
    up = groups.select(F.col("conv_id").alias("c"), (F.col("block") - 1).alias("b"), F.col("saved").alias("s"), F.col("n_leaves").alias("l"), F.col("n_children").alias("extra_children"))
    rows = rows.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    after = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(c).over(after), F.lit(0)).alias(name) for c, name in (("s", "extra_saved"), ("l", "extra_leaves"))]
    return rows.select("conv_id", "block", "p1", "p2", "k", "sizes", "more", *sums, F.coalesce("extra_children", F.lit(0)).alias("extra_children"))


def nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the trie's nodes.
    turns: conv_id, depth (from 1), role, text; convs: every conv_id once with its length, those without turns too."""
    rows = scratch.write(blocks(turns, convs, block))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("extra_saved", "extra_leaves", "extra_children")]
    deep = scratch.write(sweep(rows.where("block > 0").select("*", *nothing), block))
    roots = deep.where(f"kind = 'node' AND depth = {block} * block").select("conv_id", "block", "saved", "n_leaves", "n_children")
    seams = stitched(deep.where("kind = 'open'")).where(f"depth = {block} * block").select("conv_id", "block", "saved", "n_leaves", "n_children")
    swept = scratch.write(sweep(_later(rows, roots.unionByName(seams)), block))

    # The node at a block's end is the next block's group; only the first stays.
    real = F.expr(f"block = 0 OR depth > {block} * block")
    whole = swept.where("kind = 'node'").where(real)
    ends = hashed_ends(swept.where("kind = 'ends'"))
    seams = stitched(swept.where("kind = 'open'")).where(real).join(ends, ID, "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    columns = [*ID, "parent1", "parent2", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    done = whole.where("known_parent").select(*columns, "parent_conv_id")
    waiting = whole.where("NOT known_parent").select(*columns).unionByName(seams.select(*columns))
    every = scratch.write(whole.select(*ID, "conv_id", "n_children").unionByName(seams.select(*ID, "conv_id", "n_children")))
    heavy = scratch.write(every.where(F.col("n_children") * HEAVY > every.count()).select(*(F.col(c).alias(n) for c, n in zip(ID, ("up", "parent1", "parent2"), strict=True))))
    parents = every.select((F.col("depth")).alias("up"), F.col("h1").alias("parent1"), F.col("h2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    found = _joined(waiting.withColumn("up", F.col("depth") - 1), parents, ["up", "parent1", "parent2"], heavy, "left").drop("up")
    out = done.unionByName(found)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, scratch)
    return nodes(turns, convs, scratch, block)


_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295)"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rk FROM conversations),
ids AS (SELECT conv_id AS c, count(*) AS n, {_CRC} % 9 AS h FROM conversations GROUP BY conv_id),
r AS (
  SELECT ids.c, t.rk AS d, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND t.rk <= ids.h
  UNION ALL
  SELECT ids.c, least(ids.h, coalesce(b.n, 0)) + t.rk - ids.h, role, text FROM ids JOIN t ON t.c = ids.c AND t.rk > ids.h LEFT JOIN ids b ON b.c = ids.c - ids.c % 5),
p AS (
  SELECT c, d, strlen(text) AS bytes, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS key FROM r
  UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (SELECT d, key, min(c) AS m, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY d, key),
up AS (SELECT p.c, p.d, node.m FROM p JOIN node USING (d, key)),
tree AS (SELECT node.*, up.m AS parent FROM node LEFT JOIN up ON up.c = node.m AND up.d = node.d - 1),
kids AS (SELECT parent AS m, d - 1 AS d, count(*) AS k FROM tree WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT up.m, up.d, sum((tree.n - 1) * tree.bytes) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM tree JOIN up ON up.c = tree.m AND up.d <= tree.d LEFT JOIN kids ON kids.m = tree.m AND kids.d = tree.d GROUP BY up.m, up.d),
last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
ends AS (SELECT up.m, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM last JOIN up USING (c, d) GROUP BY up.m, d)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM tree LEFT JOIN kids USING (m, d) JOIN below USING (m, d) LEFT JOIN ends USING (m, d)
"""
