"""N-gram Jaccard join with set-relation skipping, and the groups that its links make.

A document's set holds the distinct hashes (64 bits) of its n-word shingles. Sets that are equal are one class
and are joined once. Classes meet in an inverted index over their prefixes: in one order of all shingles
(frequent ones last), two sets of Jaccard similarity T must share one of their first (1 - T) * size + 1.

Skipping within a list: a list is sorted by set size and position, so entries that agree in both are a block. One
comparison decides for a block whether any of its sets can reach the overlap that the probing set needs.
Before that, a set leaves the index if no partner in its lists can share enough of its prefix with it.

Skipping by answers: what has been computed for a set is used for the sets that are much like it. Linked sets share one
answer, their component, so pairs within one are never looked at. And a set Y with a linked set X that lacks d of Y's
shingles has an overlap with any Z of at most X's with Z, plus d: where that is known and too little, Y and Z are refuted
without their sets. A set only probes entries of other components, first the nearest and the farthest in the list, which
are verified and merged; the next round works from these answers with more neighbours a probe, and rounds end when no
probe was cut short. So a group of thousands of near copies costs a few verified pairs each, not all pairs, and yet
every pair that may link two components has been verified or refuted: the components are exact.

Lists of any length are probed. Those of shingles that are known to be in over WHOLE sets are split by a hash before
they are sorted, and all beyond CHUNK entries are cut into chunks. The first round looks within chunks and between
neighbouring ones; later ones look at pairs of chunks unless both hold nothing but one component, the list's most common.
Classes and shingles go by 64-bit hashes. Nothing is collected but a bounded table of frequent shingles (an order, which
affects work, not results) and a bounded bit table.

Cases: null text and text without words have an empty set and are linked with nothing; with fewer than n words
the whole sequence is the one shingle; repeated rows and equal texts are one class; a null id never names a
component that has another id; ties in the order go by hash. `keep_one` returns the columns of its input.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, Scratch, text_blocks, utf8
from .words import shingles

#: Shingles found in so many classes or more, and so many of them at most, go last in the order of prefixes.
FREQUENT, MOST_FREQUENT = 20, 1 << 16
#: Entries of an index list that are probed together, entries of a list for each task that its group's lists go to,
#: neighbours a probe may take in the first round, and how many times as many in the next.
CHUNK, SPREAD, FIRST_ROUND, MORE = 2048, 256, 2, 6
#: Entries of a list that are looked at as a whole when needs are worked out.
WHOLE = 1 << 18
#: Links between components that one task unites; there are other means beyond.
UNITED = 1 << 17
#: Bits of the table that says whose sets may be needed; more documents than that only make it less selective.
BITS = 1 << 23


def set_of(raw: bytes, n: int) -> np.ndarray:
    return shingles(raw.translate(LOWER_AZ).split(), n)


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """4096 bits, each the parity of the number of shingles that fall on it. Where two sets' sketches differ in more
    bits than two linked sets may differ in shingles, the sets don't link."""
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & 4095, minlength=4096) & 1).astype(np.uint8)).view(np.int64)


def _sets(batches, n: int, once: bool):
    """Blocks with rows of (position in the block, set, class); with `once`, a task's first of each class that isn't empty."""
    seen: set[int] = set()
    for block in text_blocks(batches):
        rows = []
        for i, raw in enumerate(utf8(block)):
            s = set_of(raw, n)
            c = class_of(s) if len(s) else None
            if once and (c is None or c in seen):
                continue
            seen.add(c) if once else None
            rows.append((i, s, c))
        yield block, rows


def _arrow(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def profile(docs: DataFrame, n: int) -> DataFrame:
    """Rows of kind 0: doc_id, n_shingles, class of each document. Kind 1: shingles that several of a task's
    classes have, and how many."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = ["kind", "doc_id", "n_shingles", "class", "token", "n"]
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        size, id_kind = 0, None

        def several() -> pa.RecordBatch:
            """What several of the waiting sets have; most of what one has is told by a table of counts alone."""
            every = np.concatenate(waiting)
            cell = (every >> np.uint64(43)).astype(np.int64)
            tokens, n = np.unique(every[np.bincount(cell, minlength=1 << 21)[cell] > 1], return_counts=True)
            t, n = tokens[n > 1], n[n > 1]
            m = len(t)
            return _arrow(names, [pa.array(np.ones(m, np.int32)), pa.nulls(m, id_kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(t.view(np.int64)), pa.array(n)])

        for block, rows in _sets(batches, n, False):
            id_kind = block.schema.field(0).type
            m = block.num_rows
            yield _arrow(names, [pa.array(np.zeros(m, np.int32)), block.column(0), pa.array([len(s) for _, s, _ in rows], pa.int64()), pa.array([c for *_, c in rows], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())])
            for _, s, c in rows:
                if c is not None and c not in seen:
                    seen.add(c)
                    waiting.append(s)
                    size += len(s)
            if size > 1 << 20:
                yield several()
                waiting, size = [], 0
        if waiting:
            yield several()

    return docs.select("doc_id", "text").mapInArrow(run, f"kind int, doc_id {id_type}, n_shingles long, class long, token long, n long")


def index(docs: DataFrame, n: int, threshold: int, frequent: np.ndarray, counts: np.ndarray, whole: int = WHOLE) -> DataFrame:
    """token, pos, size, class, parts, part: a row for each place of a class's prefix. `frequent` is in the order's order,
    `counts` says in how many classes they are. The list of a shingle that more than `whole` have comes in parts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT numbers
    hot = np.argsort(frequent)[counts[np.argsort(frequent)] > whole]
    split = docs.sparkSession.sparkContext.broadcast((frequent[hot], -(-counts[hot] // whole)))

    def run(batches):
        order = shared.value
        by_hash = np.argsort(order)
        table = order[by_hash]
        for _, rows in _sets(batches, n, True):
            out = []
            for _, s, c in rows:
                size = len(s)
                take = size - -(-threshold * size // 100) + 1
                for part in (s[: 2 * take], s) if len(table) else ():
                    at = np.minimum(np.searchsorted(table, part), len(table) - 1)
                    often = table[at] == part
                    rare = part[~often]
                    if len(rare) >= take:  # whatever comes after has higher hashes
                        s = rare
                        break
                else:
                    s = np.concatenate([rare, order[np.sort(by_hash[at[often]])]]) if len(table) else s
                out.append((s[:take], size, c))
            if out:
                lengths = [len(s) for s, _, _ in out]
                repeat = np.repeat(np.arange(len(out)), lengths)
                tokens, classes = np.concatenate([s for s, _, _ in out]), np.array([c for *_, c in out], np.int64)[repeat]
                parts = np.ones(len(tokens), np.int64)
                if len(split.value[0]):
                    at = np.minimum(np.searchsorted(split.value[0], tokens), len(split.value[0]) - 1)
                    parts = np.where(split.value[0][at] == tokens, split.value[1][at], 1)
                yield _arrow(["token", "pos", "size", "class", "parts", "part"], [
                    pa.array(tokens.view(np.int64)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
                    pa.array(np.array([k for _, k, _ in out], np.int32)[repeat]), pa.array(classes), pa.array(parts.astype(np.int32)), pa.array((classes % parts).astype(np.int32)),
                ])

    return docs.select("text").mapInArrow(run, "token long, pos int, size int, class long, parts int, part int")


def listed_twice(entries: DataFrame) -> DataFrame:
    """The entries of lists that hold at least two, without repeats, sorted by list, part, size and position."""
    w = Window.partitionBy("token", "part").orderBy("size", "pos", "class")
    before, after = F.lag("class").over(w), F.lead("class").over(w)
    some = F.col("before").isNotNull() | F.col("after").isNotNull() | (F.col("parts") > 1)
    rows = entries.withColumn("before", before).withColumn("after", after).where(some & ~F.col("before").eqNullSafe(F.col("class")))
    return rows.drop("before", "after")


def lists(entries: DataFrame) -> DataFrame:
    """Those entries with their chunk, the number that chunks are below, the part's first class and the tasks that it is
    spread over."""
    w = Window.partitionBy("token", "part").orderBy("size", "pos", "class")
    rows = listed_twice(entries)
    # A part of a split list holds WHOLE entries about, and its chunks have numbers of their own.
    most = F.when(F.col("parts") > 1, max(1, 2 * WHOLE // CHUNK))
    inside = F.floor((F.row_number().over(w) - 1) / CHUNK).cast("int")
    rows = rows.withColumn("chunk", F.when(most.isNull(), inside).otherwise(F.col("part") * most + inside % most))
    # Lists that begin with the same class are mostly those of one group of near copies. They go to the same task, which
    # then sends each pair once; long ones are spread over as many tasks as they have some hundred entries.
    every = Window.partitionBy("token", "part")
    spread = F.pmod(F.xxhash64("token"), F.floor(F.count(F.lit(1)).over(every) / SPREAD) + 1)
    chunks = F.when(most.isNull(), F.max("chunk").over(every) + 1).otherwise(F.col("parts") * most)
    return rows.withColumn("chunks", chunks).withColumn("first", F.first("class").over(w)).withColumn("spread", spread).drop("parts", "part")


def _runs(batches, keys: list[str], most: int | None = None):
    """Tables of whole runs of equal keys, and where each run starts and the table ends. With `most`, a run that is
    longer may come in pieces, each but the first at the start of a table; then the length of that piece is told too."""
    held, cut = None, None

    def told(t, bounds):
        first = tuple(t[c][0].as_py() for c in keys)
        return (t, bounds, int(bounds[1]) if first == cut else 0) if most else (t, bounds)

    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        k = [t[c].to_numpy() for c in keys]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        if len(new):
            yield told(t.slice(0, int(new[-1])), np.concatenate([[0], new]))
            held = t.slice(int(new[-1])).combine_chunks()
        else:
            held = t.combine_chunks()
        if most and len(held) > most:
            yield told(held, np.array([0, len(held)]))
            held, cut = None, tuple(held[c][0].as_py() for c in keys)
    if held is not None and len(held):
        yield told(held, np.array([0, len(held)]))


def _pairs_of_chunks(rows: DataFrame, turn: int, long_lists: bool = True) -> DataFrame:
    """Every entry once for each pair of its chunk and another that is looked at, sorted by list, size and position."""
    if turn == 0:
        others = F.sequence(F.greatest(F.lit(0), F.col("chunk") - 1), F.least(F.col("chunks") - 1, F.col("chunk") + 1))
        rows = rows.withColumn("other", F.explode(others)).withColumn("more", F.col("chunks") > 2)
    elif not long_lists:
        rows = rows.withColumn("other", F.lit(0)).withColumn("more", F.lit(False))
    else:
        long = rows.where("chunks > 1")
        held = long.groupBy("token", "chunk").agg(F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("only"))
        held = held.groupBy("token").agg(F.mode("only").alias("main"), F.collect_list(F.struct("chunk", "only")).alias("all"))
        # A chunk is odd unless it holds the main component alone; pairs without an odd chunk have their answer.
        odd = F.transform(F.filter("all", lambda c: ~F.coalesce(c["only"] == F.col("main"), F.lit(False))), lambda c: c["chunk"])
        held = held.select("token", F.transform("all", lambda c: c["chunk"]).alias("all"), odd.alias("odd"))
        others = F.when(F.array_contains("odd", F.col("chunk")), F.col("all")).otherwise(F.col("odd"))
        long = long.join(held, "token").withColumn("other", F.explode(others)).drop("all", "odd")
        rows = rows.where("chunks = 1").withColumn("other", F.lit(0)).unionByName(long).withColumn("more", F.lit(False))
    rows = rows.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "chunks")
    return rows.repartition("first", "spread", "lo", "hi").drop("first", "spread").sortWithinPartitions("token", "lo", "hi", "size", "pos", "chunk", "class")


def needed_overlap(n: np.ndarray, k: np.ndarray, threshold: int) -> np.ndarray:
    """How many prefix shingles two sets of n and k shingles have in common if they link: what they share beyond is
    at most the rest of the one whose prefix ends first."""
    rest = -(-threshold * np.maximum(n, k) // 100) - 1
    return np.maximum(-(-threshold * (n + k) // (100 + threshold)) - rest, 1)


def partnered(rows: DataFrame, threshold: int, whole: int = WHOLE) -> DataFrame:
    """token, pos, size, class, parts, part, need of lists' entries: the least overlap of prefixes that a link with another set of
    the list takes; entries whose list has no set of fitting size are left out. The overlap grows with the smaller
    set and falls with the larger one, so the least and the greatest fitting size tell. rows come sorted by list and
    size; of lists beyond `whole` entries, and of those in parts, nothing is left out, and 1 stands for the need."""

    def run(batches):
        for t, bounds, piece in _runs(batches, ["token", "part"], whole):
            size = t["size"].to_numpy().astype(np.int64)
            need = np.zeros(len(t), np.int64)
            lengths = np.diff(bounds)
            for i, m in zip(bounds[:-1][lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                if m > whole:
                    need[i : i + m] = 1
                    continue
                part, at = size[i : i + m], np.arange(m)
                low = np.searchsorted(part, -(-threshold * part // 100))
                high = np.searchsorted(part, 100 * part // threshold, "right") - 1
                some = high > low
                low, high = low + (low == at), high - (high == at)
                low, high = part[np.minimum(low, m - 1)], part[np.maximum(high, 0)]
                least = np.minimum(needed_overlap(part, low, threshold), needed_overlap(part, high, threshold)) - 1
                need[i : i + m] = np.where(some, np.maximum(least, 1), 0)
            two = bounds[:-1][lengths == 2]
            fit = 100 * size[two] >= threshold * size[two + 1]
            need[two] = need[two + 1] = np.where(fit, needed_overlap(size[two], size[two + 1], threshold), 0)
            need[:piece] = 1
            need[t["parts"].to_numpy() > 1] = 1
            if (need > 0).any():
                out = t.append_column("need", pa.array(need.astype(np.int32)))
                yield from out.filter(pa.array(need > 0)).to_batches()

    names = ["token", "pos", "size", "class", "parts", "part"]
    return rows.select(*names).mapInArrow(run, "token long, pos int, size int, class long, parts int, part int, need int")


def qualified(entries: DataFrame) -> DataFrame:
    """The entries of the classes that can link at all. A linked set shares as many prefix shingles with its partner
    as they need, and each of those has an entry whose need is that or less: so for some r, r entries need r at most."""
    own = entries.groupBy("class").agg(F.collect_list(F.struct("token", "pos", "size", "parts", "part", "need")).alias("es"))
    needs = F.array_sort(F.transform("es", lambda e: e.need))
    own = own.where(F.exists(F.transform(needs, lambda m, i: m <= i + 1), lambda ok: ok))
    return own.select("class", F.explode("es").alias("e")).select("e.token", "e.pos", "e.size", "class", "e.parts", "e.part")


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit for each document id, by its hash: at most BITS / 64 numbers come to the driver."""
    words = ids.select(_bit(F.col("doc_id")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("m"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.m
    return out.view(np.uint8)


def _bit(doc_id: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS)).cast("int")


def chosen_sets(docs: DataFrame, n: int, bits: np.ndarray, whole: bool) -> DataFrame:
    """class, n_set and the set itself, or its sketch, of the documents whose bit is set; a class once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    name = "set" if whole else "sketch"

    def run(batches):
        def wanted():
            for batch in batches:
                bit = batch.column(1).to_numpy(zero_copy_only=False)
                use = (shared.value[bit >> 3] >> (bit & 7)) & 1 == 1
                if use.any():
                    yield batch.filter(pa.array(use)).select(["text"])

        for _, rows in _sets(wanted(), n, True):
            if rows:
                out = [s.view(np.int64) if whole else sketch_of(s) for _, s, _ in rows]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                yield _arrow(["class", "n_set", name], [pa.array([c for *_, c in rows], pa.int64()), pa.array([len(s) for _, s, _ in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text", _bit(F.col("doc_id")).alias("bit")).mapInArrow(run, f"class long, n_set int, {name} array<bigint>")
    return rows.repartition(parts, "class").dropDuplicates(["class"])


def kept_on_disk(rows: DataFrame) -> DataFrame:
    """Rows kept on the executors' disks as they are dealt. They are planned without coalescing, so that later joins
    know how they are dealt and don't deal them anew; what is lost with an executor is made again."""
    conf, name = rows.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return rows.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set(name, before)


def _probe(size: list[int], pos: list[int], chunk: list[int], comp: list[int], lo: int, hi: int, threshold: int, most: int, turn: int):
    """Pairs (r, q) of one list, or of two of its chunks, that may link two components, at most `most` a probe q,
    in the first turn the nearest and the farthest, later others by chance; then whether a probe was cut short."""
    m, cut = len(size), False
    starts = [i for i in range(m) if not i or (size[i], pos[i], chunk[i]) != (size[i - 1], pos[i - 1], chunk[i - 1])]
    block_of = np.searchsorted(starts, np.arange(m), "right") - 1 if m > 2 else [0, len(starts) - 1]
    ends = [*starts[1:], m]
    for q in range(1, m):
        n, left, mine, found = size[q], size[q] - pos[q], comp[q], []
        for b in range(block_of[q], -1, -1):
            s = starts[b]
            k = size[s]
            if 100 * k < threshold * n:
                break  # smaller sets follow only
            if lo != hi and chunk[s] == chunk[q] or min(left, k - pos[s]) * (100 + threshold) < threshold * (n + k):
                continue  # the whole block can't reach the overlap
            found += [r for r in range(min(ends[b], q) - 1, s - 1, -1) if comp[r] != mine]
        if len(found) > most:
            cut = True
            found = [found[0], found[-1]] if turn == 0 else random.Random(f"{turn} {q} {m}").sample(found, most)
        for r in found:
            yield r, q
    yield cut


def probe(rows: DataFrame, threshold: int, most: int, turn: int, long_lists: bool = True) -> DataFrame:
    """(a, b) of candidate pairs between components; (token) of lists in which a probe was cut short or chunks weren't paired.
    rows: token, chunk, chunks, pos, size, class, comp."""

    def run(batches):
        sent = set()
        for t, bounds in _runs(batches, ["token", "lo", "hi"]):
            yield from emit(t, bounds, sent)

    def emit(t, bounds, sent):
        bounds = bounds.tolist()
        lo, hi, chunk, pos, size, more = (t[c].to_pylist() for c in ("lo", "hi", "chunk", "pos", "size", "more"))
        name, comp = t["class"].to_pylist(), t["comp"].to_pylist()
        token, out = t["token"].to_pylist(), []
        for i, j in zip(bounds, bounds[1:], strict=False):
            if j - i == 2 and comp[i] == comp[i + 1] and not more[i]:
                continue
            if more[i]:
                out.append((None, None, token[i]))
            for got in _probe(size[i:j], pos[i:j], chunk[i:j], comp[i:j], lo[i], hi[i], threshold, most, turn):
                if got is True:
                    out.append((None, None, token[i]))
                elif got is not False:
                    pair = tuple(sorted((name[i + got[0]], name[i + got[1]])))
                    if pair not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(pair)
                        out.append((*pair, None))
        if out:
            yield _arrow(["a", "b", "token"], [pa.array([x[k] for x in out], pa.int64()) for k in range(3)])

    return _pairs_of_chunks(rows, turn, long_lists).mapInArrow(run, "a long, b long, token long")


def _united(edges: DataFrame) -> DataFrame:
    """(c, p): the least component that each reaches, by union-find in one task; for edges of a checked number."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            yield _arrow(["c", "p"], [pa.array(list(parent), pa.int64()), pa.array([find(x) for x in list(parent)], pa.int64())])

    return edges.select("ca", "cb").coalesce(1).mapInArrow(run, "c long, p long")


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (class, comp) after joining the components that links (a, b) connect. Up to UNITED edges between
    components are united in one task. Beyond, each step sends every component to its least neighbour and follows
    that one step on, until no link joins two components."""
    a, b = (labels.select(F.col("class").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = scratch.write(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct())
    steps = []
    while n_edges := edges.count():
        if n_edges <= UNITED:
            steps.append(_united(edges))
            break
        both = edges.union(edges.select("cb", "ca"))
        least = both.groupBy("ca").agg(F.min("cb").alias("p")).select(F.col("ca").alias("c"), F.least("ca", "p").alias("p"))
        least = scratch.write(least)
        jump = least.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        step = scratch.write(least.join(jump, "p", "left").select("c", F.coalesce("pp", "p").alias("p")))
        steps.append(step)
        x, y = step.select(F.col("c").alias("ca"), F.col("p").alias("pa")), step.select(F.col("c").alias("cb"), F.col("p").alias("pb"))
        after = edges.join(x, "ca", "left").join(y, "cb", "left").select(F.coalesce("pa", "ca").alias("x"), F.coalesce("pb", "cb").alias("y")).where("x <> y")
        edges = scratch.write(after.select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct())
    for step in steps:
        labels = labels.join(step.select(F.col("c").alias("comp"), "p"), "comp", "left").select("class", F.coalesce("p", "comp").alias("comp"))
    return scratch.write(labels) if steps else labels


def _least_overlap(threshold: int) -> F.Column:
    """The overlap that sets of n_a and n_b shingles need to link."""
    return F.ceil(F.lit(threshold) * (F.col("n_a") + F.col("n_b")) / (100 + threshold))


def open_pairs(pairs: DataFrame, links: DataFrame, bounds: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the answers of the sets most like theirs don't refute. links: (a, b, n_a, n_b, most) of linked
    sets with their overlap; bounds: the same of compared sets, `most` being what their overlap can't be above."""
    x, y = (links.select(F.col(i).alias("y"), F.col(j).alias("x"), (F.col(f"n_{i}") - F.col("most")).alias("lacks"), F.col(f"n_{i}").alias("n_y")) for i, j in ("ab", "ba"))
    like = x.union(y).groupBy("y").agg(F.min(F.struct("lacks", "x", "n_y")).alias("l")).select("y", "l.*")
    known = bounds.select(F.col("a").alias("p"), F.col("b").alias("q"), "n_a", "n_b", "most")
    for i, z in ("ab", "ba"):
        # Y is pairs[i], Z the other; what is known of X and Z bounds them.
        near = pairs.join(like, pairs[i] == F.col("y"), "left").withColumn("p", F.least("x", z)).withColumn("q", F.greatest("x", z))
        near = near.join(known, ["p", "q"], "left").withColumn("n_z", F.when(F.col("q") == F.col(z), F.col("n_b")).otherwise(F.col("n_a")))
        need = F.ceil(F.lit(threshold) * (F.col("n_y") + F.col("n_z")) / (100 + threshold))
        pairs = near.where(F.coalesce(F.col("most") + F.col("lacks") >= need, F.lit(True))).select("a", "b")
    return pairs


def groups(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, class, component_id for every document. Two documents link when
    100 * intersection >= threshold * union of their sets."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    profiled = scratch.write(profile(docs, n), "kind")
    rows = profiled.where("kind = 0")
    often = profiled.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = sorted((r.n, r.token) for r in often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect())
    frequent, counts = np.array([t for _, t in often], np.int64).view(np.uint64), np.array([c for c, _ in often], np.int64)
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first_id"))
    # Most entries are of sets that share a shingle or two by chance; those go before anything is verified.
    entries = qualified(partnered(listed_twice(index(docs, n, threshold, frequent, counts, WHOLE)), threshold, WHOLE))
    listed = scratch.write(lists(entries))
    labels = scratch.write(listed.select("class").distinct().withColumn("comp", F.col("class")))
    bits_of = lambda named: _bits(classes.join(named, "class").select(F.col("first_id").alias("doc_id")))
    sketches = kept_on_disk(chosen_sets(docs, n, bits_of(labels.select("class")), False))
    # What all rounds have found, compared by sketch, and compared by set.
    seen, sketched, sized = [], [], []
    links_if = F.lit(100) * F.col("most") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("most"))
    most, turn = FIRST_ROUND, 0
    while True:
        long_lists = turn == 0 or not listed.where("chunks > 1").isEmpty()
        found = scratch.write(probe(listed.join(labels, "class"), threshold, most, turn, long_lists).distinct())
        met = found.where("a IS NOT NULL").select("a", "b")
        new = met.join(scratch.together(seen).where("a IS NOT NULL").select("a", "b"), ["a", "b"], "left_anti") if seen else met
        if sized:
            known = scratch.together(sized)
            new = open_pairs(new, known.where(links_if), known.union(scratch.together(sketched).where(F.col("most") < _least_overlap(threshold))), threshold)
        side = lambda of, x, c: of.select(F.col("class").alias(x), F.col("n_set").alias(f"n_{x}"), F.col(c).alias(f"{c}_{x}"))
        # Sketches first: most pairs that met by chance end there, and whole sets are made for the others only.
        tried = new.join(side(sketches, "b", "sketch"), "b").join(side(sketches, "a", "sketch"), "a")
        apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
        tried = scratch.write(tried.select("a", "b", "n_a", "n_b", F.floor((F.col("n_a") + F.col("n_b") - apart) / 2).alias("most")))
        near = tried.where(F.col("most") >= _least_overlap(threshold))
        if not near.isEmpty():
            sets = chosen_sets(docs, n, bits_of(near.select(F.explode(F.array("a", "b")).alias("class")).distinct()), True)
            pairs = near.select("a", "b").join(side(sets, "b", "set"), "b").join(side(sets, "a", "set"), "a")
            verified = scratch.write(pairs.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("most")))
            labels = merged(labels, verified.where(links_if).select("a", "b"), scratch)
            sized.append(verified)
        sketched.append(tried)
        seen.append(found)
        # Lists of which no probe was cut short have shown all their pairs; the others are probed again.
        open_ = found.where("a IS NULL").select("token")
        if open_.isEmpty():
            break
        listed = scratch.write(listed.join(open_, "token", "left_semi"))
        most, turn = most * MORE, turn + 1
    least = labels.join(classes, "class").groupBy("comp").agg(F.min("first_id").alias("least_id"))
    grouped = scratch.write(classes.join(labels, "class", "left").join(least, "comp", "left").select("class", F.coalesce("least_id", "first_id").alias("component_id")))
    sketches.unpersist()
    scratch.keep(profiled, grouped)
    return rows.join(grouped, "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group stays, that of least id, with all its columns; documents without words all stay.
    Rows that repeat the id of a document that stays are that document and stay with it; rows without id stay if no
    row of their group has one."""
    found = groups(docs, n, threshold)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]), "left_semi")
