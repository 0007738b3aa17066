"""Language-model scoring by online logistic context mixing, with a unigram base score beside it.

The model predicts a text's bytes and its end, bit by bit. A bit's node is the byte's bits so far in a context of
the 1, 2, 3 or 4 bytes before; each order hashes (context, bits) to a 64-bit slot that holds how often a 0 and a 1
followed in the learning texts. The orders' predictions, in the logistic domain, are combined by weights. Which
weights is gated by the order-2 context and by how often the order-4 node was seen. An adaptive table by gate, depth and
predicted probability then refines the result. Every distribution over the 256 symbols sums to 1, so the score is a
log probability.

All of it is learnt online, along the stream of learning texts, with state kept by context. The stream is cut into
segments, each as long as all before it: every n-gram of a segment is predicted from the counts that the segments
before it left and the weights and table cells that stand by then; its error moves the weights of its gate, in steps of
STEP n-grams, and its outcome enters the table; then the segment's counts are added. Nothing is ever predicted from what
comes later. Texts are scored by the state at the stream's end.

How it is distributed: documents are dealt over buckets of about BUCKET_BYTES of text, whatever the corpus's size, and
the buckets' numbers are the stream's order. A bucket's distinct words and 5-byte grams (not their occurrences) go out
to be counted over all buckets, what belongs to one order-2 context meets in one place to be mixed, and what a bucket
asked for comes back to it. So what moves grows with distinct grams and buckets, and what a task holds at once, a bucket
or some gates, doesn't grow. Nothing that grows with the corpus is broadcast or collected: only the order-1 counts
(65,536 a segment, and segments are a logarithm), and two totals.

Cases: null text is empty and scores its end alone; without learning texts every bit is even, and the base score
is 0; a null id counts as the empty text, which is held out; repeated rows give repeated results and count as
often as they are there. Words are told apart by 64-bit hashes. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, Scratch, id_crc, text_blocks, utf8
from .words import mix, word_hashes

#: Orders, added counts, learning rate, n-grams a gate learns from at a time.
ORDERS, ADD, RATE, STEP = (1, 2, 3, 4), 0.08, 0.02, 32
#: Bytes of text of a bucket, about; least number of buckets; buckets (a power of 2) in one list of who asked for a key;
#: rows of whole gates that are mixed at once.
BUCKET_BYTES, LEAST_BUCKETS, LIST, ROWS = 16 << 20, 8, 1 << 12, 1 << 18
#: Bytes of text whose grams are in memory at once.
BLOCK = 1 << 20
#: Partitions that buckets are dealt to, at most: one a bucket, unless there are more.
MOST_PARTS = 1 << 16
#: First weights of the orders; limits of the confidence classes; buckets and prior weight of the adaptive table.
WEIGHTS, SEEN, CELLS, PRIOR = (0.15, 0.2, 0.35, 0.5), (1, 3, 10, 40), 24, 12.0
LEAST = 1.0 / 65536
#: Out of UTF-8's bytes: stands before a text's start and for its end.
EDGE = b"\xff"
PAD = EDGE * 4
_TOP = np.uint64(1 << 63)
END_KEY = int((word_hashes([b""]) | _TOP).view(np.int64)[0])


def word_keys(words: list[bytes]) -> np.ndarray:
    """Negative numbers, as grams' keys are positive."""
    return (word_hashes(words) | _TOP).view(np.int64)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all 5-byte windows of the joined texts, which of them end on a symbol, and each text's first."""
    b = np.frombuffer(b"".join([PAD + t + EDGE for t in texts]) + PAD, np.uint8).astype(np.int64)
    m = len(b) - 4
    key = np.zeros(m, np.int64)
    for i in range(5):
        key <<= 8
        key |= b[i : m + i]
    sizes = np.array([len(t) + 5 for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    use = np.ones(m, bool)
    for i in range(1, 5):
        use[(first + sizes - i)[first + sizes - i < m]] = False
    return key, use, first


def _sum(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(np.concatenate(keys))
    return distinct, np.bincount(codes, np.concatenate(numbers), len(distinct))


def segment_of(bucket):
    """The segment of the stream that a bucket is in: 0 and 1, 2 and 3, 4 to 7, ..."""
    return F.length(F.bin(bucket)) - 1


def vocabulary(table: pa.Table) -> pa.Table:
    """key, ask: a bucket's distinct words and grams; ask holds the bucket and, in its lower 32 bits, the key's number
    in learning texts (0: in others only)."""
    keys, numbers, many = [], [], 0
    for block in text_blocks(table.to_batches(), limit=BLOCK):
        raw = utf8(block)
        learn = 1.0 - np.array(block.column(block.schema.get_field_index("held_out")).to_pylist(), float)
        words = [x.translate(LOWER_AZ).split() for x in raw]
        key, use, first = grams(raw)
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        w = word_keys([x for ws in words for x in ws])
        of_words, of_grams = np.repeat(learn, [len(ws) for ws in words]), np.repeat(learn, sizes)[use]
        k, n = _sum([w, np.full(1, END_KEY), key[use]], [of_words, learn.sum(keepdims=True), of_grams])
        keys.append(k), numbers.append(n)
        many += len(k)
        if many > 1 << 20:
            k, n = _sum(keys, numbers)
            keys, numbers, many = [k], [n], len(k) // 2
    k, n = _sum(keys, numbers)
    return pa.table({"key": pa.array(k), "ask": pa.array(n.astype(np.int64) + (table["bucket"][0].as_py() << 32))})


class Nodes:
    """How often each gram's node of one order and depth was met so far, and met with a 1 next."""

    def __init__(self, order: int, depth: int, key: np.ndarray):
        y = key & 255
        so_far = (y >> (7 - depth + 1)) | (1 << depth)
        self.order, self.depth, self.bit = order, depth, ((y >> (7 - depth)) & 1).astype(float)
        if order == 1:
            self.context, self.at = (key >> 8) & 255, (so_far - (1 << depth)) * 2
            self.ones = np.zeros((256, 1 << (depth + 1)))
        else:
            context = (key >> 8) & ((1 << (8 * order)) - 1)
            slot = mix((context.astype(np.uint64) << np.uint64(9) | so_far.astype(np.uint64)) + np.uint64(order << 56))
            self.slot, distinct = pd.factorize(slot)
            self.met, self.one = np.zeros(len(distinct)), np.zeros(len(distinct))

    def counts(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        if self.order == 1:
            context, at = self.context[rows], self.at[rows]
            return self.ones[context, at] + self.ones[context, at + 1], self.ones[context, at + 1]
        return self.met[self.slot[rows]], self.one[self.slot[rows]]

    def add(self, rows: np.ndarray, n: np.ndarray, first_order: np.ndarray) -> None:
        """A segment's grams, or what the whole segment has of order 1."""
        if self.order == 1:
            self.ones += first_order.reshape(256, 1 << (self.depth + 1), -1).sum(-1)
        else:
            self.met += np.bincount(self.slot[rows], n, len(self.met))
            self.one += np.bincount(self.slot[rows], n * self.bit[rows], len(self.one))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Weights and adaptive table of some gates, for the bits of one depth."""

    def __init__(self, gates: int):
        self.classes = len(SEEN) + 1
        self.weights = np.tile(np.array(WEIGHTS), (gates * self.classes, 1))
        self.met, self.one = np.zeros(gates * CELLS), np.zeros(gates * CELLS)

    def sets(self, gate: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return gate * self.classes + np.searchsorted(SEEN, seen, "right")

    def cells(self, gate: np.ndarray, p: np.ndarray) -> np.ndarray:
        return gate * CELLS + np.clip(((np.clip(_logit(p), -8, 8) + 8) / 16 * CELLS).astype(int), 0, CELLS - 1)

    def learn(self, gate: np.ndarray, which: np.ndarray, x: np.ndarray, bit: np.ndarray, much: np.ndarray) -> None:
        """One step: predicts, moves the weights by the error, enters the outcomes."""
        p = _squash((self.weights[which] * x).sum(1))
        cell = self.cells(gate, p)
        self.met += np.bincount(cell, much, len(self.met))
        self.one += np.bincount(cell, much * bit, len(self.one))
        of, at = np.unique(which, return_inverse=True)
        wrong, all_ = (bit - p) * much, np.bincount(at, much)
        for k in range(len(ORDERS)):
            self.weights[of, k] += RATE * np.bincount(at, wrong * x[:, k]) / all_

    def predict(self, gate: np.ndarray, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = _squash((self.weights[which] * x).sum(1))
        cell = self.cells(gate, p)
        middle = _squash((cell % CELLS + 0.5) / CELLS * 16 - 8)
        refined = (self.one[cell] + PRIOR * middle) / (self.met[cell] + PRIOR)
        return np.clip((3 * p + refined) / 4, LEAST, 1 - LEAST)


def mixed(key: np.ndarray, n: np.ndarray, first_order: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after the four before. key: distinct grams; n: their numbers by segment;
    first_order: numbers of all (byte before, byte) by segment. All grams of an order-2 context must be there; what is
    computed for one doesn't depend on which others are."""
    order = np.lexsort((key, (key >> 8) & 0xFFFF))
    key, n = key[order], n[order].astype(float)
    gate = np.unique((key >> 8) & 0xFFFF, return_inverse=True)[1]
    gates, total = int(gate.max(initial=-1)) + 1, np.zeros(len(key))
    # Each segment's grams, their numbers, and the steps that their turns in their gates make.
    parts = []
    for s in range(n.shape[1]):
        rows = np.flatnonzero(n[:, s] > 0)
        start = np.searchsorted(gate[rows], np.arange(gates))
        turn = (np.arange(len(rows)) - start[gate[rows]]) // STEP
        by_turn = np.argsort(turn, kind="stable")
        steps = np.split(by_turn, np.searchsorted(turn[by_turn], np.arange(1, 1 + turn.max(initial=0))))
        parts.append((rows, n[rows, s], steps))
    for depth in range(8):
        nodes = [Nodes(k, depth, key) for k in ORDERS]
        mixer, bit = Mixer(gates), nodes[0].bit

        def inputs(rows):
            counts = [node.counts(rows) for node in nodes]
            return np.stack([_logit((one + ADD) / (met + 2 * ADD)) for met, one in counts], 1), mixer.sets(gate[rows], counts[-1][0])

        for s, (rows, times, steps) in enumerate(parts):
            if s:  # before the first segment nothing is known
                x, which = inputs(rows)
                for at in steps:
                    mixer.learn(gate[rows[at]], which[at], x[at], bit[rows[at]], times[at])
            for node in nodes:
                node.add(rows, times, first_order[s])
        x, which = inputs(slice(None))
        p = mixer.predict(gate, which, x)
        total += np.log10(np.where(bit > 0, p, 1 - p))
    out = np.empty(len(key))
    out[order] = total
    return out


def _whole_gates(batches, least: int = ROWS):
    """Tables of whole gates, each of `least` rows or more but the last. Rows come sorted by gate."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        gate = (t["key"].to_numpy() >> 8) & 0xFFFF
        end = int(np.searchsorted(gate, gate[-1]))
        if end:
            yield t.slice(0, end)
            held, rows = t.slice(end).to_batches(), rows - end
    if rows:
        yield pa.Table.from_batches(held)


def _model(rows: DataFrame, first_order: np.ndarray, parts: int) -> DataFrame:
    """key, value of every gram of rows (key, segment, n)."""
    shared = rows.sparkSession.sparkContext.broadcast(first_order)  # 65,536 numbers a segment

    def run(batches):
        for t in _whole_gates(batches):
            codes, key = pd.factorize(t["key"].to_numpy())
            segments = len(shared.value)
            n = np.bincount(codes * segments + t["segment"].to_numpy(), t["n"].to_numpy(), len(key) * segments).reshape(len(key), segments)
            yield from pa.table({"key": pa.array(key), "value": pa.array(mixed(key, n, shared.value))}).to_batches(1 << 16)

    gate = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    return rows.withColumn("gate", gate).repartition(parts, "gate").sortWithinPartitions("gate").drop("gate").mapInArrow(run, "key long, value double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    # Id and text, so that rows without ids are spread; equal rows meet, as their counts then add up at once.
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket")
    rows = docs.select(bucket, "doc_id", (id_crc(F.col("doc_id")) % 10 == 0).alias("held_out"), "text").repartitionById(min(buckets, MOST_PARTS), F.col("bucket"))
    asked = rows.groupBy("bucket").applyInArrow(vocabulary, "key long, ask long")
    number = F.col("ask").bitwiseAND(0xFFFFFFFF)
    # A key that all buckets have is in as many rows as there are lists of LIST buckets.
    asked = asked.groupBy("key", F.floor(F.shiftright("ask", 32) / LIST).alias("list")).agg(F.sum(number).alias("n"), F.collect_list("ask").alias("asks"))
    counted = scratch.write(asked)
    words = counted.where("key < 0").groupBy("key").agg(F.sum("n").alias("n"))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    of_grams = counted.where("key >= 0").select("key", F.explode("asks").alias("ask")).select("key", segment_of(F.shiftright("ask", 32)).alias("segment"), number.alias("n"))
    first = of_grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("k"), "segment").agg(F.sum("n").alias("n")).collect()
    first_order = np.zeros((max((r.segment for r in first), default=0) + 1, 1 << 16))
    first_order[[r.segment for r in first], [r.k for r in first]] = [r.n for r in first]
    model = words.select("key", F.col("n").cast("double").alias("value")).union(_model(of_grams, first_order, parts))
    back = counted.select("key", "asks").join(model, "key").select(F.explode("asks").alias("ask"), "key", "value").select(F.shiftright("ask", 32).cast("int").alias("bucket"), "key", "value")
    back = back.repartitionById(min(buckets, MOST_PARTS), F.col("bucket"))
    n_train, n_kinds = float(totals.n), float(totals.v)
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(docs_: pa.Table, model: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
        key, value = model["key"].to_numpy(), model["value"].to_numpy()
        of_words = key < 0
        word_index, word_n = pd.Index(key[of_words]), value[of_words]
        gram_index, gram_p = pd.Index(key[~of_words]), value[~of_words]
        word_base = np.log10((word_n + 0.1) / (n_train + 0.1 * (n_kinds + 1)))
        out = []
        for block in text_blocks(docs_.to_batches(), limit=BLOCK):
            raw = utf8(block)
            words = [x.translate(LOWER_AZ).split() for x in raw]
            n = np.array([len(w) for w in words]) + 1
            w = np.concatenate([np.concatenate([word_keys(ws), [END_KEY]]) for ws in words])
            at = word_index.get_indexer(w)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            base, known = np.add.reduceat(word_base[at], starts), np.add.reduceat((word_n[at] > 0).astype(np.int64), starts)
            k, use, first = grams(raw)
            p = np.zeros(len(k))
            p[use] = gram_p[gram_index.get_indexer(k[use])]
            p = np.add.reduceat(p, first)
            size = np.array([len(x) for x in raw])
            out.append(pa.RecordBatch.from_arrays([
                block.column(block.schema.get_field_index("doc_id")), block.column(block.schema.get_field_index("held_out")), pa.array(n, pa.int64()), pa.array(known),
                pa.array(np.full(len(n), int(n_train))), pa.array(base), pa.array(p), pa.array(size, pa.int64()), pa.array(-p / np.log10(2) / (size + 1)),
            ], names))
        kinds = [pa.field(f.name, f.type) for f in docs_.schema if f.name in ("doc_id", "held_out")]
        return pa.Table.from_batches(out) if out else pa.schema([*kinds, *(pa.field(c, pa.int64()) for c in names[2:5]), *(pa.field(c, pa.float64()) for c in names[5:7]), pa.field("n_bytes", pa.int64()), pa.field("bits_per_byte", pa.float64())]).empty_table()

    schema = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return rows.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(finish, schema)
