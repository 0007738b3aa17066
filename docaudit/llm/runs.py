"""Periodic runs of words by tandem repeats: the linear method of Gusfield and Stoye (2004) over a block of texts.

A run is a stretch of words with smallest period q that neither neighbour extends, of at least `shortest` words and
`times` periods. Every run lies within words whose `gram`-word windows occur twice in the text (equal hashes, so at worst too many),
and only such passages are searched; they are laid out as one string of numbers, with a separator of its own after each.

1. Suffixes are sorted by doubling; the ranks of every power of two are kept, so that a longest common extension, forwards
   or backwards, takes a few array steps for any number of pairs at once.
2. The string is cut in Lempel-Ziv blocks; extensions about each block's borders give tandem repeats that cover the leftmost
   occurrence of every kind (algorithms 1A and 1B of the paper).
3. From these the other kinds are reached by suffix-link walks: leave out the first word, put it at the end if the suffix
   tree goes on with it. Intervals of the suffix array stand for the tree's nodes. A kind that was seen ends a walk.
4. Each kind's interval gives all its occurrences; those of one period in successive places merge into a run.

Only repeats with a primitive root are walked from, as a root's powers give no run of their own. No shuffle: texts
are handled in blocks of bounded size, a very long text alone.

Cases: null text has no words; null ids count as the empty text in the checksum; an empty table gives an empty result;
equal rows give equal results; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, text_blocks, utf8
from .words import mix, windows, word_hashes

SHORTEST, TIMES = 6, 4


class Suffixes:
    """Suffix array of a string of numbers, with the ranks of its substrings of 1, 2, 4 .. words."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = s, len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.ranks, order, step = [rank.astype(np.int32)], np.argsort(rank, kind="stable"), 1
        while self.n > 1 and rank[order[-1]] < self.n - 1:
            nxt = np.zeros(self.n, np.int64)
            nxt[: self.n - step] = rank[step:] + 1  # 0 beyond the end: a shorter string comes first
            key = rank * (self.n + 1) + nxt
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            self.ranks.append(rank.astype(np.int32))
            step *= 2
        self.order = order
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at a and at b; two different places a pair. Equal ranks never cross the
        string's end, as a substring that does has a rank of its own."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step = 1 << level
            fits = (a + step <= self.n) & (b + step <= self.n)
            same = fits.copy()
            r = self.ranks[level]
            same[fits] = r[a[fits]] == r[b[fits]]
            out[same] += step
            a[same] += step
            b[same] += step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common suffix of the prefixes that end with the words at a and at b, inclusive; -1 is before the string."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step = 1 << level
            fits = (a - step >= -1) & (b - step >= -1)
            same = fits.copy()
            r = self.ranks[level]
            same[fits] = r[a[fits] - step + 1] == r[b[fits] - step + 1]
            out[same] += step
            a[same] -= step
            b[same] -= step
        return out

    def intervals(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) in the suffix array: all suffixes that begin with these words of the string."""
        place = self.place[at]

        def edge(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
            """The last place from good towards bad whose suffix still agrees."""
            good, bad = good.copy(), bad.copy()
            while True:
                open_ = np.flatnonzero(np.abs(bad - good) > 1)
                if not len(open_):
                    return good
                mid = (good[open_] + bad[open_]) // 2
                fits = self.agree(self.order[mid], at[open_], length[open_])
                good[open_[fits]] = mid[fits]
                bad[open_[~fits]] = mid[~fits]

        return edge(place, np.full(len(at), -1)), edge(place, np.full(len(at), self.n)) + 1

    def agree(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from a are those from b, by two overlapping powers of two."""
        out = (a == b) | (length == 0)
        rest = np.flatnonzero(~out & (a + length <= self.n) & (b + length <= self.n))
        level = np.frexp(length[rest].astype(float))[1] - 1  # the largest power of two that isn't longer
        high = level >= len(self.ranks)  # no two substrings of that length agree
        rest, level = rest[~high], level[~high]
        for k in np.unique(level):
            i = rest[level == k]
            r, off = self.ranks[k], length[i] - (1 << int(k))
            out[i] = (r[a[i]] == r[b[i]]) & (r[a[i] + off] == r[b[i] + off])
        return out

    def goes_on(self, at: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A place where the `length` words from `at` stand before `word`; -1 if there is none. Within an interval of the
        suffix array the words that follow are in order."""
        low, high = self.intervals(at, length)
        end = high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            where = self.order[mid] + length[open_]
            follow = np.where(where < self.n, self.s[np.minimum(where, self.n - 1)], -1)
            less = follow < word[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        found = low < end
        at_low = self.order[np.minimum(low, self.n - 1)]
        where = at_low + length
        found &= where < self.n
        found &= self.s[np.minimum(where, self.n - 1)] == word
        return np.where(found, at_low, -1)


def lz_starts(x: Suffixes) -> np.ndarray:
    """Where the blocks begin: each is the longest string that also begins further left, or one new word."""
    order, n = x.order, x.n
    before = np.full(n, -1, np.int64)
    after = np.full(n, -1, np.int64)
    stack: list[int] = []
    lower, upper = before.tolist(), after.tolist()
    for i in order.tolist():  # nearest suffixes in rank that begin further left
        while stack and stack[-1] > i:
            upper[stack.pop()] = i
        lower[i] = stack[-1] if stack else -1
        stack.append(i)
    i = np.arange(n)
    longest = np.zeros(n, np.int64)
    for near in (np.array(lower), np.array(upper)):
        has = near >= 0
        longest[has] = np.maximum(longest[has], x.forward(i[has], near[has]))
    steps, starts, at = np.maximum(longest, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    return np.array(starts, np.int64)


def covering(x: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of tandem repeats that cover the leftmost one of every kind."""
    ends = np.append(starts[1:], x.n)
    size = ends - starts

    def each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and k = 1 .. count, for all blocks."""
        block = np.repeat(np.arange(len(counts)), counts)
        return block, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    block, k = each(size)  # repeats whose centre is in the block, right half beyond it
    h1 = ends[block]
    q = h1 - k
    inside = h1 < x.n
    block, k, h1, q = block[inside], k[inside], h1[inside], q[inside]
    right, left = x.forward(h1, q), x.backward(h1 - 1, q - 1)
    ok = (left + right >= k) & (right > 0)
    found = [(np.maximum(q - left, q - k + 1)[ok], k[ok])]

    block, k = each(size + np.append(size[1:], 0))  # repeats that begin before the block
    h, h1 = starts[block], ends[block]
    q = h + k
    inside = q < x.n
    k, h, h1, q = k[inside], h[inside], h1[inside], q[inside]
    right, left = x.forward(h, q), x.backward(h - 1, q - 1)
    start = np.maximum(h - left, h - k + 1)
    ok = (left + right >= k) & (right > 0) & (left > 0) & (start + k <= h1)
    found.append((start[ok], k[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def primitive(x: Suffixes, at: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether no shorter string makes up the root: it would be a period of the tandem repeat that divides the root."""
    out, left, p = np.ones(len(at), bool), root.copy(), 2
    while True:
        most = left.max(initial=1)
        if most < 2:
            return out
        if p * p > most:  # what is left is 1 or a prime
            i = np.flatnonzero(left > 1)
            d = root[i] // left[i]
            out[i[x.forward(at[i], at[i] + d) >= 2 * root[i] - d]] = False
            return out
        i = np.flatnonzero(left % p == 0)
        if len(i):
            d = root[i] // p
            out[i[x.forward(at[i], at[i] + d) >= 2 * root[i] - d]] = False
            while len(i):
                left[i] //= p
                i = i[left[i] % p == 0]
        p += 1


def vocabulary(x: Suffixes, at: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, root length): the suffix-array interval of every kind of tandem repeat that walks reach from these. A walk
    goes on in place while the text does, and through the tree where the text goes on otherwise."""
    seen, parts = np.zeros(0, np.int64), []
    names = lambda low, r: low * (x.n + 1) + r  # noqa: E731  a kind: the interval of its words, and how many they are
    while len(at):
        here = np.minimum(x.forward(at, at + root) - root, root - 1)  # turns that the text itself makes
        walker = np.repeat(np.arange(len(at)), here + 1)
        turn = np.arange(len(walker)) - np.repeat(np.cumsum(here + 1) - here - 1, here + 1)
        where, length = at[walker] + turn, root[walker]
        low, high = x.intervals(where, 2 * length)
        name, first = np.unique(names(low, length), return_index=True)
        new = ~np.isin(name, seen)
        fresh = first[new]
        parts.append((low[fresh], high[fresh], length[fresh]))
        last = np.cumsum(here + 1) - 1
        going = (here < root - 1) & np.isin(names(low[last], root), name[new])  # the class isn't whole, and its end wasn't known
        seen = np.union1d(seen, name)
        end, root = (at + here)[going], root[going]
        nxt = x.goes_on(end + 1, 2 * root - 1, x.s[end])
        at, root = nxt[nxt >= 0], root[nxt >= 0]
        if len(at):
            low, _ = x.intervals(at, 2 * root)
            name, first = np.unique(names(low, root), return_index=True)
            first = first[~np.isin(name, seen)]
            at, root = at[first], root[first]
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))


def located(x: Suffixes, low: np.ndarray, high: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal stretches that all occurrences of these kinds make up."""
    n = high - low
    kind = np.repeat(np.arange(len(n)), n)
    at = x.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    key = np.sort(root[kind] * (2 * x.n) + at)  # successive places of one period are successive numbers
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 1]))
    count = np.diff(np.append(first, len(key)))
    period, start = np.divmod(key[first], 2 * x.n)
    return start, count - 1 + 2 * period, period


def runs_of(s: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a string of numbers from 0, by start and period; times is 2 or more."""
    if len(s) < max(2, shortest):
        return []
    x = Suffixes(s)
    at, root = covering(x, lz_starts(x))
    good = primitive(x, at, root)
    start, length, period = located(x, *vocabulary(x, at[good], root[good]))
    keep = length >= np.maximum(shortest, times * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return list(zip(start[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True))


def _gram(shortest: int, times: int) -> int:
    """Words of a window that each run has twice, whatever its period."""
    return max(1, min(max(shortest, times * q) - q for q in range(1, shortest + 1)))


def block_runs(texts: list[list[bytes]], shortest: int = SHORTEST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    total, gram = int(sizes.sum()), _gram(shortest, times)
    if total < shortest:
        return out
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    hashes = np.concatenate([word_hashes(t) for t in texts if t])
    seen = mix(windows(hashes, gram) + text[: total - gram + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = np.flatnonzero(text[: total - gram + 1] == text[gram - 1 :])  # windows that don't leave their text
    order = inside[np.argsort(seen[inside], kind="stable")]
    twice = np.zeros(len(order), bool)
    same = seen[order][1:] == seen[order][:-1]
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(total + 1, np.int64)
    at = order[twice]
    np.add.at(covered, at, 1)
    np.subtract.at(covered, at + gram, 1)
    covered = np.cumsum(covered[:-1]) > 0
    where = np.flatnonzero(covered)
    if not len(where):
        return out
    # Passages: stretches of covered words of one text. Each is followed by a number that occurs once.
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 1) | (np.diff(text[where]) != 0)]))
    lengths = np.diff(np.append(cut, len(where)))
    begins = where[cut]
    numbers: dict = {}
    string, origin = [], []
    first = (ends - sizes).tolist()
    for begin, n in zip(begins.tolist(), lengths.tolist(), strict=True):
        t = int(text[begin])
        for w in texts[t][begin - first[t] : begin - first[t] + n]:
            string.append(numbers.setdefault((t, w), len(numbers)))
        origin.append((len(string) + len(origin), begin, t))
    top = len(numbers)
    laid = np.insert(np.array(string, np.int64), np.cumsum(lengths), np.arange(top, top + len(lengths)))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    for start, length, period in runs_of(laid, shortest, times):
        i = int(np.searchsorted(starts, start, "right")) - 1
        _, begin, t = origin[i]
        out[t].append((begin - first[t] + start - int(starts[i]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def periodic(words: list[bytes], h: int) -> list[bytes]:
    """The words with a periodic tail, if the checksum h says so."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FOUND = "doc_id long, start long, length long, period long"


def _blocks(batches: Iterable[pa.RecordBatch], plant: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    for block in text_blocks(batches):
        ids = block.column(0).to_pylist()
        texts = [t.split() for t in utf8(block)]
        if plant:
            texts = [periodic(w, zlib.crc32(b"" if i is None else str(i).encode())) for i, w in zip(ids, texts, strict=True)]
        yield ids, texts


def find(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period: a row for each run of a text's words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, False):
            rows = [(i, *r) for i, found in zip(ids, block_runs(texts, shortest, times), strict=True) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def collapse(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, n_runs, text: texts with every run cut to its first period, words joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, False):
            found = block_runs(texts, shortest, times)
            kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in found], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_runs long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """The runs of each text with its planted period: the best one, and checksums of all and of what collapsing leaves."""

    def one(i, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        best = (None,) * 4
        if runs:
            s, n, q = runs[0]
            for r in runs[1:]:
                if r[1] * q > n * r[2]:  # by start, so that the first of equals stays
                    s, n, q = r
            best = (s, n, q, 1000 * n // q)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (i, len(runs), *best, sha256_hex(listed.encode()), sha256_hex(b" ".join(collapsed(words, runs))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, True):
            rows = [one(*x) for x in zip(ids, texts, block_runs(texts), strict=True)]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], [c.split(" ")[0] for c in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)
