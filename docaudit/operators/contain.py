"""Which texts hold which patterns: automata over parts of the patterns, word runs where both sides are large."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.operators.render import parts

#: Patterns that are searched in one pass over all texts: so many characters at most, so what is sent to the tasks is bounded.
PASS_CHARS = 4 << 20


def _automaton(patterns: Iterable[tuple[object, str]]) -> ahocorasick.Automaton:
    """Finds all patterns at once; equal patterns share an entry."""
    out, ids = ahocorasick.Automaton(), {}
    for pid, p in patterns:
        ids.setdefault(p, []).append(pid)
    for p, found in ids.items():
        out.add_word(p, (len(p), found))
    out.make_automaton()
    return out


def _hits(a: ahocorasick.Automaton, text: str) -> dict:
    """pid to whether the text begins with it."""
    out: dict = {}
    if len(a):
        for end, (n, ids) in a.iter(text):
            for i in ids:
                out[i] = out.get(i, False) or end + 1 == n
    return out


def within(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(page, tid, pid, first): patterns that a text of their own page holds, and whether it begins with them. texts: page,
    tid, text; patterns: page, pid, pattern. Empty patterns are in no text. Parts of a page's texts and of its patterns meet
    in pairs, so the work grows with lengths, not with texts times patterns."""
    kinds = {f.name: f.dataType.simpleString() for d in (texts, patterns) for f in d.schema}
    ts = parts(texts.where("text IS NOT NULL"), ["tid", "text"], ["tid"], "ts")
    ps = parts(patterns.where("pattern <> ''"), ["pid", "pattern"], ["pid"], "ps", 4096)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, t, p in zip(pdf["page"], pdf["ts"], pdf["ps"], strict=True):
                a = _automaton((x["pid"], x["pattern"]) for x in p)
                out += [(page, x["tid"], pid, first) for x in t for pid, first in _hits(a, x["text"]).items()]
            yield pd.DataFrame(out, columns=["page", "tid", "pid", "first"])

    return ts.join(ps, "page").mapInPandas(run, f"page {kinds['page']}, tid {kinds['tid']}, pid {kinds['pid']}, first boolean")


def _in_passes(docs: DataFrame, items: DataFrame, chars: int) -> DataFrame:
    """(item_id, doc_id): a pass over the texts for each block of patterns; a block has at most `chars` characters, or one item."""
    kinds = {f.name: f.dataType.simpleString() for d in (docs, items) for f in d.schema}

    def one(block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = _automaton(block)
            for pdf in batches:
                out = [(pid, d) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for pid in _hits(a, t)]
                yield pd.DataFrame(out, columns=["item_id", "doc_id"])

        return docs.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}")

    passes, block, held = [], [], 0
    for r in items.select("item_id", "item").toLocalIterator():
        if block and held + len(r.item) > chars:
            passes.append(one(block))
            block, held = [], 0
        block.append((r.item_id, r.item))
        held += len(r.item)
    return reduce(DataFrame.unionByName, [*passes, one(block)])


def contained(docs: DataFrame, items: DataFrame, words: int = 3, chars: int = PASS_CHARS) -> DataFrame:
    """(item_id, doc_id): items that a text holds whole. docs: doc_id, text; items: item_id, item. All words of an item but
    its first and last are whole words of a text that holds it, so items of three words or more join by runs of up to
    `words` of them, and whole texts are compared where runs agree. Shorter items are searched by automata, `chars`
    characters of them in a pass. An empty item is in none."""
    cut = lambda c: F.split(c, " ")
    run = lambda ws, i, n: F.xxhash64(F.array_join(F.slice(ws, i, n), " "))
    items = items.where("item IS NOT NULL")
    n_inner = F.least(F.size(cut("item")) - 2, F.lit(words))
    keys = items.where(n_inner >= 1).select("item_id", n_inner.alias("n"), run(cut("item"), F.lit(2), n_inner).alias("h"))
    ws = docs.select("doc_id", cut("text").alias("ws")).where("ws IS NOT NULL")

    def runs_of(n: int) -> DataFrame:
        hashes = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: run(F.col("ws"), i, n))
        return ws.where(F.size("ws") >= n).select("doc_id", F.lit(n).alias("n"), F.explode(F.array_distinct(hashes)).alias("h"))

    found = _in_passes(docs, items.where((F.size(cut("item")) < 3) & (F.col("item") != "")), chars)
    for n in sorted(r.n for r in keys.select("n").distinct().collect()):
        near = runs_of(n).join(keys, ["n", "h"]).select("doc_id", "item_id").distinct()
        hit = near.join(docs, "doc_id").join(items, "item_id").where(F.contains("text", "item")).select("item_id", "doc_id")
        found = found.unionByName(hit)
    return found
