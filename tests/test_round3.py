"""Cases of the third review: results that depend on accidents of the data, and work that must not grow with the square."""

import random
import time
from difflib import SequenceMatcher

from docaudit.functions import align, lines
from docaudit.operators import geometry, render
from docaudit.plans import audits, planted  # noqa: F401
from docaudit.plans.catalogue import queries


def turn_of(kind, conv, m=40):
    """A turn of a conversation for which the plans plant a kind."""
    return next(t for t in range(m * 3) if (conv * 7919 + t * 104729) % 1000003 % m == kind)


def test_a_long_line_that_holds_a_string_in_order_hides_no_lost_letter(spark, tmp_path):
    """the long turn holds all letters of the short one in order, which lacks a letter where it is rendered."""
    short = "Oneahehe and ouan ndanti ouble."
    rows = [(1, turn_of(1, 1), "user", short), (1, turn_of(20, 1), "user", "7".join(short) + "7")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries()["text_statuses"](spark, str(tmp_path)).collect()] == [(1, "NEAR")]


def test_blocks_are_those_of_aligning_every_place():
    """The blocks and edits of SequenceMatcher, ties included, in time for near copies of 20,000 characters."""
    rng = random.Random(4)
    for t in range(3000):
        signs = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        a, b = ("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2))
        b = b + a[: t % 7] + a[t % 7 + 1 :] + b if t % 3 == 0 else b
        assert [tuple(m) for m in align.blocks(a, b)] == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    long_ = "".join(rng.choice("abcd") for _ in range(20_000))
    began = time.process_time()
    assert align.gaps("Ω" + long_[1:], long_) == [(0, "Ω", long_[0])]
    assert time.process_time() - began < 2


def test_long_candidates_are_refuted_without_an_alignment(monkeypatch):
    """lines that have all letters of a string, but not in order, need no alignment."""
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefghijklmno") for _ in range(n))
    strings = [line(300) for _ in range(20)]
    found = [s[:150] + s[151:] for s in strings] + [line(900) for _ in range(40)]
    calls = []
    monkeypatch.setattr(render, "matched", lambda a, b: calls.append(1) or align.matched(a, b))
    assert [s for s, _ in render.best_shares(strings, found)] == [299 / 300] * 20 and len(calls) <= 40
    assert [p for _, p, _ in render.best_places(strings, found, [(0.0, float(i), 1.0, 1.0) for i in range(60)])] == list(range(20))


def test_character_boxes_of_a_long_line_are_one_walk():
    """each character looks at three boxes, whatever the length of the line."""
    line = "".join(chr(97 + i % 26) for i in range(50_000))
    words = [{"text": c, "x0": float(i), "y0": 0.0, "x1": i + 1.0, "y1": 2.0} for i, c in enumerate(line)]
    began = time.process_time()
    assert lines.boxes_in_order(line, words) == words and lines.boxes_in_order("a b", words[:2]) == [words[0], None, words[1]]
    assert time.process_time() - began < 2


def test_strips_are_walked_many_a_call(spark, monkeypatch):
    """a call of Python takes a lot of strips; strips above FEW boxes give what small ones give."""
    rng = random.Random(5)
    rows = [(p, i, float(x := rng.randint(0, 90)), float(y := rng.randint(0, 400)), x + float(rng.randint(1, 30)), y + float(rng.randint(1, 9))) for p in range(60) for i in range(30)]
    df = spark.createDataFrame(rows, "page long, pos long, x0 double, y0 double, x1 double, y1 double")
    lot = geometry.lots(df, geometry.strips(df, "y0", "y1"))
    assert lot.select("page", "strip").distinct().count() > 60 and lot.select("_lot").distinct().count() == 1
    key = lambda d: sorted(repr(tuple(r)) for r in d.collect())
    want = key(geometry.clipped(df, 120.0, 420.0, 0.01))
    monkeypatch.setattr(geometry, "FEW", 0)
    monkeypatch.setattr(geometry, "LOT", 64)
    assert key(geometry.clipped(df, 120.0, 420.0, 0.01)) == want and len(want) == len(rows)


def test_chains_and_rooms_serve_many_pages_a_call(spark, monkeypatch):
    """Lots of any size give the same rows."""
    rng = random.Random(6)
    rows = [(str(p), i, "t", float(x := rng.randint(0, 60)), float(y := rng.randint(0, 90)), x + float(rng.randint(1, 30)), y + float(rng.randint(1, 9))) for p in range(40) for i in range(15)]
    df = spark.createDataFrame(rows, "page string, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    assert geometry.lots(df, df, "page").select("_lot").distinct().count() == 1
    key = lambda: [sorted(map(repr, map(tuple, d.collect()))) for d in (geometry.rooms(df, 120.0, 120.0), geometry.column_chains(df))]
    want = key()
    monkeypatch.setattr(geometry, "LOT", 16)
    assert key() == want
