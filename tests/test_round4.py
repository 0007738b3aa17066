"""Findings of the third review that were open: votes whose work grows with the text, one Python step for drafts. Those of the fourth:
boxes that stay columns, candidates that are all aligned."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from docaudit.functions import align, lines
from docaudit.operators import match, vote
from docaudit.plans import prompts
from test_whole import plain_vote


def test_places_that_cannot_begin_a_longer_stretch_are_leapt_over():
    """F8: near copies of 100,000 characters with a fault in the middle."""
    rng = random.Random(8)
    long_ = "".join(rng.choice("abcd") for _ in range(100_000))
    began = time.process_time()
    assert align.ballots(long_[:50_000] + "Ω" + long_[50_001:], long_[:80_000] + long_[80_001:]) == [(50_000, "Ω", long_[50_000])]
    assert time.process_time() - began < 1


def test_votes_fold_stretches_not_characters(spark):
    """F8: a blank before a line's end isn't one before an insertion; a line with many faults is the plain walk's."""
    rng = random.Random(9)
    right = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(300))
    page, places = list(right), range(5, len(right), 100)
    for k, i in enumerate(places):
        page[i] = {0: "Ω", 1: "", 2: align.LOST}[k % 3] if right[i] != " " else " "
    rows = [(0, "ab \ncd", ["ab\nXcd"] * 2), (1, "ab  cd", ["abXcd"] * 2), (2, f"ab {align.LOST}{align.LOST}cd", ["abXYcd"] * 2), (3, "".join(page), [right] * 2)]
    got = {r.line_id: r.merged for r in vote.voted(spark.createDataFrame(rows, "line_id int, page string, readings array<string>")).collect()}
    assert (got[0], got[1], got[2]) == ("ab \nXcd", "ab Xcd", "ab XY cd")
    assert got[3] == plain_vote(rows[3][1], rows[3][2]) and got[3].replace(" ", "") == right.replace(" ", "")


def test_drafts_are_matched_once_and_take_one_python_step(spark):
    """each further step keeps a Python worker and its batches a task."""
    matches = spark.createDataFrame([(i, i + 10) for i in range(5)], "line_id long, entry_id long")
    lines = spark.createDataFrame([(0, " 品牌策略 "), (1, "品脾 策略"), (2, None), (3, "ab cd"), (4, "增长策 的路径")], "line_id long, line string")
    draft = spark.createDataFrame([(10, "品牌策略。"), (11, "品牌策略"), (12, "x"), (13, None), (14, "我们的增长策略的路径图")], "entry_id long, entry string")
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")
    kept, found = match.corrected_lines(matches, lines, draft), prompts.draft_differences(matches, lines, draft)
    assert (steps(kept), steps(found)) == (1, 1)
    assert {r.line_id: r.text for r in kept.collect()} == {0: "品牌策略", 1: "品牌 策略", 2: None, 3: "ab cd", 4: "增长策 略的路径"}
    assert found.columns == ["line_id", "entry_id", "line", "text", "changes"]
    assert {r.line_id: (r.text, [tuple(c) for c in r.changes]) for r in found.collect()} == {1: ("品牌 策略", [("脾", "牌")]), 4: ("增长策 略的路径", [("", "略")])}


def test_character_boxes_stay_columns_and_are_planned_each_time(spark):
    """boxes go by piece and aren't made Python objects; the query ran once a session only."""
    words = [[(c, i, 0, i + 1, 2) for i, c in enumerate("ab" * k)] for k in (0, 1, 400)]
    rows = [(0, "x", words[0]), (1, "a b", [None, ("", 9, 0, 9, 9), *words[1]]), (2, "ab" * 400, words[2]), (3, None, words[1]), (4, "ab", None), (5, "b", [(None, 1, 1, 1, 1), *words[1]])]
    df = spark.createDataFrame(rows, "i int, line string, words array<struct<text:string,x0:int,y0:int,x1:int,y1:int>>").coalesce(1)
    want = {0: [None], 1: [0.0, None, 1.0], 2: [float(i) for i in range(800)], 3: None, 4: None, 5: [1.0]}
    made = df.withColumn("words", F.transform("words", lambda w: F.when(w.isNotNull(), F.struct(w.text.alias("text"), *(w[c].alias(c) for c in ("x0", "y0", "x1", "y1"))))))
    for _ in range(2):
        for found in (lines.boxed(made, "line", "words"), df.select("i", lines.character_boxes(F.col("line"), F.col("words")).alias("boxes"))):
            assert {r.i: r.boxes and [b and b.x0 for b in r.boxes] for r in found.collect()} == want


def test_a_piece_of_boxes_holds_no_more_than_its_bytes():
    """a batch is walked in pieces, whatever its size; a slice's boxes are those of its own words."""
    line, n = "abc" * 100, 3000
    word = [{"text": c, "x0": float(i), "y0": 0.0, "x1": i + 1.0, "y1": 2.0} for i, c in enumerate(line)]
    b = pa.RecordBatch.from_arrays([pa.array([line] * n), pa.array([word] * n)], ["line", "words"])
    sizes = [p.num_rows for p in lines._pieces(b)]
    assert sum(sizes) == n and max(sizes) <= lines.PIECE // 10_000
    assert lines.boxes_of_lines(b.slice(7, 2).column(0), b.slice(7, 2).column(1)).to_pylist() == [[{k: v for k, v in w.items() if k != "text"} for w in word]] * 2


def best_of_all(lines, entries):
    """For each line its best acceptable entry of all that share enough bigrams, in plain Python."""
    grams, out = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}, {}
    for k, t in lines.items():
        near = [e for e, x in entries.items() if len(grams(t) & grams(x)) >= max(1, int(0.45 * (len(t) - 1)))]
        same = [(1.0, 1.0, -e) for e, x in entries.items() if x == t]
        found = same or [(*s, -e) for e in near if (s := align.acceptable(t, entries[e], False))]
        if found:
            out[k] = (-max(found)[2], max(found)[0])
    return out


def test_all_candidates_of_a_line_are_aligned(spark):
    """entries that share more of a line, but not in order, hide none that may stand for it; the former code took the first 40."""
    rng = random.Random(2)
    right, halves = "ABCDEFGHIJKLMNOPQRST", "KLMNOPQRSTABCDEFGHIJ"
    entries = {i: halves + chr(0x4E00 + i) * 2 for i in range(50)} | {99: right.replace("J", "9Z"), 98: right.replace("J", "Z"), 120: right.replace("J", "Z")}
    lines_ = {0: right}
    for k in range(1, 40):  # near copies of one text, over 40 to each line
        base = list(rng.choice(["UVWXYUVXWYVUXY", "VUXWVUYXWVYUVX"]))
        entries[200 + k] = "".join(c if rng.random() > 0.15 else rng.choice("UVWXY") for c in "UVWXYUVXWYVUXY")
        entries[300 + k] = entries[200 + k][rng.randrange(4) :] + "".join(base[: rng.randrange(4)])
        lines_[k] = "".join(c if rng.random() > 0.1 else rng.choice("UVWXY") for c in base)
    want = best_of_all(lines_, entries)
    asked = spark.createDataFrame(list(lines_.items()), "line_id long, line string")
    got = {r.line_id: (r.entry_id, r.score) for r in match.corpus_match(asked, spark.createDataFrame(list(entries.items()), "entry_id long, entry string")).collect()}
    assert got == want and got[0] == (98, 0.95) and len(got) > 20
