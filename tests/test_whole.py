"""Registered queries over whole texts: fixtures with texts beyond what the driver's tables have."""

import difflib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docaudit.functions import align, text
from docaudit.plans import audits, catalogue


@pytest.fixture
def stored(spark, tmp_path):
    """Writes one table of a fixture and says where it is."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_turns_are_voted_on_whole(spark, stored):
    """The two right readings outvote the first at every place, so what is merged is the turn itself."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = ["He said " + prose(150), "we " + prose(400), "no swap here " + prose(20), "short", "", None, "Be" + "语" * 200 + ".\nlast line"]
    at = stored("conversations", [(7, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    got = {r.turn: r.merged for r in catalogue.queries()["voted_turns"](spark, at).collect()}
    assert max(len(t or "") for t in texts) > 1000 and got == dict(enumerate(texts))


def test_decks_have_all_lines(spark, stored):
    """Lines far down a turn are bullets too."""
    texts = ["\n".join(["Title", *(f"条目{i}" for i in range(1500)), "最后一条；"]), "only a title", "", None]
    at = stored("conversations", [(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    pages, _ = catalogue.decks(spark, at)
    got = {r.pos: r["items"] for r in pages.selectExpr("pos", "blocks[0].items AS items").collect()}
    assert [x.text for x in got[0]] == texts[0].split("\n")[1:] and (got[1], got[2], got[3]) == ([], [], None)


# Registered queries without SQL, against plain versions over the smallest tables

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


def blocks(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


def matched(a, b):
    return sum(m.size for m in blocks(a, b).get_matching_blocks())


@needs_data
def test_renderings_are_those_of_aligning_all(spark):
    strings, lines = audits.rendered(spark, DATA)
    lines, norm = lines.cache(), text.normalise(F.col("text")).alias("n")
    wanted = strings.select("page", "sid", norm).collect()
    found = sorted(lines.select("page", "pos", "x0", "y0", "x1", "y1", norm).collect(), key=lambda r: (r.page, r.pos))
    pages = defaultdict(list)
    for r in found:
        pages[r.page].append(r)
    ratios, places = {}, {}
    for w in wanted:
        own = pages[w.page]
        groups = [[x] for x in own] + [[a, b] for a, b in zip(own, own[1:], strict=False)]
        whole = ["".join(x.n for x in g) for g in groups]
        ratios[w.page, w.sid] = 1.0 if not w.n or any(w.n in c for c in whole) else max(matched(w.n, c) / len(w.n) for c in whole)
        best = None
        for g, c in zip(groups, whole, strict=True):
            if len(w.n) >= 2 and c and (len(g) == 1 or abs(g[0].y0 - g[1].y0) < g[0].y1 - g[0].y0):
                box = (min(x.x0 for x in g), min(x.y0 for x in g), max(x.x1 for x in g), max(x.y1 for x in g))
                key = (matched(w.n, c) / len(w.n) * min(1.0, len(w.n) / len(c) + 0.3), -box[1], -box[0])
                best = max(best or (key, box), (key, box))
        if best and best[0][0] >= 0.45:
            places[w.page, w.sid] = (round(best[0][0], 9), -best[0][1], -best[0][2])
    got = catalogue.queries()["best_renderings"](spark, DATA).collect()
    assert {(r.conv_id, r.turn): r.ratio for r in got} == pytest.approx({k: round(v, 9) for k, v in ratios.items()}) and sum(r.aligned for r in got) < sum(r.pairs for r in got)
    assert {(r.conv_id, r.turn): (r.score, r.y0, r.x0) for r in catalogue.queries()["rendering_places"](spark, DATA).collect()} == places


def plain_vote(page, others):
    """Place by place, by what common blocks leave between them."""
    solid = lambda t: t.replace(" ", "").replace(align.LOST, "")
    base, others = solid(page), [solid(o) for o in others if solid(o)]
    word = lambda c: (c.isalnum() or "㐀" <= c <= "鿿") and not ("①" <= c <= "⓿" or "❶" <= c <= "➓")
    if len(others) < 2 or not base:
        return page.replace(align.LOST, " ")
    swaps, puts, fold = defaultdict(Counter), defaultdict(Counter), lambda t: "".join(c.upper() if len(c.upper()) == 1 else c for c in t)
    for o in others:
        for tag, a, b, c, d in blocks(fold(base), fold(o)).get_opcodes():
            if tag == "insert":
                puts[a][o[c:d]] += 1
            elif tag == "replace" and b - a == d - c:
                for k in range(b - a):
                    swaps[a + k][o[c + k]] += 1
    out, at, used = "", 0, set()

    def put(gap):
        for t, n in puts[at].items():
            edge = at in (0, len(base))
            if n >= 2 and at not in used and all(word(c) or c in align.DASHES for c in t) and not (edge and any(c in align.DASHES for c in t)) and (not edge or gap or len(t) == 1):
                used.add(at)
                return t
        return None

    for c in page:
        if c == " ":
            out += c
        elif c == align.LOST:
            out += put(True) or " "
        else:
            t = put(False)
            out = out + "" if t is None else (out[:-1] if out.endswith(" ") else out) + t
            best = max(swaps[at], key=lambda x: (swaps[at][x], [-ord(ch) for ch in x]), default=c)
            out += best if swaps[at][best] >= 2 and best.upper() != c.upper() and word(best) and word(c) else c
            at += 1
    t = put(False)
    return out if t is None else (out[:-1] if out.endswith(" ") else out) + t


@needs_data
def test_votes_are_those_of_plain_counting(spark):
    rows = {(r.line_id.conv_id, r.line_id.turn): (r.page, list(r.readings)) for r in audits.readings(spark, DATA).collect()}
    got = {(r.conv_id, r.turn): r.merged for r in catalogue.queries()["voted_readings"](spark, DATA).collect()}
    assert got == {k: plain_vote(*v) for k, v in rows.items()}
    right = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    assert sum(got[k].replace(" ", "") == right[k].replace(" ", "") for k in got) > 0.8 * len(got) > 50  # faults are mended


@needs_data
def test_character_boxes_are_a_walk_with_three_ahead(spark):
    want = {}
    for r in audits.boxed_characters(spark, DATA).collect():
        k, out, flat = 0, [], [w for w in r.words if w.text]
        for c in r.line:
            j = next((j for j in range(k, min(k + 3, len(flat))) if flat[j].text == c), k) if not c.isspace() else len(flat)
            if j < len(flat):
                out.append(str(int(flat[j].x0)))
                k = j + 1
            else:
                out.append("-")
        want[r.conv_id, r.turn] = " ".join(out)
    assert {(r.conv_id, r.turn): r.places for r in catalogue.queries()["reader_boxes"](spark, DATA).collect()} == want


@needs_data
def test_paragraphs_are_a_walk_from_the_top(spark):
    rows = sorted(audits.columns_of_lines(spark, DATA).collect(), key=lambda r: (r.page, r.y0, r.x0, r.pos, r.style, r.size, r.x1, r.y1))
    chains, want = defaultdict(list), Counter()
    for r in rows:
        for c in chains[r.page]:
            last, pitch = c[-1], r.y0 - c[-1].y0
            near = min(abs(r.x0 - last.x0), abs((r.x0 + r.x1) / 2 - (last.x0 + last.x1) / 2), abs(r.x1 - last.x1)) <= 0.5 * r["size"]
            if last.style == r.style and 1.05 * r["size"] <= pitch <= 2.3 * r["size"] and near and (len(c) == 1 or abs(pitch - (last.y0 - c[-2].y0)) <= 0.12 * pitch):
                c.append(r)
                break
        else:
            chains[r.page].append([r])
    for page, found in chains.items():
        for k, c in enumerate(found):
            spread = [max(v) - min(v) for v in ([r.x0 for r in c], [(r.x0 + r.x1) / 2 for r in c], [r.x1 for r in c])]
            for r in c:
                want[page, r.pos, k, ("left", "center", "right")[spread.index(min(spread))]] += 1
    assert Counter((r.page, r.pos, r.paragraph, r["align"]) for r in catalogue.queries()["paragraph_lines"](spark, DATA).collect()) == want
    assert max(len(c) for found in chains.values() for c in found) >= 3


@needs_data
def test_rotation_is_a_walk_over_pages(spark):
    options = {"surface": ["plain", "card", "band"], "accent": ["a", "b"], "framing": ["f", "g", "h"], "device": ["d", "e", "i", "k"]}
    pages, _ = catalogue.decks(spark, DATA)
    decks_, want = defaultdict(list), {}
    for r in pages.where("kind = 'content'").select("doc", "pos", "id").collect():
        decks_[r.doc].append((r.pos, r.id))
    for doc, ps in decks_.items():
        last, past = {}, []
        for n, (_, page) in enumerate(sorted(ps)):
            pick = {}
            for k, (axis, o) in enumerate(options.items()):
                if axis == "surface":
                    pick[axis] = o[0] if n % 2 == 0 else o[1 + n // 2 % (len(o) - 1)]
                else:
                    pick[axis] = o[(n + k) % len(o)]
                    if pick[axis] == last.get(axis):
                        pick[axis] = o[(o.index(pick[axis]) + 1) % len(o)]
            while tuple(pick.values()) in past[-6:]:
                pick["device"] = options["device"][(options["device"].index(pick["device"]) + 1) % 4]
            last = pick
            past.append(tuple(pick.values()))
            want[doc, page] = " ".join(pick[a] for a in sorted(pick))
    assert {(r.doc, r.page): r.choices for r in catalogue.queries()["rotation_plan"](spark, DATA).collect()} == want


@needs_data
def test_clipped_boxes_are_a_walk_in_order(spark):
    rows = sorted(audits.crowded(spark, DATA).collect(), key=lambda r: (r.page, r.pos, r.x0, r.y0, r.x1, r.y1))
    pages = defaultdict(list)
    for r in rows:
        pages[r.page].append([r.pos, r.x0, r.y0, r.x1, r.y1])
    want = Counter()
    for page, own in pages.items():
        cut = []
        for s in own:
            _, x0, y0, x1, y1 = s
            top = foot = False
            for o in own:
                if o is not s and min(x1, o[3]) - max(x0, o[1]) >= 0.3 * min(x1 - x0, o[3] - o[1]):
                    if y0 < o[2] < y1 < o[4]:
                        y1, foot = (o[2] + y1) / 2, True
                    elif o[2] < y0 < o[4] < y1:
                        y0, top = (y0 + o[4]) / 2, True
            h = y1 - y0
            for o in own:
                if o is not s and min(y1, o[4]) - max(y0, o[2]) >= 0.5 * min(h, o[4] - o[2]):
                    if x0 < o[1] < x1 + 0.6 * h and o[3] > x1:
                        x1 = (o[1] + x1) / 2 if o[1] < x1 else x1
                    elif x0 - 0.6 * h < o[3] < x1 and o[1] < x0:
                        x0 = (o[3] + x0) / 2 if o[3] > x0 else x0
            s[1:] = [x0, y0, x1, y1]
            cut.append((top, foot))
        for s, c in zip(own, cut, strict=True):
            want[(page, s[0], *(round(v, 6) for v in s[1:]), *c)] += 1
    got = catalogue.queries()["clipped_boxes"](spark, DATA).collect()
    assert Counter((r.page, r.pos, *(round(v, 6) for v in (r.cx0, r.cy0, r.cx1, r.cy1)), r.cut_top, r.cut_bottom) for r in got) == want
    assert any(r.cut_top or r.cut_bottom for r in got)
