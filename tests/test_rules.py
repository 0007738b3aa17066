"""Sources, order, geometry, state and the rule layer on fixture documents."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docaudit.functions import text as forms
from docaudit.operators import contain, geometry, grams, graph, match, medians, order, render, staging, state, stats
from docaudit.plans import dims, prompts, rules
from docaudit.sources import files, markdown, outline, sinks


def page(kind="content", **more):
    return {"kind": kind, **more}


def outlines(spark, tmp_path, *docs):
    for i, d in enumerate(docs):
        (tmp_path / f"d{i}.json").write_text(json.dumps(d, ensure_ascii=False), encoding="utf-8")
    return outline.read_outlines(spark, str(tmp_path)).withColumn("doc", F.regexp_extract("doc", "(d\\d+)\\.json", 1))


SETTINGS = "doc string, thesis string, mode string, max_pages int, section_pages boolean, duration_min double, has_source boolean, unread boolean"
NONE = ("doc string, idx int, level int, text string", "doc string, text string", "doc string, name string", "doc string, source string, reason string")


def settings(spark, *rows):
    return spark.createDataFrame(rows or [("d0", "thesis", "read", None, None, None, False, False)], SETTINGS)


def found(df):
    return {(r.rule, r.entity) for r in df.collect()}


def nothing(spark):
    return [spark.createDataFrame([], s) for s in NONE]


def test_flatten_reads_all_block_types(spark, tmp_path):
    doc = {"title": "t", "pages": [page(kicker=" k ", title="T", subtitle="", blocks=[
        {"type": "bullets", "items": ["a", {"text": "b"}, " "]}, {"type": "numbered", "items": [{"label": "1", "title": "x", "text": "y"}]}, {"type": "kpis", "items": [{"value": "9", "label": "n"}]},
        {"type": "table", "caption": "c", "header": ["h"], "rows": [["r1", "r2"], ["r3"]]}, {"type": "columns", "columns": [{"title": "ct", "items": ["ci"]}]}, {"type": "quote", "text": "q", "source": "s"}, {"type": "heading", "text": "hd"}, {"type": "other", "text": "no"},
    ], takeaway="tk", footnote="fn"), page("closing", id="end", title="E")]}
    pages = outline.pages_of(outlines(spark, tmp_path, doc))
    rows = outline.slots(pages).orderBy("pos", "ord").collect()
    assert [(r.role, r.text) for r in rows if r.page == "p01"] == [
        ("kicker", "k"), ("title", "T"), ("bullet", "a"), ("bullet", "b"), ("number", "1"), ("item title", "x"), ("item text", "y"), ("big number", "9"), ("number label", "n"), ("table caption", "c"),
        ("table header", "h"), ("table cell", "r1"), ("table cell", "r2"), ("table cell", "r3"), ("column title", "ct"), ("column item", "ci"), ("quote", "q"), ("source", "s"), ("heading", "hd"), ("takeaway", "tk"), ("footnote", "fn"),
    ]
    assert rows[-1].page == "end"
    load = {r.page: r for r in outline.load(pages).collect()}
    assert (load["p01"].table_rows, load["p01"].table_columns) == (2, 2) and load["end"].strings == 1


def test_broken_outline_keeps_its_row(spark, tmp_path):
    (tmp_path / "d1.json").write_text("{broken")
    rows = outlines(spark, tmp_path, {"title": "t", "pages": []}).collect()
    assert len(rows) == 2 and any(r._corrupt for r in rows)


def test_storyline_rules(spark, tmp_path):
    doc = {"pages": [
        page("cover", title="封面"), page("agenda", title="目录", blocks=[{"type": "bullets", "items": ["甲"]}]), page(chapter="甲", title="市场现状", source="第一章", blocks=[{"type": "kpis", "items": [{"label": "收入", "value": "10"}]}]),
        page(chapter="乙", title="本页说明", blocks=[{"type": "kpis", "items": [{"label": "收入", "value": "12"}]}]), page(chapter="甲", title="结论成立", blocks=[{"type": "text", "text": "见附录 A2"}]), page(title="无章节"),
        page("summary", title="摘要", covers=["乙", "甲"]), page("appendix", title="附录", chapter="甲"), page("closing", title="谢谢"),
    ]}
    pages = outline.pages_of(outlines(spark, tmp_path, doc))
    got = found(rules.storyline(pages, settings(spark, ("d0", " ", "read", None, None, None, False, False)), *nothing(spark)))
    want = {
        ("storyline.thesis", None), ("storyline.chapter_missing", "p06"), ("storyline.chapter_split", "甲"), ("storyline.appendix_before_closing", None), ("storyline.appendix_not_last", None), ("storyline.appendix_reference", "p05"),
        ("storyline.closing_thanks", "p09"), ("storyline.title_about_deck", "p04"), ("storyline.title_topic", "p03"), ("storyline.agenda", "p02"), ("storyline.covers_order", "p07"), ("storyline.kpi_conflict", "收入"),
    }
    assert got == want
    assert not rules.gate(rules.storyline(pages, settings(spark), *nothing(spark)))


def test_source_coverage(spark, tmp_path):
    doc = {"storyline": {"dropped": ["第三章：不上屏", {"source": "别的", "reason": ""}]}, "pages": [page(chapter="a", title="x", source=["1.1 节"]), page(chapter="a", title="y", source="无此来源"), page(chapter="a", title="z"), page(chapter="a", title="w", source="补充：访谈")]}
    raw = outlines(spark, tmp_path, doc)
    heads = spark.createDataFrame([("d0", 0, 1, "第一章"), ("d0", 1, 2, "1.1 节"), ("d0", 2, 1, "第二章"), ("d0", 3, 1, "第三章")], NONE[0])
    body, names = spark.createDataFrame([("d0", "正文内容")], NONE[1]), spark.createDataFrame([("d0", "报告")], NONE[2])
    got = found(rules.storyline(outline.pages_of(raw), settings(spark, ("d0", "t", "read", None, None, None, True, False)), heads, body, names, outline.dropped_of(raw)))
    assert {g for g in got if "source" in g[0] or "heading" in g[0] or "dropped" in g[0]} == {("storyline.source_unknown", "p02"), ("storyline.source_missing", "p03"), ("storyline.heading_uncovered", "第二章"), ("storyline.dropped_reason", "别的")}


def brief(skeleton, structure="flow", **more):
    return {"message": "m", "structure": structure, "form": f"f{id(more)}", "focal": "f", "skeleton": skeleton, **more}


def test_visual_rules(spark, tmp_path):
    sk = ["cards", "cards", "split", "cards", "split", "hero", "bands", "hero", "table"]
    pages = [page(title=f"t{i}", visual=brief(s, "list" if i < 3 else "flow", form=f"form{i}", motif="城市夜景航拍" if i in (6, 8) else f"m{i}")) for i, s in enumerate(sk)]
    pages += [page(title="字" * 31, kicker="字" * 9, visual={"structure": "bad", "skeleton": "nope"}), page("section", title="s")]
    pages[3]["blocks"] = [{"type": "table", "header": ["a"] * 6, "rows": [["b"]] * 7}]
    got = found(rules.visual(outline.pages_of(outlines(spark, tmp_path, {"pages": pages})), settings(spark, ("d0", "t", "read", 5, False, None, False, False))))
    for want in [
        ("visual.max_pages", None), ("visual.section_pages", "p11"), ("visual.brief_missing", "p11"), ("visual.field_missing", "p10"), ("visual.structure_unknown", "p10"), ("visual.skeleton_unknown", "p10"), ("visual.neighbour_skeleton", "p02"),
        ("visual.neighbour_structure", "p03"), ("visual.skeleton_lag2", "p04"), ("visual.skeleton_lag2", "p05"), ("visual.list_quota", None), ("visual.motif_same", "p09"), ("capacity.title", "p10"), ("capacity.kicker", "p10"), ("capacity.table", "p04"),
    ]:
        assert want in got, want
    assert ("visual.skeleton_lag2", "p08") not in got and ("visual.form_same", "p02") not in got


def test_close_motifs_name_the_first(spark, tmp_path):
    pages = [page(title="a", visual=brief("hero", motif="港口集装箱夜景")), page(title="b", visual=brief("cards", motif="港口集装箱日景")), page(title="c", visual=brief("split", motif="无照片"))]
    got = rules.visual(outline.pages_of(outlines(spark, tmp_path, {"pages": pages})), settings(spark)).where("rule = 'visual.motif_close'").collect()
    assert [(r.entity, r.detail) for r in got] == [("p02", "p01")]


def test_rhythm(spark, tmp_path):
    dense = [page(title="t", visual=brief("cards"), blocks=[{"type": "text", "text": "字" * 30}]) for _ in range(10)]
    pages = outline.pages_of(outlines(spark, tmp_path, {"pages": dense}))
    assert ("rhythm.dense_frame", "p01") in found(rules.capacity(pages, settings(spark)))
    got = found(rules.capacity(pages, settings(spark, ("d0", "t", "present", None, None, None, False, False))))
    assert ("rhythm.dense_run", None) in got and ("rhythm.no_light_page", None) in got


def test_punctuation_groups(spark, tmp_path):
    doc = {"pages": [page(title="标题。", blocks=[{"type": "bullets", "items": ["第一句。第二句。", "没有句号"]}])]}
    got = found(rules.punctuation(outline.slots(outline.pages_of(outlines(spark, tmp_path, doc)))))
    assert got == {("punct.stop", "p01"), ("punct.mixed", "p01/b1")}


def direction(i, **more):
    axes = {k: v[i % len(v)] for k, v in dims.AXES.items()}
    base = {"doc": "d", "id": f"x{i}", "source": "own", "refs": [], "imagery_mode": dims.IMAGERY_MODES[i], "dims": {k: f"{k}{i}" for k in dims.DIMENSIONS}, "axes": axes, "cover": (f"l{i}", f"m{i}"), "type_classes": {"title": "hei", "body": "song"}, "temperature": "safe" if i else "distinct", "icons": "none", "allow": [], "variety": None, "light": f"background #00000{i}", "dark": f"background #11111{i}", "brand_fit": "fits"}
    return tuple((base | more).values())


DIRECTION = "doc string, id string, source string, refs array<string>, imagery_mode string, dims map<string,string>, axes map<string,string>, cover struct<layout:string,motif:string>, type_classes map<string,string>, temperature string, icons string, allow array<string>, variety map<string,array<string>>, light string, dark string, brand_fit string"


def test_directions(spark):
    make = lambda *rows: found(rules.directions(spark.createDataFrame(rows, DIRECTION)))
    assert make(*(direction(i) for i in range(3))) == set()
    got = make(direction(0, temperature="safe", light="background #000001"), direction(1, dims={k: f"{k}{1}" for k in dims.DIMENSIONS} | {"layout": "layout 0"}, allow=["laser"]), direction(2, imagery_mode=dims.IMAGERY_MODES[1], type_classes={"title": "hei", "body": "kai"}))
    assert {("directions.all_safe", None), ("directions.same", "x0 = x1"), ("directions.same", "x1 = x2"), ("directions.allow", "x1"), ("directions.type_classes", "x2")} == got
    assert ("directions.count", None) in make(direction(0))


def test_variety_plan(spark, tmp_path):
    pages = outline.pages_of(outlines(spark, tmp_path, {"pages": [page(title="t", visual=brief("cards", variant={"accent": "own"} if i == 3 else None)) for i in range(8)]}))
    got = rules.plan_variety(pages, {"surface": ["s0", "s1", "s2"], "accent": ["a0", "a1"], "framing": ["f0", "f1", "f2"], "device": ["d0", "d1", "d2"]}).collect()
    by = {}
    for r in got:
        by.setdefault(r.page, {})[r.axis] = r.choice
    combos = [tuple(by[p].values()) for p in sorted(by)]
    assert len(by) == 8 and by["p01"]["surface"] == by["p03"]["surface"] == "s0" and by["p04"]["accent"] == "own" and all(combos[i] not in combos[max(0, i - 6) : i] for i in range(8))


def test_audit_and_approval(spark):
    rows = [("d", f"p{i}", None if i == 0 else "pass", {"q1": True, "q2": None if i == 1 else False}, [("icons", "n")] + ([("odd", "n")] if i == 2 else [])) for i in range(3)]
    entries = spark.createDataFrame(rows, "doc string, page string, verdict string, answers map<string,boolean>, problems array<struct<type:string,note:string>>")
    assert found(rules.audit(entries)) == {("audit.no_verdict", "p0"), ("audit.unanswered", "p1"), ("audit.unknown_type", "p2"), ("audit.deck_wide", "icons")}
    sig = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc string, signature string")
    was = spark.createDataFrame([("a", "1"), ("b", "0")], "doc string, signature string")
    assert {(r.rule, r.doc) for r in rules.approval(sig, was).collect()} == {("approval.changed", "b"), ("approval.missing", "c")}


def test_import_findings(spark):
    before = spark.createDataFrame([("1", "title", "收入 10%"), ("2", "bullet", "甲"), ("3", "notes", "一"), ("4", "text", "丁"), ("5", "text", "戊")], "id string, role string, text string")
    after = spark.createDataFrame([("1", "收入 12%"), ("2", ""), ("3", "一\n二"), ("4", "丁\n丁"), ("6", "x")], "id string, text string")
    got = {(r.rule, r.id) for r in state.import_findings(before, after, before.select("id", "text").where("id <> '3'")).collect()}
    assert got == {("import.facts", "1"), ("import.emptied", "2"), ("import.newline", "4"), ("import.marker_missing", "5"), ("import.marker_extra", "6"), ("import.stale", "3")}
    kept = state.applied(before, after, state.import_findings(before, after, before.select("id", "text")))
    assert {r.id: r.text for r in kept.collect()} == {r.id: r.text for r in before.collect()}


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 1)], "page string, v int")
    assert {r.page: r.next_free for r in order.next_free(rows, ["page"], "v").collect()} == {"a": 3, "b": 1, "c": 2}
    tries = spark.createDataFrame([("a", 1, 5, 0, 1), ("a", 2, 3, 0, 1), ("a", 3, 2, 1, 0), ("a", 4, 1, 0, 3)], "page string, v int, errors int, corner int, extra int")
    assert [r.accepted for r in state.accepted_versions(tries, ["page"], "v").orderBy("v").collect()] == [True, True, False, False]
    index = spark.createDataFrame([("p1", 1, "cards"), ("p2", 2, "cards"), ("p3", 3, "hero"), ("p4", 4, "split"), ("p5", 5, "split")], "page string, pos int, skeleton string")
    waves = {r.page: r.wave for r in state.waves(index, spark.createDataFrame([("p5",)], "page string")).collect()}
    assert waves == {"p1": 1, "p2": 2, "p3": 2, "p4": 2}
    log = spark.createDataFrame([("a", 1, 60000), ("a", 0, 60000), ("b", 0, 100)], "page string, rc int, bytes long")
    assert {r.page: (r.tries, r.ok) for r in state.succeeded(log).collect()} == {"a": (2, True), "b": (1, False)}


OCR = "page string, pos long, text string, x0 double, y0 double, x1 double, y1 double"


def test_wrapped_string_is_found_in_its_column(spark):
    lines = spark.createDataFrame([("p", 0, "品牌定位", 0.0, 0.0, 40.0, 10.0), ("p", 1, "渠道", 100.0, 1.0, 140.0, 11.0), ("p", 2, "需要重", 0.0, 11.0, 40.0, 21.0), ("p", 3, "下沉", 100.0, 12.0, 140.0, 22.0), ("p", 4, "新梳理", 0.0, 22.0, 40.0, 32.0)], OCR)
    want = spark.createDataFrame([("p", "s1", "品牌定位需要重新梳理"), ("p", "s2", "渠道下沉"), ("p", "s3", "完全无关")], "page string, sid string, text string")
    plain = {r.sid: r.ratio for r in render.best_ratio(want, lines).collect()}
    chains = geometry.column_chains(lines)
    full = {r.sid: r.ratio for r in render.best_ratio(want, lines, chains).collect()}
    assert plain["s1"] < 0.8 and full["s1"] == 1.0 and full["s2"] == 1.0 and full["s3"] < 0.5
    assert {r.sid: r.status for r in match.rendering_status(render.best_ratio(want, lines, chains)).collect()}["s3"] == "MISS"
    boxes = {r.sid: (r.x0, r.y0, r.x1, r.y1) for r in render.locate(want, lines, chains).collect()}
    assert boxes["s1"] == (0.0, 0.0, 40.0, 32.0) and "s3" not in boxes


def test_extra_text_and_stops(spark):
    strings = spark.createDataFrame([("p", "s1", "品牌定位"), ("p", "s2", "增长目标")], "page string, sid string, text string")
    lines = spark.createDataFrame([("p", 0, "品牌定位", 0.0, 0.0, 1.0, 1.0), ("p", 1, "多余文字", 0.0, 0.0, 1.0, 1.0), ("p", 2, "增长目标。", 0.0, 0.0, 1.0, 1.0)], OCR)
    assert [r.pos for r in render.extra_lines(strings, lines).collect()] == [1]
    assert [r.sid for r in match.extra_stops(strings, lines).collect()] == ["s2"]
    slides = spark.createDataFrame([("p", 0, "品牌"), ("p", 1, "定位。")], "page string, pos long, text string")
    assert sorted(r.pos for r in match.missing_text(lines, slides).collect()) == [1, 2]


def test_corpus_match_prefers_authority(spark):
    lines = spark.createDataFrame([(1, "品脾战略升级计划"), (2, "完全不同的一行字"), (3, "第12页数据")], "line_id long, line string")
    page_corpus = spark.createDataFrame([(10, "品牌战略升级计划"), (11, "第13页数据")], "entry_id long, entry string")
    whole = spark.createDataFrame([(20, "完全不同的一行字")], "entry_id long, entry string")
    got = {r.line_id: (r.entry_id, r.authority) for r in match.by_authority([match.corpus_match(lines, page_corpus), match.corpus_match(lines, whole)]).collect()}
    assert got == {1: (10, 0), 2: (20, 1)}


def test_geometry(spark):
    pages = spark.createDataFrame([("p", "br", 1000.0, 500.0)], "page string, corner string, width double, height double")
    corner = geometry.corner_boxes(pages).first()
    assert (corner.x0, corner.y0, corner.x1, corner.y1) == (880.0, 455.0, 1000.0, 500.0)
    lines = spark.createDataFrame([("p", 0, "in", 900.0, 460.0, 950.0, 480.0), ("p", 1, "out", 0.0, 0.0, 10.0, 10.0)], OCR)
    assert [r.text for r in geometry.centres_inside(lines, geometry.corner_boxes(pages)).collect()] == ["in"]
    assert [r.text for r in geometry.centres_inside(lines, geometry.corner_boxes(pages), 50.0).collect()] == ["in"]
    row = spark.createDataFrame([("p", 0, "a", 0.0, 0.0, 10.0, 10.0), ("p", 1, "b", 30.0, 2.0, 40.0, 12.0), ("p", 2, "c", 20.0, 50.0, 40.0, 60.0)], OCR)
    assert {r.text: r.room for r in geometry.free_room(row, 100.0).collect()} == {"a": 20.0, "b": 60.0, "c": 60.0}
    assert [r.text for r in geometry.reading_order(row).orderBy("place").collect()] == ["a", "b", "c"]


def test_paragraphs_and_segments(spark):
    rows = [("p", i, "s", 10.0, 0.0, 15.0 * i, 50.0 + i, 15.0 * i + 10) for i in range(3)] + [("p", 9, "s", 10.0, 0.0, 200.0, 50.0, 210.0)]
    got = geometry.paragraphs(spark.createDataFrame(rows, "page string, pos long, style string, size double, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {r.pos: (r.paragraph, r["align"]) for r in got} == {0: (0, "left"), 1: (0, "left"), 2: (0, "left"), 9: (1, "left")}
    at, chars = 0.0, []
    for i, (c, gap) in enumerate([("a", 0), ("b", 1), ("c", 1), ("d", 5), ("e", 1), ("f", 40)]):
        at += gap
        chars.append(("p", 0, i, c, at, at + 8, 10.0))
        at += 8
    got = geometry.segments(spark.createDataFrame(chars, "page string, line int, i int, ch string, x0 double, x1 double, h double")).orderBy("segment").collect()
    assert [r.text for r in got] == ["abc de", "f"]


def test_rejections(spark):
    rows = spark.createDataFrame([("ok", 10.0, 100.0, False), ("2024", 30.0, 100.0, False), ("***", 5.0, 100.0, False), ("カナ", 5.0, 100.0, False), ("x", 5.0, 100.0, True)], "text string, height double, page_height double, excluded boolean")
    assert [r.reason for r in geometry.rejected(rows).collect()] == [None, "giant", "symbol", "garbled", "excluded"]
    fits = spark.createDataFrame([(10.0, 5, 30, False), (30.0, 0, 30, False), (30.0, 5, 10, False), (30.0, 5, 30, True), (30.0, 5, 30, False)], "contrast double, ink int, px int, busy boolean")
    assert [r.reason for r in geometry.fit_rejected(fits).collect()] == ["low contrast", "no ink", "too small", "busy background", None]


def test_nearest_with_fallback(spark):
    grid = spark.createDataFrame([(6.0, 4.5), (6.25, 4.7), (6.5, 4.9)], "key double, offset double")
    rows = spark.createDataFrame([(6.25,), (6.125,), (9.0,), (6.6,)], "v double")
    got = {r.v: r.offset for r in match.nearest(rows, "v", grid, 0.25, 0.13, F.col("v") * 0.752).collect()}
    assert got[6.25] == 4.7 and got[6.125] == 4.5 and got[9.0] == pytest.approx(6.768) and got[6.6] == 4.9


def test_title_drift_and_boxes(spark):
    rows = [(f"p{i}", None, None, "cards", 0.05, 0.08, 0.06) for i in range(4)] + [("low", None, None, "cards", 0.05, 0.2, 0.06), ("small", None, None, "cards", 0.05, 0.08, 0.04), ("hero", None, None, "hero", 0.5, 0.5, 0.2)]
    got = {r.page: (r.off_y, r.off_x, r.off_size) for r in stats.title_drift(spark.createDataFrame(rows, "page string, tone string, kind string, skeleton string, x0 double, y0 double, h double")).collect()}
    assert got == {"low": (True, False, False), "small": (False, False, True)}
    titles = spark.createDataFrame([("p", "品牌增长战略")], "page string, title string")
    lines = spark.createDataFrame([("p", 0, "品牌增长", 0.0, 0.0, 40.0, 10.0), ("p", 1, "战略", 0.0, 11.0, 20.0, 21.0), ("p", 2, "正文", 0.0, 50.0, 20.0, 55.0)], OCR)
    box = geometry.title_boxes(titles, lines).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (0.0, 0.0, 40.0, 10.0)


def test_statistics(spark):
    probes = spark.createDataFrame([(6.0, 4.5), (6.0, 4.9), (7.0, 5.2), (7.0, 5.3), (7.0, 5.4)], "pitch double, offset double")
    assert {r.pitch: r.offset for r in stats.two_probe_median(probes.withColumnRenamed("offset", "o"), ["pitch"], "o", F.col("pitch") * 0.752).collect()} == {6.0: 4.5, 7.0: 5.3}
    px = spark.createDataFrame([("a", 250, 250, 250)] * 5 + [("a", 255, 0, 0)] + [("b", 10, 10, 10)] * 3 + [("c", 200, 0, 50)] * 3, "logo string, r int, g int, b int")
    assert {r.logo: r.logo_class for r in stats.logo_class(px, ["logo"]).collect()} == {"a": "light", "b": "dark", "c": "colour"}
    assert px.where("logo = 'b'").select(stats.colour_bin(F.col("r"), F.col("g"), F.col("b")).alias("v")).first().v == 36
    two = px.where("logo = 'b'").withColumn("r2", F.lit(100)).withColumn("g2", F.lit(10)).withColumn("b2", F.lit(10))
    d = stats.pixel_difference(two, ["logo"]).first()
    assert (d.mean_diff, d.share_over_40) == (90.0, 1.0)


def test_components_travel_chains(spark):
    nodes = spark.range(40).select(F.col("id"))
    edges = spark.range(1, 30).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 30 else i for i in range(40)}
    styles = spark.createDataFrame([("p", 1, 20.0, 0, 0, 0), ("p", 2, 21.0, 10, 10, 10), ("p", 3, 30.0, 0, 0, 0), ("q", 4, 20.0, 0, 0, 0), ("p", 5, 20.0, 200, 0, 0)], "page string, id long, px double, r int, g int, b int")
    assert [(r.a, r.b) for r in graph.similar_style_edges(styles).collect()] == [(1, 2)]


def docx(styles, *paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        top = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/styles.xml", f"<w:styles {top}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {top}><w:body>" + "".join(f"<w:p><w:pPr>{p}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>" for p, t in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 一 #\ntext\n## 二\n#no\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("# not a heading", encoding="utf-8")
    (tmp_path / "c.docx").write_bytes(docx('<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="O"><w:name w:val="own"/><w:outlineLvl w:val="2"/></w:style>', ('<w:pStyle w:val="H1"/><w:outlineLvl w:val="5"/>', "标题"), ('<w:pStyle w:val="O"/>', "小"), ('<w:outlineLvl w:val="1"/>', "中"), ("", "正文")))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    docs, heads, unread = markdown.read_sources(spark, [str(tmp_path)])
    got = sorted((r.doc[-6:].rsplit("/")[-1], r.idx, r.level, r.text) for r in heads.collect())
    assert got == [("a.md", 0, 1, "一"), ("a.md", 1, 2, "二"), ("c.docx", 0, 1, "标题"), ("c.docx", 1, 3, "小"), ("c.docx", 2, 2, "中")]
    assert docs.count() == 3 and {r.doc.rsplit("/")[-1] for r in unread.collect()} == {"d.docx", "e.pdf"}


def test_marked_and_sectioned_text(spark):
    marked = spark.createDataFrame([("f", "# 头\n⟦p01.01 标题⟧ 甲\n续行\n## p02\n游离\n⟦p02.01 正文⟧ 乙\n")], "doc string, text string")
    assert {r.id: r.text for r in markdown.marked(marked).collect()} == {"p01.01": "甲\n续行", "p02.01": "乙"}
    brand = spark.createDataFrame([("f", "## 颜色\n（填写提示）\n主色 #AABBCC，用在标题与强调处\n## 字体\n不适用\n## 语气\n短\n")], "doc string, text string")
    found_ = markdown.sections(brand)
    got = {(r.section, r.rule) for r in markdown.brand_findings(found_.drop("doc"), {"颜色": "#[0-9A-Fa-f]{6}", "字体": None, "语气": None, "图像": None}).collect()}
    assert got == {("字体", "no reason"), ("语气", "too short"), ("图像", "missing")}


def test_listing(spark, tmp_path):
    for name, size in (("brand/vi-guide.pdf", 100), ("brand/.hidden/x.png", 100), ("deep/a/b/c/x.png", 100), ("small.png", 1), ("note.doc", 100), ("brand/Logo.png", 100), ("Pack.app/x.png", 100), ("out_v1.pdf", 5), ("mine.pdf", 5), ("a/b/deck.key", 5), ("a/b/c/deck.key", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = markdown.listing(spark, str(tmp_path), least_bytes=10, own=("mine.pdf",), deliverables="out_")
    assert sorted(r.rel for r in files.collect()) == ["a/b/deck.key", "brand/vi-guide.pdf"]
    files = files.where("dir = 'brand'")
    ranked = markdown.ranked_files(files.withColumn("width", F.lit(None).cast("int")).withColumn("height", F.lit(None).cast("int")), ["品牌"], ["vi", "guide"], dt.datetime(2030, 1, 1), "/nowhere")
    assert [(r.score, r.hits) for r in ranked.collect()] == [(7, ["guide", "vi"])]
    day = dt.datetime(2026, 1, 1)
    rows = [(f"/p/{i}.png", i, day, f"{i}.png", "png", "", 500, 400 if i == 9 else 500) for i in range(10)]
    shots = spark.createDataFrame(rows, "path string, bytes long, mtime timestamp, rel string, kind string, dir string, width int, height int")
    got = markdown.ranked_files(shots, [], [], day + dt.timedelta(days=180), "/pp")
    assert sorted((r.bytes, r.score, r.others) for r in got.collect()) == [(6, 0, 0), (7, 0, 0), (8, 0, 6)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "error", "d", "p|1", None), ("r2", "warning", "d", "p2", "x")], "rule string, severity string, doc string, entity string, detail string")
    sinks.write_findings(rows, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("rule = 'r1'").count() == 1
    assert [r.line for r in sinks.markdown_rows(rows, ["entity", "detail"], ["entity"]).collect()] == ["| p2 | x |", "| p\\|1 |  |"]
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_streamed_latest_is_the_batchs(spark, tmp_path):
    from docaudit.streaming import latest as streaming

    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i % 50), i % 5, "error" if i % 7 == 0 else "ok") for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, kind string")
    events.repartition(4).write.parquet(str(tmp_path / "log"))
    stream = streaming.latest(streaming.read_log(spark, str(tmp_path / "log"), events.schema), ["user_id"], ["ts", "event_id"], F.col("kind") == "ok")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.user_id: r.event_id for r in spark.table("latest_rows").collect()}
    assert got == {r.user_id: r.event_id for r in state.latest(events, ["user_id"], ["ts", "event_id"], F.col("kind") == "ok").collect()}


def test_projects_have_defaults(spark, tmp_path):
    (tmp_path / "project.json").write_text(json.dumps({"name": "n", "source": "a.md", "deck_mode": "odd"}))
    row = outline.read_projects(spark, str(tmp_path / "project.json")).first()
    assert (row.margin, row.parallel, row.upscale, row.suffix, row.deck_mode) == (0.8, 4, 2, "", "read") and row.source[0].endswith(f"{tmp_path.name}/a.md")


def test_prompts(spark, tmp_path):
    doc = {"pages": [page(title="A", tone="dark", visual=brief("hero"), blocks=[{"type": "bullets", "items": ["x", "y"]}]), page("section", title="B", visual=brief("cards")), page(title="C", visual=brief("split", motif="m"))]}
    pages = outline.pages_of(outlines(spark, tmp_path, doc))
    got = {r.page: r for r in prompts.prompts(pages, F.lit("style"), {"section": "dark"}).collect()}
    assert got["p01"].tone == "dark" and got["p02"].tone == "dark" and got["p03"].tone == "light"
    assert 'Text, verbatim: "A"\n[list]\n"x"\n"y"' in got["p01"].prompt and "Unlike its neighbours: hero, split" in got["p02"].prompt and "Motif: m" in got["p03"].prompt and "Motif" not in got["p01"].prompt


def test_plans_at_the_edge(spark):
    bans = spark.createDataFrame([("glow", "no glow"), ("3d", "no 3d")], "key string, text string")
    assert sorted(r.text for r in prompts.avoided(bans, bans.where("key = '3d'"), spark.createDataFrame([("own",)], "text string")).collect()) == ["no glow", "own"]
    pages = spark.createDataFrame([("p1", ""), ("p2", "02")], "page string, label string")
    logos = spark.createDataFrame([("br", 0.05), ("br", 0.2), ("tl", 0.1)], "corner string, width double")
    assert {(r.page, r.corner): r.width for r in prompts.numbered_corners(pages, logos, "bl").collect()} == {("p1", "br"): 0.2, ("p1", "tl"): 0.1, ("p2", "br"): 0.2, ("p2", "tl"): 0.1, ("p2", "bl"): 0.12}
    index = spark.createDataFrame([("d1", "p1"), ("d1", "p2"), ("d2", "p3")], "direction string, page string")
    checks = spark.createDataFrame([("p1", "OK"), ("p2", "MISS"), ("p3", "OK")], "page string, status string")
    assert {r.direction: (r.n, r.n_bad, r.worst) for r in prompts.sample_status(index, checks).collect()} == {"d1": (2, 1, "MISS"), "d2": (1, 0, "OK")}
    files = spark.createDataFrame([("a1", "x.png", 5, "attempt"), ("a2", "y.png", 5, "attempt"), ("o1", "z.pdf", 9, "output"), ("w1", "t", 1, "work")], "path string, name string, bytes long, stage string")
    gone = prompts.retention(files, files.where("path = 'a1'"), spark.createDataFrame([("z.pdf", 9)], "name string, bytes long"))
    assert {r.path: r.reason for r in gone.collect()} == {"a2": "not taken", "o1": "delivered"}
    diff = prompts.draft_differences(spark.createDataFrame([(1, 10, 0.9), (2, 11, 1.0)], "line_id long, entry_id long, score double"), spark.createDataFrame([(1, "品脾"), (2, "一 样")], "line_id long, line string"), spark.createDataFrame([(10, "品牌"), (11, "一样")], "entry_id long, entry string"))
    assert [(r.line_id, [tuple(c) for c in r.changes]) for r in diff.collect()] == [(1, [("脾", "")])]


def test_block_products_are_all_pairs(spark, monkeypatch):
    import numpy as np

    from docaudit.operators import contain, medians, render, stats

    monkeypatch.setattr(stats, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 6))
    v[7], v[9] = v[3], v[3]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs = sorted(((float(v[a] @ v[b]), a, b) for a in range(40) for b in range(a + 1, 40)), reverse=True)
    got = stats.top_pairs(rows, "id", "v", 9).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in pairs[:9]]
    close = {(r.a, r.b) for r in stats.close_pairs(rows, "id", "v", 2.0).collect()}
    assert close == {(a, b) for s, a, b in pairs if s >= 2.0} and close
    r = stats.similarity_report(rows, "id", "v", 2.0).first()
    assert r.n_pairs == len(pairs) and r.n_close == len(close) and abs(r.mean - np.mean([s for s, *_ in pairs])) < 1e-9


def noisy(rng, s):
    """A string as a page may render it."""
    kind = rng.randrange(6)
    at = rng.randrange(len(s) + 1)
    return [s, s[:at] + s[at + 1 :], s[:at] + rng.choice("xy语") + s[at:], s[:at], s[::-1], s + rng.choice(["", "尾", " more"])][kind]


def test_best_renderings_are_those_of_aligning_all(spark):
    """A page of a thousand lines, and small ones: bounds skip most alignments and change no ratio and no box."""
    import difflib
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij语言文字") for _ in range(rng.randint(0, 14)))
    strings = [("big", f"s{i}", word()) for i in range(60)] + [(f"p{i % 7}", f"s{i}", word()) for i in range(60)] + [("bare", "s", "abc"), ("bare", "empty", "")]
    lines, at = [], 0
    for i in range(1060):
        page, s = ("big", strings[i % 60][2]) if i < 1000 else (f"p{i % 7}", strings[60 + i % 60][2])
        at += rng.choice([0, 0, 7])
        lines.append((page, i, noisy(rng, s), float(rng.randint(0, 50)), float(at), float(rng.randint(51, 90)), float(at + 10)))
    want = spark.createDataFrame(strings, "page string, sid string, text string")
    rows = spark.createDataFrame(lines, "page string, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    norm = {r.t: r.n for r in spark.createDataFrame([(t,) for t in {x[2] for x in strings + lines}], "t string").select("t", forms.normalise(F.col("t")).alias("n")).collect()}
    matched = lambda a, b: sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    ratios, places = {}, {}
    for page, sid, s in strings:
        t, own = norm[s], [x for x in lines if x[0] == page]
        groups = [[x] for x in own] + [[a, b] for a, b in zip(own, own[1:], strict=False)]
        whole = ["".join(norm[x[2]] for x in g) for g in groups]
        ratios[page, sid] = 1.0 if not t or any(t in c for c in whole) else max((matched(t, c) / len(t) for c in whole), default=0.0)
        best = None
        for g, c in zip(groups, whole, strict=True):
            if len(t) < 2 or not c or (len(g) == 2 and not abs(g[0][4] - g[1][4]) < g[0][6] - g[0][4]):
                continue
            box = (min(x[3] for x in g), min(x[4] for x in g), max(x[5] for x in g), max(x[6] for x in g))
            key = (matched(t, c) / len(t) * min(1.0, len(t) / len(c) + 0.3), -box[1], -box[0])
            best = max(best or (key, box), (key, box))
        if best and best[0][0] >= 0.45:
            places[page, sid] = (best[0][0], best[0][1:])
    got = render.best_renderings(want, rows).collect()
    assert {(r.page, r.sid): r.ratio for r in got} == ratios
    assert sum(r.aligned for r in got) < 0.1 * sum(r.pairs for r in got) and max(r.pairs for r in got) > 500
    assert {(r.page, r.sid): (r.score, (-r.y0, -r.x0)) for r in render.locate(want, rows).collect()} == places


def test_contained_is_every_text_and_item(spark):
    """Short, long, blank, spaced and hot items, a character of them in a pass."""
    import random

    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["a", "ab", "b", "cab", "the", ""]) for _ in range(n))
    docs = [(i, some(rng.randint(0, 30))) for i in range(120)] + [(500, None), (501, "")]
    items = [(i, some(rng.randint(1, 6))) for i in range(150)] + [(900, ""), (901, None), (902, "zz"), (903, " "), (904, "a b")]
    got = contain.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"), chars=40)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == {(i, d) for i, p in items for d, t in docs if p and t is not None and p in t}
    assert got.count() == got.distinct().count()


def test_sources_agree_both_ways(spark):
    values = [("d", v) for v in ("市场分析", "一、市场分析（续）", "补充：附件", "正文里的一句", "report", "无", "别处", "report-v2 附录", "")]
    frames = [(values, "doc string, value string"), ([("d", "一、市场分析"), ("e", "别处")], "doc string, text string"), ([("d", "有正文里的一句话"), ("d", None)], "doc string, text string"), ([("d", "report-v2"), ("d", "r")], "doc string, name string")]
    got = {r.value: r.found for r in match.sources_found(*(spark.createDataFrame(*f) for f in frames)).collect()}
    assert got == {"市场分析": True, "一、市场分析（续）": True, "补充：附件": True, "正文里的一句": True, "report": True, "无": False, "别处": False, "report-v2 附录": True, "": False}


def test_rooms_and_clipping(spark):
    """Rooms as by comparing all boxes; clipping as by walking all lines in order."""
    import random

    rng = random.Random(6)
    rows = []
    for page in range(6):
        for pos in range(40):
            x, y = rng.randint(0, 80), rng.randint(0, 200 if page else 20)
            rows.append((page, pos, float(x), float(y), float(x + rng.randint(1, 30)), float(y + rng.randint(1, 12))))
    df = spark.createDataFrame(rows, "page long, pos long, x0 double, y0 double, x1 double, y1 double")
    for r in geometry.rooms(df, 120.0, 220.0).collect():
        own = [o for o in rows if o[0] == r.page]
        level, upright = [o for o in own if o[3] < r.y1 and o[5] > r.y0], [o for o in own if o[2] < r.x1 and o[4] > r.x0]
        assert r.right == min([o[2] for o in level if o[2] >= r.x1], default=120.0) - r.x1 and r.left == r.x0 - max([o[4] for o in level if o[4] <= r.x0], default=0.0)
        assert r.below == min([o[3] for o in upright if o[3] >= r.y1], default=220.0) - r.y1 and r.above == r.y0 - max([o[5] for o in upright if o[5] <= r.y0], default=0.0)
    want = {}
    for page in range(6):
        boxes = {o[1]: list(o[2:]) for o in rows if o[0] == page}
        notes = {}
        for i, box in boxes.items():
            x0, y0, x1, y1 = box
            top = foot = False
            pads = [None, None]
            for j, (a, b, c, d) in boxes.items():
                if j != i and min(x1, c) - max(x0, a) >= 0.3 * min(x1 - x0, c - a):
                    if y0 < b < y1 < d:
                        y1, foot = (b + y1) / 2, True
                    elif b < y0 < d < y1:
                        y0, top = (y0 + d) / 2, True
            for j, (a, b, c, d) in boxes.items():
                h = y1 - y0
                if j != i and min(y1, d) - max(y0, b) >= 0.5 * min(h, d - b):
                    if x0 < a < x1 + 0.6 * h and c > x1:
                        x1 = (a + x1) / 2 if a < x1 else x1
                        pads[1] = min(0.6 if pads[1] is None else pads[1], max(0.02, (max(a, x1) - x1) / 2 / max(1, h)))
                    elif x0 - 0.6 * h < c < x1 and a < x0:
                        x0 = (c + x0) / 2 if c > x0 else x0
                        pads[0] = min(0.6 if pads[0] is None else pads[0], max(0.02, (x0 - min(c, x0)) / 2 / max(1, h)))
            boxes[i] = [x0, y0, x1, y1]
            notes[i] = (top, foot, *pads)
        for i, (x0, y0, x1, y1) in boxes.items():
            h = y1 - y0
            right = [o[0] for j, o in boxes.items() if j != i and o[0] >= x1 - 0.2 * h and min(y1, o[3]) - max(y0, o[1]) > 0.3 * min(h, o[3] - o[1])]
            want[page, i] = (x0, y0, x1, y1, *notes[i], max(0.0, min([*right, 0.96 * 120]) - 0.6 * h - x1) if h >= 0.02 * 220 else 0.0)
    none = lambda v: None if v is None or v != v else v
    got = {(r.page, r.pos): (r.cx0, r.cy0, r.cx1, r.cy1, r.cut_top, r.cut_bottom, none(r.pad_left), none(r.pad_right), r.free) for r in geometry.clipped(df, 120.0, 220.0, 0.02).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w), k


def test_exact_medians_of_huge_groups(spark):
    """Groups larger than a task may hold: bins of two, ties, wide ranges, nulls and NaN, keys of null."""
    import random
    import statistics

    rng = random.Random(1)
    groups = {
        "even": [rng.uniform(-1e300, 1e300) for _ in range(400)], "odd": [rng.choice([1.0, 2.0, 3.0]) for _ in range(301)], "same": [7.0] * 200, "steps": [2.0**i for i in range(-100, 101)],
        "two": [1.0] * 100 + [2.0] * 100, None: [float(i) for i in range(150)], "small": [3.0, 1.0], "none": [],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("odd", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for held, bins in ((50, 2), (50, 1024), (1 << 16, 1024)):
        got = {r.k: (r.m, r.d) for r in medians.group_medians(df, ["k"], {"m": F.col("v"), "d": F.abs(F.col("v"))}, held, bins).collect()}
        for k, vs in groups.items():
            assert got[k] == ((pytest.approx(statistics.median(vs)), pytest.approx(statistics.median(map(abs, vs)))) if vs else (None, None)), k


def test_folders_that_are_left_out_are_never_listed(tmp_path, monkeypatch):
    for name in ("a/x.png", "a/.git/y.png", "a/b/z.png", "a/b/c/deep.png", "node_modules/m/x.png", "Pack.app/in/x.png", ".hid/x.png", "top.md", "many/1.md", "many/2.md", "many/3.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    listed, real = [], files.children
    monkeypatch.setattr(files, "children", lambda store, folder: listed.append(folder[len(str(tmp_path)) :].strip("/")) or real(store, folder))
    reader = files.FolderReader({"path": str(tmp_path), "depth": "3", "skip": "node_modules"})
    got = [r[3] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(got) == ["a/b/z.png", "a/x.png", "many/1.md", "many/2.md", "many/3.md", "top.md"] and sorted(set(listed)) == ["", "a", "a/b", "many"]
    few = files.FolderReader({"path": str(tmp_path), "visits": "2"})
    assert sorted(r[3] for p in few.partitions() for r in few.read(p) if p.rel == "many") == ["many/1.md", "many/2.md"]
    assert [p.rel for p in files.FolderReader({"path": str(tmp_path), "depth": "1"}).partitions()] == [""]


def test_file_source_over_spark(spark, tmp_path):
    (tmp_path / "d" / ".h").mkdir(parents=True)
    (tmp_path / "d" / "A.PNG").write_bytes(b"12345")
    (tmp_path / "d" / ".h" / "x.png").write_bytes(b"1")
    spark.dataSource.register(files.FolderFiles)
    got = spark.read.format("folder_files").load(str(tmp_path)).collect()
    assert [(r.path, r.bytes, r.rel, r.kind, r.dir) for r in got] == [(str(tmp_path / "d" / "A.PNG"), 5, "d/A.PNG", "png", "d")] and got[0].mtime is not None


def test_import_is_one_step(spark, tmp_path, monkeypatch):
    """Stopped between any two steps it leaves the old state; run again it comes through, once."""
    slots = spark.createDataFrame([("p1.0", "title", "标题。"), ("p1.1", "text", "有 3 个目标"), ("p1.2", "notes", "备注")], "id string, role string, text string")
    edited = spark.createDataFrame([("p1.0", "新标题。"), ("p1.1", "有 3 项目标"), ("p1.2", "备注")], "id string, text string")
    s = staging.Staged(spark, str(tmp_path / "deck"))
    assert s.manifest()["version"] == 0 and s.done().count() == 0
    s.start(slots)
    s.start(slots)
    assert s.manifest()["version"] == 1 and s.pending().count() == 3
    state_of = lambda: (s.manifest()["version"], sorted(r.text for r in s.slots().collect()), sorted(r.text for r in s.done().collect()), s.log().count())
    old = state_of()
    write, commit = staging.Staged._write, staging.Staged._commit
    for broken in ("slots", "done", "log", "commit"):
        def fails(self, step, name, rows, broken=broken):
            if name == broken:
                raise OSError("lost")
            return write(self, step, name, rows)

        def lost(self, was, now, broken=broken):
            if broken == "commit":
                raise OSError("lost")
            return commit(self, was, now)

        monkeypatch.setattr(staging.Staged, "_write", fails)
        monkeypatch.setattr(staging.Staged, "_commit", lost)
        with pytest.raises(OSError):
            s.take(slots, edited)
        assert state_of() == old
    monkeypatch.undo()
    assert s.take(slots, edited.withColumn("text", F.replace("text", F.lit("3"), F.lit("4")))).where("severity = 'error'").count() == 1 and state_of() == old
    assert s.take(slots, edited).count() == 0
    new = state_of()
    assert new == (2, ["备注", "新标题。", "有 3 项目标"], sorted(["备注", "新标题", "有 3 项目标"]), 2)
    assert s.take(slots, edited).count() == 0 and state_of() == new  # the same step again
    other = staging.Staged(spark, str(tmp_path / "deck"))
    was = other.manifest()
    with pytest.raises(staging.Overtaken):
        other._commit(was | {"version": 1}, was)
    assert s.accept() == 0 and state_of() == new
    more = spark.createDataFrame([("p1.0", "又一个标题"), ("p1.1", "有 3 项目标"), ("p1.2", "备注")], "id string, text string")
    assert s.take(s.slots(), more).count() == 0 and s.done().count() == 4
    fresh = staging.Staged(spark, str(tmp_path / "other"))
    fresh.start(slots)
    assert fresh.accept("as it is") == 3 and fresh.pending().count() == 0 and {r.note for r in fresh.log().collect()} == {"as it is"} and fresh.accept() == 0


def test_close_earlier_texts(spark):
    import difflib
    import random

    rng = random.Random(3)
    rows = [(f"d{i % 3}", i, f"p{i}", "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(400)]
    want = {}
    for page, pos, sid, t in rows:
        near = [o for o in rows if o[0] == page and o[1] < pos and t and o[3] and difflib.SequenceMatcher(None, t, o[3], autojunk=False).ratio() >= 0.8]
        if near:
            want[page, sid] = near[0][2]
    got = {(r.page, r.sid): r.other for r in render.close_earlier(spark.createDataFrame(rows, "page string, pos int, sid string, text string"), 0.8).collect()}
    assert got == want


def test_top_pairs_are_bounded_under_ties(spark, monkeypatch):
    made = []
    real = stats._pairs_table
    monkeypatch.setattr(stats, "block_products", lambda rows, key, vector, schema, reduce: made.append(reduce) or rows.select(F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(1.0).alias("similarity")))
    stats.top_pairs(spark.createDataFrame([(1, [1.0])], "k long, v array<double>"), "k", "v", 8)
    import numpy as np

    i, j = np.triu_indices(1500, 1)
    out = made[0](i, j, np.ones(len(i)))
    assert real is stats._pairs_table and out.num_rows == 8 and sorted(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True), reverse=True)[0] == (1498, 1499)


@pytest.mark.parametrize("sent", [0, 1 << 22])
def test_shared_grams_are_all_pairs_counted(spark, sent):
    """Hot grams, repeated lines, short and empty ones, characters beyond the first plane; sent to tasks or joined."""
    import random

    rng = random.Random(12)
    word = lambda n, k: "".join(rng.choice("aab语😀cd"[:k]) for _ in range(n))
    lines = [(i, word(rng.randint(0, 40), rng.randint(1, 7))) for i in range(300)] + [(900, None), (901, "aaaaaa"), (902, "aaaaaa")]
    entries = [(i, word(rng.randint(0, 60), rng.randint(1, 7))) for i in range(80)] + [(900, None), (901, "aaaaaaaa")]
    for n, share in ((2, 0.45), (3, 0.8), (5, 0.45)):
        of = lambda t, n=n: {t[i : i + n] for i in range(len(t) - n + 1)}
        want = {}
        for i, a in lines:
            for j, b in entries:
                k = len(of(a or "") & of(b or ""))
                if k >= max(1, int(share * (len(a or "") - n + 1))):
                    want[i, j] = k
        got = grams.sharing(spark.createDataFrame(lines, "line_id long, line string"), spark.createDataFrame(entries, "entry_id long, entry string"), n, share, sent).collect()
        assert {(r.line_id, r.entry_id): r.n_shared for r in got} == want and len(got) == len(want)


def test_text_check_finds_each_kind(spark):
    strings = [("ok", 0, "标题文字"), ("miss", 0, "这一句不在页面上"), ("near", 0, "这一句差一个字呢"), ("corner", 0, "右下"), ("extra", 0, "正文"), ("stop", 0, "结论清楚"), ("drift", 0, "标题"), ("bare", 0, "x")]
    lines = [
        ("ok", 0, "标题文字", 0.0, 0.0, 9.0, 9.0), ("near", 0, "这一句差一个字", 0.0, 0.0, 9.0, 9.0), ("corner", 0, "右下", 90.0, 90.0, 99.0, 99.0), ("corner", 1, "角里的字", 91.0, 91.0, 98.0, 98.0), ("extra", 0, "正文", 0.0, 0.0, 9.0, 9.0), ("extra", 1, "内容端", 0.0, 20.0, 9.0, 29.0),
        ("stop", 0, "结论清楚。", 0.0, 0.0, 9.0, 9.0), ("drift", 0, "标题", 0.0, 0.0, 9.0, 9.0),
    ]
    titles = [(f"t{i}", "light", "content", "cards", 0.1, 0.1, 0.05) for i in range(4)] + [("drift", "light", "content", "cards", 0.1, 0.3, 0.05)]
    args = (spark.createDataFrame(strings, "page string, sid long, text string"), spark.createDataFrame(lines, OCR.replace("pos int", "pos long")), spark.createDataFrame([(p, "br", 88.0, 88.0, 100.0, 100.0) for p in ("corner", "ok")], "page string, corner string, x0 double, y0 double, x1 double, y1 double"))
    got = rules.text_check(*args, spark.createDataFrame(titles, "page string, tone string, kind string, skeleton string, x0 double, y0 double, h double"))
    assert {(r.rule, r.doc, r.severity) for r in got.collect()} == {("text.missing", "miss", "error"), ("text.near", "near", "warning"), ("text.corner", "corner", "error"), ("text.extra", "extra", "warning"), ("text.stop", "stop", "warning"), ("text.drift", "drift", "warning")}
    assert {r.page: r.status for r in rules.text_statuses(args[0], got).collect()} == {"ok": "OK", "miss": "MISS", "near": "NEAR", "corner": "CORNER", "extra": "EXTRA", "stop": "PUNCT", "drift": "DRIFT", "bare": "OK"}


def test_values_and_headings_agree(spark):
    values = [("d", "市场 分析"), ("d", "一、市场分析（续）"), ("d", "x"), ("d", "无"), ("e", "市场分析"), ("d", None)]
    headings = [("d", 0, "市场分析"), ("d", 1, "一、市场分析（续）二"), ("d", 2, "x"), ("d", 3, "市场分析"), ("f", 0, "市场分析")]
    got = {(r.doc, r.value, r.idx) for r in match.agreeing(spark.createDataFrame(values, "doc string, value string"), spark.createDataFrame(headings, "doc string, idx int, heading string")).collect()}
    assert got == {("d", "市场 分析", 0), ("d", "市场 分析", 1), ("d", "市场 分析", 3), ("d", "一、市场分析（续）", 0), ("d", "一、市场分析（续）", 1), ("d", "一、市场分析（续）", 3)}
