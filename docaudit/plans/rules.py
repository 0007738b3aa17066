"""The rule layer: every rule is a DataFrame of findings (rule, severity, doc, entity, detail); rule sets are unions.

Inputs are tables, so that one run audits any number of documents:
pages as sources.outline gives them; settings: doc, thesis, mode, max_pages, section_pages, duration_min, has_source;
headings: doc, idx, level, text; body: doc, text; names: doc, name; dropped: doc, source, reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text
from docaudit.operators import geometry, graph, match, order, render, stats
from docaudit.plans import dims
from docaudit.sources import outline

ERROR, WARNING = "error", "warning"


def finding(rows: DataFrame, rule: str, severity: str, entity: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("doc"), (none if entity is None else entity.cast("string")).alias("entity"), (none if detail is None else detail.cast("string")).alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gate(findings: DataFrame) -> bool:
    """Whether a stage may go on: no error stands."""
    return findings.where(F.col("severity") == ERROR).isEmpty()


def _numbered(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page", F.col("id"))


def storyline(pages: DataFrame, settings: DataFrame, headings: DataFrame, body: DataFrame, names: DataFrame, dropped: DataFrame) -> DataFrame:
    """Chapters, structure pages, titles, coverage, numbers and sources of each document. All tables grow with the documents, and what
    is made of a narrow table is far larger than its file, by which Spark plans: they meet by shuffle, never through the driver."""
    pages, settings, headings, body, names, dropped = (t.hint("merge") for t in (pages, settings, headings, body, names, dropped))
    p = _numbered(pages)
    page, title = F.col("page"), F.coalesce("title", F.lit(""))
    content = p.where("kind = 'content'")
    slots = outline.slots(pages)
    out = [finding(settings.where(text.blank_to_null(F.col("thesis")).isNull()), "storyline.thesis", ERROR)]
    out.append(finding(p.where(F.col("kind").isin("content", "appendix") & text.blank_to_null(F.col("chapter")).isNull()), "storyline.chapter_missing", ERROR, page))
    chaptered = content.where(text.blank_to_null(F.col("chapter")).isNotNull())
    split = order.split_values(chaptered, ["doc"], ["pos"], "chapter")
    out.append(finding(split, "storyline.chapter_split", ERROR, F.col("chapter"), F.col("runs")))
    chapters = graph.first_seen(chaptered, ["doc"], "chapter", ["pos"])
    sizes = content.groupBy("doc").agg(F.count(F.lit(1)).alias("n_content")).join(chapters.groupBy("doc").agg(F.count(F.lit(1)).alias("n_chapters")), "doc", "left").na.fill(0)
    out.append(finding(sizes.where("n_content >= 6 AND NOT n_chapters BETWEEN 3 AND 7"), "storyline.chapter_count", WARNING, None, F.col("n_chapters")))

    tail = order.misplaced_tail(p, ["doc"], ["pos"], F.col("kind") == "appendix", F.col("kind") == "closing")
    out.append(finding(tail.where("end_after_tail"), "storyline.appendix_before_closing", ERROR))
    out.append(finding(tail.where("broken"), "storyline.appendix_not_last", ERROR))
    labels = order.labels(p, ["doc"], ["pos"], F.col("kind"), False, False).where("kind = 'appendix'").select("doc", text.normalise(F.col("label")).alias("ref")).distinct()
    refs = slots.select("doc", "page", F.explode(F.regexp_extract_all("text", F.lit(text.APPENDIX_REF), F.lit(1))).alias("found")).withColumn("ref", text.normalise(F.col("found")))
    out.append(finding(refs.join(labels, ["doc", "ref"], "left_anti"), "storyline.appendix_reference", ERROR, page, F.col("found")))

    about = F.rlike(title, F.lit(text.META))
    out.append(finding(p.where((F.col("kind") == "closing") & F.rlike(title, F.lit(text.THANKS))), "storyline.closing_thanks", ERROR, page, title))
    out.append(finding(p.where(about), "storyline.title_about_deck", ERROR, page, title))
    out.append(finding(content.where(~about & F.rlike(title, F.lit(text.TOPIC_END))), "storyline.title_topic", WARNING, page, title))
    meta = slots.where((F.col("role") != "title") & F.rlike("text", F.lit(text.META))).groupBy("doc", "page").agg(F.min_by(F.concat_ws(": ", "role", F.substring("text", 1, 24)), "ord").alias("first"))
    out.append(finding(meta, "storyline.body_about_deck", WARNING, page, F.col("first")))
    normal = headings.select("doc", text.normalise(F.col("text")).alias("t")).distinct()
    out.append(finding(content.withColumn("t", text.normalise(title)).join(normal, ["doc", "t"], "left_semi"), "storyline.title_is_heading", WARNING, page, title))

    ordered = chapters.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "chapter"))), lambda s: s.chapter).alias("chapters"))
    listed = slots.join(p.where("kind = 'agenda'").select("doc", "page"), ["doc", "page"], "left_semi").groupBy("doc", "page").agg(text.normalise(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text), "")).alias("all"))
    agenda = p.where("kind = 'agenda'").select("doc", "page").join(listed, ["doc", "page"], "left").join(ordered, "doc").withColumn("lack", F.filter("chapters", lambda c: ~F.contains(F.coalesce("all", F.lit("")), text.normalise(c))))
    out.append(finding(agenda.where(F.size("lack") > 0), "storyline.agenda", ERROR, page, F.array_join("lack", ", ")))
    summary = p.where((F.col("kind") == "summary") & (F.size("covers") > 0)).join(ordered, "doc", "left").withColumn("chapters", F.coalesce("chapters", F.array().cast("array<string>")))
    in_order = F.col("covers") == F.filter("chapters", lambda c: F.array_contains("covers", c))
    lack = F.array_except("chapters", "covers")
    out.append(finding(summary.where(~in_order), "storyline.covers_order", ERROR, page))
    out.append(finding(summary.where(in_order & (F.size(lack) > 0)), "storyline.covers_incomplete", ERROR, page, F.array_join(lack, ", ")))
    following = order.next_where(p, ["doc"], ["pos"], F.struct("chapter"), F.col("kind") == "content")
    section = p.withColumn("next", following).where("kind = 'section' AND title IS NOT NULL AND next.chapter IS NOT NULL AND next.chapter <> ''")
    out.append(finding(section.where(text.normalise(F.col("title")) != text.normalise(F.col("next.chapter"))), "storyline.section_title", WARNING, page, F.col("next.chapter")))

    counts = p.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("kind") == "summary").alias("n_summary"), F.count_if(F.col("kind") == "content").alias("n_content")).join(settings, "doc")
    out.append(finding(counts.where("mode = 'read' AND n_pages >= 8 AND n_summary = 0"), "storyline.no_summary", WARNING))
    low, high = F.floor(F.col("duration_min") / 2), F.bround(F.col("duration_min") / 1.5)
    out.append(finding(counts.where((F.col("mode") == "present") & (F.col("duration_min") > 0) & ~F.col("n_content").between(low, F.greatest(low, high))), "storyline.duration", WARNING, None, F.col("n_content")))

    items = p.select("doc", "page", "pos", "kind", F.explode(F.filter("blocks", lambda b: b.type == "kpis")).alias("b")).select("doc", "page", "pos", "kind", F.explode("b.items").alias("i")).where("i.label <> '' AND i.value <> ''")
    kpi = items.groupBy("doc", text.normalise(F.col("i.label")).alias("k")).agg(F.count_distinct(text.normalise(F.col("i.value"))).alias("n_values"), F.count_if(~F.col("kind").isin("summary", "cover")).alias("n_outside"), F.min_by("i.label", "pos").alias("label"))
    out.append(finding(kpi.where("n_values > 1"), "storyline.kpi_conflict", ERROR, F.col("label"), F.col("n_values")))
    out.append(finding(kpi.where("n_values = 1 AND n_outside > 1"), "storyline.kpi_repeated", WARNING, F.col("label"), F.col("n_outside")))
    out.append(_sources(p, settings, headings, body, names, dropped))
    return union(out)


def _sources(p: DataFrame, settings: DataFrame, headings: DataFrame, body: DataFrame, names: DataFrame, dropped: DataFrame) -> DataFrame:
    page = F.col("page")
    known = settings.where("has_source").select("doc")
    with_source = p.join(known, "doc", "left_semi")
    out = [finding(with_source.where(F.col("kind").isin("content", "appendix") & (F.size("source") == 0)), "storyline.source_missing", ERROR, page)]
    values = graph.settled(p.select("doc", "page", F.explode("source").alias("value")))
    found = graph.settled(match.sources_found(graph.settled(values.join(known, "doc", "left_semi").select("doc", "value").distinct()), headings, body, names))
    out.append(finding(values.join(found.where("NOT found").select("doc", "value"), ["doc", "value"], "left_semi"), "storyline.source_unknown", ERROR, page, F.col("value")))

    w = Window.partitionBy("doc").orderBy("pos")
    cap = dims.capacity(p.sparkSession).select("skeleton", "mode", "body_cap")
    loaded = p.join(outline.load(p.drop("page")), ["doc", "page"]).join(settings.select("doc", "mode"), "doc")
    loaded = loaded.withColumn("skeleton", F.when(F.col("visual.skeleton").isin(*dims.SKELETONS), F.col("visual.skeleton")).otherwise("diagram")).join(F.broadcast(cap), ["skeleton", "mode"])
    pair = loaded.withColumn("after", F.lead(F.struct("page", "source", "kind", "body", F.size("blocks").alias("n"))).over(w))
    both = pair.where((F.size("source") > 0) & (F.col("source") == F.col("after.source")) & (F.col("kind") == "content") & (F.col("after.kind") == "content") & (F.size("blocks") > 0) & (F.col("after.n") > 0) & (F.col("body") + F.col("after.body") <= F.col("body_cap")))
    out.append(finding(both, "storyline.merge", WARNING, page, F.col("after.page")))
    out.append(finding(dropped.where(text.blank_to_null(F.col("reason")).isNull()), "storyline.dropped_reason", ERROR, F.col("source")))

    full = graph.settled(graph.heading_tree(headings.join(known, "doc", "left_semi").hint("merge"), 3))
    h = full.select("doc", "idx", F.col("text").alias("heading"))
    uses = graph.settled(values.join(match.agreeing(values.select("doc", "value"), h), ["doc", "value"]).select("doc", "idx", "page").distinct())
    let_go = graph.settled(match.agreeing(dropped.select("doc", F.col("source").alias("value")), h).select("doc", "idx").distinct())
    # Covered from above by any used heading, from below by those of the two upper levels.
    upper = full.where("level <= 2")
    above = graph.settled(graph.covered_headings(full, uses.join(full.select("doc", "idx", "level"), ["doc", "idx"]).where("level <= 2").select("doc", "idx")))
    open_ = upper.join(above, ["doc", "idx"]).where("NOT covered").join(let_go, ["doc", "idx"], "left_anti").join(uses.select("doc", "idx"), ["doc", "idx"], "left_anti")
    out.append(finding(open_, "storyline.heading_uncovered", ERROR, F.col("text")))
    parents = full.where("parent IS NOT NULL").select("doc", F.col("parent").alias("idx")).distinct()
    spread = full.join(parents, ["doc", "idx"], "left_anti").join(uses.groupBy("doc", "idx").agg(F.count_distinct("page").alias("n_pages")).hint("merge"), ["doc", "idx"]).where("n_pages >= 4")
    out.append(finding(spread, "storyline.heading_spread", WARNING, F.col("text"), F.col("n_pages")))
    out.append(finding(settings.where("NOT has_source AND unread"), "storyline.source_unread", WARNING))
    return union(out)


def visual(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """Briefs, neighbours, quotas and repeated pictures of each document."""
    p = _numbered(pages)
    page, v = F.col("page"), lambda c: F.nullif(F.col(f"visual.{c}"), F.lit(""))
    counts = p.where("kind <> 'appendix'").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).join(settings, "doc")
    out = [finding(counts.where("max_pages > 0 AND n > max_pages"), "visual.max_pages", ERROR, None, F.col("n"))]
    out.append(finding(p.where("kind = 'section'").join(settings.where("section_pages = false").select("doc"), "doc", "left_semi"), "visual.section_pages", ERROR, page))
    out.append(finding(p.where("visual IS NULL"), "visual.brief_missing", ERROR, page))
    lacking = F.array_compact(F.array(*(F.when(text.blank_to_null(F.col(f"visual.{c}")).isNull(), F.lit(c)) for c in dims.BRIEF_FIELDS)))
    out.append(finding(p.where(F.col("visual").isNotNull() & (F.size(lacking) > 0)), "visual.field_missing", ERROR, page, F.array_join(lacking, ", ")))
    for c, allowed in (("structure", dims.STRUCTURES), ("skeleton", dims.SKELETONS)):
        out.append(finding(p.where(v(c).isNotNull() & ~v(c).isin(*allowed)), f"visual.{c}_unknown", ERROR, page, v(c)))
    w = Window.partitionBy("doc").orderBy("pos")
    rows = p.select("doc", "pos", "page", "kind", v("skeleton").alias("skeleton"), v("structure").alias("structure"), v("form").alias("form"), v("motif").alias("motif"))
    near = rows.withColumn("b", F.lag(F.struct("skeleton", "structure")).over(w)).withColumn("same", F.coalesce(F.col("skeleton") == F.col("b.skeleton"), F.lit(False)))
    out.append(finding(near.where("same"), "visual.neighbour_skeleton", ERROR, page, F.col("skeleton")))
    out.append(finding(near.where("NOT same AND structure = b.structure"), "visual.neighbour_structure", WARNING, page, F.col("structure")))
    content = rows.where(F.col("kind").isin(*dims.CONTENT_KINDS))
    out.append(finding(order.over_quota(content, ["doc"], "skeleton", 2, 0.25), "visual.skeleton_quota", ERROR, F.col("skeleton"), F.col("used")))
    long_ = order.with_size(content, ["doc"]).where("n_rows >= 8")
    out.append(finding(order.same_as_before(long_, ["doc"], ["pos"], "skeleton", 2).where("skeleton <> 'hero'"), "visual.skeleton_lag2", ERROR, page, F.col("skeleton")))
    lists = content.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("structure") == "list").alias("used"))
    out.append(finding(lists.where(F.col("used") > F.greatest(F.lit(1), F.floor(F.col("n") / 5))), "visual.list_quota", ERROR, None, F.col("used")))
    for c in ("form", "motif"):
        t = rows.withColumn("t", text.normalise(F.col(c))).where("t <> ''")
        t = t.where(~F.rlike("t", F.lit("^(无|NONE)"))) if c == "motif" else t
        first = t.groupBy("doc", "t").agg(F.min_by("page", "pos").alias("first"), F.min("pos").alias("first_pos"))
        out.append(finding(t.join(first, ["doc", "t"]).where("pos > first_pos"), f"visual.{c}_same", WARNING, page, F.col("first")))
        if c == "motif":
            near = render.close_earlier(first.select(F.col("doc").alias("page"), F.col("first_pos").alias("pos"), F.col("first").alias("sid"), F.col("t").alias("text")), 0.6)
            out.append(finding(near.select(F.col("page").alias("doc"), "sid", "other"), "visual.motif_close", WARNING, F.col("sid"), F.col("other")))
    out.append(capacity(pages, settings))
    return union(out)


def with_load(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """Pages with their load, their capacity (appendix pages are always read) and whether they are dense."""
    p = _numbered(pages).join(settings.select("doc", "mode"), "doc").withColumn("skeleton", F.col("visual.skeleton"))
    cap = dims.capacity(pages.sparkSession)
    own = cap.select("skeleton", F.col("mode").alias("cap_mode"), "body_cap", "strings_cap")
    p = p.withColumn("cap_mode", F.when(F.col("kind") == "appendix", "read").otherwise(F.col("mode"))).join(F.broadcast(own), ["skeleton", "cap_mode"], "left")
    p = p.join(F.broadcast(cap.select("skeleton", "mode", F.col("body_cap").alias("mode_cap"))), ["skeleton", "mode"], "left").join(outline.load(pages), ["doc", "page"])
    light = F.col("skeleton").isin("hero", "bignum") & (F.col("body") <= F.col("mode_cap") / 2)
    return p.withColumn("dense", ~F.coalesce(light, F.lit(False)))


def capacity(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """Text capacity, title lengths and rhythm."""
    p = with_load(pages, settings)
    page, title = F.col("page"), F.coalesce("title", F.lit(""))
    out = [finding(p.where(text.visible_length(title) > dims.TITLE_CHARS), "capacity.title", ERROR, page, text.visible_length(title))]
    out.append(finding(p.where(F.col("kind").isin(*dims.CONTENT_KINDS) & (text.visible_length(F.col("kicker")) > dims.KICKER_CHARS)), "capacity.kicker", WARNING, page, F.col("kicker")))
    out.append(finding(p.where((F.col("table_rows") > dims.TABLE_ROWS) | (F.col("table_columns") > dims.TABLE_COLUMNS)), "capacity.table", ERROR, page, F.concat_ws(" x ", "table_rows", "table_columns")))
    out.append(finding(p.where("body > body_cap OR strings > strings_cap"), "capacity.text", ERROR, page, F.concat_ws("/", "body", "strings")))
    out.append(finding(p.where((F.col("kind") == "content") & F.col("body_cap").isNotNull() & (F.col("body") < 20) & ~F.col("skeleton").isin("hero", "bignum")), "capacity.thin", WARNING, page, F.col("body")))
    content = order.with_size(p.where(F.col("kind").isin("content", "summary")), ["doc"])
    heavy = F.col("dense") & ~F.coalesce(F.col("tone") == "dark", F.lit(False))
    out.append(finding(order.first_frame(content.where("mode = 'read' AND n_rows >= 10"), ["doc"], ["pos"], heavy, 6), "rhythm.dense_frame", WARNING, page))
    shown = content.where("mode = 'present'")
    out.append(finding(order.long_runs(shown, ["doc"], ["pos"], F.col("dense"), 3), "rhythm.dense_run", ERROR, None, F.col("n")))
    total = p.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"))
    out.append(finding(shown.groupBy("doc").agg(F.bool_and("dense").alias("all_dense")).join(total, "doc").where("all_dense AND n_pages >= 8"), "rhythm.no_light_page", ERROR))
    return union(out)


def punctuation(slots: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Strings that still end with a mark, and list groups of mixed endings."""
    rows = slots.where(~F.col("text").isin(*keep)) if keep else slots
    role, t = F.col("role"), F.col("text")
    left = rows.where(text.should_strip(role, t))
    done = text.settled(role, t)
    groups = rows.where("grp IS NOT NULL").groupBy("doc", "grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.ends_with_stop(done)).alias("stops"))
    return union([finding(left, "punct.stop", ERROR, F.col("page"), t), finding(groups.where("n > 1 AND stops > 0 AND stops < n"), "punct.mixed", WARNING, F.col("grp"), F.col("stops"))])


TEXT_RULES = ("text.missing", "text.corner", "text.extra", "text.drift", "text.stop", "text.near")


def text_check(strings: DataFrame, lines: DataFrame, corners: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """How pages as they were read differ from the strings that they should have, as findings of each page: strings that are
    missing or nearly so, lines in reserved corners, text that no string has, titles that drift, stops put in.
    strings: page, sid, text; lines: page, pos, text, x0, y0, x1, y1; corners: page, corner and box; titles as
    stats.title_drift takes them. Pages are strings. What is missing or in a corner has to be made again."""
    want = strings.where(F.length(text.normalise(F.col("text"))) >= 2)
    ratios = render.best_ratio(want, lines, geometry.column_chains(lines)).join(want, ["page", "sid"])
    box = ("x0", "y0", "x1", "y1")
    areas = corners.select(F.col("page").alias("_page"), "corner", *(F.col(c).alias(f"_{c}") for c in box))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("page") == F.col("_page")) & cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))
    held = lines.where(F.length(text.normalise(F.col("text"))) >= 2).join(areas, inside)
    free = lines.join(held.select("page", "pos").distinct(), ["page", "pos"], "left_anti")
    extra = render.extra_lines(strings, free.join(strings.select("page").distinct(), "page", "left_semi"))
    stops = match.extra_stops(strings, lines).join(strings, ["page", "sid"])
    drift = () if titles is None else (stats.title_drift(titles),)
    on = lambda rows: rows.withColumnRenamed("page", "doc")
    t = F.col("text")
    out = [
        finding(on(ratios.where("ratio < 0.8")), "text.missing", ERROR, t, F.round("ratio", 3)), finding(on(ratios.where("ratio >= 0.8 AND ratio < 1")), "text.near", WARNING, t, F.round("ratio", 3)),
        finding(on(held), "text.corner", ERROR, F.col("corner"), t), finding(on(extra), "text.extra", WARNING, t), finding(on(stops), "text.stop", WARNING, t),
        *(finding(on(d), "text.drift", WARNING, None, F.concat_ws(", ", *(F.when(F.col(c), c[4:]) for c in ("off_y", "off_x", "off_size")))) for d in drift),
    ]
    return union(out)


def text_statuses(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """(page, status): the gravest of what was found on each page, OK where nothing was."""
    has = findings.groupBy(F.col("doc").alias("page")).agg(*(F.bool_or(F.col("rule") == r).alias(r.split(".")[1]) for r in TEXT_RULES))
    rows = pages.select("page").distinct().join(has, "page", "left")
    flags = [F.coalesce(F.col(r.split(".")[1]), F.lit(False)) for r in TEXT_RULES]
    return rows.select("page", match.page_status(*flags).alias("status"))


def directions(d: DataFrame) -> DataFrame:
    """The rules of a set of design directions. d: doc, id, source, refs, imagery_mode, dims, axes, cover (layout,
    motif), type_classes, temperature, icons, allow, variety, light, dark, brand_fit."""
    i = F.col("id")
    per = d.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("axes.color_strategy").alias("n_strategies"), F.count("axes.color_strategy").alias("n_with"), F.bool_and(F.coalesce(F.col("temperature") == "safe", F.lit(False))).alias("all_safe"))
    out = [finding(per.where("n <> 3"), "directions.count", ERROR, None, F.col("n")), finding(per.where("n = 3 AND n_with = 3 AND n_strategies < 2"), "directions.one_strategy", ERROR), finding(per.where("n = 3 AND all_safe"), "directions.all_safe", ERROR)]
    vocab = {"imagery_mode": dims.IMAGERY_MODES, "icons": dims.ICON_POLICIES, "temperature": dims.TEMPERATURES}
    for c, allowed in vocab.items():
        optional = F.lit(c == "icons") & F.col(c).isNull()
        out.append(finding(d.where(~optional & ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))), f"directions.{c}", ERROR, i, F.col(c)))
    lacking = F.filter(F.array(*map(F.lit, dims.DIMENSIONS)), lambda k: text.blank_to_null(F.element_at("dims", k)).isNull())
    out.append(finding(d.where(F.size(lacking) > 0), "directions.dims", ERROR, i, F.array_join(lacking, ", ")))
    for axis, allowed in dims.AXES.items():
        value = F.element_at("axes", F.lit(axis))
        out.append(finding(d.where(~F.coalesce(value.isin(*allowed), F.lit(False))), "directions.axis", ERROR, i, F.concat_ws("=", F.lit(axis), value)))
    out.append(finding(d.where("cover IS NULL OR coalesce(trim(cover.layout), '') = '' OR coalesce(trim(cover.motif), '') = ''"), "directions.cover", ERROR, i))
    out.append(finding(d.where(~F.coalesce(F.element_at("type_classes", F.lit("title")).isin(*dims.TYPE_CLASSES) & F.element_at("type_classes", F.lit("body")).isin(*dims.BODY_CLASSES), F.lit(False))), "directions.type_classes", ERROR, i))
    out.append(finding(d.where(F.size(F.array_except(F.coalesce("allow", F.array().cast("array<string>")), F.array(*map(F.lit, dims.AVOIDED)))) > 0), "directions.allow", ERROR, i))
    out.append(finding(d.where("source = 'reference' AND coalesce(size(refs), 0) <= 0"), "directions.references", ERROR, i))
    out.append(finding(d.where(text.blank_to_null(F.col("brand_fit")).isNull()), "directions.brand_fit", ERROR, i))
    out.append(finding(d.where(F.exists(F.map_values(F.coalesce("variety", F.create_map().cast("map<string,array<string>>"))), lambda o: F.size(o) < 1)), "directions.variety", ERROR, i))

    attributes = [("mode", F.col("imagery_mode"), ERROR)]
    attributes += [(f"dim.{k}", text.category_key(F.element_at("dims", F.lit(k))), ERROR) for k in dims.DIMENSIONS]
    attributes += [(f"axis.{k}", F.element_at("axes", F.lit(k)), ERROR) for k in dims.DISTINCT_AXES]
    attributes += [("cover.layout", text.category_key(F.col("cover.layout")), ERROR), ("cover.motif", text.category_key(F.col("cover.motif")), ERROR)]
    attributes += [(f"background.{t}", text.first_hex(F.col(t)), WARNING) for t in ("light", "dark")]
    long_ = d.select("doc", "id", F.explode(F.array(*(F.struct(F.lit(n).alias("attr"), F.nullif(c, F.lit("")).alias("value"), F.lit(s).alias("sev")) for n, c, s in attributes))).alias("x")).select("doc", "id", "x.*")
    same = graph.pairwise_equal(long_, "id", ["doc", "attr", "sev"], "value")
    pair = F.concat_ws(" = ", "a", "b")
    out += [finding(same.where(F.col("sev") == s), "directions.same", s, pair, F.concat_ws(": ", "attr", "value")) for s in (ERROR, WARNING)]
    return union(out)


def audit(entries: DataFrame, deck_wide_pages: int = 3) -> DataFrame:
    """Unanswered questions and verdicts, unknown problem types, and types found on several pages.
    entries: doc, page, verdict, answers map, problems array of (type, note)."""
    open_ = F.array_sort(F.map_keys(F.map_filter("answers", lambda _, v: v.isNull())))
    problems = entries.select("doc", "page", F.explode("problems").alias("p")).select("doc", "page", "p.*")
    wide = problems.groupBy("doc", "type").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= deck_wide_pages)
    return union([
        finding(entries.where(F.size(open_) > 0), "audit.unanswered", ERROR, F.col("page"), F.array_join(open_, ", ")), finding(entries.where("verdict IS NULL"), "audit.no_verdict", ERROR, F.col("page")),
        finding(problems.where(~F.coalesce(F.col("type").isin(*dims.PROBLEM_TYPES), F.lit(False))), "audit.unknown_type", ERROR, F.col("page"), F.col("type")), finding(wide, "audit.deck_wide", WARNING, F.col("type"), F.col("n")),
    ])


def approval(current: DataFrame, approved: DataFrame) -> DataFrame:
    """Documents without an approval, or whose text has changed since. current, approved: doc, signature."""
    a = approved.select("doc", F.col("signature").alias("was"))
    rows = current.join(a, "doc", "left")
    return union([finding(rows.where("was IS NULL"), "approval.missing", ERROR), finding(rows.where("was <> signature"), "approval.changed", ERROR)])


def variety(report: DataFrame, most: float = 0.45) -> DataFrame:
    """Decks whose pages look alike on the whole. report: doc, mean."""
    return finding(report.where(F.col("mean") > most), "variety.mean", WARNING, None, F.round("mean", 3))


def plan_variety(pages: DataFrame, options: dict[str, list[str]], recent: int = 6) -> DataFrame:
    """doc, page, axis, choice: for content pages each axis rotates through its options; the first surface comes on
    every other page; a choice isn't that of the page before, nor a whole combination one of the last six (if a device
    is left that makes it another); a page's own variant goes first. What is chosen depends on what was chosen before,
    so it is a walk over a document's pages in order, within the JVM."""
    axes, at = list(options), {a: k for k, a in enumerate(options)}
    of = {a: F.array(*map(F.lit, o)) for a, o in options.items()}
    combination = lambda picks: F.array_join(picks, "\x01")

    def rotated(axis: str, n: Column, last: Column) -> Column:
        o, size = of[axis], len(options[axis])
        if axis == "surface":
            return o[0] if size == 1 else F.when(n % 2 == 0, o[0]).otherwise(F.get(o, (F.lit(1) + F.floor(n / 2) % (size - 1)).cast("int")))
        here = ((n + at[axis]) % size).cast("int")
        return F.when(F.get(o, here) == F.get(last, F.lit(at[axis])), F.get(o, ((here + 1) % size).cast("int"))).otherwise(F.get(o, here))

    def step(s: Column, page: Column) -> Column:
        picks = F.array(*(rotated(a, s.n, s.last) for a in axes))
        if len(options.get("device", ())) > 1:
            k, o, size = at["device"], of["device"], len(options["device"])
            turned = lambda by: F.get(o, ((F.array_position(o, F.get(picks, F.lit(k))) - 1 + by) % size).cast("int"))
            other = lambda by: F.transform(picks, lambda v, i: F.when(i == k, turned(by)).otherwise(v))
            free = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda by: ~F.array_contains(s.recent, combination(other(by))))
            picks = F.when(F.size(free) > 0, other(free[0])).otherwise(picks)
        picks = F.transform(picks, lambda v, i: F.coalesce(F.get(page.own, i), v))
        past = F.slice(F.array_append(s.recent, combination(picks)), -recent, recent) if recent else s.recent
        past = F.when(F.size(s.recent) < recent, F.array_append(s.recent, combination(picks))).otherwise(past)
        return F.struct((s.n + 1).alias("n"), picks.alias("last"), past.alias("recent"), F.array_append(s.out, F.struct(page.page.alias("page"), picks.alias("picks"))).alias("out"))

    rows = pages.where(F.col("kind").isin(*dims.CONTENT_KINDS))
    own = F.array(*(F.try_element_at("visual.variant", F.lit(a)) for a in axes))
    rows = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("page"), own.alias("own")))).alias("ps"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("n"), none.alias("last"), none.alias("recent"), F.array().cast("array<struct<page:string,picks:array<string>>>").alias("out"))
    out = rows.select("doc", F.explode(F.aggregate("ps", start, step, lambda s: s.out)).alias("p"))
    return out.select("doc", "p.page", F.posexplode("p.picks").alias("k", "choice")).select("doc", "page", F.array(*map(F.lit, axes))[F.col("k")].alias("axis"), "choice")
