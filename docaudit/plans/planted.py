"""Registered queries of rule sets on data where the rules fire: each customer is a deck, or a set of design directions, that is
without fault but for what its key plants. The SQL counts the keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.plans import dims, rules
from docaudit.plans.catalogue import _table, registered

K = "c_custkey"


def _counts(planted: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS n FROM customer WHERE {where.replace('k%', K + ' % ')} GROUP BY ALL" for rule, severity, where in planted)


def _when(where: str, then, otherwise) -> Column:
    """A value where the key plants a fault, else another; where: k%11=0 and the like."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(F.expr(where.replace("k%", "k % ")), as_column(then)).otherwise(as_column(otherwise))


STORYLINE = [
    ("storyline.closing_thanks", "error", "k%3=0"), ("storyline.kpi_conflict", "error", "k%5=0"), ("storyline.kpi_repeated", "warning", "k%5=1"), ("storyline.agenda", "error", "k%7=0"), ("storyline.appendix_reference", "error", "k%11=0"),
    ("storyline.covers_order", "error", "k%13=0"), ("storyline.covers_incomplete", "error", "k%13=1"), ("storyline.source_unknown", "error", "k%17=0"), ("storyline.source_missing", "error", "k%19=0"), ("storyline.section_title", "warning", "k%23=0"),
    ("storyline.chapter_split", "error", "k%29=0"), ("storyline.title_about_deck", "error", "k%31=0"), ("storyline.title_topic", "warning", "k%37=0"), ("storyline.dropped_reason", "error", "k%41=0"), ("storyline.duration", "warning", "k%43=0"),
    ("storyline.heading_uncovered", "error", "k%53=0"), ("storyline.thesis", "error", "k%59=0"), ("storyline.merge", "warning", "k%61=0"), ("storyline.body_about_deck", "warning", "k%67=0"),
]


def storyline_decks(spark, sf_dir):
    """pages, settings, headings, body, names, dropped: a deck of twelve pages a customer. Keys are dealt by deck once, before
    pages are made of them, so that all rules find a deck's rows together and many tasks make them, however small the file is."""
    decks = _table(spark, sf_dir, "customer").select(F.col(K).alias("k"), F.col(K).cast("string").alias("doc")).repartition("doc")
    text_, words = F.lit(None).cast("string"), F.array().cast("array<string>")
    item = lambda t=None, label=None, value=None: F.struct(*(F.coalesce(v if isinstance(v, Column) else F.lit(v).cast("string"), text_).alias(n) for n, v in (("text", t), ("label", label), ("title", None), ("value", value))))

    def block(kind: str, *items: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), *(text_.alias(c) for c in ("text", "source", "caption", "visual")), F.array(*items).alias("items"), F.lit(None).cast("array<string>").alias("header"),
            F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("array<struct<title:string,items:array<string>>>").alias("columns"),
        )

    def page(kind: str, title, chapter=None, source=words, covers=words, blocks: tuple[Column, ...] = ()) -> Column:
        many = F.array(*blocks) if blocks else F.array(block("bullets", item("要点")))
        as_text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        return F.struct(F.lit(kind).alias("kind"), as_text(title).alias("title"), as_text(chapter).alias("chapter"), source.alias("source"), covers.alias("covers"), many.alias("blocks"))

    one = lambda v: F.array(v if isinstance(v, Column) else F.lit(v))
    chapters = F.array(F.lit("甲部"), F.lit("乙部"), F.lit("丙部"))
    covers = F.when(F.expr("k % 13 = 0"), F.array(F.lit("甲部"), F.lit("丙部"), F.lit("乙部"))).when(F.expr("k % 13 = 1"), F.array(F.lit("甲部"), F.lit("乙部"))).otherwise(chapters)
    growth = block("kpis", item(None, "增长", "12%"))
    other = block("kpis", item(None, _when("k%5<2", "增长", "利润"), _when("k%5=0", "13%", "12%")))
    pages = F.array(
        page("cover", "封面"), page("agenda", "目录", blocks=(block("bullets", item("甲部"), item("乙部"), item(_when("k%7=0", "其他", "丙部"))),)), page("summary", "摘要", covers=covers), page("section", _when("k%23=0", "别部", "甲部")),
        page("content", _when("k%37=0", "市场概述", "销量涨两成"), "甲部", one("章节甲"), blocks=(block("bullets", item(_when("k%11=0", "见附录 A9", "见附录 A1"))),)),
        page("content", _when("k%31=0", "本页说销量", "客户更满意"), "甲部", one(_when("k%61=0", "章节甲", "正文依据")), blocks=(growth,)), page("content", "成本降一成", "乙部", one("章节乙"), blocks=(other,)), page("content", "交付快三天", "乙部", one(_when("k%17=0", "查无此源", "report"))),
        page("content", "团队更稳定", "丙部", F.when(F.expr("k % 19 = 0"), words).otherwise(one("补充：访谈")), blocks=(block("bullets", item(_when("k%67=0", "接下来介绍团队", "离职减半"))),)), page("content", "明年再加码", _when("k%29=0", "甲部", "丙部"), one("章节丙")), page("closing", _when("k%3=0", "Thank you!", "三件事请定")), page("appendix", "数据口径", "甲部", one("report")),
    )
    rows = decks.select("doc", F.posexplode(pages).alias("pos", "p"))
    brief = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("message", "structure", "form", "focal", "skeleton", "motif")), F.lit(None).cast("map<string,string>").alias("variant"))
    null = [text_.alias(c) for c in ("tone", "kicker", "subtitle", "takeaway", "footnote", "notes", "layout_hint", "image_hint")]
    rows = rows.select("doc", "pos", F.format_string("p%02d", F.col("pos") + 1).alias("id"), "p.kind", "p.chapter", *null, "p.title", "p.source", "p.covers", "p.blocks", brief.alias("visual"))
    present = F.expr("k % 43 = 0")
    settings = decks.select("doc", _when("k%59=0", " ", "t").alias("thesis"), F.when(present, "present").otherwise("read").alias("mode"), F.lit(20).alias("max_pages"), F.lit(True).alias("section_pages"), F.when(present, 2.0).alias("duration_min"), F.lit(True).alias("has_source"), F.lit(False).alias("unread"))
    titles = F.when(F.expr("k % 53 = 0"), F.array(*map(F.lit, ("章节甲", "章节乙", "章节丙", "未用的章")))).otherwise(F.array(*map(F.lit, ("章节甲", "章节乙", "章节丙"))))
    headings = decks.select("doc", F.posexplode(titles).alias("idx", "text")).select("doc", "idx", F.lit(1).alias("level"), "text")
    body = decks.select("doc", F.lit("这里有正文依据的一段。").alias("text"))
    return rows, settings, headings, body, decks.select("doc", F.lit("report-2024").alias("name")), decks.select("doc", F.lit("旧资料").alias("source"), _when("k%41=0", " ", "过时").alias("reason"))


@registered(_counts(STORYLINE))
def storyline_findings(spark, sf_dir):
    """What the storyline rules find in decks with chapters, agenda, summary, appendix, KPIs and sources, by rule."""
    return rules.storyline(*storyline_decks(spark, sf_dir)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


_ALL = "k%11<>0"
DIRECTIONS = [
    ("directions.count", "error", "k%11=0"), ("directions.all_safe", "error", f"k%7=0 AND k%17<>0 AND {_ALL}"), ("directions.one_strategy", "error", f"k%53=0 AND {_ALL}"), ("directions.imagery_mode", "error", "k%59=0"), ("directions.icons", "error", "k%13=0"),
    ("directions.temperature", "error", "k%17=0"), ("directions.dims", "error", "k%19=0"), ("directions.axis", "error", "k%23=0"), ("directions.cover", "error", "k%29=0"), ("directions.type_classes", "error", "k%31=0"), ("directions.allow", "error", "k%37=0"),
    ("directions.references", "error", "k%41=0"), ("directions.brand_fit", "error", "k%43=0"), ("directions.variety", "error", "k%47=0"), ("directions.same", "error", "k%5=0 AND k%59<>0"), ("directions.same", "warning", "k%3=0"),
]


@registered(_counts(DIRECTIONS))
def direction_findings(spark, sf_dir):
    """What the rules of design directions find in a set of three a customer, by rule."""
    i = F.col("i")
    keys = _table(spark, sf_dir, "customer").select(F.col(K).alias("k"), F.col(K).cast("string").alias("doc")).repartition("doc")  # many tasks, however small the file
    rows = keys.select("k", "doc", F.explode(F.sequence(F.lit(0), _when("k%11=0", 1, 2))).alias("i"))
    at = lambda n, where, then, otherwise: F.when((i == n) & F.expr(where.replace("k%", "k % ")), then).otherwise(otherwise)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), i % len(values) + 1)
    named = lambda p: F.concat(F.lit(p), i.cast("string"))
    text_map = lambda pairs: F.create_map(*(c for k, v in pairs for c in (F.lit(k), v)))
    mode = at(0, "k%59=0", "hologram", at(1, "k%5=0", dims.IMAGERY_MODES[0], pick(dims.IMAGERY_MODES)))
    axes = {a: pick(v) for a, v in dims.AXES.items()}
    axes["texture"] = at(0, "k%23=0", "velvet", axes["texture"])
    axes["color_strategy"] = F.when(F.expr("k % 53 = 0"), dims.AXES["color_strategy"][0]).otherwise(axes["color_strategy"])
    none = F.array().cast("array<string>")
    d = rows.select(
        "doc", named("x").alias("id"), at(0, "k%41=0", "reference", F.lit("own")).alias("source"), none.alias("refs"), mode.alias("imagery_mode"),
        text_map([(k, at(0, "k%19=0", " ", named(k)) if k == "layout" else named(k)) for k in dims.DIMENSIONS]).alias("dims"), text_map(list(axes.items())).alias("axes"),
        F.when(~((i == 1) & F.expr("k % 29 = 0")), F.struct(named("l").alias("layout"), named("m").alias("motif"))).alias("cover"), text_map([("title", F.lit("hei")), ("body", at(0, "k%31=0", "kai", F.lit("song")))]).alias("type_classes"),
        at(1, "k%17=0", "warm", F.when((i > 0) | F.expr("k % 7 = 0"), "safe").otherwise("distinct")).alias("temperature"), at(1, "k%13=0", "many", F.lit("none")).alias("icons"), at(0, "k%37=0", F.array(F.lit("laser")), none).alias("allow"),
        F.create_map(F.lit("surface"), at(0, "k%47=0", none, F.array(F.lit("plain")))).alias("variety"), F.concat(F.lit("background #00000"), at(1, "k%3=0", "0", i.cast("string"))).alias("light"), named("background #11111").alias("dark"), at(1, "k%43=0", " ", F.lit("fits")).alias("brand_fit"),
    )
    return rules.directions(d).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


_LINE = "(SELECT conv_id, turn, text, (conv_id * 7919 + turn * 104729) % 1000003 % 40 AS kind FROM conversations WHERE length(text) >= 20 AND regexp_matches(text, '^[A-Za-z](?s:.{11})[^ea]*[ea]'))"


@registered(
    f"SELECT conv_id, CASE WHEN bool_or(kind = 0) THEN 'MISS' WHEN bool_or(turn = 0 AND conv_id % 5 = 0) THEN 'CORNER' WHEN bool_or(kind = 2) THEN 'EXTRA' WHEN bool_or(kind = 3) THEN 'PUNCT' WHEN bool_or(kind = 1) THEN 'NEAR' ELSE 'OK' END AS status FROM {_LINE} GROUP BY conv_id"
)
def text_statuses(spark, sf_dir):
    """The one status of each page as it was read: turns as strings, of which some are left out, lack a letter, stand in a
    corner or end with a stop, and pages with a line too many."""
    t = _table(spark, sf_dir, "conversations").where("length(text) >= 20 AND text RLIKE '^[A-Za-z](?s:.{11})[^ea]*[ea]'")
    t = t.select(F.col("conv_id").cast("string").alias("page"), F.col("turn").cast("long").alias("sid"), "text", F.expr("cast((conv_id * 7919 + turn * 104729) % 1000003 % 40 AS int)").alias("kind"))
    shown = F.when(F.col("kind") == 1, F.regexp_replace("text", "^([A-Za-z](?s:.{11})[^ea]*)[ea]", "$1")).when(F.col("kind") == 3, F.concat("text", F.lit("。"))).otherwise(F.col("text"))
    box = lambda y: [F.lit(10.0).alias("x0"), y.cast("double").alias("y0"), F.lit(40.0).alias("x1"), (y + 10).cast("double").alias("y1")]
    y = F.col("sid") * 40
    lines = t.where("kind <> 0").select("page", F.col("sid").alias("pos"), shown.alias("text"), *box(y))
    more = t.where("kind = 2").select("page", (F.col("sid") + 100_000).alias("pos"), F.lit("新增的字").alias("text"), *box(y + 20))
    corners = t.select("page").distinct().where("cast(page AS long) % 5 = 0").select("page", F.lit("tl").alias("corner"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(12.0).alias("y1"))
    # What is left out is a string that no other line of a page resembles, and what lacks a letter has a sign there that none
    # has: a long line may hold all letters of a short string, in order.
    lost = F.regexp_replace("text", "^([A-Za-z](?s:.{11})[^ea]*)[ea]", "$1⌀")
    strings = t.select("page", "sid", F.when(F.col("kind") == 0, F.concat(F.lit("这页缺少了整句话"), F.col("sid").cast("string"))).when(F.col("kind") == 1, lost).otherwise(F.col("text")).alias("text"))
    found = rules.text_check(strings, lines.unionByName(more), corners)
    return rules.text_statuses(strings, found).select(F.col("page").cast("long").alias("conv_id"), "status")
