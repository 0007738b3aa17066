"""The nested document: reading it, and flattening it to ordered (page, role, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.functions import text

ITEM = "struct<text: string, label: string, title: string, value: string>"
BLOCK_IN = "struct<type: string, text: string, source: string, caption: string, visual: string, items: array<string>, header: array<string>, rows: array<array<string>>, columns: array<struct<title: string, items: array<string>>>>"
BLOCK = BLOCK_IN.replace("items: array<string>, header", f"items: array<{ITEM}>, header")
VISUAL = "struct<message: string, structure: string, form: string, focal: string, skeleton: string, motif: string, variant: map<string,string>>"
FIELDS = "id: string, kind: string, chapter: string, tone: string, kicker: string, title: string, subtitle: string, takeaway: string, footnote: string, notes: string, layout_hint: string, image_hint: string"
PAGE_IN = f"struct<{FIELDS}, source: string, covers: array<string>, blocks: array<{BLOCK_IN}>, visual: {VISUAL}>"
OUTLINE_IN = f"title string, storyline struct<thesis: string, mode: string, dropped: array<string>>, pages array<{PAGE_IN}>, _corrupt string"
PAGES = f"doc string, pos int, {FIELDS.replace(':', '')}, source array<string>, covers array<string>, blocks array<{BLOCK}>, visual {VISUAL}"


PROJECT = "name string, suffix string, source string, logos array<struct<corner: string, file: string>>, page_number struct<corner: string, format: string, skip_first: boolean, skip_last: boolean>, margin double, parallel int, upscale int, deck_mode string, max_pages int, section_pages boolean, duration_min double"


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project settings by file, with the defaults of what isn't stated, and sources resolved against the file's folder."""
    rows = spark.read.schema(PROJECT).json(path, multiLine=True).withColumn("file", F.input_file_name())
    folder = F.regexp_replace("file", "/[^/]*$", "/")
    sources = F.transform(_list(F.col("source")), lambda s: F.when(F.startswith(s, F.lit("/")), s).otherwise(F.concat(folder, s)))
    defaults = {"suffix": F.lit(""), "margin": F.lit(0.8), "parallel": F.lit(4), "upscale": F.lit(2), "logos": F.array().cast("array<struct<corner:string,file:string>>")}
    rows = rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()}).withColumn("source", sources)
    return rows.withColumn("deck_mode", F.when(F.col("deck_mode").isin("present", "read"), F.col("deck_mode")).otherwise("read"))


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """Outlines by file. Items may be strings or objects and sources strings or lists: such fields are read as text
    and brought to one shape. A file that can't be parsed keeps its row, with `_corrupt` set."""
    rows = spark.read.schema(OUTLINE_IN).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    return rows.withColumn("doc", F.input_file_name())


def _item(raw: Column) -> Column:
    parsed = F.from_json(raw, ITEM.replace("struct<", "").replace(">", "").replace(":", ""))
    plain = F.struct(raw.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("label", "title", "value")))
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), parsed).otherwise(plain)


def _list(raw: Column) -> Column:
    """A list that may have been written as one string."""
    many = F.from_json(raw, "array<string>")
    out = F.when(F.startswith(F.ltrim(raw), F.lit("[")), many).when(raw.isNotNull(), F.array(raw))
    return F.filter(F.transform(F.coalesce(out, F.array().cast("array<string>")), F.trim), lambda s: s != "")


def pages_of(outlines: DataFrame) -> DataFrame:
    """A row a page, with the defaults of kind and id, in one shape."""
    rows = outlines.select("doc", F.posexplode("pages").alias("pos", "p"))
    blocks = F.transform(F.coalesce("p.blocks", F.array().cast(f"array<{BLOCK_IN}>")), lambda b: b.withField("items", F.transform(b["items"], _item)))
    plain = ["chapter", "tone", "kicker", "title", "subtitle", "takeaway", "footnote", "notes", "layout_hint", "image_hint"]
    return rows.select(
        "doc", F.col("pos").cast("int").alias("pos"), F.coalesce(text.blank_to_null(F.col("p.id")), F.format_string("p%02d", F.col("pos") + 1)).alias("id"), F.coalesce("p.kind", F.lit("content")).alias("kind"),
        *(F.col(f"p.{c}").alias(c) for c in plain), _list(F.col("p.source")).alias("source"), F.coalesce("p.covers", F.array().cast("array<string>")).alias("covers"), blocks.alias("blocks"), F.col("p.visual").alias("visual"),
    )


def dropped_of(outlines: DataFrame) -> DataFrame:
    """doc, source, reason of what a storyline leaves out; written as objects or as 'source：reason'."""
    d = outlines.select("doc", F.explode("storyline.dropped").alias("d"))
    parsed = F.from_json("d", "source string, reason string")
    is_object = F.startswith(F.ltrim("d"), F.lit("{"))
    return d.select("doc", F.when(is_object, parsed.source).otherwise(F.substring_index("d", "：", 1)).alias("source"), F.when(is_object, parsed.reason).otherwise(F.when(F.contains("d", F.lit("：")), F.regexp_replace("d", "^[^：]*：", "")).otherwise("")).alias("reason"))


def _slot(role: str, value: Column, group: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), value.alias("text"), (group if group is not None else F.lit(None)).cast("string").alias("grp"))


def _block_slots(page: Column, b: Column, i: Column) -> Column:
    """A block's strings in reading order, by its type."""
    name = F.concat(page, F.lit("/b"), (i + 1).cast("string"))
    none = F.array().cast("array<struct<role:string,text:string,grp:string>>")
    each = lambda xs, f: F.coalesce(F.flatten(F.transform(xs, f)), none)
    cells = lambda row: F.transform(row, lambda c: _slot("table cell", c))
    column = lambda c, k: F.concat(F.array(_slot("column title", c.title)), F.coalesce(F.transform(c["items"], lambda s: _slot("column item", s, F.concat(name, F.lit("/c"), (k + 1).cast("string")))), none))
    return (
        F.when(b.type == "bullets", each(b["items"], lambda x: F.array(_slot("bullet", x.text, name))))
        .when(b.type == "steps", each(b["items"], lambda x: F.array(_slot("step", x.text, name))))
        .when(b.type == "numbered", each(b["items"], lambda x: F.array(_slot("number", x.label), _slot("item title", x.title), _slot("item text", x.text, name))))
        .when(b.type == "kpis", each(b["items"], lambda x: F.array(_slot("big number", x.value), _slot("number label", x.label))))
        .when(b.type == "table", F.concat(F.array(_slot("table caption", b.caption)), F.coalesce(F.transform(b.header, lambda h: _slot("table header", h)), none), each(b.rows, cells)))
        .when(b.type == "columns", F.coalesce(F.flatten(F.transform(b.columns, column)), none))
        .when(b.type == "quote", F.array(_slot("quote", b.text), _slot("source", b.source)))
        .when(b.type == "text", F.array(_slot("text", b.text), _slot("source", b.source)))
        .when(b.type == "callout", F.array(_slot("callout", b.text), _slot("source", b.source)))
        .when(b.type == "heading", F.array(_slot("heading", b.text)))
        .otherwise(none)
    )


def slots(pages: DataFrame) -> DataFrame:
    """doc, pos, page, role, text, grp, ord: every printed string in reading order, trimmed, without empty ones."""
    head = F.array(*(_slot(r, F.col(r)) for r in ("kicker", "title", "subtitle")))
    tail = F.array(*(_slot(r, F.col(r)) for r in ("takeaway", "footnote")))
    body = F.flatten(F.transform("blocks", lambda b, i: _block_slots(F.col("id"), b, i)))
    rows = pages.select("doc", "pos", F.col("id").alias("page"), F.posexplode(F.concat(head, F.coalesce(body, F.array().cast("array<struct<role:string,text:string,grp:string>>")), tail)).alias("ord", "s"))
    return rows.select("doc", "pos", "page", "s.role", text.blank_to_null(F.col("s.text")).alias("text"), F.col("s.grp").alias("grp"), "ord").where("text IS NOT NULL")


def copy_slots(pages: DataFrame) -> DataFrame:
    """The strings with CJK text that go through editing, notes last, each with an id by its count on the page."""
    rows = slots(pages).where(text.cjk_length(F.col("text")) > 0).select("doc", "pos", "page", "role", "text", "ord")
    notes = pages.where(text.cjk_length(F.col("notes")) > 0).select("doc", "pos", F.col("id").alias("page"), F.lit("notes").alias("role"), F.trim("notes").alias("text"), F.lit(1 << 30).alias("ord"))
    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord"))
    return rows.unionByName(notes).withColumn("id", F.concat("page", F.lit("."), F.format_string("%02d", n)))


def load(pages: DataFrame) -> DataFrame:
    """doc, page, body, strings, table_rows, table_columns: what a page carries, for the capacity rules."""
    s = slots(pages).groupBy("doc", "page").agg(
        F.sum(F.when(~F.col("role").isin("kicker", "title", "subtitle", "table header"), text.cjk_length(F.col("text"))).otherwise(0)).cast("int").alias("body"),
        F.count_if(~F.col("role").isin("table header", "table cell")).cast("int").alias("strings"),
    )
    tables = pages.select("doc", F.col("id").alias("page"), F.explode(F.filter("blocks", lambda b: b.type == "table")).alias("b"))
    size = lambda a: F.greatest(F.size(a), F.lit(0))
    wide = F.greatest(size("b.header"), F.coalesce(F.array_max(F.transform("b.rows", size)), F.lit(0)))
    most = tables.groupBy("doc", "page").agg(F.max(F.struct(size("b.rows").alias("r"), wide.alias("c"))).alias("t"))
    rows = pages.select("doc", F.col("id").alias("page")).join(s, ["doc", "page"], "left").join(most, ["doc", "page"], "left")
    return rows.select("doc", "page", F.coalesce("body", F.lit(0)).alias("body"), F.coalesce("strings", F.lit(0)).alias("strings"), F.coalesce("t.r", F.lit(0)).alias("table_rows"), F.coalesce("t.c", F.lit(0)).alias("table_columns"))


def segments(rows: DataFrame, column: str = "text") -> DataFrame:
    """A corpus of distinct segments from plain or Markdown text: cells, lines, quoted spans of 2 to 80 characters and
    parts between semicolons, without marks; 2 to 160 characters with a word character."""
    lines = rows.select(F.explode(F.split(column, "\n")).alias("s"))
    cells = lines.where(F.contains("s", F.lit("|"))).select(F.explode(F.split("s", "\\|")).alias("s"))
    quoted = lines.select(F.explode(F.regexp_extract_all("s", F.lit("[「“\"]([^「」“”\"]{2,80})[」”\"]"), F.lit(1))).alias("s"))
    parts = lines.where(F.rlike("s", F.lit("[；;]"))).select(F.explode(F.split("s", "[；;]")).alias("s"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("s", "^\\s*(#{1,6}|[-*+>]|\\d+[.)])\\s+", ""), "\\*\\*|__|`", ""))
    every = lines.unionByName(cells).unionByName(quoted).unionByName(parts).select(clean.alias("segment"))
    return every.where(F.length("segment").between(2, 160) & F.rlike("segment", F.lit("[\\p{L}\\p{N}_]"))).distinct()


def page_corpus(pages: DataFrame) -> DataFrame:
    """doc, page, texts, kpis: the copy that a page has to show, and its numbers apart."""
    s = slots(pages)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.text)
    return s.groupBy("doc", "page").agg(ordered(F.struct("ord", "text")).alias("texts"), ordered(F.when(F.col("role") == "big number", F.struct("ord", "text"))).alias("kpis"))


def tones(pages: DataFrame, by_kind: dict[str, str]) -> DataFrame:
    """Adds `page_tone`: the page's own, else that of its kind, else light."""
    of_kind = F.create_map(*(F.lit(x) for kv in by_kind.items() for x in kv)) if by_kind else F.lit(None).cast("map<string,string>")
    return pages.withColumn("page_tone", F.coalesce("tone", F.element_at(of_kind, F.col("kind")), F.lit("light")))


def font_size(blocks: DataFrame, sizes: range = range(18, 10, -1)) -> DataFrame:
    """Adds `size`, the largest at which the text's lines fit the height, else the smallest.
    blocks: text, width and height in points."""
    fits = lambda s: F.ceil(text.width_em(F.col("text")) * s / F.col("width")) * s * 1.3 <= F.col("height")
    return blocks.withColumn("size", F.coalesce(*(F.when(fits(s), s) for s in sizes), F.lit(min(sizes))))
