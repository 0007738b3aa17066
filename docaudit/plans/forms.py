"""More registered queries: text forms and marks, page checks, boxes, logs and versions, each through its operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions import text
from docaudit.operators import geometry, match, state, stats
from docaudit.plans import prompts, rules
from docaudit.plans.catalogue import _LINES, _lines, _norm_sql, _table, decks, registered
from docaudit.sources import markdown, outline

#: White space and CJK as classes of the SQL engine.
_S = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_CJK = "[\\x{3400}-\\x{9FFF}]"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _end_sql(c: str) -> str:
    return f"regexp_replace({c}, '{_S}+$', '')"


def _body_sql(c: str) -> str:
    return f"regexp_replace({_end_sql(c)}, '(?s).$', '')"


def _stop_sql(c: str) -> str:
    return f"regexp_matches({_end_sql(c)}, '[。．]$|{_CJK}\\.$')"


def _strip_sql(role: str, c: str) -> str:
    mark = f"({_stop_sql(c)} OR ({role} IN ({_quoted(text.LIST_ROLES)}) AND regexp_matches({_end_sql(c)}, '[；;]$')))"
    limit = f"CASE WHEN {role} IN ({_quoted(text.DESCRIPTIVE_ROLES)}) THEN {text.DESCRIPTIVE_CHARS} ELSE {text.LONG_CHARS} END"
    short = f"({role} IN ({_quoted(text.SHORT_ROLES)}) OR length(regexp_replace({_body_sql(c)}, '{_S}', '', 'g')) < {limit})"
    return f"({mark} AND NOT regexp_matches({_body_sql(c)}, '[。！？!?]') AND {short})"


def _settled_sql(role: str, c: str) -> str:
    return f"CASE WHEN {_strip_sql(role, c)} THEN regexp_replace({_body_sql(c)}, '{_S}+$', '') ELSE {c} END"


# Lines with full-width stops, and a role that goes by their number.
_ROLES = ("title", "text", "bullet", "notes")
_ROLED = f"SELECT doc_id, n, translate(line, '.', '。') AS line, CASE n % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'bullet' ELSE 'notes' END AS role FROM ({_LINES})"


def _roled(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("n") % 4 + 1).cast("int"))
    return _lines(spark, sf_dir).select("doc_id", "n", F.translate("line", ".", "。").alias("line"), role.alias("role"))


@registered(f"WITH l AS ({_ROLED}) SELECT doc_id, count(*) FILTER ({_stop_sql('line')}) AS n_stops, count(*) FILTER ({_stop_sql('line')} OR (role = 'bullet' AND regexp_matches({_end_sql('line')}, '[；;]$'))) AS n_marks, count(*) FILTER ({_strip_sql('role', 'line')}) AS n_strip FROM l GROUP BY doc_id")
def terminal_marks(spark, sf_dir):
    """Lines that end in a stop or a mark of their role, and those that have to lose it."""
    role, line = F.col("role"), F.col("line")
    return _roled(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.ends_with_stop(line)).alias("n_stops"), F.count_if(text.ends_with_mark(role, line)).alias("n_marks"), F.count_if(text.should_strip(role, line)).alias("n_strip"))


@registered(f"WITH l AS ({_ROLED}) SELECT doc_id, CAST(n AS INTEGER) AS n, {_settled_sql('role', 'line')} AS settled FROM l WHERE {_settled_sql('role', 'line')} <> line")
def settled_lines(spark, sf_dir):
    """Lines that the punctuation rules change, as they leave them."""
    rows = _roled(spark, sf_dir).withColumn("settled", text.settled(F.col("role"), F.col("line")))
    return rows.where("settled <> line").select("doc_id", "n", "settled")


@registered(f"WITH l AS ({_ROLED}), d AS (SELECT DISTINCT {_settled_sql('role', 'line')} AS t FROM l WHERE doc_id % 2 = 0) SELECT doc_id, count(*) AS n_pending FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.t = {_settled_sql('role', 'line')}) GROUP BY doc_id")
def pending_lines(spark, sf_dir):
    """Lines whose settled text no document of even number has."""
    rows = _roled(spark, sf_dir).withColumnRenamed("line", "text")
    done = rows.where("doc_id % 2 = 0").select(text.settled(F.col("role"), F.col("text")).alias("text"))
    return state.pending(rows, done).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pending"))


_TITLED = f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Thank you!' WHEN 1 THEN trim(line, ' ') || '介绍' WHEN 2 THEN '本页' || line WHEN 3 THEN ' Q & A ' ELSE line END AS title FROM ({_LINES}) WHERE n = 0"


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@registered(f"WITH t AS ({_TITLED}) SELECT doc_id, regexp_matches(title, '{_re2(text.THANKS)}') AS thanks, regexp_matches(title, '{_re2(text.META)}') AS about_deck, regexp_matches(title, '{_re2(text.TOPIC_END)}') AS topic FROM t")
def title_patterns(spark, sf_dir):
    """Which titles thank, speak about the deck, or name a topic only."""
    line = F.col("line")
    title = F.when(F.col("doc_id") % 5 == 0, "Thank you!").when(F.col("doc_id") % 5 == 1, F.concat(F.trim(line), F.lit("介绍"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("本页"), line)).when(F.col("doc_id") % 5 == 3, " Q & A ").otherwise(line)
    rows = _lines(spark, sf_dir).where("n = 0").select("doc_id", title.alias("title"))
    return rows.select("doc_id", *(F.rlike("title", F.lit(p)).alias(c) for c, p in (("thanks", text.THANKS), ("about_deck", text.META), ("topic", text.TOPIC_END))))


@registered(f"WITH l AS ({_LINES}), p AS (SELECT doc_id, n, {_norm_sql('line')} AS a, {_norm_sql('substr(line, 3, 9)')} AS b, {_norm_sql('lead(line) OVER (PARTITION BY doc_id ORDER BY n)')} AS c FROM l) SELECT doc_id, count(*) FILTER (length(a) >= 2 AND length(b) >= 2 AND (contains(a, b) OR contains(b, a))) AS n_part, count(*) FILTER (length(a) >= 2 AND length(c) >= 2 AND (contains(a, c) OR contains(c, a))) AS n_next FROM p GROUP BY doc_id")
def heading_matches(spark, sf_dir):
    """Lines that agree as headings with a part of themselves, and with the next line."""
    from pyspark.sql import Window

    rows = _lines(spark, sf_dir).withColumn("after", F.lead("line").over(Window.partitionBy("doc_id").orderBy("n")))
    return rows.groupBy("doc_id").agg(F.count_if(text.headings_agree(F.col("line"), F.substring("line", 3, 9))).alias("n_part"), F.count_if(text.headings_agree(F.col("line"), F.col("after"))).alias("n_next"))


@registered("WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '品牌设计/' ELSE '' END || p_type AS path FROM part) SELECT p_partkey, array_to_string(list_concat(list_filter(['设计', '风格'], lambda k: contains(path, k)), list_sort(list_distinct(list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda t: t IN ('brass', 'steel', 'promo'))))), ',') AS hits FROM p")
def keyword_paths(spark, sf_dir):
    """Keywords that speak for a file, CJK ones anywhere and Latin ones as whole tokens."""
    path = F.concat(F.when(F.col("p_partkey") % 5 == 0, "品牌设计/").otherwise(""), F.col("p_type"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.keyword_hits(path, ["设计", "风格"], ["brass", "steel", "promo"]), ",").alias("hits"))


_READ = f"SELECT doc_id, n, CASE n % 5 WHEN 0 THEN line WHEN 1 THEN regexp_replace(line, '[^0-9]', '', 'g') || '12' WHEN 2 THEN '※ —' WHEN 3 THEN line || 'ア' ELSE '✦' END AS text, CAST(length(line) % 300 AS DOUBLE) AS height, n % 7 = 6 AS excluded FROM ({_LINES})"


@registered(f"WITH r AS ({_READ}), c AS (SELECT doc_id, CASE WHEN excluded THEN 'excluded' WHEN height > CAST(0.18 AS DOUBLE) * 1000 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) >= CAST(0.6 AS DOUBLE) THEN 'giant' WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'symbol' WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]') THEN 'garbled' WHEN regexp_matches(text, '^[J/+|\\\\✦✧◆◇*]{{1,2}}$') THEN 'ornament' ELSE 'text' END AS reason FROM r) SELECT doc_id, reason, count(*) AS n FROM c GROUP BY doc_id, reason")
def rejected_lines(spark, sf_dir):
    """Read lines by the reason why they are no text."""
    n, line = F.col("n"), F.col("line")
    t = F.when(n % 5 == 0, line).when(n % 5 == 1, F.concat(F.regexp_replace(line, "[^0-9]", ""), F.lit("12"))).when(n % 5 == 2, "※ —").when(n % 5 == 3, F.concat(line, F.lit("ア"))).otherwise("✦")
    rows = _lines(spark, sf_dir).select("doc_id", t.alias("text"), (F.length("line") % 300).cast("double").alias("height"), F.lit(1000.0).alias("page_height"), (n % 7 == 6).alias("excluded"))
    return geometry.rejected(rows).groupBy("doc_id", F.coalesce("reason", F.lit("text")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 22 THEN 'low contrast' WHEN coalesce(nullif(l_linenumber, 3), 0) = 0 THEN 'no ink' WHEN l_extendedprice / 1000 < 18 THEN 'too small' WHEN l_discount > 0.05 THEN 'busy background' END AS reason FROM lineitem")
def unfit_lines(spark, sf_dir):
    """Lines that can't be set again, by the first reason."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("contrast"), F.nullif("l_linenumber", F.lit(3)).alias("ink"), (F.col("l_extendedprice") / 1000).alias("px"), (F.col("l_discount") > 0.05).alias("busy"))
    return geometry.fit_rejected(rows).select("l_orderkey", "l_linenumber", "reason")


@registered("WITH p AS (SELECT n_nationkey AS id, ['bl', 'br', 'tl', 'tr'][n_nationkey % 4 + 1] AS corner, 100.0 + n_nationkey AS w, 50.0 + n_nationkey AS h FROM nation), b AS (SELECT *, CASE WHEN corner LIKE '%l' THEN 0.2 ELSE 0.12 END * w AS cw FROM p) SELECT id, corner, round(CAST(CASE WHEN corner LIKE '%l' THEN 0 ELSE w - cw END AS DOUBLE), 6) AS x0, round(CAST(CASE WHEN corner LIKE 'b%' THEN h * 0.91 ELSE 0 END AS DOUBLE), 6) AS y0, round(CAST(CASE WHEN corner LIKE '%l' THEN cw ELSE w END AS DOUBLE), 6) AS x1, round(CAST(CASE WHEN corner LIKE 'b%' THEN h ELSE h * 0.09 END AS DOUBLE), 6) AS y1 FROM b")
def corner_zones(spark, sf_dir):
    """Reserved corners' boxes."""
    corner = F.element_at(F.array(*map(F.lit, ("bl", "br", "tl", "tr"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), corner.alias("corner"), (F.col("n_nationkey") + 100.0).alias("width"), (F.col("n_nationkey") + 50.0).alias("height"))
    return geometry.corner_boxes(rows).select("id", "corner", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


_BOXES = "SELECT conv_id AS page, turn AS pos, turn * 10 AS x0, turn * 10 + length(text) % 23 AS x1, turn % 2 * 5 AS y0, turn % 2 * 5 + 6 AS y1 FROM conversations"


def _boxes(spark, sf_dir):
    n = F.col("turn")
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), n.alias("pos"), (n * 10).alias("x0"), (n * 10 + F.length("text") % 23).alias("x1"), (n % 2 * 5).alias("y0"), (n % 2 * 5 + 6).alias("y1"))


@registered(f"WITH b AS ({_BOXES}) SELECT a.page, a.pos, CAST(coalesce(min(b.x0), 100) - any_value(a.x1) AS DOUBLE) AS room FROM b a LEFT JOIN b ON b.page = a.page AND b.x0 >= a.x1 AND b.y0 < a.y1 AND b.y1 > a.y0 GROUP BY a.page, a.pos")
def free_rooms(spark, sf_dir):
    """The space to the right of each box of a page."""
    return geometry.free_room(_boxes(spark, sf_dir), 100.0).select("page", "pos", "room")


@registered("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round_even(value / 8, 0), event_id) AS place FROM events")
def reading_places(spark, sf_dir):
    """Events in reading order: rows of eight units, then from left to right."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "event_id", F.col("value").alias("y0"), F.col("event_id").alias("x0"))
    return geometry.reading_order(rows).select(F.col("page").alias("user_id"), "event_id", F.col("place").cast("long").alias("place"))


@registered("""WITH c AS (SELECT conv_id AS page, turn AS i, substr(role, 1, 1) AS ch, CAST(turn * 10 + length(text) % 50 / 10 AS DOUBLE) AS x0, CAST(2 + turn % 4 AS DOUBLE) AS h FROM conversations),
g AS (SELECT *, x0 - lag(x0 + 5) OVER (PARTITION BY page ORDER BY i) AS gap FROM c), m AS (SELECT *, coalesce(median(gap) OVER (PARTITION BY page), 0) AS mid FROM g),
s AS (SELECT *, coalesce(gap > 1.25 * h, false) AS cut FROM m), t AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY i) AS segment FROM s)
SELECT page, CAST(segment AS BIGINT) AS segment, string_agg(CASE WHEN NOT cut AND gap > mid + CAST(0.22 AS DOUBLE) * h THEN ' ' ELSE '' END || ch, '' ORDER BY i) AS text FROM t GROUP BY page, segment""")
def gap_segments(spark, sf_dir):
    """Turns as characters of a line, cut and spaced by their gaps."""
    n = F.col("turn")
    x0 = (n * 10 + F.length("text") % 50 / 10).cast("double")
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.lit(0).alias("line"), n.alias("i"), F.substring("role", 1, 1).alias("ch"), x0.alias("x0"), (x0 + 5).alias("x1"), (2 + n % 4).cast("double").alias("h"))
    return geometry.segments(rows).select("page", "segment", "text")


@registered("WITH i AS (SELECT doc_id AS page, source || '-' || doc_id % 50 AS sk FROM documents), e AS (SELECT page FROM i WHERE page % 11 = 0), u AS (SELECT sk, count(*) AS n, min(page) AS anchor FROM i GROUP BY sk), a AS (SELECT anchor FROM u WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM i JOIN e USING (page) WHERE i.sk = u.sk)) SELECT page, CASE WHEN page IN (SELECT anchor FROM a) THEN 1 ELSE 2 END AS wave FROM i WHERE page NOT IN (SELECT page FROM e)")
def page_waves(spark, sf_dir):
    """Which documents come first: one for each kind that several are of and none is done."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("doc_id").alias("pos"), F.concat("source", F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("skeleton"))
    return state.waves(rows, rows.where("page % 11 = 0").select("page")).select("page", "wave")


@registered("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 4")
def stale_documents(spark, sf_dir):
    """Documents whose stamp isn't that of the listing, or which it lacks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    now = docs.where("doc_id % 5 <> 4").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return state.stale(docs, now, "doc_id", ["n_chars", "source"]).select("doc_id")


@registered("WITH a AS (SELECT conv_id, turn, length(text) AS e, turn % 3 = 2 AS corner, length(text) % 5 AS x FROM conversations), b AS (SELECT *, lag(e) OVER w AS pe, lag(x) OVER w AS px, row_number() OVER w AS r FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN r = 1 THEN true ELSE e < pe AND NOT corner AND x <= px END AS accepted FROM b")
def accepted_fixes(spark, sf_dir):
    """Versions that are better than the one before."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("errors"), F.when(F.col("turn") % 3 == 2, 1).otherwise(0).alias("corner"), (F.length("text") % 5).alias("extra"))
    return state.accepted_versions(rows, ["conv_id"], "turn").select("conv_id", "turn", "accepted")


@registered("SELECT user_id AS page, count(*) AS tries, bool_or(event_type <> 'error' AND value * 1000 > 50000) AS ok FROM events GROUP BY user_id")
def attempts(spark, sf_dir):
    """Attempts by user, and whether one ended well with enough to show."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("rc"), (F.col("value") * 1000).alias("bytes"))
    return state.succeeded(rows)


@registered("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents x JOIN labels l ON l.doc_id = x.doc_id WHERE x.lang = d.lang AND x.n_chars = d.n_chars)")
def delivered_copies(spark, sf_dir):
    """Documents of which a labelled one has the same language and length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.col("n_chars").alias("bytes"))
    return state.reclaimable(docs, docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")).select("doc_id")


@registered("WITH f AS (SELECT doc_id, source || '/' || doc_id AS path, lang AS name, n_chars AS bytes, ['attempt', 'output', 'work'][doc_id % 3 + 1] AS stage FROM documents), d AS (SELECT DISTINCT name, bytes FROM f WHERE doc_id % 2 = 0) SELECT path, bytes, CASE stage WHEN 'attempt' THEN 'not taken' WHEN 'output' THEN 'delivered' ELSE 'work file' END AS reason FROM f WHERE (stage = 'attempt' AND doc_id % 4 <> 0) OR (stage = 'output' AND EXISTS (SELECT 1 FROM d WHERE d.name = f.name AND d.bytes = f.bytes)) OR stage = 'work'")
def retention_plan(spark, sf_dir):
    """What may go: attempts not taken, outputs that were delivered, work files."""
    stage = F.element_at(F.array(*map(F.lit, ("attempt", "output", "work"))), (F.col("doc_id") % 3 + 1).cast("int"))
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("name"), F.col("n_chars").alias("bytes"), stage.alias("stage"))
    return prompts.retention(files.drop("doc_id"), files.where("doc_id % 4 = 0"), files.where("doc_id % 2 = 0"), deep=True)


@registered("WITH s AS (SELECT user_id, CASE WHEN value < 5 THEN 'MISS' WHEN event_id % 9 = 6 THEN 'CORNER' WHEN event_type = 'error' THEN 'EXTRA' WHEN value > 95 THEN 'DRIFT' WHEN event_id % 4 = 1 THEN 'PUNCT' WHEN value < 40 THEN 'NEAR' ELSE 'OK' END AS status FROM events) SELECT user_id AS direction, count(*) AS n, count(*) FILTER (status <> 'OK') AS n_bad, arg_max(status, list_position(['OK', 'NEAR', 'PUNCT', 'DRIFT', 'EXTRA', 'CORNER', 'MISS'], status)) AS worst FROM s GROUP BY user_id")
def sample_statuses(spark, sf_dir):
    """The gravest status of each page, and by user how the pages came out."""
    value, n = F.col("value"), F.col("event_id")
    status = match.page_status(value < 5, n % 9 == 6, F.col("event_type") == "error", value > 95, n % 4 == 1, value < 40)
    rows = _table(spark, sf_dir, "events").select(n.alias("page"), F.col("user_id").alias("direction"), status.alias("status"))
    return prompts.sample_status(rows.select("direction", "page"), rows.select("page", "status"))


@registered("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < CAST(0.8 AS DOUBLE) THEN 'MISS' WHEN l_discount * 10 < 1 THEN 'NEAR' ELSE 'OK' END AS status FROM lineitem")
def rendering_statuses(spark, sf_dir):
    """MISS, NEAR or OK by the share found."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("ratio"))
    return match.rendering_status(rows).select("l_orderkey", "l_linenumber", "status")


@registered("""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '约 ' || p_size || '%' WHEN 1 THEN p_size || ' 万元' WHEN 2 THEN 'x' || p_size ELSE '共+' || p_size || '.5人' END AS v, 'background: deep ' || CASE WHEN p_partkey % 2 = 0 THEN '#a0b1c2 then #ffffff' ELSE 'blue' END AS d FROM part),
k AS (SELECT *, regexp_extract(v, '^\\s*(\\D*?)\\s*([+\\-−±~≈]?\\d[\\d.,]*\\s*[%‰]?)\\s*(\\D*?)\\s*$', ['a', 'b', 'c']) AS x FROM v)
SELECT p_partkey, CASE WHEN regexp_matches(x.a || x.c, '[\\x{4E00}-\\x{9FFF}]') THEN trim(x.a) || '|' || trim(x.b) || '|' || trim(x.c) END AS kpi, upper(nullif(regexp_extract(d, '(?i)background[^#\\n]*(#[0-9a-f]{6})', 1), '')) AS colour, 'deck' || coalesce(nullif('-' || p_partkey % 3, '-0'), '') || '.pptx' AS file, regexp_replace(replace(v, '万', ' million '), '[0-9]+', '#', 'g') AS cleaned FROM k""")
def value_forms(spark, sf_dir):
    """Parts of values, first colours, file names and configured replacements."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("约 "), size, F.lit("%"))).when(k % 4 == 1, F.concat(size, F.lit(" 万元"))).when(k % 4 == 2, F.concat(F.lit("x"), size)).otherwise(F.concat(F.lit("共+"), size, F.lit(".5人")))
    d = F.concat(F.lit("background: deep "), F.when(k % 2 == 0, "#a0b1c2 then #ffffff").otherwise("blue"))
    suffix = F.nullif(F.concat(F.lit("-"), (k % 3).cast("string")), F.lit("-0"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), d.alias("d"), suffix.alias("suffix"))
    kpi = text.kpi_parts(F.col("v"))
    return rows.select("p_partkey", F.when(kpi.isNotNull(), F.concat_ws("|", kpi["prefix"], kpi["number"], kpi["suffix"])).alias("kpi"), text.first_hex(F.col("d")).alias("colour"), text.file_name(F.lit("deck"), F.col("suffix"), "pptx").alias("file"), text.clean_up(F.col("v"), [("万", " million "), ("re:[0-9]+", "#")]).alias("cleaned"))


@registered("SELECT doc_id, count(*) FILTER (regexp_matches(c, '^[\\x{3400}-\\x{9FFF}]')) AS n_cjk, count(*) FILTER (regexp_matches(c, '^[A-Za-z0-9%+]')) AS n_letters, count(*) FILTER (NOT regexp_matches(c, '^[A-Za-z0-9%+\\x{3400}-\\x{9FFF}]')) AS n_marks FROM (SELECT doc_id, unnest(string_split(text || '版式', '')) AS c FROM documents) GROUP BY doc_id")
def character_classes(spark, sf_dir):
    """Characters of each text by class."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat("text", F.lit("版式")), "")).alias("c")).where("c <> ''")
    k = text.character_class(F.col("c"))
    return rows.groupBy("doc_id").agg(F.count_if(k == "C").alias("n_cjk"), F.count_if(k == "L").alias("n_letters"), F.count_if(k == "P").alias("n_marks"))


def _line_form_sql(c: str) -> str:
    kept, gone = [(k, v) for k, v in text.LINE_FORM.items() if v], "".join(k for k, v in text.LINE_FORM.items() if not v)
    plain = f"translate({c}, '{''.join(k for k, _ in kept)}{gone}', '{''.join(v for _, v in kept)}')"
    drop = _S[:-1] + "\"''.,;:!?()/|\\-~·\\p{C}\\p{Zl}\\p{Zp}]"
    return f"replace(upper(replace(regexp_replace({plain}, '{drop}', '', 'g'), 'ß', chr(1))), chr(1), 'ß')"


@registered(f"WITH l AS ({_LINES}) SELECT k AS line, count(*) AS n FROM (SELECT {_line_form_sql('line')} AS k FROM l) WHERE k <> '' GROUP BY k")
def line_forms(spark, sf_dir):
    """The second normal form of all lines, and how many have each."""
    rows = _lines(spark, sf_dir).select(text.normalise_line(F.col("line")).alias("line"))
    return rows.where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@registered("WITH a AS (SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)), f AS (SELECT 'audit.unanswered' AS rule, 'error' AS severity, source AS doc, CAST(doc_id AS VARCHAR) AS entity, 'quality, toxic' AS detail FROM a WHERE quality IS NULL UNION ALL SELECT 'audit.no_verdict', 'error', source, CAST(doc_id AS VARCHAR), NULL FROM a WHERE quality IS NULL UNION ALL SELECT 'audit.deck_wide', 'warning', source, 'text', CAST(count(*) AS VARCHAR) FROM a WHERE toxic = 1 GROUP BY source HAVING count(*) >= 3 UNION ALL SELECT 'audit.unknown_type', 'error', source, CAST(doc_id AS VARCHAR), 'bad' FROM a WHERE quality = 0 UNION ALL SELECT 'audit.deck_wide', 'warning', source, 'bad', CAST(count(*) AS VARCHAR) FROM a WHERE quality = 0 GROUP BY source HAVING count(*) >= 3) SELECT * FROM f")
def audit_findings(spark, sf_dir):
    """Labels as audit answers: what is open, unknown, or found on several pages of a source."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc")).join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    note = F.lit(None).cast("string").alias("note")
    problems = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.struct(F.lit("text").alias("type"), note)), F.when(F.col("quality") == 0, F.struct(F.lit("bad").alias("type"), note))))
    entries = rows.select("doc", F.col("doc_id").alias("page"), F.col("quality").alias("verdict"), F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("answers"), problems.alias("problems"))
    return rules.audit(entries)


@registered("WITH p AS (SELECT event_type AS g, event_id, value FROM events WHERE event_id % 3 < 2), a AS (SELECT g || event_id // 9 AS k, value FROM p) SELECT k, CASE WHEN count(*) = 2 AND max(value) - min(value) > 0.3 THEN arg_min(value, (abs(value - 50), value)) ELSE median(value) END AS offset_ FROM a GROUP BY k")
def probe_medians(spark, sf_dir):
    """Medians of probes; of two that disagree, the one nearer to what is expected."""
    rows = _table(spark, sf_dir, "events").where("event_id % 3 < 2").select(F.concat("event_type", F.expr("event_id div 9").cast("string")).alias("k"), "value")
    return stats.two_probe_median(rows, ["k"], "value", F.lit(50.0)).select("k", F.col("offset").alias("offset_"))


@registered("WITH p AS (SELECT l_orderkey, CAST(l_quantity * 5 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g, CAST(l_suppkey % 256 AS INTEGER) AS b, l_linenumber * 10 AS d FROM lineitem), m AS (SELECT l_orderkey, greatest(abs(d), abs(g - b)) AS x, greatest(r, g, b) - least(r, g, b) < 30 AS neutral, r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE) AS lum FROM p), s AS (SELECT l_orderkey, avg(x) AS mean_diff, avg(CASE WHEN x > 40 THEN 1.0 ELSE 0 END) AS share, avg(CASE WHEN neutral THEN 1.0 ELSE 0 END) AS ns, avg(CASE WHEN neutral THEN lum END) AS ml FROM m GROUP BY l_orderkey) SELECT l_orderkey, round(mean_diff, 6) AS mean_diff, round(share, 6) AS share_over_40, CASE WHEN ns >= 0.3 AND ml > 200 THEN 'light' WHEN ns >= 0.3 AND ml < 120 THEN 'dark' ELSE 'colour' END AS logo_class FROM s")
def pixel_checks(spark, sf_dir):
    """Differences of two pictures, and whether one is light, dark or coloured, with order lines as pixels."""
    g, b = F.col("l_partkey") % 256, F.col("l_suppkey") % 256
    r = (F.col("l_quantity") * 5).cast("int")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", r.alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), (r + F.col("l_linenumber") * 10).alias("r2"), b.cast("int").alias("g2"), b.cast("int").alias("b2"))
    found = stats.pixel_difference(rows, ["l_orderkey"]).join(stats.logo_class(rows, ["l_orderkey"]), "l_orderkey")
    return found.select("l_orderkey", F.round("mean_diff", 6).alias("mean_diff"), F.round("share_over_40", 6).alias("share_over_40"), "logo_class")


@registered(f"WITH l AS ({_LINES}), f AS (SELECT doc_id, n, {_end_sql('line')} AS e, {_norm_sql('line')} AS k FROM l), t AS (SELECT DISTINCT doc_id, right({_norm_sql('z')}, 6) AS tail FROM (SELECT doc_id, line || '。' AS z FROM l WHERE n % 2 = 0) WHERE length({_norm_sql('z')}) >= 2) SELECT DISTINCT f.doc_id AS page, CAST(n AS BIGINT) AS sid FROM f JOIN t ON t.doc_id = f.doc_id AND ends_with(k, tail) WHERE NOT regexp_matches(e, '[。．]$')")
def extra_stop_lines(spark, sf_dir):
    """Lines without a full stop of which a rendering ends with one."""
    rows = _lines(spark, sf_dir)
    strings = rows.select(F.col("doc_id").alias("page"), F.col("n").cast("long").alias("sid"), F.col("line").alias("text"))
    return match.extra_stops(strings, rows.where("n % 2 = 0").select(F.col("doc_id").alias("page"), F.concat("line", F.lit("。")).alias("text")))


# Decks made from conversations: a turn is a page, its first line the title, its other lines bullets.

_SLOTS = f"SELECT CAST(conv_id AS VARCHAR) AS doc, printf('p%02d', turn + 1) AS page, i, CASE WHEN i = 1 THEN 'title' ELSE 'bullet' END AS role, regexp_replace(regexp_replace(s, '^{_S}+', ''), '{_S}+$', '') AS text FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)"


@registered(f"WITH s AS ({_SLOTS}) SELECT doc, page, role, count(*) AS n, sha256(string_agg(text, '|' ORDER BY i)) AS texts FROM s WHERE text <> '' GROUP BY doc, page, role")
def deck_slots(spark, sf_dir):
    """The printed strings of each page by role, in reading order."""
    rows = outline.slots(decks(spark, sf_dir)[0]).groupBy("doc", "page", "role").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("s"))
    return rows.select("doc", "page", "role", F.size("s").cast("long").alias("n"), F.sha2(F.array_join(F.transform("s", lambda x: x.text), "|"), 256).alias("texts"))


@registered(f"WITH s AS ({_SLOTS}) SELECT doc, page, CAST(sum(CASE WHEN role = 'bullet' THEN length(regexp_replace(text, '[^\\x{{3400}}-\\x{{9FFF}}]', '', 'g')) ELSE 0 END) AS INTEGER) AS body, CAST(count(*) FILTER (text <> '') AS INTEGER) AS strings, sha256(coalesce(string_agg(text, '|' ORDER BY i) FILTER (text <> ''), '')) AS texts FROM s GROUP BY doc, page")
def deck_loads(spark, sf_dir):
    """What each page carries, and the copy that it has to show."""
    pages = decks(spark, sf_dir)[0]
    copy = outline.page_corpus(pages).select("doc", "page", F.array_join("texts", "|").alias("t"))
    rows = outline.load(pages).select("doc", "page", "body", "strings").join(copy, ["doc", "page"], "left")
    return rows.select("doc", "page", "body", "strings", F.sha2(F.coalesce("t", F.lit("")), 256).alias("texts"))


@registered("SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INTEGER) AS pos, CASE WHEN role = 'system' THEN 'dark' WHEN turn % 3 = 2 THEN 'accent' ELSE 'light' END AS page_tone FROM conversations")
def page_tones(spark, sf_dir):
    """Each page's tone: that of its kind, its own, or light."""
    pages = decks(spark, sf_dir)[0].withColumn("tone", F.when((F.col("pos") % 3 == 2) & (F.col("kind") != "cover"), "accent"))
    return outline.tones(pages, {"cover": "dark"}).select("doc", "pos", "page_tone")


@registered(f"WITH b AS (SELECT conv_id, turn, length(text) * CAST(0.55 AS DOUBLE) AS em, 100 + turn * 20 AS h FROM conversations) SELECT conv_id, turn, CAST(coalesce(list_filter([18, 17, 16, 15, 14, 13, 12, 11], lambda z: ceil(em * z / 200.0::DOUBLE) * z * CAST(1.3 AS DOUBLE) <= h)[1], 11) AS INTEGER) AS size FROM b")
def font_sizes(spark, sf_dir):
    """The largest size at which a turn fits its box."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(200.0).alias("width"), (F.col("turn") * 20 + 100).alias("height"))
    return outline.font_size(rows).select("conv_id", "turn", "size")


@registered(f"WITH t AS (SELECT conv_id AS doc, turn, string_split(text, chr(10))[1] AS a, coalesce(string_split(text, chr(10))[2], '') AS b FROM conversations WHERE NOT regexp_matches(text, '(^|\\n)(##? |⟦)')) SELECT doc, 'p' || turn AS id, regexp_replace(regexp_replace(a || chr(10) || b, '^{_S}+', ''), '{_S}+$', '') AS text FROM t")
def marked_texts(spark, sf_dir):
    """Conversations written with a mark before each turn's first two lines, and read back."""
    part = lambda i: F.coalesce(F.get(F.split("text", "\n"), i), F.lit(""))
    rows = _table(spark, sf_dir, "conversations").where(~F.rlike("text", F.lit("(^|\n)(##? |⟦)")))
    rows = rows.select(F.col("conv_id").alias("doc"), "turn", F.concat(F.lit("⟦p"), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("⟧ "), part(0), F.lit("\n"), part(1), F.lit("\n## end\nloose")).alias("line"))
    whole = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s.line), "\n").alias("text"))
    return markdown.marked(whole)


@registered(f"WITH t AS (SELECT conv_id AS doc, turn, role, string_split(text, chr(10))[1] AS a, coalesce(string_split(text, chr(10))[2], '') AS b FROM conversations WHERE NOT regexp_matches(text, '(^|\\n)\\s*(##|（)')), s AS (SELECT doc, role || turn AS section, regexp_replace(regexp_replace(a || chr(10) || b, '^{_S}+', ''), '{_S}+$', '') AS body FROM t) SELECT doc, section, body FROM s")
def markdown_sections(spark, sf_dir):
    """Conversations written as sections with hints, and read back without them."""
    part = lambda i: F.coalesce(F.get(F.split("text", "\n"), i), F.lit(""))
    rows = _table(spark, sf_dir, "conversations").where(~F.rlike("text", F.lit("(^|\n)\\s*(##|（)")))
    rows = rows.select(F.col("conv_id").alias("doc"), "turn", F.concat(F.lit("## "), "role", F.col("turn").cast("string"), F.lit("\n（hint）\n"), part(0), F.lit("\n"), part(1)).alias("line"))
    whole = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s.line), "\n").alias("text"))
    return markdown.sections(whole)


@registered("SELECT doc_id AS line_id, n_chars AS entry_id, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS authority FROM documents")
def authorities(spark, sf_dir):
    """Of three corpora's matches each line's from the highest."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.col("n_chars").alias("entry_id"))
    return match.by_authority([docs.where("line_id % 2 = 0"), docs.where("line_id % 3 = 0"), docs]).select("line_id", "entry_id", "authority")


@registered("""WITH p AS (SELECT l_orderkey, CAST(l_quantity * 5 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g, CAST(l_suppkey * 7 % 256 AS INTEGER) AS b FROM lineitem), h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM p),
c AS (SELECT *, CASE WHEN hi > 0 THEN span / CAST(hi AS DOUBLE) ELSE 0 END AS sat, CASE WHEN span = 0 THEN 0 WHEN hi = r THEN CASE WHEN g >= b THEN (g - b) / CAST(span AS DOUBLE) ELSE (g - b) / CAST(span AS DOUBLE) + 6 END WHEN hi = g THEN (b - r) / CAST(span AS DOUBLE) + 2 ELSE (r - g) / CAST(span AS DOUBLE) + 4 END / 6 AS hue FROM h)
SELECT l_orderkey % 100 AS picture, CAST(CASE WHEN sat < CAST(0.12 AS DOUBLE) THEN 36 + least(floor(hi / CAST(256 AS DOUBLE) * 3), 2) ELSE least(floor(hue * 12), 11) * 3 + least(floor((sat - CAST(0.12 AS DOUBLE)) / CAST(0.88 AS DOUBLE) * 3), 2) END AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY ALL""")
def colour_bins(spark, sf_dir):
    """Order lines as pixels, counted by picture and colour bin."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("picture"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("b"))
    return rows.groupBy("picture", stats.colour_bin(F.col("r"), F.col("g"), F.col("b")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# Turns as lines, and drafts of them without spaces; a line has one character misread and one lost.

_FIRST = "role || ' ' || coalesce(string_split(text, chr(10))[1], '')"


def _misread(spark, sf_dir):
    first = F.concat("role", F.lit(" "), F.coalesce(F.get(F.split("text", "\n"), 0), F.lit("")))
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_id"), first.alias("first"))
    lines = rows.select("line_id", F.concat("first", F.lit(" 龘7 ed")).alias("line"))
    entries = rows.select(F.col("line_id").alias("entry_id"), F.concat(F.regexp_replace("first", " ", ""), F.lit("q7end")).alias("entry"))
    return rows.select("line_id", F.col("line_id").alias("entry_id")), lines, entries


@registered(f"SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS line_id, CAST(conv_id AS BIGINT) * 1000 + turn AS entry_id, {_FIRST} || ' 龘7 ed' AS line, {_FIRST} || ' q7 end' AS text FROM conversations")
def corrected_lines(spark, sf_dir):
    """Lines with their draft's wording, in their own spaces."""
    return match.corrected_lines(*_misread(spark, sf_dir))


@registered("SELECT CAST(conv_id AS BIGINT) * 1000 + turn AS line_id, '龘>q|>n' AS changes FROM conversations")
def draft_changes(spark, sf_dir):
    """Where a line's wording isn't its draft's."""
    rows = prompts.draft_differences(*_misread(spark, sf_dir))
    return rows.select("line_id", F.array_join(F.transform("changes", lambda c: F.concat(c.page, F.lit(">"), c.draft)), "|").alias("changes"))


@registered("""WITH l AS (SELECT l_orderkey % 100 AS picture, floor((CAST(l_quantity * 5 AS BIGINT) * 19595 + CAST(l_partkey % 256 AS BIGINT) * 38470 + CAST(l_suppkey * 7 % 256 AS BIGINT) * 7471 + 32768) / 65536.0::DOUBLE) AS lum FROM lineitem),
t AS (SELECT picture, avg(lum) AS mean, stddev_pop(lum) > 22 AS busy FROM l GROUP BY picture) SELECT picture, round(mean, 4) AS mean, mean < 110 OR busy AS dark, busy FROM t""")
def corner_tones(spark, sf_dir):
    """Order lines as a corner's pixels: how dark it is, and whether it is busy."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("picture"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") * 7 % 256).alias("b"))
    return stats.corner_tone(rows, ["picture"]).withColumn("mean", F.round("mean", 4))
