"""The registered queries over the reference's own operators, each with the SQL that gives the same rows.

The driver's tables stand in for the documents: a conversation is a deck and its turns are pages, a document's lines
are strings, the benchmark is an authoritative copy, labels are verdicts, events are a log, embeddings are picture
signatures, raw pages are sources, order lines are facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.functions import text
from docaudit.operators import contain, geometry, graph, match, order, state, stats, vote
from docaudit.plans import rules
from docaudit.sources import markdown, outline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that checks it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The normal form in SQL: marks to their plain form, white space and marks dropped, ß as SS, upper case.
_FROM, _TO, _GONE = "".join(k for k, v in text.PLAIN_FORM.items() if v), "".join(v for v in text.PLAIN_FORM.values() if v), "".join(k for k, v in text.PLAIN_FORM.items() if not v)


def _norm_sql(c: str) -> str:
    plain = f"translate({c}, '{_FROM}{_GONE}', '{_TO}')"
    drop = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\"''.,;:!?()/|\\-~·+*#]"
    return f"upper(replace(regexp_replace({plain}, '{drop}', '', 'g'), 'ß', 'SS'))"


_LINES = "SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


# Text forms and groups


@registered(f"SELECT min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, sha256({_norm_sql('text')}) AS k FROM documents WHERE text IS NOT NULL) GROUP BY k HAVING count(*) > 1")
def dup_normalised(spark, sf_dir):
    """Documents that are the same but for punctuation, space and case."""
    k = F.sha2(text.normalise(F.col("text")), 256)
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", k.alias("k"))
    return docs.groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("k")


@registered(f"WITH l AS ({_LINES}), d AS (SELECT DISTINCT doc_id, {_norm_sql('line')} AS k FROM l) SELECT k AS line, count(*) AS n_docs FROM d WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def repeated_lines(spark, sf_dir):
    """Lines that are in several documents."""
    rows = _lines(spark, sf_dir).select("doc_id", text.normalise(F.col("line")).alias("line")).where("line <> ''").distinct()
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")


@registered(f"WITH l AS ({_LINES}), e AS (SELECT doc_id, count(*) AS n, count(*) FILTER (rtrim(line, ' ') LIKE '%.') AS stops FROM l WHERE trim(line, ' ') <> '' GROUP BY doc_id) SELECT doc_id, n AS n_lines, stops AS n_stops FROM e WHERE n > 1 AND stops > 0 AND stops < n")
def mixed_line_endings(spark, sf_dir):
    """Documents some of whose lines end in a full stop."""
    rows = _lines(spark, sf_dir).where("trim(line) <> ''")
    found = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.endswith(F.rtrim("line"), F.lit("."))).alias("n_stops"))
    return found.where("n_lines > 1 AND n_stops > 0 AND n_stops < n_lines")


@registered("SELECT doc_id, length(text) AS n_chars_counted, length(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS n_visible, round(c + (length(text) - c) * CAST(0.55 AS DOUBLE), 6) AS width FROM (SELECT doc_id, text || t.tail AS text, length(regexp_replace(text || t.tail, '[^\\x{3400}-\\x{9FFF}]', '', 'g')) AS c FROM documents, (SELECT ' 版式　宽度' AS tail) t WHERE text IS NOT NULL)")
def text_lengths(spark, sf_dir):
    """Lengths and estimated width of all texts, each with a CJK tail."""
    t = F.col("text")
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit(" 版式　宽度")).alias("text"))
    return rows.select("doc_id", F.length(t).cast("long").alias("n_chars_counted"), text.visible_length(t).cast("long").alias("n_visible"), F.round(text.width_em(t), 6).alias("width"))


@registered("SELECT p_partkey, regexp_replace(lower(p_type), '[\\s·・,，、/／+＋()（）-]', '', 'g') AS k, CASE WHEN p_size * 50000 >= 1000000 THEN printf('%.1f MB', p_size * 50000 / 1e6) ELSE printf('%d KB', p_size * 50000 // 1000) END AS human, round_even(p_retailprice * 4, 0) / 4 AS quarter FROM part")
def scalar_forms(spark, sf_dir):
    """Category keys, readable sizes and quarters."""
    return _table(spark, sf_dir, "part").select("p_partkey", text.category_key(F.col("p_type")).alias("k"), text.human_bytes(F.col("p_size") * 50000).alias("human"), text.quarter(F.col("p_retailprice")).alias("quarter"))


_FACT_SQL = text.FACT.replace("'", "''")


@registered(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, replace(regexp_replace(unnest(regexp_extract_all(text, '{_FACT_SQL}')), '\\s+', '', 'g'), '％', '%') AS token FROM documents) GROUP BY doc_id, token")
def fact_tokens(spark, sf_dir):
    """Numbers, Latin words and quoted spans of each document."""
    found = text.facts(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@registered(f"""WITH w AS (SELECT conv_id, turn, replace(regexp_replace(unnest(regexp_extract_all(text, '{_FACT_SQL}')), '\\s+', '', 'g'), '％', '%') AS fact FROM conversations),
c AS (SELECT conv_id, turn, fact, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT conv_id, turn, fact, n AS n_before, 0 AS n_after FROM c UNION ALL SELECT conv_id, turn - 1, fact, 0, n FROM c WHERE turn > 0),
d AS (SELECT conv_id, turn, fact, sum(n_before) AS a, sum(n_after) AS z FROM b GROUP BY ALL HAVING sum(n_before) <> sum(n_after))
SELECT conv_id, turn, count(*) AS n_changed, CAST(sum(z - a) AS BIGINT) AS net FROM d GROUP BY conv_id, turn""")
def fact_multiset_diff(spark, sf_dir):
    """Facts that a turn has more or less often than the next one."""
    turns = _table(spark, sf_dir, "conversations")
    key = lambda n: F.struct("conv_id", n.alias("turn")).alias("at")
    before, after = turns.select(key(F.col("turn")), "text"), turns.where("turn > 0").select(key(F.col("turn") - 1), "text")
    both = state.fact_differences(before, after, "at", "text")
    return both.groupBy("at.conv_id", "at.turn").agg(F.count(F.lit(1)).alias("n_changed"), F.sum(F.col("n_after") - F.col("n_before")).alias("net"))


@registered("SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_old, CAST(n_new AS BIGINT) AS n_new FROM (SELECT *, length(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS n_new FROM conversations) WHERE n_new > length(text) * 1.25 AND n_new > length(text) + 5")
def grown_turns(spark, sf_dir):
    """Turns whose next one is over a quarter longer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, sf_dir, "conversations").withColumn("after", F.lead("text").over(w))
    return rows.where(text.grew(F.col("text"), F.col("after"))).select("conv_id", "turn", F.length("text").cast("long").alias("n_old"), F.length("after").cast("long").alias("n_new"))


@registered("SELECT DISTINCT segment FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS segment FROM documents) WHERE length(segment) BETWEEN 2 AND 160 AND regexp_matches(segment, '[a-zA-Z0-9à-ÿÀ-ÿ]') AND NOT regexp_matches(segment, '[|；;「」“”\"*_`#>+-]') AND NOT regexp_matches(segment, '^[0-9]+[.)]')")
def corpus_segments(spark, sf_dir):
    """Distinct segments of the documents' texts, those without marks of any kind."""
    found = outline.segments(_table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    plain = ~F.rlike("segment", F.lit("[|；;「」“”\"*_`#>+-]")) & ~F.rlike("segment", F.lit("^[0-9]+[.)]")) & F.rlike("segment", F.lit("[a-zA-Z0-9à-ÿÀ-ÿ]"))
    whole = _lines(spark, sf_dir).select(F.trim("line").alias("segment")).distinct()
    return found.where(plain).join(whole, "segment", "left_semi")


@registered("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS idx, level, heading FROM (SELECT page_id, i, CAST(regexp_extract(h, '<h([1-6])', 1) AS INTEGER) AS level, regexp_extract(h, '<h[1-6][^>]*>([^<]*)</h', 1) AS heading FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>') AS hs FROM pages)))")
def html_headings(spark, sf_dir):
    """Headings of raw pages in order."""
    found = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*</h[1-6]>"), F.lit(0))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("idx", "h"))
    return rows.select("page_id", F.col("idx").cast("long").alias("idx"), F.regexp_extract("h", "<h([1-6])", 1).cast("int").alias("level"), F.regexp_extract("h", "<h[1-6][^>]*>([^<]*)</h", 1).alias("heading"))


@registered("SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY turn) - 1 AS idx, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, text FROM (SELECT conv_id AS doc, turn, role, regexp_replace(trim(string_split(text, chr(10))[1], ' '), '#*$', '') AS text FROM conversations) WHERE text <> ''")
def markdown_headings(spark, sf_dir):
    """Conversations written as Markdown, a heading a turn, and read back."""
    line = F.regexp_replace(F.trim(F.element_at(F.split("text", "\n"), 1)), "#*$", "")
    level = F.when(F.col("role") == "system", "#").when(F.col("role") == "user", "##").otherwise("###")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn", F.when(line != "", F.concat(level, F.lit(" "), line, F.lit(" ##"))).alias("line"))
    whole = turns.where("line IS NOT NULL").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s.line), "\n\nprose\n").alias("text"))
    return markdown.headings(whole).select("doc", F.col("idx").cast("long").alias("idx"), "level", "text")


# Order


@registered("WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, role, CAST(sum(new) AS BIGINT) AS runs FROM c GROUP BY conv_id, role HAVING sum(new) > 1")
def role_islands(spark, sf_dir):
    """Roles that come in several runs of a conversation."""
    return order.split_values(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@registered("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b = event_type")
def adjacent_same(spark, sf_dir):
    """Events of the type of the user's event before."""
    return order.same_as_before(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@registered("SELECT conv_id, turn, role FROM (SELECT *, lag(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE b = role AND n >= 6")
def lag2_same(spark, sf_dir):
    """Turns of the role two before, in conversations of six or more."""
    rows = order.with_size(_table(spark, sf_dir, "conversations"), ["conv_id"]).where("n_rows >= 6")
    return order.same_as_before(rows, ["conv_id"], ["turn"], "role", 2).select("conv_id", "turn", "role")


@registered("SELECT conv_id, role, used, greatest(2, CAST(ceil(n / 4.0) AS BIGINT)) AS quota FROM (SELECT conv_id, role, count(*) AS used, sum(count(*)) OVER (PARTITION BY conv_id) AS n FROM conversations GROUP BY conv_id, role) WHERE used > greatest(2, CAST(ceil(n / 4.0) AS BIGINT))")
def role_quota(spark, sf_dir):
    """Roles used more often than a quarter of the turns, two at least."""
    return order.over_quota(_table(spark, sf_dir, "conversations"), ["conv_id"], "role", 2, 0.25).select("conv_id", "role", "used", "quota")


@registered("WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id), f AS (SELECT e.user_id, event_id, ts, bool_and(value > med) OVER w AS hit, count(*) OVER w AS n FROM events e JOIN m USING (user_id) WINDOW w AS (PARTITION BY e.user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM f WHERE hit AND n = 6 GROUP BY user_id")
def dense_frame6(spark, sf_dir):
    """Each user's first six events in a row above their median."""
    events = _table(spark, sf_dir, "events")
    med = stats.group_medians(events, ["user_id"], {"med": F.col("value")})
    return order.first_frame(events.join(med, "user_id"), ["user_id"], ["ts", "event_id"], F.col("value") > F.col("med"), 6).select("user_id", "event_id")


@registered("WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id), f AS (SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS pos, value > med AS hit FROM events e JOIN m USING (user_id)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, hit ORDER BY pos) AS run FROM f) SELECT user_id, CAST(min(pos) AS INTEGER) AS starts_at, count(*) AS n FROM g WHERE hit GROUP BY user_id, run HAVING count(*) > 3")
def long_value_runs(spark, sf_dir):
    """Runs of over three events above the user's median."""
    events = _table(spark, sf_dir, "events")
    med = stats.group_medians(events, ["user_id"], {"med": F.col("value")})
    return order.long_runs(events.join(med, "user_id"), ["user_id"], ["ts", "event_id"], F.col("value") > F.col("med"), 3).select("user_id", "starts_at", "n")


@registered("WITH c AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN n = 1 OR n = total THEN '' WHEN role = 'system' THEN 'A' || CAST(a AS BIGINT) ELSE printf('%02d', n) END AS label FROM c")
def page_labels(spark, sf_dir):
    """Turn labels: none for the first and last, system turns numbered apart."""
    kind = F.when(F.col("role") == "system", "appendix").otherwise("content")
    return order.labels(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], kind).select("conv_id", "turn", "label")


@registered("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role = 'assistant' AS t FROM conversations), f AS (SELECT *, min(CASE WHEN t THEN pos END) OVER (PARTITION BY conv_id) AS first FROM r) SELECT conv_id, bool_or(pos >= first AND NOT t) AS broken FROM f WHERE first IS NOT NULL GROUP BY conv_id")
def tail_position(spark, sf_dir):
    """Whether anything but answers follows the first answer."""
    return order.misplaced_tail(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "assistant", F.lit(False)).select("conv_id", "broken")


@registered("SELECT conv_id, turn, (SELECT arg_min(b.text, b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant') AS answer FROM conversations a WHERE role = 'user'")
def next_answer(spark, sf_dir):
    """The next answer to each user turn."""
    rows = _table(spark, sf_dir, "conversations")
    return rows.withColumn("answer", order.next_where(rows, ["conv_id"], ["turn"], F.col("text"), F.col("role") == "assistant")).where("role = 'user'").select("conv_id", "turn", "answer")


@registered("WITH d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, r AS rank, n - 3 AS others FROM d WHERE r <= 3 AND n > 6")
def topk_per_group(spark, sf_dir):
    """The three longest documents of sources with over six, and how many more there are."""
    docs = order.with_size(_table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"]).where("n_rows > 6")
    return order.top_per_group(docs, ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("others").cast("long").alias("others"))


@registered("SELECT l_orderkey, CAST(min(v) AS BIGINT) AS next_free FROM (SELECT l_orderkey, l_linenumber + 1 AS v FROM lineitem WHERE l_linenumber >= 1 UNION ALL SELECT DISTINCT l_orderkey, 1 FROM lineitem) c WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = c.l_orderkey AND x.l_linenumber = c.v) GROUP BY l_orderkey")
def next_free_version(spark, sf_dir):
    """Each order's least line number that isn't used."""
    return order.next_free(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@registered("SELECT source, first_lang, n_langs FROM (SELECT source, arg_min(lang, doc_id) AS first_lang, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source)")
def first_seen_values(spark, sf_dir):
    """The language that a source begins with, and how many it has."""
    seen = graph.first_seen(_table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source"], "lang", ["doc_id"])
    return seen.groupBy("source").agg(F.min_by("lang", "first_doc_id").alias("first_lang"), F.count(F.lit(1)).alias("n_langs"))


# Aggregates and facts


@registered("SELECT l_partkey, l_suppkey, count(DISTINCT l_discount) AS n_values FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_discount) > 1")
def conflicting_discount(spark, sf_dir):
    """Part and supplier with several discounts."""
    return stats.conflicts(_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_discount")


@registered("SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def multi_supplier_parts(spark, sf_dir):
    """Parts that an order has from several suppliers."""
    return stats.conflicts(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_suppkey").withColumnRenamed("n_values", "n_suppliers")


@registered("SELECT source, count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def audit_missing(spark, sf_dir):
    """Verdicts by source, unanswered ones among them."""
    both = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("has").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@registered("SELECT quality, toxic, count(DISTINCT source) AS n_sources, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic HAVING count(DISTINCT source) >= 3")
def deck_wide_problems(spark, sf_dir):
    """Verdicts that three sources or more have."""
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n")).where("n_sources >= 3")


@registered("SELECT c.conv_id, string_agg(r, ',' ORDER BY r) AS missing FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (VALUES ('assistant'), ('system'), ('user')) v(r) WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r) GROUP BY c.conv_id")
def role_coverage(spark, sf_dir):
    """Conversations that lack a role, and which."""
    has = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("has"))
    lack = F.array_except(F.array(*map(F.lit, ("assistant", "system", "user"))), F.col("has"))
    return has.select("conv_id", F.array_join(F.array_sort(lack), ",").alias("missing")).where("missing <> ''")


@registered("SELECT source, CAST(sum(n * (c - 1)) AS BIGINT) AS reclaimable FROM (SELECT source, text, max(length(text)) AS n, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY source, text HAVING count(*) > 1) GROUP BY source")
def reclaimable(spark, sf_dir):
    """Characters of exact copies beyond the first, by source."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("n"))
    return docs.groupBy("source", "h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("source").agg(F.sum(F.col("n") * (F.col("c") - 1)).alias("reclaimable"))


@registered("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS n_high, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def delivery_statistics(spark, sf_dir):
    """Counts by two properties, in the way a delivery is reported."""
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_high"), F.sum("l_quantity").alias("quantity"))


# Statistics


@registered("WITH m AS (SELECT lang, median(n_chars) AS med FROM documents GROUP BY lang) SELECT doc_id, lang, n_chars, med AS median FROM documents JOIN m USING (lang) WHERE abs(n_chars - med) > 3 * med")
def char_outliers(spark, sf_dir):
    """Documents whose length is over three medians from the language's."""
    return stats.outliers(_table(spark, sf_dir, "documents").drop("text"), ["lang"], F.col("n_chars"), 3).select("doc_id", "lang", "n_chars", "median")


@registered("WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type) SELECT event_type, round(any_value(med), 6) AS median, round(median(abs(value - med)), 6) AS mad, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY event_type")
def median_deviation(spark, sf_dir):
    """Medians and the medians of distances from them."""
    rows = stats.median_deviation(_table(spark, sf_dir, "events"), ["event_type"], F.col("value"))
    return rows.groupBy("event_type").agg(F.round(F.min("median"), 6).alias("median"), F.round(F.min("mad"), 6).alias("mad"), F.count(F.lit(1)).alias("n"))


_UNITS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id)"


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", stats.unit(F.col("embedding")).alias("v"))


@registered(f"{_UNITS} SELECT a, b, round(s, 6) AS similarity FROM p ORDER BY s DESC, a DESC, b DESC LIMIT 8")
def top_similar_pairs(spark, sf_dir):
    """The eight most similar pairs of vectors."""
    return stats.top_pairs(_vectors(spark, sf_dir), "vec_id", "v", 8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@registered(f"{_UNITS} SELECT count(*) AS n_pairs, round(avg(s), 6) AS mean, count(*) FILTER (s >= 0.5) AS n_close FROM p")
def similarity_summary(spark, sf_dir):
    """How alike all vectors are."""
    return stats.similarity_report(_vectors(spark, sf_dir), "vec_id", "v", 0.5).select("n_pairs", F.round("mean", 6).alias("mean"), "n_close")


@registered(f"{_UNITS}, c AS (SELECT * FROM p WHERE s >= 0.5) SELECT vec_id, count(*) AS n_close FROM (SELECT a AS vec_id FROM c UNION ALL SELECT b FROM c) GROUP BY vec_id")
def flagged_vectors(spark, sf_dir):
    """Vectors that are close to another, and to how many."""
    return stats.close_counts(_vectors(spark, sf_dir), "vec_id", "v", 0.5)


@registered("WITH b AS (SELECT source, least(38, CAST(floor(n_chars / 250.0) AS BIGINT)) AS bin, count(*) AS n FROM documents GROUP BY ALL) SELECT source, bin, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 6) AS share FROM b")
def histogram_signature(spark, sf_dir):
    """A length histogram of 39 bins for each source."""
    bin_of = F.least(F.lit(38), F.floor(F.col("n_chars") / 250)).cast("long")
    return stats.histogram(_table(spark, sf_dir, "documents").select("source", "n_chars"), ["source"], bin_of).select("source", "bin", F.round("share", 6).alias("share"))


@registered("WITH s AS (SELECT sum(l_quantity*l_quantity) xx, sum(l_quantity*l_tax) xy, sum(l_tax*l_tax) yy, sum(l_quantity*l_extendedprice) xz, sum(l_tax*l_extendedprice) yz FROM lineitem) SELECT round((xz*yy-yz*xy)/(xx*yy-xy*xy), 3) AS a, round((yz*xx-xz*xy)/(xx*yy-xy*xy), 1) AS b FROM s")
def length_fit(spark, sf_dir):
    """Price by quantity and tax, least squares without intercept."""
    fit = stats.fit_two(_table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice"))
    return fit.select(F.round("a", 3).alias("a"), F.round("b", 1).alias("b"))


@registered("WITH t AS (SELECT s_nationkey, l_returnflag, sum(l_quantity * l_tax) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT s_nationkey, arg_min(l_returnflag, (total, l_returnflag)) AS l_returnflag FROM t GROUP BY s_nationkey")
def weighted_choice(spark, sf_dir):
    """The return flag of least weighted total for each nation."""
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return stats.best_by_weight(rows, ["s_nationkey"], "l_returnflag", F.col("l_quantity"), F.col("l_tax")).select("s_nationkey", "l_returnflag")


# Matching


@registered("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contained_benchmark(spark, sf_dir):
    """Benchmark items that a document holds whole."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return contain.contained(_table(spark, sf_dir, "documents").select("doc_id", "text"), items)


@registered(f"""WITH l AS ({_LINES}), q AS (SELECT doc_id, n, line, length(line) AS len FROM l WHERE length(line) >= 5),
a AS (SELECT DISTINCT doc_id, n, len, substr(line, CAST(i AS INTEGER), 5) AS g FROM (SELECT *, unnest(generate_series(1, len - 4)) AS i FROM q)),
b AS (SELECT DISTINCT item_id, substr(text, CAST(i AS INTEGER), 5) AS g FROM (SELECT item_id, text, unnest(generate_series(1, length(text) - 4)) AS i FROM benchmark)),
s AS (SELECT a.doc_id, a.n, a.len, item_id, count(*) AS n_shared FROM a JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, CAST(n AS BIGINT) AS line_no, item_id, n_shared FROM s WHERE n_shared >= greatest(1, CAST(floor(CAST(0.45 AS DOUBLE) * (len - 4)) AS BIGINT))""")
def ngram_candidates(spark, sf_dir):
    """Lines and benchmark items that share many five-character grams."""
    lines = _lines(spark, sf_dir).where(F.length("line") >= 5).select(F.struct("doc_id", "n").alias("line_id"), "line")
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("entry"))
    found = match.candidates(lines, items, 5)
    return found.select("line_id.doc_id", F.col("line_id.n").cast("long").alias("line_no"), F.col("entry_id").alias("item_id"), "n_shared")


@registered()
def benchmark_matches(spark, sf_dir):
    """The benchmark item that each line may stand for, by index, alignment and the acceptance rules."""
    lines = _lines(spark, sf_dir).where(F.length("line") >= 6).select(F.struct("doc_id", "n").alias("line_id"), "line")
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("entry"))
    return match.corpus_match(lines, items, n=6).select("line_id.doc_id", F.col("line_id.n").alias("line_no"), F.col("entry_id").alias("item_id"), "score")


@registered("SELECT p_partkey, p_size, arg_min(g, (abs(g - p_size), g)) AS grid FROM part CROSS JOIN (SELECT CAST(unnest(generate_series(0, 60, 4)) AS DOUBLE) AS g) GROUP BY p_partkey, p_size")
def nearest_size(spark, sf_dir):
    """The grid size nearest to each part's, the lower one of two."""
    grid = spark.range(0, 61, 4).select(F.col("id").cast("double").alias("key"), F.col("id").cast("double").alias("offset"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_size").cast("double").alias("v"))
    return match.nearest(rows, "v", grid, 4.0, 2.0, F.lit(None).cast("double")).select("p_partkey", "p_size", F.col("offset").alias("grid"))


@registered("SELECT a.s_nationkey AS nation, CAST(floor(a.s_acctbal / 1000) AS BIGINT) AS band, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND floor(a.s_acctbal / 1000) = floor(b.s_acctbal / 1000) AND a.s_suppkey < b.s_suppkey")
def distinct_pairs(spark, sf_dir):
    """Pairs of suppliers of one nation and balance band."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("band"), "s_suppkey")
    return graph.pairwise_equal(rows, "s_suppkey", ["nation"], "band")


@registered(f"WITH l AS ({_LINES}), t AS (SELECT doc_id, {_norm_sql('text')} AS whole FROM documents) SELECT count(*) AS n_lines, count(*) FILTER (contains(whole, {_norm_sql('line')})) AS n_found FROM l LEFT JOIN t ON t.doc_id = l.doc_id + 1 WHERE line <> ''")
def lines_in_text(spark, sf_dir):
    """How many lines the text of the document after theirs holds."""
    rows = _lines(spark, sf_dir).where("line <> ''").select((F.col("doc_id") + 1).alias("page"), F.col("n").alias("pos"), F.col("line").alias("text"))
    lost = match.missing_text(rows, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.lit(0).alias("pos"), "text")).agg(F.count(F.lit(1)).alias("lost"))
    return rows.agg(F.count(F.lit(1)).alias("n_lines")).select("n_lines", (F.col("n_lines") - lost.scalar()).alias("n_found"))


# State


@registered("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_docs(spark, sf_dir):
    """Documents without a verdict."""
    return _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@registered("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY user_id")
def latest_ok_event(spark, sf_dir):
    """Each user's last event that isn't an error."""
    return state.latest(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "ts")


@registered("SELECT conv_id, substr(sha256(string_agg(sha256(role || chr(9) || text), chr(10) ORDER BY turn)), 1, 16) AS signature FROM conversations GROUP BY conv_id")
def conv_signature(spark, sf_dir):
    """A hash of each conversation's turns in order."""
    return state.signature(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.concat("role", F.lit("\t"), "text"))


@registered("SELECT d.doc_id, d.n_chars = o.n_chars AND l.doc_id IS NULL AS kept FROM documents d JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents) o USING (doc_id) LEFT JOIN labels l USING (doc_id)")
def kept_entries(spark, sf_dir):
    """Entries that stay as they are: unchanged, and not asked for anew."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    old = docs.withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return state.keep_unchanged(old, docs, "doc_id", "n_chars", _table(spark, sf_dir, "labels").select("doc_id")).select("doc_id", "kept")


@registered("WITH p AS (SELECT conv_id || '.' || turn AS id, role, text FROM conversations), a AS (SELECT id, role, text AS old, CASE WHEN role = 'system' THEN '' WHEN role = 'user' THEN text || ' 42 more words here' ELSE text END AS new FROM p) SELECT rule, severity, count(*) AS n FROM (SELECT 'import.emptied' AS rule, 'error' AS severity FROM a WHERE new = '' UNION ALL SELECT 'import.facts', 'error' FROM a WHERE new <> '' AND new <> old UNION ALL SELECT 'import.newline', 'error' FROM a WHERE contains(new, chr(10)) UNION ALL SELECT 'import.grew', 'warning' FROM a WHERE length(new) > length(old) * 1.25 AND length(new) > length(old) + 5) GROUP BY rule, severity")
def import_check(spark, sf_dir):
    """What stands against taking an edited copy of the conversations."""
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("id"), "role", "text")
    new = F.when(F.col("role") == "system", "").when(F.col("role") == "user", F.concat("text", F.lit(" 42 more words here"))).otherwise(F.col("text"))
    return state.import_findings(rows, rows.select("id", new.alias("text")), rows.select("id", "text")).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@registered("WITH s AS (SELECT conv_id, substr(sha256(string_agg(sha256(role || chr(9) || text), chr(10) ORDER BY turn)), 1, 16) AS now, substr(sha256(string_agg(sha256(role || chr(9) || CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN text || ' more' ELSE text END), chr(10) ORDER BY turn)), 1, 16) AS was FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN 'approval.missing' ELSE 'approval.changed' END AS rule FROM s WHERE conv_id % 4 = 1 OR now <> was")
def approval_state(spark, sf_dir):
    """Conversations that aren't approved, or have changed since."""
    now = conv_signature(spark, sf_dir).withColumnRenamed("conv_id", "doc")
    edited = F.when((F.col("turn") == 1) & (F.col("conv_id") % 4 == 0), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    before = _table(spark, sf_dir, "conversations").where("conv_id % 4 <> 1").withColumn("text", edited)
    was = state.signature(before, ["conv_id"], ["turn"], F.concat("role", F.lit("\t"), "text")).withColumnRenamed("conv_id", "doc")
    return rules.approval(now, was).select(F.col("doc").alias("conv_id"), "rule")


@registered("WITH RECURSIVE e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON a.text = b.text), r AS (SELECT x, min(y) AS c, count(*) AS n FROM e GROUP BY x) SELECT c AS component, count(*) AS size FROM r WHERE n > 1 GROUP BY c")
def components_small(spark, sf_dir):
    """Components of equal texts and their sizes: each copy is linked with the one before it."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h")).where("h IS NOT NULL")
    before = F.lag("id").over(Window.partitionBy("h").orderBy("id"))
    edges = docs.select(F.col("id").alias("a"), before.alias("b")).where("b IS NOT NULL")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return graph.components(ends, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


# Geometry and hierarchy over boxes and trees made from the tables


@registered("SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice / 1000 BETWEEN 5 AND 25")
def boxes_inside(spark, sf_dir):
    """Order lines as points inside an area: a containment join by grid cells."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("p").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 1000).alias("y0"), F.col("l_quantity").alias("x1"), (F.col("l_extendedprice") / 1000).alias("y1"))
    area = spark.createDataFrame([("p", 10.0, 5.0, 20.0, 25.0)], "page string, x0 double, y0 double, x1 double, y1 double")
    return geometry.centres_inside(rows, area, cell=5.0).select("l_orderkey", "l_linenumber")


@registered("WITH h AS (SELECT conv_id AS doc, turn AS idx, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lv FROM conversations), l AS (SELECT doc, idx, lv - min(lv) OVER (PARTITION BY doc) + 1 AS level FROM h) SELECT doc, idx, CAST(level AS INTEGER) AS level, (SELECT max(p.idx) FROM l p WHERE p.doc = l.doc AND p.idx < l.idx AND p.level < l.level) AS parent FROM l")
def heading_tree(spark, sf_dir):
    """Turns as headings by role, each with the one above it."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    heads = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), level.alias("level"), "text")
    return graph.heading_tree(heads, 3).select("doc", "idx", "level", "parent")


@registered("WITH h AS (SELECT conv_id AS doc, turn AS idx, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lv FROM conversations), l AS (SELECT doc, idx, lv - min(lv) OVER (PARTITION BY doc) + 1 AS level FROM h), t AS (SELECT doc, idx, (SELECT max(p.idx) FROM l p WHERE p.doc = l.doc AND p.idx < l.idx AND p.level < l.level) AS parent, idx % 4 = 1 AS used FROM l), u AS (SELECT t.doc, t.idx, bool_or(a.used) AS covered FROM t JOIN t a ON a.doc = t.doc AND (a.idx = t.idx OR a.idx = t.parent OR a.parent = t.idx OR a.idx = (SELECT p.parent FROM t p WHERE p.doc = t.doc AND p.idx = t.parent) OR (SELECT p.parent FROM t p WHERE p.doc = a.doc AND p.idx = a.parent) = t.idx) GROUP BY t.doc, t.idx) SELECT doc, count(*) FILTER (covered) AS n_covered, count(*) AS n FROM u GROUP BY doc")
def covered_headings(spark, sf_dir):
    """Headings that are used themselves, below or above a used one."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    heads = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), level.alias("level"), "text")
    tree = graph.heading_tree(heads, 3)
    covered = graph.covered_headings(tree, tree.where("idx % 4 = 1").select("doc", "idx"))
    return covered.groupBy("doc").agg(F.count_if("covered").alias("n_covered"), F.count(F.lit(1)).alias("n"))


@registered(f"WITH l AS ({_LINES}), d AS (SELECT unnest([2, 3, 4]) AS depth), c AS (SELECT doc_id, n, length(line) AS k FROM l), s AS (SELECT a.doc_id, a.n, depth, sum(b.k) AS k FROM c a, d, c b WHERE b.doc_id = a.doc_id AND b.n BETWEEN a.n AND a.n + depth - 1 AND b.n // 5 = a.n // 5 GROUP BY a.doc_id, a.n, depth HAVING count(*) = depth) SELECT CAST(doc_id AS VARCHAR) AS page, depth, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, depth")
def column_chains(spark, sf_dir):
    """Lines of documents as boxes stacked in a column, with a gap after each five: chains of two to four."""
    y = F.col("n") * 12.0 + F.floor(F.col("n") / 5) * 30
    rows = _lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("page"), F.col("n").cast("long").alias("pos"), F.col("line").alias("text"), F.lit(0.0).alias("x0"), y.alias("y0"), F.least(F.length("line"), F.lit(80)).cast("double").alias("x1"), (y + 10).alias("y1"))
    return geometry.column_chains(rows).groupBy("page", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@registered()
def voted_turns(spark, sf_dir):
    """Three readings of each turn merged: two agree on what the first has wrong."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("right"), F.regexp_replace("text", "^(.)e", "$1c").alias("page"))
    lines = rows.select(F.struct("conv_id", "turn").alias("line_id"), "page", F.array("right", "right").alias("readings"))
    return vote.voted(lines).select("line_id.conv_id", "line_id.turn", "merged")


@registered()
def deck_findings(spark, sf_dir):
    """Conversations audited as decks: the whole storyline, visual, capacity and punctuation rule sets."""
    pages, settings = decks(spark, sf_dir)
    none = spark.createDataFrame([], "doc string, idx int, level int, text string"), spark.createDataFrame([], "doc string, text string"), spark.createDataFrame([], "doc string, name string"), spark.createDataFrame([], "doc string, source string, reason string")
    found = rules.union([rules.storyline(pages, settings, *none), rules.visual(pages, settings), rules.punctuation(outline.slots(pages))])
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def decks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations in the shape of decks: a turn is a page, its first line the title, its other lines bullets."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("pos"), "role", F.split("text", "\n").alias("ls"))
    item = lambda s: F.struct(s.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("label", "title", "value")))
    block = F.struct(
        F.lit("bullets").alias("type"), *(F.lit(None).cast("string").alias(c) for c in ("text", "source", "caption", "visual")), F.transform(F.slice("ls", F.lit(2), F.size("ls")), item).alias("items"), F.lit(None).cast("array<string>").alias("header"),
        F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("array<struct<title:string,items:array<string>>>").alias("columns"),
    )
    null = {c: F.lit(None).cast("string").alias(c) for c in ("tone", "kicker", "subtitle", "takeaway", "footnote", "notes", "layout_hint", "image_hint")}
    brief = F.struct(F.lit("m").alias("message"), F.lit("list").alias("structure"), F.col("role").alias("form"), F.lit("f").alias("focal"), F.when(F.col("role") == "user", "cards").otherwise("split").alias("skeleton"), F.lit(None).cast("string").alias("motif"), F.lit(None).cast("map<string,string>").alias("variant"))
    pages = rows.select("doc", "pos", F.format_string("p%02d", F.col("pos") + 1).alias("id"), F.when(F.col("role") == "system", "cover").otherwise("content").alias("kind"), F.col("role").alias("chapter"), *null.values(), F.element_at("ls", 1).alias("title"), F.array().cast("array<string>").alias("source"), F.array().cast("array<string>").alias("covers"), F.array(block).alias("blocks"), brief.alias("visual"))
    settings = rows.select("doc").distinct().select("doc", F.lit("t").alias("thesis"), F.lit("read").alias("mode"), F.lit(6).alias("max_pages"), F.lit(True).alias("section_pages"), F.lit(None).cast("double").alias("duration_min"), F.lit(False).alias("has_source"), F.lit(False).alias("unread"))
    return pages, settings


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
