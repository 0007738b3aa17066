"""The pipeline against the stages' plain versions, and the registered queries over the smallest tables."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from test_operators import PATTERN, RANKS, SCHEMA, awkward, components, plain_quality

import corpus_pipeline
from docaudit.llm import bpe, langid, mixture, quality, queries
from docaudit.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


def test_stages_are_named_and_keep_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "source_mix", "byte_bpe"]
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_pipeline_is_its_stages(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    one = {d for d, (a, s) in lang.items() if a != "und" and s >= corpus_pipeline.LEAST_SCORE}
    kept = docs.where(docs.doc_id.isin(*one))
    forest = quality.fit(kept, labels)
    two = {r.doc_id for r in quality.judge(kept, forest).where("kept").collect()}
    assert not any(plain_quality(texts[d])["base_failed"] for d in two)
    left = sorted(two)
    three = {w["doc_id"] for w in components([(d, texts[d]) for d in left], 5, 80) if w["doc_id"] == w["component_id"]}
    copies = {r.doc_id: r.copies for r in mixture.report(docs.where(docs.doc_id.isin(*three))).collect()}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(RANKS, PATTERN).ranks, special_tokens={})
    want = Counter()
    for d, n in copies.items():
        ids = np.array(enc.encode_ordinary(texts[d]), "<u4").tobytes()
        want[d, len(ids) // 4, hashlib.sha256(ids).hexdigest()] += n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == +want and len(got) > 20


def stored(spark, path, docs, labels):
    """A folder of the two tables that the stages read."""
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("kind", ["empty", "nulls", "awkward"])
def test_pipeline_over_awkward_tables(spark, tmp_path, kind):
    """Empty tables give empty results; nulls anywhere, repeated rows and columns named like the stages' own pass."""
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(20, 60)] + [(None, 1, None), (25, None, 0)], "doc_id long, quality int, toxic int")
    rows = awkward() if kind == "awkward" else [(None,) * 9] * 5 if kind == "nulls" else []
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("mix_shard", "comp", "stay_id", "l", "rank"):
        docs = docs.withColumn(c, docs.text)
    at = stored(spark, tmp_path / kind, docs, labels.where("quality < 0") if kind == "empty" else labels)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table(spark, at, "documents"), at).columns == docs.columns
    got = corpus_pipeline.run(spark, at).collect()
    assert bool(got) == (kind == "awkward") and {r.doc_id for r in got} <= {r[0] for r in rows}


def test_clean_documents_stay(spark):
    """Labelled good documents that pass the base rule are kept by the filtering stages."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {d for d in good if d in texts and not plain_quality(texts[d])["base_failed"]}
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert len(good & {r.doc_id for r in stage(spark, docs, DATA).collect()}) >= 0.98 * len(good)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_give_their_columns(spark, name):
    columns = {
        "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op2": "doc_id n_shingles component_id", "op3": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op4": "doc_id held_out n_tokens n_known train_tokens base_score score", "op5": "doc_id n_tokens ids_sha256 decoded_sha256", "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7": "doc_id size source_size target taken", "op8": "doc_id held_out lang_pred score", "op9": "conv_id perspective", "op10": "doc_id size text_crc32 law shard slot grown_shard",
        "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
        "op13": "doc_id keep_id group_size kept text_sha256",
    }
    got = queries.queries()[name](spark, DATA)
    assert set(columns[name.split("_")[0]].split()) <= set(got.columns)
    assert got.count() == table(spark, DATA, "documents").count() or name.startswith(("op9", "op12"))


def test_queries_are_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, DATA), con.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        key = [want.columns.index(c) for c in order]
        assert Counter(tuple(str(r[c]) for c in order) for r in got.collect()) == Counter(tuple(str(r[i]) for i in key) for r in want.fetchall())
