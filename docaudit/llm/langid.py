"""Language identification by string kernels: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest
kernel ridge regression.

Two texts' kernel is the number of byte n-grams (n from 1 to 4, of the lower-cased text, hashed into DIM bins)
that both have, over the root of the product of each one's number. Landmarks from the learning rows span the
Nyström features, on which a ridge regression is solved for each language against the rest. The kernel is linear
in the presence vectors, so landmarks and coefficients fold into one DIM x languages matrix, and scoring is a
product of that with batches of presence rows.

The fit takes at most PER_LANGUAGE documents of a language and SAMPLE in all, those of least hash of their id, from
rows that `may_learn` and that have id, language and a text with letters. Rows that repeat an id in a language are one
document. Ids, sources and languages are no inputs of a prediction.

Cases: null text, or text without a letter, is `und` with score 0; without learning rows everything is `und`;
ties go to the language that is first by code point; equal texts get equal predictions. Other columns aren't
read by `predict`, and pass through `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, text_blocks

DIM, GRAMS = 1 << 15, 4
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE, SHARP = 1000, 4000, 384, 1e-3, 4.0
#: Buckets in which a language's learning rows are ranked first, so that no task sees all rows of a language.
SALTS = 256
#: Rows of presence that are multiplied at once.
ROWS = 128
_ODD = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def mark(text: str, out: np.ndarray) -> None:
    """Sets the bins of the text's n-grams in a row of zeros."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    key = np.zeros(len(b), np.uint32)
    for n in range(1, GRAMS + 1):
        if len(b) < n:
            break
        key = (key[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        out[((key + np.uint32(n)) * _ODD) >> np.uint32(17)] = 1


def presence(texts: list[str]) -> np.ndarray:
    """Rows of presence, each scaled to length 1."""
    x = np.zeros((len(texts), DIM), np.float32)
    for t, row in zip(texts, x, strict=True):
        mark(t, row)
    return x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIM x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for k in range(0, len(at), ROWS):
            part = at[k : k + ROWS]
            f = SHARP * (presence([texts[i] for i in part]) @ self.weights).astype(np.float64)
            e = np.exp(f - f.max(1, keepdims=True))
            best = f.argmax(1)
            for i, j, p in zip(part, best, e[np.arange(len(part)), best] / e.sum(1), strict=True):
                found[i], score[i] = self.languages[j], p
        return found, score


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Presence rows of length 1 from packed ones."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


def solve(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström features; landmarks are the first rows. Rows stay packed but for ROWS at once."""
    names = sorted(set(langs))
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    marks = unpacked(bits[:landmarks])
    kernel = np.concatenate([unpacked(bits[i : i + ROWS]) @ marks.T for i in range(0, len(bits), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[: len(marks)])
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    phi = kernel @ root
    beta = np.linalg.solve(phi.T @ phi + ridge * len(bits) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, marks.T @ (root @ beta).astype(np.float32))


def learning(doc_id: Column) -> Column:
    """The rows that the registered query learns from; the others are held out."""
    return id_crc(doc_id) % 3 != 1


def fit(docs: DataFrame, may_learn: Column | None = None) -> Model:
    may_learn = learning(F.col("doc_id")) if may_learn is None else may_learn
    id_type = docs.schema["doc_id"].dataType.simpleString()
    turn = F.xxhash64(F.lit(1), "doc_id")
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang").distinct().withColumn("turn", turn)
    order = [F.col("turn"), F.col("doc_id")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= PER_LANGUAGE)
    chosen = rows.orderBy("rank", "lang", "doc_id").limit(SAMPLE).select("doc_id", "lang", "rank").collect()
    if not chosen:
        return Model([], np.zeros((DIM, 0), np.float32))
    # At most SAMPLE ids: a proven bound for the broadcast.
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {id_type}, lang string, rank int").withColumnRenamed("lang", "l")

    def run(batches):
        for block in text_blocks(batches):
            out = []
            for i, t in enumerate(block.column(0).to_pylist()):
                if has_letter(t):
                    row = np.zeros(DIM, np.uint8)
                    mark(t, row)
                    out.append((i, np.packbits(row).tobytes()))
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(block.column(k).take(at) for k in (1, 2, 3)), pa.array([b for _, b in out], pa.binary())], ["doc_id", "lang", "rank", "bits"])

    marked = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id"]).where("lang = l").select("text", "doc_id", "lang", "rank")
    found = marked.mapInArrow(run, f"doc_id {id_type}, lang string, rank int, bits binary")
    # A repeated row is one document here, with the least of its texts' presences.
    found = found.groupBy("doc_id", "lang", "rank").agg(F.min("bits").alias("bits")).orderBy("rank", "lang", "doc_id").limit(SAMPLE).collect()
    if not found:
        return Model([], np.zeros((DIM, 0), np.float32))
    return solve(np.frombuffer(b"".join(bytes(r.bits) for r in found), np.uint8).reshape(len(found), -1), [r.lang for r in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers a language

    def run(batches):
        for block in text_blocks(batches):
            lang, score = shared.value.predict(block.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (~learning(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents whose language is told with a score of `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in text_blocks(batches):
            lang, score = shared.value.predict(block.column(block.schema.get_field_index("text")).to_pylist())
            yield block.filter(pa.array([a != "und" and s >= least for a, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
