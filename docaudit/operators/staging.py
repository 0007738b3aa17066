"""Edited copies taken in one step: tables behind one manifest, which is swapped or left as it is.

A folder has numbered manifests; the one with the highest number is what is so. A step stages its tables in a folder of its own,
checks them, and then makes the next manifest by a rename that fails if that number is there: a writer that was
overtaken changes nothing, and one that is lost at any point leaves the old state or the new one, never half. A step
that is run again after it came through finds itself in the manifest and does nothing, so done-sets and logs grow once.

Tables: slots (id, role, text), done (text: settled strings that are through), log (step, id, role, old, new, note).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import text
from docaudit.operators import state

LOG = "step string, id string, role string, old string, new string, note string"


class Overtaken(RuntimeError):
    """Another writer made the next manifest first."""


class Staged:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """What is so now; nothing of it is there before the first step."""
        store, top = self._store(), self._path("manifests")
        names = sorted(f.getPath().getName() for f in store.listStatus(top)) if store.exists(top) else []
        names = [n for n in names if n.startswith("m-")]
        if not names:
            return {"version": 0, "slots": None, "done": [], "log": [], "steps": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, was: dict, now: dict) -> None:
        """Makes the next manifest visible, whole or not at all."""
        version = was["version"] + 1
        store = self._store()
        draft, final = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/m-{version:08d}.json")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(now | {"version": version}).encode()))
        out.close()
        if store.exists(final) or not store.rename(draft, final):
            store.delete(draft, False)
            raise Overtaken(f"version {version} is there")

    def _write(self, step: str, name: str, rows: DataFrame) -> str:
        path = f"{self.folder}/staged/{step}-{uuid.uuid4().hex}/{name}"
        rows.write.parquet(path)
        return path

    def _all(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def slots(self, manifest: dict | None = None) -> DataFrame:
        m = manifest or self.manifest()
        return self._all([m["slots"]] if m["slots"] else [], "id string, role string, text string")

    def done(self, manifest: dict | None = None) -> DataFrame:
        return self._all((manifest or self.manifest())["done"], "text string")

    def log(self, manifest: dict | None = None) -> DataFrame:
        return self._all((manifest or self.manifest())["log"], LOG)

    def pending(self) -> DataFrame:
        m = self.manifest()
        return state.pending(self.slots(m), self.done(m))

    def start(self, slots: DataFrame) -> None:
        """The first version, of slots (id, role, text)."""
        m = self.manifest()
        if m["slots"] is None:
            self._commit(m, m | {"slots": self._write("start", "slots", slots.select("id", "role", "text"))})

    def _name(self, kind: str, *tables: DataFrame) -> str:
        """A step is named by what it takes, so the same one again has the same name."""
        sums = [t.agg(F.coalesce(F.bit_xor(F.xxhash64("id", "text")), F.lit(0)).alias("x"), F.count(F.lit(1)).alias("n")).first() for t in tables]
        return kind + "".join(f"-{r.x & (1 << 64) - 1:016x}.{r.n}" for r in sums)

    def _settled(self, rows: DataFrame, m: dict) -> DataFrame:
        """Settled texts of rows that aren't in the done-set yet."""
        new = rows.select(text.settled(F.col("role"), F.col("text")).alias("text")).distinct()
        return new.join(self.done(m), "text", "left_anti")

    def take(self, exported: DataFrame, edited: DataFrame, force: bool = False) -> DataFrame:
        """Takes an edited copy, or nothing of it: the findings, of which no error may stand unless forced. exported: id, role,
        text; edited: id, text."""
        m = self.manifest()
        step = self._name("take", exported, edited)
        if step in m["steps"]:
            return self.spark.read.parquet(m["steps"][step])
        findings = state.import_findings(exported, edited, self.slots(m).select("id", "text"))
        path = self._write(step, "findings", findings)
        findings = self.spark.read.parquet(path)
        if not force and not findings.where("severity = 'error'").isEmpty():
            return findings
        new = edited.select("id", F.col("text").alias("new"))
        both = self.slots(m).join(new, "id", "left").withColumn("new", F.coalesce("new", "text"))
        slots = self._write(step, "slots", both.select("id", "role", F.col("new").alias("text")))
        done = self._write(step, "done", self._settled(both.join(new.select("id"), "id", "left_semi").select("role", F.col("new").alias("text")), m))
        changed = both.where("text <> new").select(F.lit(step).alias("step"), "id", "role", F.col("text").alias("old"), "new", F.lit(None).cast("string").alias("note"))
        log = self._write(step, "log", changed)
        self._commit(m, m | {"slots": slots, "done": [*m["done"], done], "log": [*m["log"], log], "steps": m["steps"] | {step: path}})
        return findings

    def accept(self, note: str = "") -> int:
        """Takes what is pending as it is; how many strings that were."""
        m = self.manifest()
        rows = state.pending(self.slots(m), self.done(m))
        step = self._name("accept", rows)
        if rows.isEmpty():
            return 0
        log = self._write(step, "log", rows.select(F.lit(step).alias("step"), "id", "role", F.col("text").alias("old"), F.col("text").alias("new"), F.lit(note).alias("note")))
        done = self._write(step, "done", self._settled(rows, m))
        self._commit(m, m | {"done": [*m["done"], done], "log": [*m["log"], log]})
        return self.spark.read.parquet(log).count()
