"""Versioned state: signatures, latest versions, merges, done-sets, staged edits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text


def signature(rows: DataFrame, by: list[str], order: list[str], line: Column, chars: int = 16) -> DataFrame:
    """A hash of a group's lines in their stated order. Lines are hashed first, so what is gathered is small."""
    rows = rows.select(*by, F.struct(*order, F.sha2(line, 256).alias("h")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.h), "\n")
    return rows.groupBy(*by).agg(F.substring(F.sha2(joined, 256), 1, chars).alias("signature"))


def latest(log: DataFrame, by: list[str], order: list[str], ok: Column) -> DataFrame:
    """Each key's last successful row."""
    rest = [c for c in log.columns if c not in by]
    top = log.where(ok).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return top.select(*by, "_last.*")


def keep_unchanged(old: DataFrame, new: DataFrame, key: str, file: str, asked: DataFrame | None = None) -> DataFrame:
    """New rows, each with `kept`: whether the entry of before stays, as its file is the same and nobody asked for it anew."""
    before = old.select(F.col(key).alias("_k"), F.col(file).alias("_f"))
    rows = new.join(before, F.col(key) == F.col("_k"), "left").withColumn("kept", F.coalesce(F.col(file) == F.col("_f"), F.lit(False))).drop("_k", "_f")
    if asked is not None:
        rows = rows.join(asked.select(F.col(key).alias("_a")).distinct(), F.col(key) == F.col("_a"), "left").withColumn("kept", F.col("kept") & F.col("_a").isNull()).drop("_a")
    return rows


def pending(slots: DataFrame, done: DataFrame) -> DataFrame:
    """Slots whose settled text isn't in the done-set. slots: role, text; done: text."""
    rows = slots.withColumn("settled", text.settled(F.col("role"), F.col("text")))
    return rows.join(done.select(F.col("text").alias("settled")).distinct(), "settled", "left_anti")


def fact_differences(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(key, fact, n_before, n_after) where a text's facts differ between two versions, as multisets."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(text.facts(F.col(column))).alias("fact")).groupBy(key, "fact").agg(F.count(F.lit(1)).alias(name))

    both = counted(before, "n_before").join(counted(after, "n_after"), [key, "fact"], "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.where("n_before <> n_after")


def import_findings(before: DataFrame, after: DataFrame, current: DataFrame) -> DataFrame:
    """What stands against taking an edited copy: (rule, severity, id, detail).
    before: id, role, text as exported; after: id, text as edited; current: id, text as it is now."""
    old, new, now = before.select("id", "role", F.col("text").alias("old")), after.select("id", F.col("text").alias("new")), current.select("id", F.col("text").alias("now"))
    finding = lambda rule, severity, detail: (F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("id").cast("string").alias("id"), detail.alias("detail"))
    sides = old.join(new, "id", "full_outer")
    both = old.join(new, "id").withColumn("new", F.coalesce("new", F.lit("")))
    printed = F.coalesce(F.col("role") != "notes", F.lit(True))
    empty = F.trim("new") == ""
    changed = fact_differences(both.where(~empty).select("id", F.col("old").alias("t")), both.where(~empty).select("id", F.col("new").alias("t")), "id", "t")
    changed = changed.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("fact")), ", ").alias("facts"))
    out = sides.where("new IS NULL").select(*finding("import.marker_missing", "error", F.col("old")))
    out = out.unionByName(sides.where("role IS NULL AND old IS NULL").select(*finding("import.marker_extra", "error", F.col("new"))))
    stale = old.join(now, "id", "left").where(~F.coalesce(F.trim("now") == F.trim("old"), F.lit(False)))
    out = out.unionByName(stale.select(*finding("import.stale", "error", F.col("old"))))
    out = out.unionByName(both.where(empty).select(*finding("import.emptied", "error", F.col("old"))))
    out = out.unionByName(changed.select(*finding("import.facts", "error", F.col("facts"))))
    out = out.unionByName(both.where(printed & F.contains("new", F.lit("\n"))).select(*finding("import.newline", "error", F.col("new"))))
    return out.unionByName(both.where(printed & text.grew(F.col("old"), F.col("new"))).select(*finding("import.grew", "warning", F.col("new"))))


def applied(before: DataFrame, after: DataFrame, findings: DataFrame, force: bool = False) -> DataFrame:
    """The edited texts if no error stands against any of them, else the texts of before: all or nothing."""
    old, new = before.select("id", "role", F.col("text").alias("old")), after.select("id", F.col("text").alias("new"))
    errors = findings.where("severity = 'error'").agg(F.count(F.lit(1)).alias("n_errors")).scalar()
    take = (errors == 0) | F.lit(force)
    return old.join(new, "id", "left").select("id", "role", F.when(take, F.coalesce("new", "old")).otherwise(F.col("old")).alias("text"))


def stale(rows: DataFrame, listing: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """Rows whose source's stamp (size and time, or file name) isn't the listing's any more."""
    other = listing.select(F.col(key).alias("_k"), F.struct(*stamp).alias("_s"))
    return rows.join(other, F.col(key) == F.col("_k"), "left").where(~F.struct(*stamp).eqNullSafe(F.col("_s"))).drop("_k", "_s")


def accepted_versions(attempts: DataFrame, by: list[str], version: str) -> DataFrame:
    """Adds `accepted`: a fix stays if it has fewer targeted errors than the version before, no text in a corner and
    no more extra text. attempts: errors, corner, extra."""
    w = Window.partitionBy(*by).orderBy(version)
    better = (F.col("errors") < F.lag("errors").over(w)) & (F.col("corner") == 0) & (F.col("extra") <= F.lag("extra").over(w))
    return attempts.withColumn("accepted", F.coalesce(better, F.row_number().over(w) == 1))


def succeeded(log: DataFrame, least_bytes: int = 50_000) -> DataFrame:
    """Attempts by key with the number of tries and whether one of them ended well with a file of some size."""
    ok = (F.col("rc") == 0) & (F.col("bytes") > least_bytes)
    return log.groupBy("page").agg(F.count(F.lit(1)).alias("tries"), F.bool_or(ok).alias("ok"))


def waves(index: DataFrame, existing: DataFrame) -> DataFrame:
    """index: page, pos, skeleton; existing: page. Which pages are made first: for each skeleton used twice or more that has no page yet, the first one wanted."""
    used = index.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"), F.min_by("page", "pos").alias("anchor"))
    have = index.join(existing.select("page"), "page", "left_semi").select("skeleton").distinct()
    anchors = used.where("n >= 2 AND skeleton IS NOT NULL").join(have, "skeleton", "left_anti").select(F.col("anchor").alias("page"), F.lit(1).alias("wave"))
    wanted = index.join(existing.select("page"), "page", "left_anti")
    return wanted.join(anchors, "page", "left").withColumn("wave", F.coalesce("wave", F.lit(2)))


def reclaimable(files: DataFrame, delivered: DataFrame) -> DataFrame:
    """Stage files of which a delivered one has the same name and size."""
    return files.join(delivered.select("name", "bytes"), ["name", "bytes"], "left_semi")
