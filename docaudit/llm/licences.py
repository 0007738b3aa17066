"""Licence scan by a positional rare-token index. DataFrame functions only, one row at a time.

Notices of known licences are templates: words with positions. The index lists, for each word, the templates and
positions it is at. All of a file's words that are in the index are looked up; each place of such a word, less its
position in a template, says where the template would start. Places that agree are summed up by start, weighted by frequency; a start that covers enough of the
template's weight is a match if the template's mandatory phrase stands there, word for word. A phrase that names the
licence decides by itself, whatever notice it stands in.

Base phrases are looked for throughout, at any place. A document without the longest word of any phrase has no
match by definition, and only its words are counted.

Cases: null and empty texts have 0 words, no labels and score 0; overlapping and repeated notices all count;
words are of letters, digits and everything beyond ASCII, in lower case; equal texts get equal results. Other
columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases of the contract, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by label, each with the phrase that has to be there: the public wording of these licences.
NOTICES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "cc0-1.0": ("to the extent possible under law the author has waived all copyright and related rights to this work", "waived all copyright and related rights"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released into the public domain"),
}
#: Labels whose phrase names the licence, with the version that the label has.
NAMED = {"apache-2.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "gpl-3.0", "lgpl", "mit"}
#: Usual wordings of such a name that don't hold the phrase itself.
WORDINGS = [
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3.0", "gnu general public license v3"),
    ("gpl-3.0", "version 3 of the gnu general public license"),
]
#: Label, words and phrase of every template.
TEMPLATES = [*((name, *NOTICES[name]) for name in sorted(NOTICES)), *((name, text, text) for name, text in WORDINGS)]
#: Weight to be covered, where the phrase doesn't decide.
COVERED = 0.75


def words_of(text: Column) -> Column:
    # lower() maps just two characters beyond ASCII to words with ASCII letters, and neither makes a word of a phrase.
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def weights() -> dict[str, float]:
    """Inverse document frequency of the index's words over the templates."""
    df = Counter(w for _, text, _ in TEMPLATES for w in set(text.split()))
    return {w: math.log(1 + len(TEMPLATES) / n) for w, n in sorted(df.items())}


def _map(d: dict, value) -> Column:
    return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), value(v))))


def _starts(words: Column, places: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after another. places: of the words that are in any phrase."""
    first, *rest = phrase.split()

    def here(p: Column) -> Column:
        ok = F.get(words, p) == first
        for k, w in enumerate(rest, 1):
            ok = ok & F.coalesce(F.get(words, p + k) == w, F.lit(False))
        return ok

    return F.filter(places, here)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, start, covered)."""
    names = [name for name, *_ in TEMPLATES]
    idf = weights()
    postings, total, must, least = defaultdict(list), {}, {}, {}
    for t, (name, *texts) in enumerate(TEMPLATES):
        notice, phrase = (x.split() for x in texts)
        total[t] = sum(idf[w] for w in notice)
        at = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        # Less by what sums in another order may differ.
        least[t] = min(COVERED, sum(idf[w] for w in phrase) / total[t] * (1 - 1e-9)) if name in NAMED else COVERED
        must[t] = [(at + i, w) for i, w in enumerate(phrase)]
        for p, w in enumerate(notice):
            postings[w].append((t, p))
    index = _map(dict(postings), lambda v: F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in v)))
    weight, whole = _map(idf, F.lit), F.array(*(F.lit(total[t]) for t in range(len(names))))
    enough = F.array(*(F.lit(least[t]) for t in range(len(names))))
    phrase_of = F.array(*(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in must[t])) for t in range(len(names))))
    # Each phrase has a word that no match of it can lack; the longest are the rarest in other texts.
    cues = {max(p.split(), key=len) for p in [*BASE, *(phrase for _, phrase in NOTICES.values())]}
    cues = sorted(cues | {max(p.split(), key=len) for _, p in WORDINGS if not cues & set(p.split())})
    known = sorted({w for p in [*BASE, *(n for _, n, _ in TEMPLATES)] for w in p.split()})

    rows = docs.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("lower"))
    cue = F.col("lower").contains(cues[0])
    for c in cues[1:]:
        cue = cue | F.col("lower").contains(c)
    rows = rows.select(key, cue.alias("cue"), words_of(F.col("lower")).alias("words"))
    words = F.col("words")
    # Places of the words that are in the index or a phrase; none where no phrase can be.
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(known), i)))
    rows = rows.withColumn("places", F.when(F.col("cue"), places).otherwise(F.array().cast("array<int>")))
    starts = [_starts(words, F.col("places"), p) for p in BASE]
    rows = rows.withColumn("base", F.when(F.size("places") > 0, F.array(*starts)).otherwise(F.array(*[F.array().cast("array<int>")] * len(BASE))))
    # The file's index words, and all places of those.
    found = F.array_distinct(F.filter(F.transform("places", lambda p: F.get(words, p)), lambda w: F.array_contains(F.array(*map(F.lit, sorted(idf))), w)))
    rows = rows.withColumn("looked", F.when(F.size("places") > 0, found).otherwise(F.array().cast("array<string>")))
    votes = F.flatten(F.transform(F.filter("places", lambda p: F.array_contains(F.col("looked"), F.get(words, p))), lambda p: F.transform(
        F.element_at(index, F.get(words, p)), lambda e: F.struct(e.t.alias("t"), (p - e.p).alias("start"), F.element_at(weight, F.get(words, p)).alias("w")))))
    rows = rows.withColumn("votes", F.when(F.size("looked") > 0, F.array_sort(votes)))
    # Sums up runs of votes that agree in template and start, and keeps the runs that cover enough.
    empty = F.array().cast("array<struct<t:int,start:int,covered:double>>")
    zero = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), empty.alias("out"))

    def closed(s: Column) -> Column:
        share = s["sum"] / F.get(whole, s.t)
        run = F.array(F.struct(s.t.alias("t"), s.start.alias("start"), F.least(share, F.lit(1.0)).alias("covered")))
        return F.when((s.t >= 0) & (share >= F.get(enough, s.t)), F.concat(s.out, run)).otherwise(s.out)

    def add(s: Column, v: Column) -> Column:
        same = (s.t == v.t) & (s.start == v.start)
        return F.struct(v.t.alias("t"), v.start.alias("start"), F.when(same, s["sum"] + v.w).otherwise(v.w).alias("sum"), F.when(same, s.out).otherwise(closed(s)).alias("out"))

    runs = F.aggregate("votes", zero, add, closed)
    # A template may start before the text does; its phrase may not.
    stands = lambda r: F.forall(F.get(phrase_of, r.t), lambda k: F.coalesce(F.get(words, r.start + k.p) == k.w, F.lit(False)))
    matches = F.transform(F.filter(runs, stands), lambda r: F.struct(F.get(F.array(*map(F.lit, names)), r.t).alias("label"), r.start.alias("start"), r.covered.alias("covered")))
    rows = rows.withColumn("matches", F.when(F.size(F.coalesce("votes", F.array())) > 0, matches).otherwise(F.array().cast("array<struct<label:string,start:int,covered:double>>")))
    labels = F.array_compact(F.array(*(F.when(F.size(F.get("base", F.lit(i))) > 0, F.lit(v)) for i, v in enumerate(BASE.values()))))
    every = F.flatten("base")
    rows = rows.withColumn("own", labels)
    return rows.select(
        key, F.size(words).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort("own"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("own", F.transform("matches", lambda m: m.label))), ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m.covered)), F.lit(0.0))).alias("score"), F.size("matches").cast("long").alias("n_matches"),
    )


_word = re.compile(WORDS)


def plain_words(text: str | None) -> list[str]:
    """The words of a text by Python's re, for tests."""
    return _word.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
