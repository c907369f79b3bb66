"""Licence notices in texts by voting on diagonals. DataFrame functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and all other non-ASCII
characters. Every run of k words of every text is hashed (k = 2 for short phrases, 4 for
long notices) and joined with the positions of the same runs in the templates. A hit of word
i of a text with word j of a template votes for the diagonal i - j. Votes are counted per
text, template and diagonal; neighbouring diagonals (words added to or left out of a long
notice) are merged; every span is verified word by word against the text, so a hash alone
decides nothing.

A phrase is found where all its words stand in order on one diagonal: a place of its
own each time. A long notice is found where at least NEED of its words are verified. `score`
is the largest verified share of a template, 1.0 for a phrase, 0.0 if nothing was found.

NULL and empty texts have no words and no labels; rows with equal id and text have equal
results; an empty table gives no rows. Only the named columns are read. A text is one row
while it is scanned, whatever its length; nothing is cut off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.base import broadcast_if, settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words, also in upper case: separators one by one (a table look-up for the matcher), no backtracking.
_ANY_CASE = "[^" + "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).isalnum()) + "]++"
NEED = 0.8            # verified share at which a long notice counts
CANDIDATE = 0.3       # share of a long notice that votes must cover before its words are verified
SHORT = 12            # templates of up to so many words are phrases

# Fixed by the contract.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Public licence notices, as published with the licences.
NOTICES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
     use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
     Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
     be included in all copies or substantial portions of the Software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
     the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
     the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
     This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("apache-2.0", "apache license version 2 0"),
    ("gpl-2.0", "general public license version 2"),
    ("gpl-3.0", "general public license version 3"),
    ("lgpl", "lesser general public license"),
    ("agpl", "affero general public license"),
    ("mpl-2.0", "mozilla public license"),
    ("bsd", "bsd license"),
)
# Creative Commons marks: each set of terms with each written form.
MARKS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
IDENTIFIERS = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool = False

    @property
    def short(self) -> bool:
        return len(self.words) <= SHORT

    @property
    def k(self) -> int:
        return 2 if self.short else 4

    @property
    def slack(self) -> int:
        """Distance at which diagonals of a notice still belong together; phrases allow none."""
        return 0 if self.short else max(2, len(self.words) // 10)


def _split(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[0-9a-z]+", text.lower()))


def templates() -> list[Template]:
    """Base phrases, notices, marks and identifiers; the place in the list is the template's number."""
    found = [Template(label, _split(text), True) for label, text in BASE]
    found += [Template(label, _split(text)) for label, text in NOTICES]
    found += [Template(f"cc-{mark}", _split(f"cc {mark} {version}")) for mark in MARKS for version in VERSIONS]
    found += [Template(name.lower(), _split(f"SPDX-License-Identifier: {name}")) for name in IDENTIFIERS]
    return found


def lowered(text: Column) -> Column:
    """A-Z lower-cased where it can matter: words with other letters match no template either way.

    Only the Kelvin sign becomes an ASCII letter in lower case; texts with it are translated letter by letter.
    """
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit("K")), plain).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(_ANY_CASE), F.lit(0))


def _with_runs(df: DataFrame) -> DataFrame:
    """Column `runs`: hashes of all runs of two words, then of all runs of four: n and n for n words.

    The last run or runs of each part reach beyond the text and equal no template's words.
    """
    later = lambda x, by: F.slice(x, by + 1, F.greatest(F.size("words"), F.lit(1)))
    pair = lambda a, b: F.xxhash64(a, b)
    # Each step is a column of its own, so that it is computed once.
    df = df.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("two", F.zip_with("one", later("one", 1), pair)).drop("one")
    return df.withColumn("runs", F.concat("two", F.zip_with("two", later("two", 2), pair))).drop("two")


def _template_runs(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(run, template, at, k) for each run of each template: a few hundred rows, fixed."""
    rows = [(t, i, x.k, list(x.words[i:i + x.k])) for t, x in enumerate(known) for i in range(len(x.words) - x.k + 1)]
    runs = spark.createDataFrame(rows, "template int, at int, k int, words array<string>")
    h = lambda i: F.xxhash64(F.get("words", F.lit(i)))
    two = lambda i: F.xxhash64(h(i), h(i + 1))
    return runs.select("template", "at", "k", F.when(F.col("k") == 2, two(0)).otherwise(F.xxhash64(two(0), two(2))).alias("run"))


def _lookup(values: list, template: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), template)


def votes(docs: DataFrame, known: list[Template]) -> DataFrame:
    """(doc_id, digest, template, diagonal, hits): places of the template whose runs of k words stand on the diagonal."""
    runs = _with_runs(docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words")))
    # Rows carry no words. The outer form, as the plain one would filter on the runs' size and so compute them again.
    runs = runs.select("doc_id", "digest", F.size("words").alias("n"), F.posexplode_outer("runs").alias("i", "run"))
    hit = runs.join(F.broadcast(_template_runs(docs.sparkSession, known)), "run").where((F.col("k") == 2) == (F.col("i") < F.col("n")))
    at = F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(F.col("i") - F.col("n"))
    return (hit.select("doc_id", "digest", "template", (at - F.col("at")).alias("diagonal"), "at")
            .groupBy("doc_id", "digest", "template", "diagonal").agg(F.collect_set("at").alias("hits")))


def spans(voted: DataFrame, known: list[Template]) -> DataFrame:
    """Neighbouring diagonals merged: (doc_id, digest, template, diagonals, low, high, share).

    Diagonals join a span while the next is within the template's slack, and a span is at most four
    slacks wide, so a text that repeats a run at each word makes many spans, not one.
    """
    slack = _lookup([t.slack for t in known], F.col("template"))
    text = ["doc_id", "digest", "template"]
    along = Window.partitionBy(*text).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    chained = voted.withColumn("chain", F.sum(F.when(gap <= slack, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    from_first = F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*text, "chain"))
    wide = F.floor(from_first / (4 * slack + 1))
    merged = (chained.withColumn("bin", wide).groupBy(*text, "chain", "bin")
              .agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"), F.flatten(F.collect_list("hits")).alias("hits"),
                   F.min(F.col("diagonal") + F.array_min("hits")).alias("low"), F.max(F.col("diagonal") + F.array_max("hits")).alias("high")))
    k = _lookup([t.k for t in known], F.col("template"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda j: F.sequence(j, j + k - 1)))))
    size = _lookup([len(t.words) for t in known], F.col("template"))
    return merged.select(*text, "diagonals", "low", (F.col("high") + k - 1).alias("high"), (covered / size).alias("share"))


def _verified(found: DataFrame, docs: DataFrame, known: list[Template]) -> DataFrame:
    """Share of the template's words that stand in the text on one of the span's diagonals."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").where("text is not null")
    ids = settle(found.select("doc_id", "digest").distinct(), "suspects")
    here = ids.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    rows = rows.join(broadcast_if(here), rows.doc_id.eqNullSafe(F.col("id")) & (rows.digest == F.col("d")), "left_semi")
    rows = rows.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), words_of(F.col("text")).alias("words"))
    whole = F.broadcast(docs.sparkSession.createDataFrame([(i, list(t.words)) for i, t in enumerate(known)], "template int, template_words array<string>"))
    both = found.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).join(whole, "template")
    stands = F.transform("template_words", lambda w, j: F.exists(
        "diagonals", lambda d: (j + d >= 0) & F.coalesce(F.get("words", F.greatest(j + d, F.lit(0))) == w, F.lit(False))))
    share = F.size(F.filter(stands, lambda x: x)) / F.size("template_words")
    return both.select("doc_id", "digest", "template", "low", "high", share.alias("share"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[Template] | None = None, need: float = NEED) -> DataFrame:
    """Every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    `spans` lists what was found by start: struct(label, low, high, share), words from 0, high
    included. The base columns count and bound the places of the base phrases only.
    """
    known = known or templates()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    short = _lookup([t.short for t in known], F.col("template"))
    merged = settle(spans(votes(rows, known), known).where((short & (F.col("share") == 1.0)) | (~short & (F.col("share") >= CANDIDATE))), "spans")
    found = _verified(merged, rows, known).where(~short | (F.col("share") == 1.0))
    base = _lookup([t.base for t in known], F.col("template"))
    counted = short | (F.col("share") >= need)
    label = _lookup([t.label for t in known], F.col("template"))
    verdicts = settle(found.groupBy("doc_id", "digest").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("low"))).alias("first_word"), F.max(F.when(base, F.col("low"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, label))).alias("base_labels"), F.sort_array(F.collect_set(F.when(counted, label))).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.when(counted, F.struct("low", "high", label.alias("label"), "share")))).alias("spans")), "verdicts")
    verdicts = verdicts.withColumnsRenamed({"doc_id": "id", "digest": "d"})
    mine = rows.select("doc_id", F.xxhash64("text").alias("digest"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_ANY_CASE)).cast("long").alias("n_words"))
    both = mine.join(broadcast_if(verdicts), mine.doc_id.eqNullSafe(F.col("id")) & (mine.digest == F.col("d")), "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
                       F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", none).alias("base_labels"),
                       F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
                       F.coalesce("spans", F.array().cast("array<struct<low:int,high:int,label:string,share:double>>")).alias("spans"))


def scan_sql(known: list[Template] | None = None, need: float = NEED) -> str:
    """The same results as SQL over `documents`, with runs as texts in place of hashes."""
    known = known or templates()
    rows = ",\n    ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.k}, {t.slack}, {str(t.short).lower()}, '{' '.join(t.words)}')" for i, t in enumerate(known))
    return f"""
WITH t AS (SELECT template, label, base, k, slack, short, string_split(words, ' ') AS tw FROM (VALUES
    {rows}) t(template, label, base, k, slack, short, words)),
d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
r AS (SELECT row, k, i, array_to_string(w[i + 1:i + k], ' ') AS run FROM (SELECT row, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (VALUES (2), (4)) k(k))),
tr AS (SELECT template, k, j, array_to_string(tw[j + 1:j + k], ' ') AS run FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS j FROM t)),
vote AS (SELECT row, template, i - j AS diagonal, list(DISTINCT j) AS hits FROM r JOIN tr USING (k, run) GROUP BY ALL),
gap AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= slack AS near FROM vote JOIN t USING (template)),
chain AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY row, template ORDER BY diagonal) AS chain FROM gap),
bin AS (SELECT *, (diagonal - min(diagonal) OVER (PARTITION BY row, template, chain)) // (4 * slack + 1) AS bin FROM chain),
span AS (SELECT row, template, any_value(label) AS label, any_value(base) AS base, any_value(short) AS short, any_value(tw) AS tw,
                list(diagonal) AS diagonals, min(diagonal + list_min(hits)) AS low,
                len(list_distinct(flatten(list(flatten(list_transform(hits, lambda j: range(j, j + k))))))) / len(any_value(tw)) AS share
         FROM bin GROUP BY row, template, chain, bin),
found AS (SELECT s.row, label, base, short, low, CASE WHEN short THEN share ELSE
                 len(list_filter(range(len(tw)), lambda j: len(list_filter(diagonals, lambda x: j + x >= 0 AND w[j + x + 1] = tw[j + 1])) > 0)) / len(tw) END AS share
          FROM span s JOIN d USING (row) WHERE CASE WHEN short THEN share = 1 ELSE share >= {CANDIDATE} END),
verdict AS (SELECT row, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
                   array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
                   array_to_string(list_sort(list(DISTINCT label) FILTER (short OR share >= {need})), ',') AS labels, max(share) AS score
            FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN verdict USING (row)
"""
