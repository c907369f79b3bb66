"""Importance resampling, licence scan and divergence audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import divergence, importance, license_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, weight int, `a.b` int, term string, n int"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def _random_texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéß9") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    return [rng.choice([" ", ", ", "\n"]).join(rng.choice(words).title() for _ in range(rng.randint(0, 60))) for _ in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, 0.5, 1, 2, 3, "x", 4) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}") for i, t in enumerate(_random_texts(90, 5))]
    out += [(200, None, "en", "s1"), (201, "", "fr", None), (202, " ?! ", None, None), (None, out[4][1], "en", "s0"), (None, None, "de", "s9"),
            (7, out[7][1], "en", "s3"), (7, out[7][1], "en", "s3"), (203, "word " * 40_000, "en", "lone"), (204, "x" * 5000 + " é" * 30, "xx", "s1"),
            (205, "".join(chr(0x4E00 + i) for i in range(4000)), "zh", "s1")]
    return out


# --- importance resampling ------------------------------------------------------------

def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def _runs(t, longest):
    w = _words(t)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _resampled(rows, target, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for r in rows for f in _runs(r[1], longest))
    t = Counter(bucket(f) for x in target for f in _runs(x, longest))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (total_s + buckets) / ((s[k] + 1) * (total_t + buckets))))
    out = []
    for i, text, *_ in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in _runs(text, longest))
        out.append([i, len(_runs(text, longest)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, text, *_) in zip(out, rows) if len(_words(text)) >= least]
    for rank, r in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0]))[:percent * len(fit) // 100], 1):
        r[4] = rank
    return out


def _key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("longest,percent,least,segment", [(1, 10, 20, 50_000), (2, 60, 5, 10), (3, 100, 0, 7)])
def test_resample_is_brute_force(spark, rows, longest, percent, least, segment):
    target = _random_texts(20, 8) + [None, ""]
    got = importance.resample(_frame(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), longest=longest,
                              buckets=500, percent=percent, least_words=least, rows_per_segment=segment)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(map(tuple, _resampled(rows, target, longest, 500, percent, least)), key=_key)


def test_resample_empty_tables(spark, rows):
    none = _frame(spark, [])
    assert importance.resample(none, none).count() == 0
    got = importance.resample(_frame(spark, rows), none, least_words=1)
    assert got.count() == len(rows) and got.where("rank is not null").count() == len([r for r in rows if _words(r[1])]) // 10


def test_span_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    sizes = rng.choice([1, 2, 3, 7, 63, 64, 65, 127, 128, 129, 1000, 4096], 500)
    starts = rng.integers(0, 9000 - 4096, 500)
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, sizes)]
    for block in (4, 16, 64):
        assert importance.Crc(block).of(data, starts, sizes).tolist() == want


@pytest.mark.parametrize("piece", [1, 9, 300])
def test_long_texts_in_pieces(monkeypatch, rows, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [r[1] for r in rows if len(r[1] or "") < 6000]
    for longest in (1, 3):
        got, words = Counter(), Counter()
        for owner, hashed in importance.features(pa.array(["skipped", *texts]).slice(1), longest, 1 << 32):
            (words if hashed is None else got).update(owner.tolist() if hashed is None else zip(owner.tolist(), hashed.tolist()))
        assert got == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in _runs(t, longest))
        assert words == Counter(i for i, t in enumerate(texts) for _ in _words(t))


# --- licence scan ----------------------------------------------------------------------

def _notice(label, long=True):
    return next(text for name, text in license_scan.NOTICES if name == label and (len(text) > 200) == long)


def _base_places(text):
    w = _words(text)
    return sorted((i, label) for label, phrase in license_scan.BASE for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split())


@pytest.fixture(scope="module")
def licence_rows(rows):
    mit, apache, bsd = _notice("mit"), _notice("apache-2.0"), _notice("bsd")
    filler = rows[3][1]
    edited = " ".join(x for i, x in enumerate(mit.split()) if i not in (20, 60))                # two words left out
    added = bsd.replace("with or without", "with or really without").replace("source code", "any source code")
    half = " ".join(mit.split()[:40])
    texts = {1: f"{filler} {mit}", 2: edited, 3: f"intro {added} {filler}", 4: half, 5: f"{mit}\n{apache}", 6: f"{apache} {apache}",
             7: "MIT License, the mit-license and an Apache  LICENSE; general public license.", 8: "general public licenses, mit licence, mitlicense",
             9: "licensed under CC BY-NC-SA 4.0", 10: "licensed under CC BY-NC 4.0", 11: "cc by 3.0 text cc by", 12: "SPDX-License-Identifier: GPL-3.0-only",
             13: "general public " * 50 + "general public license", 14: "mit Kicense mit lIcense", 15: "of this software and associated " * 200,
             16: None, 17: "", 18: " .. ", 19: "é mit license é", 20: "mit", 21: "license"}
    out = [(i, t, "en", "s0") for i, t in texts.items()]
    return out + [(None, texts[7], "en", "s0"), (None, texts[9], None, None), (5, texts[5], "en", "s1"), (5, texts[5], "en", "s1"), (5, texts[8], "en", "s1")] + rows


def test_base_phrases_are_all_found(spark, licence_rows):
    got = license_scan.scan(_frame(spark, licence_rows)).drop("spans", "labels", "score").collect()
    want = []
    for i, text, *_ in licence_rows:
        places = _base_places(text)
        at = [p for p, _ in places]
        want.append((i, len(_words(text)), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})))
    assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key)


def test_notices_and_marks(spark, licence_rows):
    found = {}
    for r in license_scan.scan(_frame(spark, [r for r in licence_rows if r[0] is not None and r[0] < 22 and r[1] != licence_rows[7][1]])).collect():
        found.setdefault(r["doc_id"], []).append((set(r["labels"]), round(r["score"], 3), r["spans"]))
    labels = {i: x[0][0] for i, x in found.items()}
    assert labels[1] == labels[2] == {"mit"} and labels[3] == {"bsd"} and labels[4] == set()
    assert 0.3 < found[4][0][1] < 0.8 and 0.95 < found[2][0][1] < 1 and found[3][0][1] == 1.0
    assert labels[5] >= {"mit", "apache", "apache-2.0"} and labels[9] == {"cc-by-nc-sa"} and labels[10] == {"cc-by-nc"}
    assert labels[11] == {"cc-by"} and labels[12] == {"gpl-3.0"} and labels[15] == set() and labels[8] == set()
    span = next(s for s in found[3][0][2] if s["label"] == "bsd")
    assert (span["low"], span["high"]) == (1, len(_words(license_scan.NOTICES[1][1])) + 2)
    long = sum(s["label"] == "apache-2.0" and s["high"] - s["low"] > 20 for s in found[6][0][2])
    assert long == 2


def test_scan_equals_its_sql(spark, licence_rows):
    import duckdb

    df = _frame(spark, [r for r in licence_rows if r[0] is not None and r[0] < 210])
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(license_scan.scan_sql()).fetchall()
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    got = license_scan.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score").collect()
    assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key)


def test_scan_of_nothing(spark):
    assert license_scan.scan(_frame(spark, [])).count() == 0
    assert license_scan.scan(_frame(spark, [(1, "no notice here", "en", "s")])).first()["labels"] == []


# --- divergence audit --------------------------------------------------------------------

def _audited(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, source in rows]
    held, used = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        held.update((lang, t) for t in set(terms))
        used[lang, source].update(terms)
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)

    def shares(lang, counts):
        v, n = len(kept[lang]), sum(counts[t] for t in kept[lang])
        return {t: 1 + 10 ** 9 * (counts[t] + 5) // (n + 5 * v) for t in kept[lang]}

    out = []
    for (lang, source), counts in used.items():
        p, all_counts = shares(lang, counts), sum((c for (x, _), c in used.items() if x == lang), Counter())
        q = shares(lang, all_counts)
        others = [(sum(abs(p[t] - o[t]) for t in p), s) for (x, s), c in used.items() if x == lang and s != source for o in [shares(lang, c)]]
        terms = [(p[t] - q[t], t) for t in p if counts[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", others, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return out


@pytest.mark.parametrize("least,top,piece,level", [(5, 50, 1 << 20, 4), (2, 3, 40, 1), (1, 7, 1 << 20, 2), (1000, 50, 1 << 20, 4)])
def test_audit_is_brute_force(spark, rows, monkeypatch, least, top, piece, level):
    monkeypatch.setattr(divergence, "PIECE", piece)
    monkeypatch.setattr(divergence, "FIRST_LEVEL", level)
    some = rows if piece > 100 else [r for r in rows if len(r[1] or "") < 6000]
    got = divergence.audit(_frame(spark, some), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(_audited(some, least, top))


def test_audit_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "broadcast_if", lambda df: df)
    got = divergence.audit(_frame(spark, rows), 3, 5)
    assert sorted(map(tuple, got.collect())) == sorted(_audited(rows, 3, 5))


def test_audit_of_nothing(spark):
    assert divergence.audit(_frame(spark, [])).count() == 0
    assert divergence.audit(_frame(spark, [(1, None, None, None), (2, "", "", "s")]), 1).collect()[0]["value"] == 0


def test_prefixes_keep_exactly_the_frequent_terms(spark):
    """Terms that are prefixes of each other, at, below and above the level sizes, and at the threshold."""
    family = ["abcd"[:n] for n in (1, 2, 3, 4)] + ["abcd" + "e" * n for n in (1, 3, 4, 5, 12, 13, 60)] + ["abcf", "é", "éa", "éééé", "ééééé"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(family, rng.randint(1, 6)) * 2), "en", "s") for i in range(60)]
    held = Counter(t for r in rows for t in set(r[1].split()))
    for least in (10, 14, 20):
        lists = divergence.settle(divergence.term_lists(_frame(spark, rows)), "terms")
        got = {bytes(r["term"]).decode() for r in divergence.frequent_terms(lists, least).collect()}
        assert got == {t for t, n in held.items() if n >= least}
