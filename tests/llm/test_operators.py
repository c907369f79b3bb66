"""Each operator against brute force, on rows with NULLs, empty texts, copies and clashing columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import (attribution, bm25, chat, components, host_graph, mixing, multi_index, ngram_join, packing, private_data,
                           quality, tokenizing)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size int, rank int"


def _texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    near = texts[5].split() * 2
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100, " ".join(near), "en", "s0"), (101, " ".join([*near, "zz"]), "en", "s0"), (102, " ".join(near), "en", None),
             (103, None, "en", "s1"), (104, "", None, "s1"), (105, " \n\t ", "en", None), (None, texts[0], "en", "s2"),
             (None, "only here without an id at all", "en", "s2"), (7, texts[7], "en", "s3"), (7, texts[7], "en", "s3"),
             (106, "one two", "en", "s1"), (107, "One\tTWO", "en", "s1"), (108, "é́ ß \U0001d7d8 \x1c x" * 3, "en", "s9"),
             (109, "word " * 30_000, "en", "s1")]
    return spark.createDataFrame([(*r, 0, 0.5, "k", 1, 2) for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _words(t):
    return (t or "").encode().lower().split()


def _set(t):
    w = _words(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_similar_groups_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [_set(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, r in enumerate(rows):
        ids = [x["doc_id"] for x, g in zip(rows, group) if g == group[i] and x["doc_id"] is not None]
        want.append((r["doc_id"], len(sets[i]), (min(ids) if ids else None) if sets[i] else r["doc_id"]))
    got = [tuple(r) for r in ngram_join.similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_near_copies_link_across_leaders(spark):
    """A chain and a star of near copies, and pairs just below and at the limit."""
    base = [f"w{i}" for i in range(104)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        t = list(base)
        t[(7 * i) % 104] = f"x{i}"
        if i % 3 == 0:
            t[(11 * i + 50) % 104] = f"y{i}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:4 + k])) for i, k in enumerate((8, 9, 10, 11, 12, 80, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: _set(t) for i, t in rows}
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(df).collect()} == low


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, 150), (150, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {150: 150, 200: 150}


def test_packing_places_every_id_once(docs):
    encoder = tokenizing.WordEncoder(tokenizing.vocabulary("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, lookahead=3_000).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(encoder.model.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
                  for r in docs.select("doc_id", "text").collect())
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    for r in rows:
        assert 0 < r["length"] <= 2048 and r["start"] + r["length"] <= r["doc_tokens"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    text = docs.where("doc_id = 3").first()["text"]
    ids = np.array([*encoder.model.encode(text, add_special_tokens=False).ids, 1], "<u4")
    for r in rows:
        if r["doc_id"] == 3:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


def test_fill_window_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        chosen = packing.fill_window(counts, 40)
        first = max(counts)
        sums = {first}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n - (length == first) + 1)}
        assert all(chosen[x] <= counts[x] for x in chosen)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= 40)


def test_word_encoder_is_the_tokenizer():
    encoder = tokenizing.WordEncoder(tokenizing.vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "é", "ß", "İ", "Σ", "1", ".", ",", "'s", "!", " ", "\t", "\n", "\x1c", "\x85", " ", "中", "😀",
                "<|endoftext|>", "́", "ſ", "ﬁ", "-", "the", "ing"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)] + _texts(20)
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(t, add_special_tokens=False).ids, repr(t)


def test_mix_reaches_its_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum(g[0]["target"] for g in by.values()), total)
    for group in by.values():
        target, size = group[0]["target"], sum(r["size"] for r in group)
        assert size == group[0]["source_size"] and target <= 3 * size
        assert target - len(group) - 1 <= sum(r["taken"] for r in group) <= target
        assert all(r["taken"] <= 3 * r["size"] for r in group)
    taken = {}
    for r in mixing.mixed_rows(docs).select("source", "text").collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(_words(r["text"]))
    assert taken == {s: n for s, g in by.items() if (n := sum(r["taken"] for r in g))}


def test_attribution_adds_up(docs):
    encoding, _ = tokenizing.byte_encoder(tokenizing.vocabulary("byte_bpe_50k.tiktoken"))
    got = {}
    for r in attribution.count_tokens(docs.where("doc_id >= 100")).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    for r in docs.where("doc_id >= 100").collect():
        assert got[r["doc_id"]] == len(encoding.encode_ordinary(r["text"] or ""))
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 6, 9])
    assert [attribution.attribute(starts, ends, bounds, r)[0].tolist() for r in ("most", "first", "last")] == [[1, 1, 1], [2, 1, 0], [1, 1, 1]]


BASE = "a.b@c.de x@y 1.2.3.4 or 300.1.1.1 or 4111 1111 1111 1111 or +1 (555) 123-4567 or 4111111111111112"


@pytest.mark.parametrize("text, kind, found", [
    ("write to jane.doe [at] mail (dot) example (dot) com now", "email", "jane.doe [at] mail (dot) example (dot) com"),
    ("write to jane at mail dot example dot com now", "email", "jane at mail dot example dot com"),
    ("to jаne.doe＠exаmple.com now", "email", "jаne.doe＠exаmple.com"),
    ("call plus one five five five one two three four five six seven now", "phone",
     "plus one five five five one two three four five six seven"),
    ("host one nine two dot one six eight dot one dot nine end", "ip", "one nine two dot one six eight dot one dot nine"),
    ("card ４１１１１１１１１１１１１１１１ end", "card", "４１１１１１１１１１１１１１１１"),
])
def test_disguised_data_maps_back(text, kind, found):
    spans = private_data.private_spans("é " + text)
    assert [(private_data.KINDS[k], ("é " + text)[s:e], d) for s, k, e, d in spans] == [(kind, found, True)]
    assert found not in private_data.redact("é " + text, spans)


def test_base_spans_and_clean_texts():
    found = [(private_data.KINDS[k], BASE[s:e]) for s, k, e, d in private_data.private_spans(BASE) if not d]
    assert found == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    for clean in ("look at the one two three dots.", "meet me at example.com at two", "", "a (at) b", "seven eight nine times"):
        assert private_data.private_spans(clean) == []


def test_private_data_table(docs, none):
    rows = private_data.find_private(docs, keep=["doc_id", "score", "text"], redacted=True).collect()
    assert len(rows) == docs.count() and all(r["redacted"] == r["text"] for r in rows)
    assert private_data.find_private(none).count() == 0


def test_trust_and_distrust(spark):
    link = lambda *to: "".join(f'<p><A class="x" HREF="https://{h}/a">t</a>' for h in to)
    rows = [(1, "http://seed.org/fr/1", link("friend.example.com", "both.example.com")), (2, "https://bad.net/x", None),
            (3, "http://friend.example.com/en/", ""), (4, "http://FARM.example.com/en/?q#f", link("bad.net", "bad.net")),
            (5, "http://both.example.com", link("friend.example.com")), (6, "http://far.example.com/", link("farm.example.com")),
            (7, None, None), (8, "nothing", "x"), (9, "http://a.example.net/en/1", ""), (10, "http://x.example.com/de/1", ""), (2, "https://bad.net/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_graph.judge_pages(pages).collect()}
    assert got[1] == ("seed.org", "/fr/1", "org/fr/", "allow") and got[2] == ("bad.net", "/x", "net/", "block")
    assert got[4] == ("farm.example.com", "/en/", None, "block") and got[6][3] == "block"
    assert got[3][3] == got[5][3] == "allow" and got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("example.net/en/", "allow") and got[10][2:] == ("example.com/de/", "block")
    assert host_graph.judge_pages(pages.limit(0)).count() == 0


def test_undecided_pages_follow_the_net_evidence_of_their_host(spark):
    def pages(host, blocked, allowed, open_):   # rules: /b/ blocks, /a/ allows
        return [(f"{host}-{kind}{i}", f"http://{host}/{kind}/{i}", "")
                for kind, n in (("b", blocked), ("a", allowed), ("o", open_)) for i in range(n)]

    rules = tuple(host_graph.Rule(v, h, p) for h in ("few.x", "hot.x", "mixed.x", "good.x", "even.x")
                  for v, p in (("block", "/b/"), ("allow", "/a/")))
    rows = (pages("few.x", 1, 0, 9) + pages("hot.x", 49, 0, 51) + pages("mixed.x", 3, 2, 9) + pages("good.x", 2, 3, 9)
            + pages("even.x", 2, 2, 1) + pages("none.x", 0, 0, 2))
    got = host_graph.judge_pages(spark.createDataFrame(rows, "page_id string, url string, html string"), rules=rules).where("rule is null")
    assert {(r["host"], r["verdict"]) for r in got.collect()} == {
        ("few.x", "block"), ("hot.x", "block"), ("mixed.x", "block"), ("good.x", "allow"), ("even.x", "allow"), ("none.x", "allow")}


def test_personal_rank_is_the_power_iteration(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 1)], "src string, dst string, links long")
    got = {r["host"]: r["r"] for r in host_graph.personal_rank(links, spark.createDataFrame([("a", 2), ("d", 2)], "host string, weight long"), "r").collect()}
    m, s = np.array([[0, 0, 1, 0], [.25, 0, 0, 0], [.75, 1, 0, 0], [0, 0, 0, 0]]), np.array([.5, 0, 0, .5])
    x = s.copy()
    for _ in range(host_graph.ROUNDS):
        x = 0.15 * s + 0.85 * m @ x
    assert np.allclose([got.get(h, 0) for h in "abcd"], x)


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    names = [f"h{i:02}" for i in range(16)]
    links = spark.createDataFrame([(a, b, 1) for a, b in zip(names, names[1:])], "src string, dst string, links long")
    judged = spark.createDataFrame([(names[-1], ("r", "block"))], "host string, match struct<rule:string,verdict:string>")
    got = {r["host"]: r for r in host_graph.judge_hosts(judged, links).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == dict.fromkeys(names, "block")
    assert np.allclose([got[h]["distrust"] for h in reversed(names)], 0.15 * 0.85 ** np.arange(16), rtol=1e-6)


def test_weak_distrust_counts_however_many_seeds(spark):
    judged = spark.createDataFrame([("weak", "block", 1), ("big", "block", 5_000_000_000_000)], "host string, v string, n long")
    links = spark.createDataFrame([("far", "weak", 1)], "src string, dst string, links long")
    seeds = judged.select("host", F.col("n").alias("weight"))
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    rank = {r["host"]: r["d"] for r in host_graph.personal_rank(against, seeds, "d").collect()}
    assert 0 < rank["far"] < 5e-13
    trust, distrust = 0.0, rank["far"]
    row = spark.createDataFrame([(trust, distrust)], "trust double, distrust double")
    assert row.select(host_graph.verdict_of("trust", "distrust")).first()[0] == "block"


def test_search_is_brute_force(docs, none):
    rows = [(r["doc_id"], _words(r["text"])) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    asked = docs.where("doc_id in (0, 5, 100, 103, 106, 109)").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for r in bm25.search(docs, asked, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    for q, text in asked.collect():
        scores = []
        for i, w in rows:
            s = 0.0
            for t in set(_words(text)) & set(w):
                df = sum(t in x for _, x in rows)
                s += math.log1p((n - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s:
                scores.append((-round(s, 9), i))
        want = sorted(scores)[:5]
        assert [i for i, _ in got.get(q, [])] == [i for _, i in want]
        assert np.allclose([s for _, s in got.get(q, [])], [-s for s, _ in want])
    assert bm25.search(none, asked).count() == 0


def test_neighbours_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    x[100:160] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 6), (1040, [1.0, float("nan")] * 3), (1060, [1.0, None] * 3), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in multi_index.search(df, lambda i: i % 20 == 0, centroids=4, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(0, 400, 20))
    wide = x.astype(np.float64)
    for q, near in got.items():
        s = np.round(wide @ wide[q], 12)
        assert near == [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
    few = df.where("vec_id < 3")
    assert multi_index.search(few, lambda i: i == 0).count() == 2 and multi_index.search(df.limit(0), lambda i: i == 0).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|im_end|>", "<\\|", "<\\\\|x", "\n", "é", "|>", "<", "\\", "|", "assistant", "<|im_start|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(200)]
    roles = [rng.choice(["user", "assistant", "a\nb<|", ""]) for _ in texts]
    pieces, start, end = chat.assemble(roles, texts)
    for piece, role, text, a, b in zip(pieces.to_pylist(), roles, texts, start, end):
        assert chat.parse_piece(piece) == (role, text) and chat.unescape(piece[a:b]) == text
        assert piece.count("<|im_start|>") == piece.count("<|im_end|>") == 1
    rows = [(1, 1, "assistant", "b"), (1, None, None, None), (1, 0, "user", "a"), (None, 0, "assistant", "x"), (2, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 1 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_ranker_orders_documents(spark):
    rng = random.Random(6)
    good = [(i, " ".join(_texts(1, i)[0].split()) + ".") for i in range(0, 120)]
    bad = [(i, " ".join(w.upper() + "!!" for w in _texts(1, i)[0].split())) for i in range(120, 240)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (501, ""), (3, good[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, 1), (None, 0), (9, None), (9999, 0)],
                                   "doc_id long, quality int")
    ranker = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, ranker).collect()
    assert len(rows) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] < 120) for r in rows if r["doc_id"] < 240) >= 235
    empty = quality.fit_quality(docs.limit(0), labels)
    assert quality.score_quality(docs, empty).where("predicted = 1").count() == 243


def test_empty_tables(none):
    assert ngram_join.similar_groups(none).count() == 0 and packing.pack_documents(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0 and attribution.count_tokens(none).count() == 0


def test_neighbours_found_with_the_defaults(spark):
    """Recall against brute force at the default share."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.toPandas()
    v, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    found = multi_index.search(df, lambda i: i % 20 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = [len(near & set([i for i in ids[np.lexsort((ids, -(v @ v[ids == q][0])))] if i != q][:20])) for q, near in found.items()]
    assert len(hits) == (ids % 20 == 0).sum() and sum(hits) >= 0.9 * 20 * len(hits)


def test_long_local_parts_and_spelled_hints():
    for n in (3, 99, 150, 5000):
        text = "write to a1." + "b" * n + " at mail.example.com today"
        assert [(text[s:e], d) for s, _, e, d in private_data.private_spans(text)] == [(text[9:-6], True)]
    import pyarrow as pa
    texts = [None, "", "call ONE two", "one", "\u017fix seven", "phone. nine-", "tenone ", "Zero.", "x" * 100_000 + " oh-"]
    import re
    hint = re.compile(private_data._SPELLED_HINT)
    assert private_data.may_spell(pa.array(texts)) == [hint.search((t or "").lower()) is not None for t in texts]


def test_forgetful_encoder_gives_the_same_ids(monkeypatch):
    path = tokenizing.vocabulary("word_bpe_49k.json")
    texts = [*_texts(80, 9), "", None, "One, TWO; three! \u00e9t\u00e9 42 a-b"]
    want = tokenizing.WordEncoder(path).encode(texts)
    monkeypatch.setattr(tokenizing, "CACHED_WORDS", 20)
    monkeypatch.setattr(tokenizing, "CACHED_RUNS", 10)
    few = tokenizing.WordEncoder(path)
    assert [x for t in texts * 2 for x in few.encode([t])] == want * 2
    assert len(few.words.old) < 200 and len(few.runs.new) < 200


def test_windows_and_marks_inside_words_give_the_tokenizers_ids(monkeypatch):
    encoder = tokenizing.WordEncoder(tokenizing.vocabulary("word_bpe_49k.json"))
    rng = random.Random(4)
    alphabet = ["a", "B", "J", "\u00c9", "\u00de", "\u00df", "\u00ff", "\u00d7", "\u00f7", "\u0130", "\u030c", "\u0338", "'S", "'", ".", ",",
                "!", "#", "=", "1", " ", "\n", "\xa0", "\u3000", "\u4e2d", "<|ENDOFTEXT|>", "<|endoftext|>", "the", "ING"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for window in (5, 64, 1_000_000):
        monkeypatch.setattr(tokenizing, "WINDOW_BYTES", window)
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(t, add_special_tokens=False).ids, repr(t)
    assert encoder.encode([]) == [] and encoder.encode([None, "", " \n"]) == [b"", b"", b""]
    import pyarrow as pa
    assert encoder.encode(pa.array(["no", None, *texts]).slice(2)) == encoder.encode(texts)


def test_encoding_a_long_text_needs_no_object_a_word():
    import tracemalloc
    encoder = tokenizing.WordEncoder(tokenizing.vocabulary("word_bpe_49k.json"))
    text = "some words of one long text, twice. " * 400_000
    tracemalloc.start()
    ids = encoder.encode([text])[0]
    peak = tracemalloc.get_traced_memory()[1] - 2 * len(ids)      # the parts and the whole
    tracemalloc.stop()
    assert len(ids) == 4 * 9 * 400_000 and peak < 6 * len(text)
