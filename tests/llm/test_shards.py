import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import bm25


def _texts(seed, n, words=400):
    """Skewed words, repeated texts, empty ones and one very long one."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(1, 60)) % words) for _ in range(n)]
    texts[5:8] = [texts[4]] * 3
    texts[9], texts[10] = "", None
    texts[11] = " ".join(f"w{w}" for w in rng.integers(0, words, 9_000)) + " w1" * 70_000
    return texts


def _scores(texts, query, df, average):
    """BM25 of every text by the formula, term by term."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        words = (text or "").split()
        for t in set(query.split()):
            tf = words.count(t)
            if tf:
                idf = np.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5))
                norm = bm25.K1 * (1 - bm25.B + bm25.B * len(words) / average)
                out[i] += idf * tf * (bm25.K1 + 1) / (tf + norm)
    return out


@pytest.mark.parametrize("k", [1, 10])
def test_shards_of_many_blocks_find_the_best_and_skip_postings(k):
    texts = _texts(3, 1_500)
    average = np.mean([len((t or "").split()) for t in texts])
    df = {}
    for t in texts:
        for w in set((t or "").split()):
            df[w] = df.get(w, 0) + 1
    shards, read = [], []
    for low in range(0, len(texts), 700):          # three shards, two of them with three blocks
        ids = list(range(low, min(low + 700, len(texts))))
        columns = bm25.build_shard(ids, [bm25.term_hashes(texts[i]) for i in ids])
        shards.append(bm25.Shard({f: pa.py_buffer(c) for f, c in zip(bm25._FIELDS, columns)}, average))
    assert [s.blocks for s in shards] == [3, 3, 1]
    assert {s.counts.itemsize for s in shards} == {1, 4}
    for s in shards:
        assert np.array_equal(s.run_max, np.maximum.reduceat(s._weights(slice(None)), s.run_start[:-1]))
        whole = s._weights
        s._weights = lambda spots, whole=whole: read.append(len(spots)) or whole(spots)

    asked = [texts[i] for i in (0, 4, 20, 333, 1_499)] + ["w1", "w1 w1 w399", "nowhere"]
    full = 0
    for query in asked:
        terms = bm25.term_hashes(query)[0]
        by_hash = {int(bm25.term_hashes(w)[0][0]): w for w in set(query.split())}
        found = np.array([df.get(by_hash[int(t)], 0) for t in terms], float)
        idf = np.log1p((len(texts) - found + 0.5) / (found + 0.5))
        full += int(found.sum())
        ids, scores, floor = np.empty(0, np.int64), np.empty(0), 0.0
        for s in shards:
            more = s.search(terms, idf, k, floor)
            ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores, floor = ids[best], scores[best], scores[best[-1]]
        best = np.lexsort((ids, -scores))[:k]
        want = _scores(texts, query, df, average)
        order = [i for i in np.lexsort((np.arange(len(texts)), -np.round(want, 9))) if want[i] > 0][:k]
        assert ids[best].tolist() == order
        assert np.allclose(scores[best], want[order], rtol=1e-12)
    assert 0 < sum(read) < full


def test_postings_of_common_terms_are_not_read_for_each_query():
    """Common words fill the lists; only rare ones and the documents that may be among the best are read."""
    rng = np.random.default_rng(8)
    texts = [" ".join([*(f"c{w}" for w in rng.permutation(120)[:rng.integers(60, 100)]), *(f"r{w}" for w in rng.integers(0, 4_000, 12))])
             for _ in range(900)]
    average = np.mean([len(t.split()) for t in texts])
    df = {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    columns = bm25.build_shard(list(range(900)), [bm25.term_hashes(t) for t in texts])
    shard, read, full = bm25.Shard({f: pa.py_buffer(c) for f, c in zip(bm25._FIELDS, columns)}, average), [], 0
    whole = shard._weights
    shard._weights = lambda spots: read.append(len(spots)) or whole(spots)
    for i in (0, 100, 500):
        terms = bm25.term_hashes(texts[i])[0]
        by_hash = {int(bm25.term_hashes(w)[0][0]): w for w in set(texts[i].split())}
        found = np.array([df[by_hash[int(t)]] for t in terms], float)
        full += int(found.sum())
        ids, scores = shard.search(terms, np.log1p((900 - found + 0.5) / (found + 0.5)), 10)
        want = _scores(texts, texts[i], df, average)
        order = np.lexsort((np.arange(900), -want))[:10]
        assert ids[np.lexsort((ids, -scores))].tolist()[:10] == order.tolist()
        assert np.allclose(np.sort(scores)[::-1][:10], want[order], rtol=1e-12)
    assert sum(read) < full / 10


def test_queries_side_by_side_are_answered_as_alone_and_a_known_score_saves_exact_ones():
    texts = [t for t in _texts(6, 1_000) if t]
    columns = bm25.build_shard(list(range(len(texts))), [bm25.term_hashes(t) for t in texts])
    shard = bm25.Shard({f: pa.py_buffer(c) for f, c in zip(bm25._FIELDS, columns)}, 40.0)
    terms = [bm25.term_hashes(t)[0] for t in [*texts[:30], "nowhere", "w1"]]
    asked = bm25.Asked([(t, 1 + (t % 7).astype(float)) for t in terms])     # an idf of its own for each term
    alone = [shard.search(t, 1 + (t % 7).astype(float), 10) for t in terms]
    floors = np.array([np.sort(s)[::-1][9] if len(s) >= 10 else 0.0 for _, s in alone])
    assert floors.max() > 0
    for given in (np.zeros(len(terms)), floors):
        for (ids, scores), (want, exact) in zip(shard.best(asked, 10, given), alone):
            assert ids.tolist() == want.tolist() and scores.tolist() == exact.tolist()
    read, whole = [], shard._weights
    shard._weights = lambda spots: read.append(len(spots)) or whole(spots)
    assert all(len(s) == 0 for (_, s), floor in zip(shard.best(asked, 10, floors * 3 + 1e-3), floors) if floor)
    assert sum(read) < 100


def test_queries_meet_some_groups_first_and_miss_nothing_in_the_rest(spark, monkeypatch):
    """Twenty groups, two of them first: the same as scoring every text, and the rest add few rows."""
    monkeypatch.setattr(bm25, "SHARD_DOCS", 20)
    monkeypatch.setattr(bm25, "GROUP_SHARDS", 1)
    monkeypatch.setattr(bm25, "HOME_SHARE", 10)
    texts = _texts(9, 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked = docs.where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), "text")
    kept, settle = [], bm25.settle
    monkeypatch.setattr(bm25, "settle", lambda df, label="step": kept.append((label, settle(df, label))) or kept[-1][1])
    found = {}
    for r in bm25.search(docs, asked, k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    average, df = np.mean([len((t or "").split()) for t in texts]), {}
    for t in texts:
        for w in set((t or "").split()):
            df[w] = df.get(w, 0) + 1
    for q in (i for i in range(0, 400, 40) if texts[i]):
        want = _scores(texts, texts[q], df, average)
        order = [i for i in np.lexsort((np.arange(400), -np.round(want, 9))) if want[i] > 0][:5]
        assert [i for i, _ in found[q]] == order
        assert np.allclose([s for _, s in found[q]], want[order], rtol=1e-12)
    first = dict(kept)["first"]
    assert first.groupBy("query_id").count().where("count > 10").count() == 0 < first.count()
    assert dict(kept)["shards"].count() == 20
