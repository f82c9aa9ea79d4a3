"""Lexical search, source mixing and drift-bounded clustering against brute force, invariants and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regilake.llm import drift_means, lexical_search, mixing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, source string, qid long, h1 string, size string, `a.b` string, `my col` int"


def terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdeé0", k=r.randint(1, 5))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    out = [" ".join(r.choices(vocabulary, weights, k=r.choice([3, 30, 200]))) for _ in range(300)]
    out += [out[5]] * 40 + [out[6]] * 3 + [None, "", "...", "LONG Long " + "z " * 200_000 + out[7], "中文 😀 " * 30, "a-b_c A"]
    return out


def rows_of(texts):
    return [(None if i in (9, 305) else i, t, ["x", "é", None, "B"][i % 4], 1, "h", "s", "d", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = rows_of(texts)
    return spark.createDataFrame(rows + rows[:3], DOCS).repartition(5)


def brute_search(rows, items, k=20):
    counted = [(r[0], Counter(terms(r[1]))) for r in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, docs, texts):
    rows = rows_of(texts)
    items = [(1, texts[0]), (2, texts[5]), (3, texts[5]), (3, texts[5]), (None, "nothing like it 0"), (4, None), (5, "..."), (6, "qqqq"),
             (7, "LONG z z"), (8, "中文"), (9, " ".join(texts[20:60])), (10, texts[6] + " " + texts[7])]
    asked = spark.createDataFrame([(i, t, "n", 3) for i, t in items], "item_id long, text string, term string, doc_id int")
    got = lexical_search.search(docs, asked).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == brute_search(rows + rows[:3], items)


def test_search_batches_and_slices(spark, docs, texts, monkeypatch):
    rows = rows_of(texts)
    items = [(i, t) for i, t in enumerate(texts[30:37])]
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    monkeypatch.setattr(lexical_search, "TERMS", 60)
    monkeypatch.setattr(lexical_search, "SLICE", 2)
    monkeypatch.setattr(lexical_search, "BROADCAST_PAIRS", 4)
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == brute_search(rows + rows[:3], items, 5)


def test_bounds_are_never_below_the_score(spark, docs, texts):
    asked = lexical_search.item_terms(spark.createDataFrame([(1, texts[0] + " " + texts[1])], "item_id long, text string"))
    n, total, _ = lexical_search.statistics(docs, asked)
    index = lexical_search.sketches(docs, n, total).toArrow().to_batches()
    batch = lexical_search.Batch([(0, [(t.encode(), 3) for t in set(terms(texts[0] + " " + texts[1]))])])
    by_text = {}
    for a, b, u in batch.bounds(index):
        by_text.update(zip(zip(a.tolist(), b.tolist()), u[:, 0].tolist(), strict=True))
    keyed = lexical_search._keyed(docs).collect()
    for r in keyed:
        c = Counter(terms(r.text))
        if c:
            factor = lexical_search.length_factor(sum(c.values()), n, total)
            exact = sum(3 * lexical_search.impact(c[t.decode()], factor) for t in batch.weights[0] if t.decode() in c)
            assert exact <= by_text[r.h1, r.h2]


def test_search_on_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(none, items).columns == ["item_id", "rank", "doc_id", "score"]


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_are_reshared():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    got = mixing.targets([10, 1000, 1000])
    assert got[0] == 20 and got[1] == pytest.approx(2 * got[2]) and sum(got) == pytest.approx(1.5 * 2010)
    assert mixing.targets([100]) == [150.0]


def test_permutations_hit_every_index_once():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, (1, 2, 3)).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, (1, 2, 3)).tolist() != mixing.permuted(np.arange(1000), 1000, (1, 2, 4)).tolist()


def test_shard_counts_meet_the_totals():
    plan = mixing.Plan(["a", "b", "c"], [50_000, 9_000, 0], [25_000.0, 18_000.0, 0.0], 8, 100, 3)
    got = list(plan.counts(0, plan.shards))
    assert [k for k, _, _ in got] == list(range(plan.shards))
    assert all(own.sum() == 100 for _, own, _ in got[:-1]) and sum(own for _, own, _ in got).tolist() == plan.slots.tolist()
    before = np.zeros(3, np.int64)
    for k, own, begin in got:
        assert begin.tolist() == before.tolist()
        before += own
        assert [x[1].tolist() for x in plan.counts(k, k + 1)] == [own.tolist()]  # a task finds its shards alone
    spread = np.array([own[0] for _, own, _ in got[:-1]])
    assert 0 < spread.std() < 10


@pytest.mark.parametrize("options", [{}, {"block": 7, "shard": 11}, {"block": 1000, "weights": (1, 9), "total": 0.7}])
def test_mix_meets_targets_and_reruns_agree(docs, texts, options):
    rows = rows_of(texts)
    rows += rows[:3]
    mixed, places, plan = mixing.mix_documents(docs, **options)
    taken = {r.row: r.n for r in mixed.groupBy("row").agg(F.sum("words").alias("n")).collect()}
    found = places.collect()
    assert len(found) == len(rows) and sorted(r["size"] for r in found) == sorted(word_count(r[1]) for r in rows)
    of = defaultdict(int)
    for r in found:
        assert taken.get(r.row, 0) <= 2 * r["size"]
        of[r.s] += taken.get(r.row, 0)
    assert plan.names == ["B", "x", "é", None]
    assert [of[s] for s in range(4)] == [round(t) for t in plan.targets]
    slots = [(r.shard, r.slot) for r in mixed.select("shard", "slot").distinct().collect()]
    assert len(slots) == plan.total
    again, other, _ = mixing.mix_documents(docs.repartition(3), **options)
    digest = lambda m, p: sorted(map(repr, m.join(p.select("row", "doc_id", "h1"), "row").drop("row").collect()))
    assert digest(mixed, places) == digest(again, other)


def test_mixed_words_are_the_documents_words(spark, docs, texts):
    rows = [r for r in rows_of(texts) if r[0] != 303]
    few = spark.createDataFrame(rows, DOCS)
    mixed, places, plan = mixing.mix_documents(few, block=50, shard=16)
    got = mixing.with_text(mixed, places, few).collect()
    source = {r[0]: r[1].split() for r in rows if r[1] and r[0] is not None}
    assert sum(word_count(r.text) for r in got) == plan.words.sum()
    for r in got:
        if r.doc_id is not None:
            assert f" {r.text} " in f" {' '.join(source[r.doc_id])} "
    assert len({(r.shard, r.slot, r["at"]) for r in got}) == len(got)


def test_mix_of_an_empty_table(spark):
    mixed, places, _ = mixing.mix_documents(spark.createDataFrame([], DOCS))
    assert mixed.count() == 0 and places.count() == 0
    mixed, places, _ = mixing.mix_documents(spark.createDataFrame([(1, None, "a", 1, "h", "s", "d", 2)], DOCS))
    assert mixed.count() == 0 and places.count() == 1


def brute_means(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


VECTORS = "vec_id long, embedding array<float>, v string, cluster int"


def vectors(n, seed, spread=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, 64)) * spread
    return [(i, (middle[i % 12] + r.normal(size=64)).astype("f4").tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.0), (2, 1.0), (3, 5.0)])
def test_means_equal_brute_force(spark, seed, spread):
    rows = vectors(400, seed, spread)
    bad = list(rows[0][1])
    rows += [(500, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (501, bad[:-1]), (502, bad + [0.0]), (503, [None] + bad[1:]),
             (504, [float("nan")] + bad[1:]), (505, [float("inf")] + bad[1:]), (506, None), (507, []), (508, rows[7][1]), (508, rows[7][1])]
    got, centroids = drift_means.cluster_vectors(spark.createDataFrame([(*r, "v", 1) for r in rows], VECTORS).repartition(3))
    got = got.collect()
    want, want_centroids = brute_means(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert centroids.tolist() == want_centroids
    if spread == 5.0:
        assert sum(r.scanned for r in got) < len(got)  # the bounds spare some vectors the scan


def test_loosening_bounds_every_vector_and_is_less_than_the_drift():
    r, ratio = np.random.default_rng(0), []
    for _ in range(60):
        old = r.normal(size=(4, 5)) * 10
        new, radius = old + r.normal(size=(4, 5)) * 3, r.uniform(0.1, 8, 4)
        got, drift = drift_means.loosening(old, new, radius), np.linalg.norm(new - old, axis=1)
        for i in range(4):
            x = r.normal(size=(500, 5))
            x = old[i] + x * (radius[i] * r.uniform(0, 1, 500) ** 0.05 / np.linalg.norm(x, axis=1))[:, None]
            nearer = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in range(4) if j != i)
            assert nearer <= got[i] <= np.delete(drift, i).max() * (1 + 1e-6)
            ratio.append(got[i] / np.delete(drift, i).max())
    assert np.mean(ratio) < 0.6


def test_means_of_few_large_and_no_vectors(spark):
    few = vectors(5, 4)
    got, centroids = drift_means.cluster_vectors(spark.createDataFrame([(*r, "v", 1) for r in few], VECTORS))
    assert sorted((r.cluster, r.distance) for r in got.collect()) == [(i, 0) for i in range(5)] and len(centroids) == 5
    none, centroids = drift_means.cluster_vectors(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and len(centroids) == 0 and {"vec_id", "cluster", "distance"} <= set(none.columns)
    large = [(i, [float(np.float32(x * 1e5)) for x in v]) for i, v in vectors(40, 5)]
    got, _ = drift_means.cluster_vectors(spark.createDataFrame([(*r, "v", 1) for r in large], VECTORS))
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == brute_means(large)[0]
    with pytest.raises(Exception, match="component"):
        drift_means.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, "v", 1)], VECTORS))
