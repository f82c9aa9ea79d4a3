"""The word models of operator 6 against brute force, looked up in several parts, and what is left of their tables."""

import math
import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regilake.llm import kneser_ney
from regilake.session import checkpoint_dir

DOCS = "doc_id long, text string, lang string"
LEFT = {"kn-trigrams", "kn-one", "kn-two", "kn-word-scores", "kn-scores", "kn-limits"}


def discounts(counts):
    n = [sum(c == k for c in counts) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
    found = [k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else 0.5 for k in (1, 2, 3)]
    return [0.0, *[d if 0 < d < k else 0.5 for k, d in zip((1, 2, 3), found, strict=True)]]


class Model:
    def __init__(self, texts, size):
        self.n = Counter(p for t in texts for p in zip(["", *t], t, strict=False))
        self.follow, self.total = Counter(w for _, w in self.n), Counter()
        for (h, _), n in self.n.items():
            self.total[h] += n
        self.d, d = discounts(self.n.values()), discounts(self.follow.values())
        seen = sum(self.follow.values())
        floor = sum(d[min(n, 3)] for n in self.follow.values()) / seen / size
        self.alone = lambda w: (self.follow[w] - d[min(self.follow[w], 3)]) / seen + floor
        self.cut = Counter()
        for (h, _), n in self.n.items():
            self.cut[h] += self.d[min(n, 3)]

    def p(self, h, w):
        gamma = self.cut[h] / self.total[h] if self.total[h] else 1.0
        n = self.n[h, w]
        return ((n - self.d[min(n, 3)]) / self.total[h] if n else 0.0) + gamma * self.alone(w)


def test_word_scores_against_brute_force_in_parts(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PART_WORDS", 500)
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 70))) + r.choice([".", " !!", ""]) for _ in range(90)]
    texts += [texts[0], "", None, "unheard words only", "Ab ab AB"]
    rows = [(None if i == 5 else i, t, ["en", None][i % 2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[7]], DOCS)
    labels = spark.createDataFrame([(i, int(i < 50), int(40 <= i < 60)) for i in range(80)], "doc_id long, quality int, toxic int")
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    got = kneser_ney.judge(docs, labels).collect()
    assert len(got) == len(texts) + 1
    assert {t.rsplit("-", 1)[0] for t in set(os.listdir(tables)) - before} <= LEFT

    of = {i: re.findall(r"[a-z]+|[^a-z\s]+", (t or "").lower()) for i, t in enumerate(texts)}
    fold = {x.doc_id: x.hash & 1 for x in got}
    given = {0: [*range(40), 7], 1: range(50, 80), 2: range(40, 60)}
    trained = {(c, f): [of[i] for i in given[c] if i != 5 and fold[i] != f] for c in given for f in (0, 1)}
    size = 1 + len({w for ts in trained.values() for t in ts for w in t})
    models = {m: Model(ts, size) for m, ts in trained.items()}
    for x in got:
        t, f = of[5 if x.doc_id is None else x.doc_id], x.hash & 1
        if not t:
            assert x.bits is None and x.ratio is None and x.worst is None and x.kept
            continue
        p = [[models[c, f].p(h, w) for h, w in zip(["", *t], t, strict=False)] for c in (0, 1)]
        assert x.bits == pytest.approx(-sum(map(math.log2, p[0])) / len(t), abs=2e-6)
        assert x.ratio == pytest.approx(sum(math.log2(b / a) for a, b in zip(*p, strict=True)) / len(t), abs=2e-6)
        assert x.worst == pytest.approx(max(math.log2(models[2, f].alone(w) / models[0, f].alone(w)) for w in t), abs=2e-6)


def test_a_blocks_pair_is_asked_for_once(spark):
    text = "one two three one two"
    docs = kneser_ney._keyed(spark.createDataFrame([(i, text, "en") for i in range(50)], DOCS).coalesce(1))
    blocks = kneser_ney.word_blocks(docs)
    asked = [kneser_ney._asked(blocks, True, k, 4).count() for k in range(4)]
    assert blocks.count() == 1 and sum(asked) == 4  # start one, one two, two three, three one
    assert kneser_ney._asked(blocks, False, 0, 1).count() == 4


def test_words_are_those_of_the_pattern(spark):
    alone = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
    word = rf"[{alone}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{alone}]]+|[^\s\p{{L}}\p{{M}}\p{{N}}]+"
    r = random.Random(3)
    pool = "abXYZ09 \n\t!?.,-éßжДѠΣςİ中々〇⺀あカไย฿ລខ។မ၊က\u3000\u2003\U0001f600\x0b\x1c\x85"
    texts = ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(1500)] + ["", None, " \n", "၊၊!၊", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = [x.words or [] for x in rows.select("i", F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)).alias("words")).orderBy("i").collect()]
    n, hashes = kneser_ney.word_hashes(texts)
    assert n.tolist() == [len(x) for x in found]
    of = {}
    for w, h in zip((w for x in found for w in x), hashes.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    assert [len(x) for x in kneser_ney.word_hashes([])] == [0, 0]


def test_packed_texts_are_read_without_a_step_of_their_own(spark):
    texts = ["Ab ab, ab", "", None, "один два 中文", "x" * 40]
    docs = kneser_ney._keyed(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS))
    packed = kneser_ney.packed(docs, "doc_id", "hash")
    pairs = [sorted(map(tuple, kneser_ney.word_pairs(x).collect())) for x in (docs, packed)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 8
    grams = [sorted(map(tuple, kneser_ney.count_trigrams(x).collect())) for x in (docs, packed)]
    assert grams[0] == grams[1] and sum(n for _, n in grams[0]) == sum(len(t or "") for t in texts)
    plan = kneser_ney.word_blocks(packed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # packed, read


def test_cost_table_is_made_piece_by_piece():
    k = kneser_ney.CLASSES
    model = {"gamma1": np.array([0.5]), "p1_at": np.array([3, 1]), "p1": np.array([0.2, 0.1]), "p2_at": np.array([5, 700]), "p2": np.array([0.3, 0.2]),
             "g2_at": np.array([0, 3]), "g2": np.array([0.5, 0.4]), "p3_at": np.array([k ** 3 - 1, 9, 2 * k * k, k * k + 7]),
             "p3": np.array([0.9, 0.8, 0.7, 0.6]), "g3_at": np.array([k + 1, 2]), "g3": np.array([0.25, 0.75])}
    tracemalloc.start()
    costs = kneser_ney.log_table(model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert costs.dtype == np.float32 and len(costs) == k ** 3 and peak < 2 * costs.nbytes
    one, g2 = {3: 0.2, 1: 0.1}, {0: 0.5, 3: 0.4}
    two = lambda w: {5: 0.3, 700: 0.2}.get(w, g2.get(w // k, 1.0) * one.get(w % k, 0.5 / k))
    three = dict(zip(model["p3_at"].tolist(), model["p3"].tolist(), strict=True))
    for w in [*three, 0, 5, 700, (k + 1) * k + 3, 2 * k + 1, 12345, 3 * k * k + 3 * k + 3]:
        p = three.get(w, {k + 1: 0.25, 2: 0.75}.get(w // k, 1.0) * two(w % (k * k)))
        assert costs[w] == pytest.approx(-math.log2(p), rel=1e-6)


def test_words_of_a_part_of_the_documents_are_on_disk_at_a_time(spark, monkeypatch):
    r, seen = random.Random(5), []
    docs = spark.createDataFrame([(i, " ".join(r.choices("abcdefgh", k=60)), "en") for i in range(120)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.materialize

    def told(df, label, free=False):
        table = kept(df, label, free)
        seen.append((label, table.agg(F.sum(F.size("doc_id"))).first()[0] if label == "kn-blocks" else table.count()))
        return table

    monkeypatch.setattr(kneser_ney, "materialize", told)
    monkeypatch.setattr(kneser_ney, "PART_WORDS", 500)
    assert kneser_ney.judge(docs, labels).count() == 120
    parts = [n or 0 for label, n in seen if label == "kn-blocks"]
    assert sum(parts) == 120 and max(parts) < 80
    assert all(label in {x for x, _ in seen} for label in ("kn-replies", "kn-labelled-texts"))


def test_keys_are_looked_up_by_range(spark):
    r = random.Random(6)
    keys = [0, 1, 2**63 - 1, -1, -2**63, *(r.randrange(-2**63, 2**63) for _ in range(300))]
    known = {(f, w): [r.choice([0, 1, 2, 300, 70_000, 2**33]) for _ in kneser_ney.WORD_VALUES] for f in (0, 1) for w in r.sample(keys, 200)}
    rows = spark.createDataFrame([(f, w, *v) for (f, w), v in known.items()], ", ".join(["f int, w long", *[f"{c} long" for c in kneser_ney.WORD_VALUES]]))
    tables = kneser_ney._by_range(rows.repartition(5), kneser_ney.WORD_VALUES, 0, 3)
    assert sorted(map(tuple, kneser_ney._rows(tables, "w", kneser_ney.WORD_VALUES, 3).collect())) == sorted((f, w, *v) for (f, w), v in known.items())

    asked, requests = {}, []
    for block in (4, 9):
        for f in (0, 1):
            words = np.sort(np.array([k % 2**64 for k in r.sample(keys, 120)], np.uint64))
            for at, begin, end in kneser_ney._ranges(words, 3):
                asked[block, f << 3 | at] = f, words[begin:end].view(np.int64).tolist()
                requests.append((f << 3 | at, end - begin, kneser_ney._zip_keys(words[begin:end]), block))
    got = kneser_ney.looked_up(spark.createDataFrame(requests, "range int, n int, keys binary, block long"), tables, 3).collect()
    assert len(got) == len(requests) and {(x.block, x.range) for x in got} == set(asked)
    none = [0] * len(kneser_ney.WORD_VALUES)
    for x in got:
        f, words = asked[x.block, x.range]
        values = kneser_ney._unzip(bytes(x.found), x.n * len(none)).reshape(len(none), -1).T.tolist()
        assert values == [known.get((f, w), none) for w in words]
