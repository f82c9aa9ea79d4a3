"""The corpus pipeline on a small corpus: each stage against brute force over its own input, and odd column names."""

import hashlib
import os
import random
import re

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from regilake.llm import near_join, quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `my col` string, `a.b` int, hash string"


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijk", k=r.randint(2, 7))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=120)) for _ in range(80)]
    passage = " ".join(r.choices(words, k=14))
    texts += [texts[0], texts[1] + " one more", texts[2].replace(" ", "  "), texts[3] + " " + passage, "short text", "", None, "spam " * 80, "# $ % " * 40]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or ""), "x", i, "h") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(87, 0, 0), (88, 0, 1)], "doc_id long, quality int, toxic int") \
        .write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame([(1, passage.upper()), (2, None)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder, docs, passage


def test_each_stage_against_brute_force(spark, corpus):
    folder, docs, passage = corpus
    stages, given = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = corpus_pipeline.materialize(stage(spark, given, folder), name.replace(" ", "-"))
        assert given.columns == docs.columns
        stages.append({r.doc_id: r.text for r in given.collect()})
    classified, ruled, single, clean = stages
    assert set(range(80)) - set(classified) == set() and 88 not in classified

    for i, t in classified.items():  # the base rules; the fences may reject more
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            assert i not in ruled
    assert set(range(80)) <= set(ruled)

    sets, kept = {i: shingles(t) for i, t in ruled.items()}, set()
    for i in sorted(sets):  # groups are pairs with their least member here
        if not any(sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept):
            kept.add(i)
    assert set(single) == kept and 80 not in kept and 81 not in kept and 82 not in kept

    window = alnum(passage)
    grams = {tuple(window[k:k + 10]) for k in range(len(window) - 9)}
    leaks = {i for i, t in single.items() if any(tuple(alnum(t)[k:k + 10]) in grams for k in range(len(alnum(t)) - 9))}
    assert set(clean) == set(single) - leaks

    out = corpus_pipeline.run(spark, folder).collect()
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(corpus_pipeline.RANKS)))
    assert {r.doc_id for r in out} == set(clean)
    for r in out:
        ids = encoder.encode_ordinary(clean[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_filters_keep_odd_column_names(corpus):
    _, docs, _ = corpus
    for kept in (quality_rules.filter_documents(docs), near_join.keep_one(docs)):
        assert kept.columns == docs.columns and kept.count() >= 80
        assert {r["a.b"] for r in kept.select("`a.b`").collect()} <= set(range(89))


def test_bpe_does_not_depend_on_its_bounds(spark, corpus):
    docs, ranks = corpus[1], public_tokenizers.path(corpus_pipeline.RANKS)
    few = corpus_pipeline.bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, memo=1, chars=3000)
    many = corpus_pipeline.bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
