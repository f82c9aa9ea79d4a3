"""Training-data operators against brute force, exact round trips and edge cases."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regilake.llm import (bpe, chat, decontaminate, kneser_ney, license_scan, near_join, quality_rules, token_file,
                          url_graph, warc)
from regilake.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, extra string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgé", k=r.randint(1, 6))) for _ in range(300)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(1, 120))) + "." for _ in range(60)]
    out += [out[0], out[0], out[1] + " tail", " ".join(out[2].split()[:-1]), "", None, "x", "a" * 5000, "# * $ " * 60,
            "\n\n  two  blanks \t tab\x1f​ end \n", "Released under the MIT License. MIT license!", "中文 😀 " * 30]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 7 else i, t, ["en", None, "de"][i % 3], "s" if i % 4 else None, "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_match_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_quality_measures_by_brute_force(docs, texts):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    for t in texts + ["a b c a b c", "x\nx\ny\nx", "q q q q"]:
        m = quality_rules.measure(t)
        assert (m[0], m[1], m[2], m[4], m[5]) == brute(t)


def test_quality_filter_keeps_columns_and_whole_rows(docs, empty):
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.filter_documents(empty).count() == 0


def test_url_rules_and_propagation(spark):
    page = lambda *links: "".join(f'<a href="{x}">' for x in links)
    rows = [(1, "https://A.example.com/fr/x", page("http://good.net/")), (2, "http://good.net/a", page("//far.net/x")),
            (3, "http://b.com/de/1", ""), (4, "http://spam.net/", page("http://b.com/de/1")), (5, "http://far.net", None),
            (6, None, None), (7, "no scheme", ""), (8, "http://x.org/en/1?q", ""), (9, "http://www.example.org/en/12#f", ""), (9, "http://x.org", "")]
    got = {(r.page_id, r.path): (r.host, r.rule, r.verdict) for r in
           url_graph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1, "/fr/x"] == ("a.example.com", "com/fr/", "allow")
    assert got[3, "/de/1"][2] == "block" and got[4, "/"] == ("spam.net", None, "block")
    assert got[2, "/a"][2] == "allow" and got[5, ""][2] == "allow"
    assert got[6, ""] == ("", None, "allow") and got[7, ""][0] == ""
    assert got[8, "/en/1"][1:] == ("org/", "allow") and got[9, "/en/12"][1:] == ("example.org/en/1", "block")
    assert got[9, ""][1] is None


def test_url_distrust_reaches_far_hosts(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="//h{i + 1}.net/">') for i in range(25)] + [(25, "http://h25.net/", '<a href="//b.com/de/1">'),
                                                                                          (26, "http://b.com/de/1", None)]
    got = url_graph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(27))


def test_chat_parts_and_round_trip(spark):
    part = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:long>>"
    rows = [(1, 0, "user", [("text", "see <s>[INST] \\e", None, None), ("image", None, "a.png", 576), ("text", "!", None, None)]),
            (1, 1, "assistant", [("text", "</s>\\l[", None, None)]), (1, 1, None, None), (None, None, "user", [("audio", None, "b", None)])]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, part))
           .select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.body) for t in out[1].turns] == [("user", "see <s>[INST] \\e<image 0.1>!"), ("", ""), ("assistant", "</s>\\l[")]
    assert out[1].loss == "</s>\\l[" and out[1].attachments[0].ref == "a.png" and out[1].expanded_tokens == 4 + 576 + 1 + 2
    assert out[None].attachments[0].place == "<audio 0.0>"


def test_near_join_by_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 10 * common >= 8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
    got = sorted(((r.doc.doc_id is None, r.doc.doc_id), r.n_links) for r in near_join.near_groups(docs).collect())
    assert got == sorted(((r.doc_id is None, r.doc_id), n) for r, n in zip(rows, links, strict=True))
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t]) == len({t for t in texts if t}) and near_join.keep_one(empty).count() == 0


def test_near_join_splits_large_groups(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1:]])) for i in range(0, 60)]
    monkeypatch.setattr(near_join, "BLOCK", 16)
    got = near_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component.doc_id for r in got} == {0} and {r.n_links for r in got} == {59}


def test_licences(docs, empty):
    rows = license_scan.scan_documents(docs).collect()
    mit = [r for r in rows if r.labels]
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in mit] == [(2, 3, 5, "mit")]
    assert license_scan.scan_documents(empty).count() == 0
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.BASE)
    idf = dict.fromkeys(index.postings, 1.0)
    for name, (text, _) in license_scan.TEMPLATES.items():
        found = license_scan.scan(["x"] * 0 + [b"head"] * 7 + text.encode().split(), index, idf)
        assert name in found[4] and found[5] > 0.99


def test_licences_of_one_file():
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.BASE)
    idf = dict.fromkeys(index.postings, 1.0)
    names = ["mit", "isc", "bsd", "gpl", "unlicense", "apache"]
    whole = " x y ".join(license_scan.TEMPLATES[n][0] for n in names).encode().split()
    assert set(names) <= set(license_scan.scan(whole, index, idf)[4])
    everything = " ".join(text for text, _ in license_scan.TEMPLATES.values()).encode().split()
    assert set(license_scan.scan(everything, index, idf)[4]) >= set(license_scan.TEMPLATES)
    alone = "this work is a creative commons attribution of gnu terms".encode().split()  # a key phrase among other templates' words
    assert "cc-by" in license_scan.scan([*everything[:100], *alone], index, idf)[4]


def test_kneser_ney_is_a_distribution_and_tells_junk(spark):
    good = ["the cat sat on the mat and the dog sat on the log"] * 30
    rows = [(i, f"{t} {i}", "en") for i, t in enumerate(good)] + [(100, "###$$$ %%%&&& ***###", "en"), (101, None, None), (102, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    model = kneser_ney.train(docs.where("doc_id < 30"))
    p = np.exp2(-kneser_ney.log_table(model).astype(float)).reshape(-1, kneser_ney.CLASSES)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    kept = {r.doc_id for r in kneser_ney.filter_documents(docs, labels).collect()}
    assert kept == {*range(30), 101, 102}
    assert kneser_ney.filter_documents(docs, labels.where("quality = 5")).count() == len(rows)


@pytest.fixture(scope="module")
def cyrillic(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choices("абвгдежзиклмнопрст", k=r.randint(2, 7))) for _ in range(40)]
    rows = [(i, " ".join(r.choices(vocabulary, k=40)), "ru") for i in range(120)]
    rows.append((500, "".join(c if c == " " else chr(ord(c) + 95) for c in rows[7][1]), "ru"))  # the same character classes
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), \
        spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")


def test_kneser_ney_knows_words_of_any_script(cyrillic):
    docs, labels = cyrillic
    got = {r.doc_id: r for r in kneser_ney.judge(docs, labels).collect()}
    assert got[500].char_bits == pytest.approx(got[7].char_bits)
    assert not got[500].kept and got[500].perplexity > 2 * got[7].perplexity
    assert sum(r.kept for r in got.values()) >= 115


def test_kneser_ney_word_pairs_are_a_distribution(cyrillic, spark):
    docs, labels = cyrillic
    labelled = kneser_ney._keyed(docs).join(kneser_ney.label_classes(labels), "doc_id")
    models = kneser_ney.WordModels(labelled)
    seen = kneser_ney.word_pairs(labelled, "cls").withColumn("f", 1 - F.col("f"))
    counts = {(r.f, r.h, r.w): r.g for r in seen.collect()}
    f, h = 0, next(iter(counts))[1]
    known = [r.w for r in models.words.where("f = 0").collect()]
    rows = [(1, 1, f, counts.get((f, h, w), -k), h, w, 1) for k, w in enumerate([*known, 12345])]
    p = [r.p0 for r in models.probabilities(spark.createDataFrame(rows, "doc_id long, hash long, f int, g long, h long, w long, n int")).collect()]
    more = models.words.select("w").distinct().count() - len(known)  # words that only the other model knows
    assert sum(p) + more * min(p) == pytest.approx(1, abs=1e-6)


def test_kneser_ney_finds_a_few_insults(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghiklmnoprst", k=r.randint(2, 7))) for _ in range(80)]
    texts = [r.choices(vocabulary, k=80) for _ in range(260)]
    for t in texts[200:]:
        t[r.randrange(80)] = r.choice(["idiot", "scum"])
    docs = spark.createDataFrame([(i, " ".join(t), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(250)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.filter_documents(docs, labels).collect()}
    assert not kept & set(range(200, 260)) and len(kept) >= 190


def test_token_file_round_trip(spark, docs, empty, tmpdir_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for k, d in enumerate((docs, empty)):
        file = f"{tmpdir_path}/{k}"
        token_file.write_token_file(token_file.encode_documents(d, path), file, t.get_vocab_size())
        got = sorted(token_file.read_token_file(spark, file).collect(), key=lambda r: r.start)
        ids = [[*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in d.collect()]
        assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted(ids)
        assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:len(got)]
        order = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert order == sorted(order)


def test_rans_from_checkpoints_and_damage():
    r = np.random.default_rng(0)
    ids = r.zipf(1.5, 700_000).clip(0, 999).astype("<u4")
    freq, start, symbol = token_file._tables(token_file.scale_frequencies(np.bincount(ids, minlength=1000)))
    payload, marks = token_file.rans_encode(ids, freq, start)
    assert len(payload) < 0.6 * ids.nbytes
    assert (token_file.rans_decode(payload, marks, len(ids), freq, start, symbol) == ids).all()
    step = token_file.LANES * token_file.CHECKPOINT_STEPS
    assert (token_file.rans_decode(payload, marks, len(ids), freq, start, symbol, first=1) == ids[step:]).all()
    assert zlib.crc32(payload) != zlib.crc32(payload[:-1] + b"x")


def test_bpe_against_tiktoken(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    want = sorted([enc.encode_ordinary(r.text or "") for r in docs.collect()])
    rows = out.collect()
    assert sorted(r.ids for r in rows) == want
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)
    back = bpe.decode_documents(out.select("doc_id", "ids"), path)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in docs.collect())
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_decontamination(spark, docs, empty, texts):
    items = [(1, texts[3]), (2, "x"), (3, None), (4, "words that are nowhere here at all in any of them"), (1, texts[3]), (5, texts[10])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        windows.setdefault(i, set()).update(tuple(w[k:k + 10]) for k in range(max(len(w) - 9, 1)) if w)
    want = []
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for i, wins in windows.items():
            for x in wins:
                for b in range(len(w) - len(x) + 1):
                    if tuple(w[b:b + len(x)]) == x:
                        hit.update(range(b, b + len(x)))
                        found.add(str(i))
        want.append((r.doc_id or -1, len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [(r.doc_id or -1, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in decontaminate.verdicts(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[4] for w in want)
    assert decontaminate.verdicts(empty, bench).count() == 0


def test_revisits(spark):
    schema = "record_id long, warc_type string, target_uri string, warc_time timestamp, payload_digest string, headers map<string,string>"
    import datetime as dt

    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, "response", "http://www.a.net:80/x/?ref=1", at(1), "d1", {"etag": "e1", "content-type": "t"}),
            (2, "response", "https://A.net/x", at(3), "d2", {"etag": "e2"}), (3, "revisit", "http://a.net/x#f", at(2), None, {"etag": "e1", "date": "now", "server": "s"}),
            (4, "revisit", "http://a.net/x", at(9), None, {"etag": "e1"}), (5, "revisit", "http://a.net/x", at(3), "d2", {}),
            (6, "revisit", "http://b.net/", at(3), None, None), (7, "revisit", None, at(3), None, None), (8, "revisit", "http://a.net/x", None, None, None)]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.status, r.target_id) for k, r in got.items()} == {
        3: ("resolved", 1), 4: ("etag differs", None), 5: ("resolved", 2), 6: ("no response", None), 7: ("no url or time", None), 8: ("no url or time", None)}
    assert got[3].headers == {"etag": "e1", "content-type": "t", "date": "now"} and got[3].url == "a.net/x"
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_revisits_with_null_and_shared_ids(spark):
    schema = "record_id long, warc_type string, target_uri string, warc_time timestamp, payload_digest string, headers map<string,string>"
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(i, "response", f"http://h.net/{k}", at(1), f"d{k}", {"etag": f"e{k}", "x": f"h{k}"}) for i, k in ((None, 0), (None, 1), (7, 2), (7, 3))]
    rows += [(i, "revisit", f"http://h.net/{k}", at(2 + n), None, {"etag": f"e{k}"}) for n in range(3) for i, k in ((None, 0), (None, 1), (8, 2), (8, 3))]
    rows += [(None, "revisit", "http://h.net/9", at(3), None, {})] * 2
    got = sorted((r.url, r.warc_time, r.status, r.payload_digest, (r.headers or {}).get("x")) for r in
                 warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect() if r.status == "resolved")
    assert got == sorted((f"h.net/{k}", at(2 + n), "resolved", f"d{k}", f"h{k}") for n in range(3) for k in range(4))
    assert warc.resolve_revisits(spark.createDataFrame(rows, schema)).count() == 14


def test_queries_have_their_names():
    import __spark_entry__ as E

    names = {re.match(r"op(\d+)_", q)[1] for q in E.queries() if q.startswith("op")}
    assert names == {str(i) for i in range(1, 14)} and "pipeline" in E.queries()
