"""The corpus operators against brute force on small tables with nulls, ties, repeats, empties and very long texts."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as pt
import pytest
import xxhash
from tokenizers import Tokenizer

from phrasemill.llm import bpe, entry, exact_dedup, html_text, kn_quality, license_scan, packing, passages, simhash, topk, toxicity
from phrasemill.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(7)
WORDS = ["w%d" % k for k in range(400)]


def prose(n: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def table(spark, texts, lang="en"):
    rows = [(k, t, lang, "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "  \n\t", "a", "a b", "A  b\n", "a b", "x" * 20_000, prose(3000, 1), prose(3000, 1), "café \U0001f642", "a b"]


def clashing(df):
    """Extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(n) for n in ("h1", "rid", "name", "kept", "fp", "component", "score", "spans", "words", "key", "id", "label")])


# exact dedup ---------------------------------------------------------------------------------------------------------


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_against_brute_force(spark):
    texts = [*ODD, *[prose(n, s) for n in (1, 5, 3000) for s in (1, 2)], "a" * 9000 + "b", "a" * 9000 + "c", "a " * 9000 + "b"]
    got = exact_dedup.exact_dedup(clashing(table(spark, texts)), block=16).collect()
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(squeeze(t), []).append(k)
    assert len(got) == len(texts)
    for r in got:
        s = squeeze(texts[r.doc_id])
        keep = min(groups[s], key=lambda k: (-len(texts[k] or ""), k))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[s]), r.doc_id == keep, hashlib.sha256(s.encode()).hexdigest())
    assert len({(r.level, r.name) for r in got}) == len(groups)


def test_names_are_ranks_on_any_number_of_partitions(spark):
    docs = table(spark, [prose(900, s % 7) for s in range(20)])
    one = {r.doc_id: (r.level, r.name) for r in exact_dedup.identities(docs.repartition(1), block=64).collect()}
    assert one == {r.doc_id: (r.level, r.name) for r in exact_dedup.identities(docs.repartition(7), block=64).collect()}
    assert len(set(one.values())) == 7 and {n for _, n in one.values()} == set(range(1, 8))


def test_exact_dedup_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "ab", "en", "s", 2), (None, "z", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted(r.kept for r in got) == [False, False, True, True]
    kept = exact_dedup.keep_first(df).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, "a b"), (True, "z")]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# SimHash -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h)) if h else 0


def forest(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("chunk", [60_000, 5])
def test_simhash_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint_links", lambda f, b, _g=simhash.fingerprint_links: _g(f, b, chunk))
    base = [prose(300, s) for s in range(6)]
    near = [b.replace("w1 ", "v%d " % k, 1) for b in base for k in range(6)]
    texts = [*ODD, *base, *near, "one two three", "one two three four"]
    fps = [plain_fingerprint(t) for t in texts]
    want = forest(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    got = {r.doc_id: r for r in simhash.simhash_components(clashing(table(spark, texts))).collect()}
    assert [got[k].fingerprint for k in range(len(texts))] == ["%016x" % f for f in fps]
    assert [got[k].component_id for k in range(len(texts))] == want
    assert simhash.keep_one(table(spark, texts)).count() == len(set(want))


def test_trie_links_in_a_dense_ball():
    centre = int(rng.integers(2**62))
    keys = {centre}
    for _ in range(800):
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        keys.add(x)
    keys = np.array(sorted(keys), dtype=np.uint64)
    whole = np.array([[0, len(keys)]])
    want = forest(len(keys), [(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if int(keys[i] ^ keys[j]).bit_count() <= 4])
    assert simhash.trie_links(keys, whole, whole, 0, 4).tolist() == want


def test_simhash_empty_and_null_ids(spark):
    assert simhash.simhash_components(table(spark, []).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (3, "a b c d e", None, None, None)], DOCS)
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()} == {(None, 3), (3, 3)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


# packing and BPE -----------------------------------------------------------------------------------------------------


def test_packing_is_whole_gapless_and_unpadded(spark):
    texts = [*ODD, "a  b \n c", " lead", "trail ", "<|endoftext|> x", "\n\n \n"]
    at = pt.path
    got = packing.pack(table(spark, texts), at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), pt.PATTERN).collect()
    tk = Tokenizer.from_file(at("byte_bpe_50k.json"))
    sequences = {}
    for k, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in mine)
        assert [r.start for r in mine] == list(itertools.accumulate([0, *[r.length for r in mine]]))[:-1]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rows)
        assert 1024 - total <= 1024 // packing.PADDING or total & (total - 1) == 0 or total >= len(rows) * (1024 // len(rows))
        assert [r.offset for r in rows] == list(itertools.accumulate([0, *[r.length for r in rows]]))[:-1]


@pytest.mark.parametrize("capacity", [1024, 256, 8, 1])
def test_pieces_and_bins_of_every_length(capacity):
    r = np.random.default_rng(4)
    lengths = [*range(1, 3 * capacity), *r.integers(1, 8 * capacity, 300).tolist()]
    bins, rows, want = packing.Bins(3, capacity), [], 0
    for k, n in enumerate(lengths):
        at, parts = 0, packing.pieces(n, capacity)
        assert sum(parts) == n and all(0 < x <= capacity for x in parts)
        for x in parts:
            rows += bins.add((k, at, x, n, bytes(4 * x)))
            at += x
        want += n
    for held in bins.open.values():
        assert len(held) < capacity // held[0][2]
    full = len({x[5] for x in rows})
    assert full * capacity - sum(x[2] for x in rows) <= full * capacity / packing.PADDING
    rows += bins.finish()
    assert sum(x[2] for x in rows) == want and all(len(x[4]) == 4 * x[2] for x in rows)
    seen: dict[int, list] = {}
    for x in rows:
        seen.setdefault(x[5], []).append(x)
    assert all([y[6] for y in x] == list(itertools.accumulate([0, *[y[2] for y in x]]))[:-1] and sum(y[2] for y in x) <= capacity for x in seen.values())
    places = sorted((x[0], x[1], x[2]) for x in rows)
    assert all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(places) if a[0] == b[0])


def test_packing_of_null_ids_and_clashing_columns(spark):
    docs = clashing(table(spark, ["a b", None])).withColumns({"doc_id": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("long")})
    got = packing.pack(docs, pt.path("byte_bpe_50k.json"), pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN).collect()
    assert all(r.doc_id is None for r in got) and sum(r.length for r in got) == 4


def test_packing_empty(spark):
    at = pt.path
    assert packing.pack(table(spark, []).limit(0), at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), pt.PATTERN).count() == 0


def test_bpe_equals_the_library(spark):
    path = pt.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    texts = [*ODD, "don't I'LL 12345", "aaaaaaa aa a", "<|startoftext|>A<|endoftext|>", "<|EndOfText|>", "ΣΑΣ İ é", "x\x1cy\x85z", "日本語 \U0001f44d\U0001f3fd"]
    got = {r.doc_id: r for r in bpe.encode(clashing(table(spark, texts)), path).collect()}
    for k, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        decoded = tk.decode(ids, skip_special_tokens=False)
        r = got[k]
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids)) and bpe.decode(ids, path) == decoded
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# licenses ------------------------------------------------------------------------------------------------------------


def test_bpe_of_long_words():
    import time

    bpe_ = bpe.load(pt.path("word_bpe_49k.json"))
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdeinrst"), n)).encode() for n in (2, 40, 300, 999)] + [b"a" * 700, "é".encode() * 300]
    assert [bpe_.merge_long(w) for w in words] == bpe_._rounds(words)
    took = []
    for n in (20_000, 100_000):
        t = time.process_time()
        bpe_.merge(["".join(r.choice(list("abcdeinrst"), n)).encode()])
        took.append(time.process_time() - t)
    assert took[1] < 12 * took[0] + 0.5
    tk = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    text = "".join(r.choice(list("abcdeinrst"), 30_000))
    assert next(bpe_.encode([text]))[0] == " ".join(map(str, tk.encode(text, add_special_tokens=False).ids))
    assert text not in bpe_.memory


def test_license_scan_against_brute_force(spark):
    texts = [*ODD, "cc\nby cc-by", "All\n\nrights reserved. all RIGHTS reserved", "general public\nlicense", "by cc license public general", "Licensed under the Apache License, Version 2.0.", "Licensed under Apache License Version 2", "rights all reserved"]
    got = {r.doc_id: r for r in license_scan.license_scan(clashing(table(spark, texts))).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for k, t in enumerate(texts):
        w = pattern.findall(low(t))
        places, labels = [], set()
        for p in license_scan.PHRASES:
            x = p.text.split()
            here = [i for i in range(len(w)) if w[i : i + len(x)] == x]
            places += here
            labels |= {p.label} if here else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        for n in license_scan.NOTICES:
            need = pattern.findall(low(n.text))
            width = -int(-len(need) / n.threshold // 1)
            best = max(len(set(need) & set(w[i : i + width])) / len(set(need)) for i in range(max(1, len(w) - width + 1)))
            if best >= n.threshold:
                labels.add(n.label)
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_license_notices_wrapped_over_lines(spark):
    r = np.random.default_rng(11)
    texts = []
    for n in license_scan.NOTICES:
        for gap in (1, 3, 8):
            w = n.text.split()
            for _ in range(int(r.integers(0, 1 + len(w) // 4))):
                w[int(r.integers(0, len(w)))] = "other"
            lines = [" ".join(w[k : k + gap]) for k in range(0, len(w), gap)]
            texts.append(prose(12, gap) + "\n * " + "\n * ".join(lines) + "\n" + prose(20, gap))
    texts += ["\n\n".join(license_scan.NOTICES[3].text.split()), "Licensed under\n" + prose(8, 1) + " the Apache\nLicense, Version 2.0", *ODD]
    got = {x.doc_id: x for x in license_scan.license_scan(table(spark, texts)).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wrapped = set()
    for k, t in enumerate(texts):
        w = pattern.findall((t or "").lower())
        labels, score = set(), 0.0
        for n in license_scan.NOTICES:
            x = pattern.findall(n.text.lower())
            width = -int(-len(x) / n.threshold // 1)
            blocks = [w[i : i + width] for i in range(max(1, len(w) - width + 1))]
            best = max(len(set(x) & set(b)) / len(set(x)) for b in blocks)
            if best >= n.threshold:
                labels.add(n.label)
                score = max(score, best)
        if got[k].n_base == 0:
            assert (got[k].labels, got[k].score) == (",".join(sorted(labels)), score)
            wrapped |= labels
        else:
            assert labels <= set(got[k].labels.split(","))
    assert {"mit", "bsd", "mpl", "apache", "unlicense", "cc-by"} <= wrapped


def test_license_words_scattered_over_a_long_line_are_no_notice(spark):
    line = prose(280, 1) + " released " + prose(280, 2) + " under the " + prose(280, 3) + " MIT " + prose(280, 4) + " License " + prose(280, 5)
    two = license_scan.NOTICES[2].text.replace("obtaining", "obtaining\n")
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, [line, two])).collect()}
    assert got[0].labels == "" and got[0].score == 0 and got[1].labels == "mit"
    assert license_scan.license_scan(table(spark, []).limit(0)).count() == 0


# search --------------------------------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    x = rng.normal(size=(300, 8))
    x[:100] = x[0]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0]), (None, [0.0] * 8), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = np.floor(64 * x)
    for block, group in ((8192, 4096), (20, 3)):
        got = topk.top_k(df, topk.F.col("vec_id") % 20 == 0, block=block, query_block=group).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(by) == list(range(0, 300, 20))
        for q, rs in by.items():
            s = v @ v[q]
            want = sorted((-s[k], k) for k in range(300) if k != q)[:20]
            assert [(i, int(sc)) for _, i, sc in sorted(rs)] == [(k, int(-n)) for n, k in want]
    assert topk.top_k(df.limit(0), topk.F.col("vec_id") % 20 == 0).count() == 0


# quality -------------------------------------------------------------------------------------------------------------


def test_trees_prune_where_vectors_lie_in_clusters():
    r = np.random.default_rng(2)
    centres = r.normal(0, 60, (30, 16))
    x = np.floor(centres[r.integers(0, 30, 6000)] + r.normal(0, 2, (6000, 16)))
    q = x[:300]
    best = topk.dual_search(q, np.arange(300), np.full(300, -np.inf), x, np.arange(6000), 10)
    assert best.visited < 0.2 * 300 * 6000
    score = q @ x.T
    score[np.arange(300), np.arange(300)] = -np.inf
    assert all(sorted((s for s, _ in best.found[k]), reverse=True) == np.sort(score[k])[::-1][:10].tolist() for k in range(300))


def test_top_k_clashing_columns_and_equal_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(k, [1.0, 0.0]) for k in range(400)] + [(1000, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("cell", "part", "batch", "v", "kth", "far", "shell", "norm")])
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 3, block=50, query_block=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got if r.query_id in (0, 300, 1000)] == [(0, 1, 4096), (0, 2, 4096), (0, 3, 4096), (300, 0, 4096), (300, 1, 4096), (300, 2, 4096), (1000, 0, 0), (1000, 1, 0), (1000, 2, 0)]


def test_model_probabilities_sum_to_one(spark):
    texts = table(spark, ["abracadabra", "banana bandana", None, ""])
    path, n = kn_quality.store(kn_quality.estimate(kn_quality.count(texts)))
    shard = kn_quality.Shard(path, 0, kn_quality.ORDER)
    for context in (b"\n\n\n\n", b"abra", b"nana", b"zzzz", b"xxan"):
        base = int.from_bytes(context, "big") << 8
        p = np.exp(shard.log_probs(np.arange(256, dtype=np.int64) + base).astype(np.float64))
        assert abs(p.sum() - 1) < 1e-4


def test_shards_give_the_same_scores(spark, monkeypatch):
    docs = table(spark, [prose(60, s) for s in range(12)])
    model = kn_quality.estimate(kn_quality.count(docs))
    one = kn_quality.store(model)
    monkeypatch.setattr(kn_quality, "SHARD_ROWS", 200)
    many = kn_quality.store(model)
    assert one[1] == 1 and many[1] > 3
    a, b = ({r.doc_id: r.nll for r in kn_quality.surprise(docs, m, ["doc_id"]).collect()} for m in (one, many))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-2 for k in a)


def test_hashes_equal_those_of_spark(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    a, b = r.integers(-(2**63), 2**63 - 1, (2, 50))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("a", "b").alias("y")).collect()
    assert kn_quality.hashed(a).tolist() == [{x.a: x.x for x in df}[k] for k in a.tolist()] and kn_quality.hashed(a, b).tolist() == [{x.a: x.y for x in df}[k] for k in a.tolist()]


def test_word_model_against_brute_force(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    texts = [prose(n, n) + " The end" for n in (30, 80, 200, 400)] * 2 + [None, "", "the END  the\tend"]
    split = lambda t: ["<s>", *(t or "").lower().split()]
    pairs = Counter(p for t in texts for p in itertools.pairwise(split(t)))
    ones = Counter(b for _, b in pairs)

    def cuts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        return kn_quality.discounts(*n)

    d2, d1 = cuts(pairs), cuts(ones)
    total, rest = sum(ones.values()), sum(d1[min(v, 3) - 1] for v in ones.values()) / sum(ones.values()) / (kn_quality.UNSEEN * len(ones))

    def p1(w):
        return (ones[w] - d1[min(ones[w], 3) - 1]) / total + rest if w in ones else rest

    def p2(a, w):
        own = {b: n for (x, b), n in pairs.items() if x == a}
        if not own:
            return p1(w)
        t = sum(own.values())
        return (own[w] - d2[min(own[w], 3) - 1] if w in own else 0) / t + sum(d2[min(n, 3) - 1] for n in own.values()) / t * p1(w)

    asked = [*texts[:3], "new words the end w1 w2", "w3", prose(50, 77), "x", None]
    docs = table(spark, asked).withColumn("rid", F.col("doc_id"))
    values = kn_quality.estimate_words(kn_quality.count_pairs(table(spark, texts)))
    got = {r.rid: (r.word_nll, r.n_words) for r in kn_quality.word_surprise(docs, values).collect()}
    for k, t in enumerate(asked):
        w = split(t)
        if len(w) > 1:
            assert got[k] == (pytest.approx(-sum(math.log(p2(a, b)) for a, b in itertools.pairwise(w)), rel=1e-5), len(w) - 1)
    assert 7 not in got


def test_word_model_lies_in_parts_and_leaves_no_pairs(spark):
    import os

    texts = [prose(90, s) for s in range(6)]
    pairs = kn_quality.count_pairs(table(spark, texts))
    want = pairs.count() + len({w for t in texts for w in t.split()} | {""}) + 1  # with the start and the number of words
    files = [f.replace("file://", "") for f in pairs.inputFiles()]
    path, parts = kn_quality.estimate_words(pairs)
    keys = [kn_quality._values(path, k)[0] for k in range(parts)]
    assert not any(map(os.path.exists, files)) and sum(map(len, keys)) == want
    assert all((x % parts == k).all() and (np.diff(x) > 0).all() for k, x in enumerate(keys))


def test_frequent_words_are_looked_up_where_the_document_is(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [prose(90, s) + " the end of the" for s in range(12)]
    docs = table(spark, [*texts, "never seen", "the", None]).withColumn("rid", F.col("doc_id"))
    got = []
    for most in (0, 8, 10**6):
        monkeypatch.setattr(kn_quality, "FREQUENT", most)
        model = kn_quality.estimate_words(kn_quality.count_pairs(table(spark, texts)))
        keys = kn_quality._values(model[0], -1)[0]
        assert kn_quality.COUNT in keys and len(keys) <= most + 1 and (len(keys) > 1) == (most > 0)
        every = np.concatenate([kn_quality._values(model[0], k)[0] for k in range(model[1])])
        assert np.isin(keys, every).all() and (most < 10**6 or len(keys) == len(every))
        got.append({r.rid: (r.word_nll, r.n_words) for r in kn_quality.word_surprise(docs, model).collect()})
    assert len(got[0]) == 14 and got[0][12][1] == 2
    for other in got[1:]:
        assert {k: (pytest.approx(x, rel=1e-9), n) for k, (x, n) in other.items()} == got[0]


def test_quality_of_many_languages_and_repeated_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = table(spark, [prose(60, s) for s in range(30)] + [prose(60, 3)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    docs = docs.unionByName(docs.where("doc_id = 5"))
    labels = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    few = sorted(map(str, kn_quality.score(docs, labels).collect()))
    sized = kn_quality.sized
    monkeypatch.setattr(kn_quality, "sized", lambda df, n, most=0: sized(df, n, 0))
    assert few == sorted(map(str, kn_quality.score(docs, labels).collect())) and len(few) == 32
    same = [r for r in kn_quality.score(docs, labels).collect() if r.doc_id == 5]
    assert len(same) == 2 and same[0].n_words == 60 and same[0] == same[1]


def test_quality_rejects_noise_and_keeps_prose(spark):
    good = [prose(150, s) for s in range(60)]
    r = np.random.default_rng(3)
    noise = ["".join(chr(c) for c in r.integers(33, 126, 800)) for _ in range(5)]
    docs = clashing(table(spark, [*good, *noise, None, ""]))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(60, 0, 0), (60, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in kn_quality.score(docs, labels).collect()}
    assert all(got[k].kept for k in range(60)) and not any(got[k].kept for k in range(60, 65)) and got[65].kept and got[66].kept
    assert got[66].perplexity == 1.0
    assert kn_quality.keep_good(docs, labels).count() == 62
    assert kn_quality.score(docs, labels.limit(0)).where("kept").count() == 67
    assert kn_quality.score(docs.limit(0), labels).count() == 0


# pages ---------------------------------------------------------------------------------------------------------------


def test_html_rules():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header>
    <nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav><div class="cookie-notice">We use cookies of the site</div>
    <article><header><h1>Head  line</h1></header><p>It is the first &amp;lt; of all\n and the rest.<p>Ok.<aside>buy it</aside>
    <div class="ad">Buy the thing that we have in the shop</div><ul class="share"><li><a href="x">Share</a></ul><form><label>Mail</label></form>
    <section id="comments"><p>I like the text that you have and it is so good to read it</p></section></article><footer>&copy; 2020</footer><p"""
    assert html_text.main_text(page) == "Head line\n\nIt is the first &lt; of all and the rest.\n\nOk."
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<p") == "" and html_text.main_text("plain text") == "plain text"


@pytest.mark.parametrize("sentence", ["Это первое предложение статьи, в котором достаточно слов, чтобы считать его текстом страницы.", "これは記事の最初の文であり、ページの本文と見なされるのに十分な長さがあります。さらに続きの文もあります。", "Αυτή είναι η πρώτη πρόταση του άρθρου και έχει αρκετές λέξεις ώστε να θεωρηθεί κείμενο.", "To jest pierwsze zdanie tego tekstu i ma ono wystarczająco wiele słów, aby uznać je za treść strony."])
def test_html_in_languages_without_a_list(sentence):
    page = f'<html><body><nav><a href="/">x</a></nav><div><p>{sentence}</p><p>{sentence[:20]}.</p><p>{sentence}</p><p><a href="/y">{sentence}</a></p></div><footer>{sentence}</footer></body></html>'
    assert html_text.main_text(page) == "\n\n".join([sentence, sentence[:20] + ".", sentence])


def test_html_of_deep_and_unmatched_tags_takes_linear_time():
    import time

    took = []
    for n in (20_000, 100_000):
        t = time.process_time()
        assert html_text.main_text("<article>" + "<div>" * n + "the text of it" + "</span></b>" * n + "</article>") == "the text of it"
        took.append(time.process_time() - t)
    assert took[1] < 12 * took[0] + 0.5


def test_html_rules_against_brute_force():
    """Labels of random blocks by the rules as the docstring has them, block by block over the whole list."""

    def plain(blocks):
        stop = [0 if not (w := re.findall(r"[^\W\d_]+", b.text.lower())) else sum(x in html_text.STOP for x in w) / len(w) for b in blocks]
        first = []
        for b, d in zip(blocks, stop, strict=True):
            n = len(b.text)
            if b.boiler or b.linked / n > html_text.LINKS:
                first.append(-1)
            elif n < html_text.SHORT:
                first.append(0)
            else:
                first.append(1 if d >= html_text.HIGH or d >= html_text.LOW and n > 200 else 0 if d >= html_text.LOW else -1)
        out = []
        for k, x in enumerate(first):
            if x == 0:
                near = [(abs(j - k), j) for j, y in enumerate(first) if y]
                sides = [min((p for p in near if (p[1] < k) == before), default=None) for before in (True, False)]
                known = [p for p in sides if p]
                labels = [first[j] for _, j in known]
                x = -1 if not known else labels[0] if len(set(labels)) == 1 else first[min(known, key=lambda p: (p[0], -first[p[1]]))[1]]
            out.append(x)
        return out if 1 in out else [1 if a == 0 and not b.linked else y for b, a, y in zip(blocks, first, out, strict=True)]

    for seed in range(300):
        r = np.random.default_rng(seed)
        blocks = []
        for _ in range(int(r.integers(1, 9))):
            text = " ".join(r.choice(["the", "of", "and", "wort", "zqx", "blorp", "is"], int(r.integers(1, 60))))
            blocks.append(html_text.Block(text, int(r.choice([0, 0, len(text) // 2, len(text)])), bool(r.integers(0, 5) == 0), 0, False))
        blocks.append(html_text.Block("the text of it and the rest of the words that are in it " * 5, 0, False, 0, False))
        assert html_text.labels_of(blocks) == plain(blocks)


def test_html_of_odd_tables(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<article>It is so</article>", 2), (1, "u", "<article>It is so</article>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("It is so", 8), ("It is so", 8)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_pages_table(spark, sf):
    import html as h

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for p, r in zip(pages.orderBy("page_id").collect(), html_text.extract(pages).orderBy("page_id").collect(), strict=True):
        body = p.html[p.html.index("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# toxicity ------------------------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0})
    assert toxicity.folded("ІD10T!") == toxicity.folded("idiot ").rstrip() + " " or lex.score("ІD10T!") > 0.3
    assert lex.score("you 1d10t") >= 0.3 and lex.score("an idiotic plan") >= 0.3
    assert lex.score("take the trash can out") < 0.3 and lex.score("trash talk") >= 0.3
    assert lex.score("") == lex.score(None) < 0.3 and 0 <= lex.score("idiot " * 5000) <= 1


def test_lexicon_against_brute_force():
    import math

    alphabet = ["ab", "abc", "cd", "x", "bad", "day", "out"]
    for seed in range(200):
        r = np.random.default_rng(seed)
        pick = lambda n: " ".join(r.choice(alphabet, n))  # noqa: E731, B023
        weights = {"".join(r.choice(alphabet, int(r.integers(1, 3)))): float(r.integers(1, 9)) for _ in range(5)}
        free = tuple({pick(int(r.integers(1, 4))) for _ in range(3)} | {"ab bad", "bad day"})  # they overlap
        lex = toxicity.Lexicon(weights, free)
        text = pick(int(r.integers(0, 30)))
        t = toxicity.folded(text)
        inside = set()
        for x in free:
            for k in range(len(t)):
                if (t + " ").startswith(f" {x} ", k):
                    inside.update(range(k + 1, k + 1 + len(x)))
        total = 0.0
        for k in range(1, len(t)):
            if t[k - 1] == " " and t[k] != " " and k not in inside:
                total += max([w for e, w in weights.items() if t.startswith(e, k)], default=0.0)
        want = 0.01 + 0.99 * (1 - math.exp(-0.35 * total / (1 + 0.1 * math.log1p(len(t) / 6)))) if total else 0.01
        assert lex.score(text) == pytest.approx(want), (seed, text, weights, free)


def test_toxicity_on_held_out_rows(spark):
    r = np.random.default_rng(5)
    bad = ["grubsel", "fomikta", "idiot"]
    texts, labels = [], []
    for k in range(400):
        w = prose(int(r.integers(5, 200)), k).split()
        toxic = k % 4 == 0
        if toxic:
            w[int(r.integers(len(w)))] = bad[k % 3] + "xyz"[k % 3]
        texts.append(" ".join(w)), labels.append((k, 1, int(toxic)))
    docs, lab = clashing(table(spark, [*texts, None, ""])), spark.createDataFrame([*labels, (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, toxicity.learn(docs, lab)).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(402))
    assert all(got[k].predicted == labels[k][2] for k in range(400)) and got[400].score == got[401].score
    assert toxicity.toxicity(docs.limit(0), {}).count() == 0 and toxicity.learn(docs, lab.limit(0))


# passages ------------------------------------------------------------------------------------------------------------


def test_compact_windows_against_recursion():
    for trial in range(60):
        r = np.random.default_rng(trial)
        v = np.r_[0, r.integers(1, r.integers(2, 200), r.integers(1, 80)), 0, r.integers(1, 50, r.integers(1, 40)), 0].astype(np.uint32)
        least = int(r.integers(1, 12))
        want = set()
        for c in np.flatnonzero(v):
            a = b = int(c)
            while v[a - 1] >= v[c]:
                a -= 1
            while v[b + 1] >= v[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((a, a + int(np.argmin(v[a : b + 1])), b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, least)), strict=True)) == want


def test_passages_cover_every_long_repeat(spark):
    shared = [prose(n, 900 + n) for n in (50, 60, 200)]
    texts = [prose(120, s) for s in range(20)]
    for k in range(12):
        texts[k] = texts[k] + " " + shared[k % 3] + "\n" + prose(40, 500 + k)
    edited = shared[2].split()
    edited[100] = "changed"
    texts += ["start " + " ".join(edited), *ODD]
    rows = passages.passages(clashing(table(spark, texts))).collect()
    words = [(t or "").lower().split() for t in texts]
    first, need, cover = {}, {}, {}
    for k, w in enumerate(words):
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            if first.setdefault(x, k) != k:
                need.setdefault(k, set()).update(range(i, i + 50))
    for r in rows:
        assert r.other_id < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8
        cover.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert need and all(need[k] <= cover.get(k, set()) for k in need)
    assert set(cover) == set(need)  # and no others
    cut = {r.doc_id: r.text for r in passages.cut_passages(table(spark, texts)).collect()}
    assert cut[0] == texts[0] and shared[0] in cut[0] and shared[0] not in cut[3] and cut[15] == texts[15]
    assert passages.passages(table(spark, []).limit(0)).count() == 0


def edited_copies(n: int, edits: int, seed: int = 8) -> list[str]:
    """Documents with one passage of 120 words, of which each changes some, among foreign words."""
    r = np.random.default_rng(seed)
    base = [f"p{x}" for x in r.integers(0, 10**6, 120)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in r.choice(120, edits, replace=False):
            w[at] = f"e{k}x{at}"
        around = [f"a{x}" for x in r.integers(0, 10**6, 80)]
        texts.append(" ".join([*around[:30], *w, *around[30:]]))
    return texts


@pytest.mark.parametrize("edits", [1, 4])
def test_passages_lose_no_pair_and_do_not_depend_on_partitions(spark, edits):
    texts = edited_copies(70, edits)
    docs = table(spark, texts)
    rows = sorted(map(tuple, passages.passages(docs.repartition(1)).collect()))
    assert rows == sorted(map(tuple, passages.passages(docs.repartition(8)).collect()))
    cls = {}
    for doc, _, _, other, _, _, _, c, at in rows:
        cls.setdefault(doc, set()).add((c, at))
        cls.setdefault(other, set()).add((c, at))
    words = [t.encode().split() for t in texts]
    true = [(i, j) for i in range(70) for j in range(i) if passages.verify_pair(words[i], words[j])]
    assert len(true) > 100 and sum(bool(cls.get(i, set()) & cls.get(j, set())) for i, j in true) >= 0.9 * len(true)


def test_regions_of_spans():
    start, end = np.array([0, 5, 60, 70, 0]), np.array([50, 55, 110, 130, 50])
    assert passages.region_starts(start, end, np.array([True, False, False, False, True])).tolist() == [0, 0, 2, 2, 4]


def test_passages_of_null_and_repeated_ids(spark):
    p = prose(80, 5)
    rows = [(None, p), (1, p), (1, p), (2, "x " + p)]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.class_id) for r in got} == {(2, 1, 1)}


def near_copies(n):
    """Pairs of documents that share a passage of 50 words but for one in the middle: similarity 41/51."""
    r = np.random.default_rng(41)
    texts = []
    for k in range(n):
        w = [f"p{x}" for x in r.integers(0, 10**6, 50)]
        for side in (0, 1):
            around = [f"a{x}" for x in r.integers(0, 10**6, 120)]
            texts.append(" ".join([*around[:60], *w[:25], *([w[25]] if not side else ["changed"]), *w[26:], *around[60:]]))
    return texts


def test_passages_find_near_copies(spark):
    n = 2000
    found = {(r.doc_id, r.other_id) for r in passages.passages(table(spark, near_copies(n))).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(n)}


def test_passages_link_pairs_whose_windows_come_first_in_others(spark):
    """Pieces of each passage, too short to count, are in many documents of smaller ids, which are first in its groups."""
    r = np.random.default_rng(43)
    foreign = lambda n: [f"a{x}" for x in r.integers(0, 10**6, n)]
    shared = [[f"p{x}" for x in r.integers(0, 10**6, 60)] for _ in range(40)]
    texts = [" ".join([*foreign(60), *p[at : at + 30], *foreign(60)]) for p in shared for at in (0, 6, 12, 18, 24, 30) for _ in range(8)]
    pairs = {}
    for p in shared:
        for w in (p, [*p[:30], "changed", *p[31:]]):
            texts.append(" ".join([*foreign(40), *w, *foreign(40)]))
        pairs[len(texts) - 1] = len(texts) - 2
    rows = passages.passages(table(spark, texts)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == set(pairs.items())


def test_packed_records_come_back():
    for n in (0, 1, 50):
        r = np.random.default_rng(n)
        x = np.zeros(n, passages.LINK)
        for f in x.dtype.names:
            x[f] = r.integers(-9, 9, n)
        b = passages.packed(x, (x["doc"] % 5).astype(np.int32))
        assert b.column("part").to_pylist() == sorted({int(d) % 5 for d in x["doc"]})
        assert sorted(passages.unpacked([b], x.dtype).tolist()) == sorted(x.tolist())


def test_passages_of_short_texts_alone(spark):
    assert passages.passages(table(spark, ["a b", None, prose(20, 1)])).count() == 0


def test_windows_of_every_pair_are_linked_or_have_a_way():
    """Windows of a key have a way over links if a block or a whole passage is equal; in a small key, all have."""
    for seed in range(60):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 60))
        w = np.zeros(n, passages.WINDOW)
        w["key"], w["doc"], w["c"] = 3, r.integers(0, 40, n), r.integers(0, 99, n)
        for f in ("left", "right"):
            w[f] = r.integers(0, 9, n)
        w["whole"] = r.integers(0, 8 * n, (n, passages.ALIGNED))
        way = list(range(40))

        def top(x, way=way):
            while way[x] != x:
                x = way[x]
            return x

        for links in passages.linked(w):
            for d, d2, *_ in links.tolist():
                assert d > d2
                way[top(d)] = top(d2)
        for i, j in itertools.combinations(range(n), 2):
            same = [w[f][i] == w[f][j] > 0 for f in ("left", "right")] + [x == y > 0 for x, y in zip(w["whole"][i], w["whole"][j], strict=True)]
            assert top(w["doc"][i]) == top(w["doc"][j]) or (n > passages.FEW and not any(same))


def test_links_to_another_place_do_not_cut_regions():
    import pandas as pd

    rows = [(h, 2, 10, 60 + h, 120, 1, l2, l2 + 50 + h, l2 + 110) for h in range(4) for l2 in ((10, 900) if h != 2 else (900,))]
    rows.append((5, 2, 300, 310, 400, 1, 300, 310, 400))  # one hash only
    df = pd.DataFrame(rows, columns=["key", "doc", "l", "c", "r", "doc2", "l2", "c2", "r2"])
    # hashes of the two places alternate
    got = {tuple(x) for x in passages.regions(df, 3).itertuples(index=False)}
    assert got == {(2, 10, 120, 1, 10, 120), (2, 10, 120, 1, 900, 1010)}
    for seed in range(40):
        r = np.random.default_rng(seed)
        lo, lo2 = r.integers(0, 300, (2, 30))
        hi, hi2 = lo + r.integers(0, 40, 30), lo2 + r.integers(0, 40, 30)
        part = list(range(30))
        for _ in range(30):
            for i, j in itertools.combinations(range(30), 2):
                if max(lo[i], lo[j]) <= min(hi[i], hi[j]) and max(lo2[i], lo2[j]) <= min(hi2[i], hi2[j]):
                    part[i] = part[j] = min(part[i], part[j])
        assert passages._meeting(lo, hi, lo2, hi2).tolist() == part


def test_verified_passages_hold_every_equal_run():
    for seed in range(150):
        r = np.random.default_rng(seed)
        stock = [[b"%d" % x for x in r.integers(0, 60, n)] for n in (7, 20, 52)]
        a, b = ([w for _ in range(12) for w in (stock[r.integers(0, 3)][: r.integers(6, 60)] if r.integers(0, 4) else [b"%d" % x for x in r.integers(0, 60, 9)])] for _ in range(2))
        spans = passages.verify_pair(a, b)
        assert next(passages.verify_texts([b" ".join(a)], [b" ".join(b)])) == spans
        theirs = {tuple(b[k : k + 50]) for k in range(len(b) - 49)}
        for k in range(len(a) - 49):
            if tuple(a[k : k + 50]) in theirs:
                assert any(s <= k and k + 50 <= e for s, e, *_ in spans), (seed, k)
        assert all(e - s >= 50 and e2 - s2 >= 50 and (j < 1 or set(zip(*[a[s + x : e] for x in range(5)])) == set(zip(*[b[s2 + x : e2] for x in range(5)]))) for s, e, s2, e2, j in spans)


def test_word_ids_find_the_passages_of_the_words():
    for seed in range(200):
        r = np.random.default_rng(seed)
        base = [b"%d" % x for x in r.integers(0, 10**6, 150)]
        a, b = list(base[: r.integers(60, 150)]), list(base[r.integers(0, 60) :])
        for w in (a, b):
            for _ in range(int(r.integers(0, 6))):
                at = int(r.integers(0, len(w)))
                w[at : at + int(r.integers(0, 3))] = [b"x%d" % r.integers(0, 10**6)] * int(r.integers(0, 2))
        if r.integers(0, 2):
            k = int(r.integers(1, len(a)))
            a = a[k:] + a[:k]
        assert next(passages.verify_texts([b" ".join(a)], [b" ".join(b)])) == passages.verify_pair(a, b), seed


def test_regions_are_compared_by_ids_only(monkeypatch):
    r = np.random.default_rng(5)
    texts = [[b"%d" % x for x in r.integers(0, 10**6, 200)] for _ in range(4)]
    texts[1][40:110] = texts[0][60:130]
    texts[2] = texts[0][:70] * 2 + texts[2]  # shingles that repeat
    texts += [[b"w"] * 80, texts[0][:49], [], texts[0][:60]]
    pairs = [(a, b) for a in texts for b in texts]
    want = [passages.verify_pair(a, b) for a, b in pairs]
    asked = []
    by_ids = passages.verify_ids
    monkeypatch.setattr(passages, "verify_pair", None)
    monkeypatch.setattr(passages, "verify_ids", lambda *x: asked.append(x) or by_ids(*x))
    for size in (passages.BYTES, 1):
        monkeypatch.setattr(passages, "BYTES", size)
        asked.clear()
        got = list(passages.verify_texts(*([b" ".join(x[k]) for x in pairs] for k in range(2))))
        assert got == want and sum(map(bool, want)) <= len(asked) < sum(len(a) > 49 < len(b) for a, b in pairs)
    assert list(passages.verify_texts([], [])) == [] and list(passages.verify_texts([b""], [b""])) == [[]]


def test_stretches_in_which_enough_is_seen():
    for seed in range(300):
        r = np.random.default_rng(seed)
        sizes = r.integers(0, 30, 6)
        seen = r.random(int(sizes.sum())) < r.choice([0.5, 0.7, 0.9])
        want, at = [], 0
        for n in sizes.tolist():
            own = seen[at : at + n]
            want.append(any(10 * own[i:j].sum() >= 8 * (j - i) for i in range(n) for j in range(i + 8, n + 1)))
            at += n
        assert passages.dense(seen, sizes, 8, 0.8).tolist() == want


def test_shared_shingles_that_lie_apart_are_left_at_once(monkeypatch):
    """Two regions that share 200 shingles, but only 20 words in a row: no passage, and not looked at one by one."""
    r = np.random.default_rng(3)
    foreign = lambda n: [b"a%d" % x for x in r.integers(0, 10**9, n)]
    shared = [foreign(20) for _ in range(14)]
    a, b = (b" ".join(w for x in shared for w in [*x, *foreign(20)]) for _ in range(2))
    near = [*shared[0], *shared[1], b"changed", *shared[2]]
    asked = []
    by_ids = passages.verify_ids
    monkeypatch.setattr(passages, "verify_ids", lambda *x: asked.append(x) or by_ids(*x))
    ids = lambda t: passages.word_ids([t])[0].tobytes()
    pairs = [(a, b), (b" ".join([*foreign(5), *near, *foreign(9)]), b" ".join([*shared[0], *shared[1], *shared[2]]))]
    got = list(passages.verify_texts(*([ids(x[k]) for x in pairs] for k in range(2)), ids_of=passages.stored_ids))
    assert got == [passages.verify_pair(x.split(), y.split()) for x, y in pairs] and got[0] == [] and got[1]
    assert len(asked) == 1


def test_classes_of_near_copies_have_a_row_for_each_region(spark):
    """Rows grow with the documents, not with their pairs; every passage that has a link is in its class."""
    docs = table(spark, [*edited_copies(70, 4), *near_copies(5), "x", None])
    linked, of = passages._classed(passages.repeats(docs))
    class_of, firsts = {}, {}
    for r in of.collect():
        class_of[r.d, r.r] = r.component
        firsts[r.component] = min(firsts.get(r.component, (r.d, r.r)), (r.d, r.r))
    rows = passages.members(docs).collect()
    got = {(r.doc_id, r.start): (r.class_id, r.class_start) for r in rows}
    assert len(rows) == len(got) < linked.count()
    assert got == {k: firsts[c] for k, c in class_of.items() if k != firsts[c]}
    assert sum(r.links for r in rows) >= linked.count() and all(r.end - r.start >= 50 and r.other_id != r.doc_id and r.similarity >= 0.8 for r in rows)
    assert passages.members(table(spark, []).limit(0)).count() == 0


def test_passages_query_gives_members(spark, sf):
    rows = entry.op8_passages(spark, sf).collect()
    keys = {(r.doc_id, r.start) for r in rows}
    assert rows and len(keys) == len(rows) and not keys & {(r.class_id, r.class_start) for r in rows}


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    plain = {r.doc_id: r.text for r in docs.collect()}
    toxic = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert out.columns == columns
        now = {r.doc_id: r.text for r in out.collect()}
        assert now.keys() <= plain.keys()
        if name == "exact_dedup":
            assert len({squeeze(t) for t in now.values()}) == len(now) == len({squeeze(t) for t in plain.values()})
        if name == "simhash_dedup":
            fps = [plain_fingerprint(t) for t in now.values()]
            assert min(bin(a ^ b).count("1") for a, b in itertools.combinations(fps, 2)) > 4
        plain, docs, toxic = now, out, name
    assert toxic == "passage_dedup"
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == set(plain)


def plain_model(seqs, order, base, unseen):
    """An interpolated modified Kneser-Ney model as a function of (context, symbol), with dicts; seqs begin with order - 1
    starting symbols."""
    from collections import Counter, defaultdict

    counts = {order: Counter(tuple(x[k : k + order]) for x in seqs for k in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, total, free = {}, defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        cuts[k] = kn_quality.discounts(*[sum(v == n for v in c.values()) for n in (1, 2, 3, 4)])
        for g, n in c.items():
            total[k, g[:-1]] += n
            free[k, g[:-1]] += cuts[k][min(n, 3) - 1]
    rest = base if not unseen else 1 / (unseen * len(counts[1]))

    def p(context, x, k=order):
        if not k:
            return rest
        context = tuple(context)[len(context) - k + 1 :] if k > 1 else ()
        low = p(context[1:], x, k - 1)
        if (k, context) not in total:
            return low
        n = counts[k].get((*context, x), 0)
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total[k, context] + free[k, context] / total[k, context] * low

    return p


def plain_quality(docs, labels):
    """Ids of the documents that stay, by the same rule over plain models."""
    import math

    good = {k for k, y in labels.items() if y == 1}
    held = {k for k in good if zlib.crc32(str(k).encode()) % kn_quality.FOLD == 0}
    forms = {
        "bytes": (lambda t: list((t or "").encode()), 5, 1 / 256, 0, [10] * 4, kn_quality.PRIOR, kn_quality.MARGIN),
        "words": (lambda t: (t or "").lower().split(), 2, 0, kn_quality.UNSEEN, [None], kn_quality.WORD_PRIOR, kn_quality.WORD_MARGIN),
    }
    gone = set()
    for split, order, base, unseen, lead, prior, margin in forms.values():
        p = plain_model([[*lead, *split(t)] for k, (t, _) in docs.items() if k in good - held], order, base, unseen)
        nll, n = {}, {}
        for k, (t, _) in docs.items():
            x = [*lead, *split(t)]
            nll[k] = -sum(math.log(p(x[i - order + 1 : i], x[i])) for i in range(order - 1, len(x)))
            n[k] = len(x) - order + 1
        mean = {g: sum(nll[k] for k in good if docs[k][1] == g) / max(1, sum(n[k] for k in good if docs[k][1] == g)) for _, g in docs.values()}
        over = sum(nll[k] for k in good) / sum(n[k] for k in good)
        score = {k: (nll[k] + prior * (mean[docs[k][1]] or over)) / (n[k] + prior) for k in docs}
        all_ = [round(score[k], 3) for k in held if n[k]]
        for k, (_, g) in docs.items():
            own = [round(score[x], 3) for x in held if docs[x][1] == g and n[x]]
            limit = np.quantile(own, kn_quality.QUANTILE) if len(own) >= kn_quality.FEW else max(np.quantile(own, kn_quality.QUANTILE), np.quantile(all_, kn_quality.QUANTILE))
            if n[k] and score[k] > limit + margin:
                gone.add(k)
    return set(docs) - gone


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    shared = prose(70, 999)
    texts = [prose(90, k) for k in range(70)]
    texts += [texts[3] + " \n", texts[3], texts[4].replace(" ", "  "), prose(40, 301) + " " + shared + " " + prose(40, 302), prose(50, 303) + "\n" + shared + " " + prose(30, 304)]
    texts += ["$$ %% && " * 40 + "".join(chr(33 + k % 90) for k in range(300)), None, "", "  ", shared.replace(" ", "  ", 9)[:-3], texts[5] + " w1"]
    docs = clashing(table(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise(F.col("lang"))))
    rows = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    quality = {k: 1 for k in range(70)} | {75: 0}
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, y, 0) for k, y in quality.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {k: rows[k][0] for k in plain_quality(rows, quality)}
    assert 75 not in left and len(left) >= len(rows) - 3
    best = {}
    for k, t in sorted(left.items()):
        best.setdefault(squeeze(t), []).append((-len(t or ""), k))
    left = {min(v)[1]: rows[min(v)[1]][0] for v in best.values()}
    fps = {k: plain_fingerprint(t) for k, t in left.items()}
    root = {k: k for k in left}
    for _ in left:
        for a, b in itertools.combinations(left, 2):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                root[a] = root[b] = min(root[a], root[b])
    left = {k: t for k, t in left.items() if root[k] == k}
    cut = {}
    for k in left:
        spans = {(s, e) for j in left if j < k for s, e, *_ in passages.verify_pair((left[k] or "").lower().encode().split(), (left[j] or "").lower().encode().split())}
        cut[k] = passages.without(left[k], list(spans)) if spans else left[k]
    cut = {k: t for k, t in cut.items() if t == left[k] or t.strip()}
    assert 74 in cut and shared not in cut[74] and shared in cut[73]
    tk = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    ids = {k: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for k, t in cut.items()}
    assert {r.doc_id for r in got} == set(ids)
    for k, x in ids.items():
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(x) == mine[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    table(spark, []).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
