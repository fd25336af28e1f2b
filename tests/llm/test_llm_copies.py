"""Repeated bytes, SimHash groups and exact neighbours against brute force, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from llm_rows import documents, odd_rows
from pyspark.sql import functions as F

from tracewell.llm import graph, simhash, substrings, topk
from tracewell.llm.suffixes import common_prefixes, suffix_array

DATA = "/root/testdata/sf0.01"


def test_suffix_arrays():
    rng = random.Random(3)
    for t in range(1500):
        text = bytes(rng.choice([b"ab\0", b"a", bytes(range(256))][t % 3]) for _ in range(rng.randint(0, 70)))
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(data)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        shared = [0] + [next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k])) for i, j in zip(want, want[1:])]
        assert common_prefixes(data, order).tolist() == shared[:len(text)]


def plain_removal(rows):
    """doc_id -> n_bytes, n_removed, n_spans, digest, for rows (doc_id, text)."""
    owner = {}
    for i, text in sorted({(i, t or "") for i, t in rows if i is not None}):
        data = text.encode()
        for p in range(len(data) - 49):
            owner.setdefault(data[p:p + 50], i)
    out = []
    for i, text in rows:
        data, gone = (text or "").encode(), set()
        for p in range(len(data) - 49 if i is not None else 0):
            if owner[data[p:p + 50]] < i:
                gone.update(range(p, p + 50))
        kept = bytes(c for p, c in enumerate(data) if p not in gone)
        out.append((i, len(data), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removal(docs):
    done = substrings.with_removals(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(r.removed[1::2]) - sum(r.removed[::2]), len(r.removed) // 2, hashlib.sha256(r.kept).hexdigest()) for r in done), key=repr)


def test_removal_on_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = substrings.op5_repeated_bytes(spark, DATA).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_removal([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("load, piece", [(72, 1 << 20), (1e9, 200)])
def test_removal_of_frequent_and_periodic_text(spark, monkeypatch, load, piece):
    """With a high load every repeated hash counts as frequent; small pieces cut texts often."""
    monkeypatch.setattr(substrings, "LOAD", load)
    monkeypatch.setattr(substrings, "MIN_SHARE", 0)
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 2_000_000 if load == 72 else 700)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line, passage = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(60))
    rows = []
    for i in rng.sample(range(400), 120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        parts += [line] * (i % 3 == 0) + [passage[rng.randint(0, 90):]] * (i % 5 == 0) + [word()[:2] * rng.randint(0, 120)]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(i + 1000, t) for i, t in rows[:20]] + rows[:5] + [(2000, None), (2001, ""), (None, passage), (2002, passage[:49]), (2003, passage[:50]), (2004, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if load > 72:
        texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        assert len(substrings.frequent_hashes(texts, 100_000, 32).hashes) > 0
    assert removal(docs) == plain_removal(rows)


def test_removal_on_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] not in (7, 8)] + [(20, "ab " * 200, None), (21, "ab " * 200, None), (21, "ab " * 200, None)]
    docs = documents(spark, rows)
    assert removal(docs) == plain_removal([r[:2] for r in rows])
    assert removal(docs.limit(0)) == []
    long_rows = [r for r in odd_rows() if r[0] in (7, 8)]
    got = removal(documents(spark, long_rows))
    assert [(r[0], r[2] > 400_000) for r in got] == [(7, False), (8, True), (8, True)]


def plain_print(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["The ", "a", "É", " ", "\n", "\x0b", " ", "zz ", " "]) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(text.encode()) % 2 ** 64 == plain_print(text), repr(text)
    text = " ".join(str(i % 700) for i in range(3000))
    assert simhash.fingerprint(text.encode()) % 2 ** 64 == plain_print(text)


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)] + [(-5, 7), (5000, 5000)]
    want = {n: r for n, r in groups_of(pairs, {x for p in pairs for x in p}).items() if n != r}
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowd", [32, 2])
def test_close_links(spark, monkeypatch, crowd):
    """All pairs within two bits are connected, by pairs or, in crowds, by midpoints."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {0, 2 ** 64 - 1, 1 << 63, rng.getrandbits(64)}
    signed = [p - 2 ** 64 if p >> 63 else p for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2 ** 64).count("1") <= 2]
    assert all(bin((r.a ^ r.b) % 2 ** 64).count("1") <= 2 for r in links)
    assert groups_of(near, signed) == groups_of([(r.a, r.b) for r in links], signed)


def test_simhash_groups(spark):
    rows = [r for r in odd_rows() if r[0] not in (7, 8)] + [(30 + i, f"Some words that {'are' if i % 2 else 'ARE'} the same in all of these rows", "z") for i in range(5)]
    docs = documents(spark, rows)
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, plain_print(t)) for i, t, _ in rows]
    roots = groups_of([(a, b) for a in {p for _, p in prints} for b in {p for _, p in prints} if a < b and bin(a ^ b).count("1") <= 2], {p for _, p in prints})
    first = {}
    for i, p in prints:
        if i is not None:
            first[roots[p]] = min(i, first.get(roots[p], i))
    want = sorted(((i, p, first.get(roots[p])) for i, p in prints), key=repr)
    assert sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got), key=repr) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, _, c in want if i is not None}) and ids.count(None) == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0
    repeated = documents(spark, [(1, "a b c d", None), (1, "a b c d", None), (2, "x y z w", None)])
    assert sorted(r.doc_id for r in simhash.deduplicated(repeated).collect()) == [1, 2]


def plain_top(rows, queries, k):
    out = []
    for q, (query_id, query) in enumerate(queries):
        own = rows.index((query_id, query))
        scored = [(-sum(int(a) * int(b) for a, b in zip(query, v)), i) for n, (i, v) in enumerate(rows) if n != own and len(v) == len(query)]
        out += [(query_id, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, leaf, block", [(8192, 64, 1024), (60, 4, 7)])
def test_top_k(spark, monkeypatch, shard, leaf, block):
    for name, value in (("SHARD_ROWS", shard), ("LEAF_ROWS", leaf), ("BLOCK_QUERIES", block)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(10)
    rows = [(int(i), rng.integers(-40, 40, 6).tolist()) for i in rng.permutation(500)]
    rows += [(1000 + i, [7, -7, 7, -7, 7, -7]) for i in range(150)] + [(2000 + i, [3, 4]) for i in range(3)] + [(3000, []), (3001, [])]
    rows += [(4000, [2 ** 30, -(2 ** 30)] + [0] * 4), rows[0]]
    queries = [r for r in rows if r[0] % 50 == 0]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, vector array<long>")
    got = topk.top_k(frame(rows), frame(queries), 5).collect()
    assert sorted(tuple(r) for r in got) == plain_top(rows, queries, 5)


def test_top_k_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, None), (100, [nan, 1.0]), (1, [None, 1.0]), (2, [inf, 0.0]), (3, [0.25, 0.25]), (None, [1.0, 1.0]), (150, [0.001, -0.001]), (0, [1.0, 0.5]), (4, [0.25, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = table.select("vec_id", topk.quantised(F.col("embedding")).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    got = sorted(tuple(r) for r in topk.top_k(usable, usable.where("vec_id % 50 = 0")).collect())
    whole = [(r.vec_id, list(r.vector)) for r in usable.collect()]
    assert got == plain_top(whole, [r for r in whole if r[0] % 50 == 0], 5)
    assert topk.top_k(usable.limit(0), usable).count() == 0 and topk.top_k(usable, usable.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e6, 1e8])
def test_top_k_of_large_components(spark, monkeypatch, scale):
    """Box bounds, and the scores of other rows, may leave 64 bits where the best scores do not."""
    for name, value in (("SHARD_ROWS", 40), ("LEAF_ROWS", 4), ("BLOCK_QUERIES", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.standard_normal(64) * (scale if i % 2 else 1e6)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    table = table.withColumn("vector", F.when(F.col("vec_id") % 50 == 0, F.transform("vector", lambda x: F.floor(x / 1000))).otherwise(F.col("vector")))
    whole = [(r.vec_id, list(r.vector)) for r in table.collect()]
    got = sorted(tuple(r) for r in topk.top_k(table, table.where("vec_id % 50 = 0")).collect())
    assert got == plain_top(whole, [r for r in whole if r[0] % 50 == 0], 5)
    few = spark.createDataFrame([(0, [2.0 ** 40]), (1, [2.0 ** 40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        pairs = few.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
        topk.top_k(pairs, pairs).collect()
    with pytest.raises(Exception, match="64 bits"):
        few.select(topk.quantised(F.transform("embedding", lambda x: x * 1e20))).collect()


def test_runs_equal_those_of_single_windows():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k = rng.integers(1, 20)
        own, ids, starts = rng.integers(1, 9, k), rng.integers(0, 4, k), rng.integers(0, 40, k)
        inside, late = substrings.ranges(own), rng.random(own.sum()) < rng.random()
        at, first, last = substrings.late_runs(late, own)
        got = substrings.joined(ids[at], starts[at] + inside[first], starts[at] + inside[last])
        want = substrings.covered(np.repeat(ids, own)[late], (np.repeat(starts, own) + inside)[late])
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_chosen_segments_by_row():
    chosen = substrings.Chosen([np.array([4, 0]), np.array([], dtype=np.int64), np.array([2])])
    rows, numbers = np.array([0, 0, 0, 0, 1, 2, 2, 2]), np.array([0, 1, 4, 5, 0, 1, 2, 9])
    assert chosen.has(rows, numbers).tolist() == [True, False, True, False, False, False, True, False]
