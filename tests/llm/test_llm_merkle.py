"""The Merkle manifest against a plain build and plain proofs."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_rows import CLASHING, odd_rows

from tracewell.llm import merkle

FIELDS = "doc_id long, text string, source string, lang string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, source, lang, n_chars):
    told = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in told])


def plain_tree(digests):
    """Root, and for each digest its path: (left, right) from the leaf on."""
    paths, owners, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        runs = [range(i, min(i + 8, len(level))) for i in range(0, len(level), 8)]
        for run in runs:
            for k in run:
                for i in owners[k]:
                    paths[i].append(("".join(level[run[0]:k]), "".join(level[k + 1:run[-1] + 1])))
        level, owners = [sha(*[level[k] for k in run]) for run in runs], [[i for k in run for i in owners[k]] for run in runs]
    return level[0], paths


def fold(leaf, path):
    for left, right in path:
        leaf = sha(left, leaf, right)
    return leaf


def plain_manifest(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[3]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = own, *plain_tree([plain_leaf(*r) for r in own])
    root, upper = plain_tree([trees[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            whole, leaf = path + above, plain_leaf(*r)
            lowered = "".join(c.lower() if c.isascii() else c for c in r[1]) if r[1] is not None else None
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            back = fold(plain_leaf(r[0], lowered, *r[2:]) if hit else leaf, whole)
            out.append((r[0], leaf, subroot, root, sha(*[a + b for a, b in whole]), back, back == root))
    return sorted(out, key=repr)


def told(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING), "x", 1) for r in rows], ", ".join([FIELDS, *[f"{c} string" for c in CLASHING], "tree string, rank long"]))
    monkeypatch.setattr(merkle, "table", lambda *_: docs)
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, "").collect()), key=repr)


def random_rows(counts):
    rng, rows = random.Random(5), []
    for lang, n in counts.items():
        for _ in range(n):
            rows.append((rng.randrange(10 ** 6), rng.choice([None, "", "Upper and lower", "no capitals", "Ünï CÖDE 3:x"]), rng.choice([None, "web", "-"]), lang, rng.choice([None, 5])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counts", [
    {"en": 1}, {"en": 8}, {None: 9, "": 1, "de": 64, "en": 65}, {None: 3, "é": 2, "z": 1, "Z": 530},
    {f"l{i}": 1 + i % 3 for i in range(70)},
])
def test_equal_to_a_plain_build(spark, monkeypatch, counts):
    rows = random_rows(counts)
    assert told(spark, monkeypatch, rows) == plain_manifest(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(i, t, s, lang, None) for i, t, s in odd_rows() for lang in ("en", None)]
    rows += [(None, None, None, None, None)] * 40 + [(7, "Same", "a", "fr", 1)] * 20
    got = told(spark, monkeypatch, rows)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}
    assert told(spark, monkeypatch, []) == []


def test_some_requests(spark):
    """Only what is asked for is followed, and a wrong place finds nothing."""
    rows = [(i, f"text {i}", "a", "en", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, FIELDS)
    leaves, levels, subroots, _ = merkle.manifest(docs)
    starts = subroots.selectExpr("language AS tree", "digest", "height", f"CAST(array() AS {merkle.PATH}) AS path", "digest AS root", "digest AS subroot")
    asked = spark.createDataFrame([("+en", 0, "first"), ("+en", 57, "some"), ("+en", 99, "last"), ("+en", 64 * 8, "none"), ("+xx", 0, "none")], "tree string, rank long, name string")
    found = merkle.descended(starts, levels, asked).collect()
    assert sorted((r.rank, r.name, r.digest) for r in found) == [(i, n, plain_leaf(*rows[i])) for i, n in ((0, "first"), (57, "some"), (99, "last"))]
    assert all(fold(r.digest, [tuple(s) for s in reversed(r.path)]) == r.root for r in found)
