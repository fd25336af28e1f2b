"""Chat formatting, mixing, decontamination, the pipeline and the SQL results."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from llm_rows import KNOWN_TEXT, documents, odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import chat, decontaminate, mixing, registry
from tracewell.llm.base import text_blocks

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
NATIVE = ["op6_chat_format", "op8_source_mix"]


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, SMALL), database.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [got.columns.index(c) for c in want.columns]
    assert sorted((tuple(r[i] for i in order) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")


def test_chat_round_trip(spark):
    rng = random.Random(11)
    parts = ["###", "##", "#", "</turn>", "</", "<", "turn>", "\\", "\\e", "\\s", "s", "e", "~", ": ", ":", "\n", "Assistant", "é☃", "</turn>\n", "### user: "]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    rows = [(i // 5, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "assistant", "", None, text(3)]), rng.choice([None, text(9)])) for i in range(400)]
    rows += [(900, 1, "assistant", "x" * 300_000 + "###"), (None, 1, "user", "a"), (None, 1, "user", "a"), (901, 0, "assistant", chat.ADDED_TEXT)]
    done = chat.format_conversations(conversations(spark, rows)).withColumn("back", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    want = defaultdict(list)
    for conv, turn, role, content in rows:
        want[conv].append((turn is not None, turn or 0, role or "", content or ""))
    assert {r.conv_id for r in done} == set(want)
    for r in done:
        told = [(role, content) for _, _, role, content in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.back] == told == [(t.role, t.text) for t in r.source]
        assert r.loss == "".join(c for role, c in told if role == "assistant")
        bodies = r.formatted.split("</turn>\n")[:-1]
        assert len(bodies) == len(told) and all(b.count("###") == 1 and "</turn>" not in b for b in bodies)
        assert all(r.formatted[s.end:s.end + 8] == "</turn>\n" for s in r.loss_mask)
    assert chat.format_conversations(conversations(spark, rows).limit(0)).count() == 0


def test_mix_follows_its_targets(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 20, 200]))), rng.choice(["a"] * 6 + ["b", "c", None, "d"])) for i in range(3000)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total, taken, target, largest = sum(r.size for r in got), defaultdict(int), {}, max(r.size for r in got)
    source = dict((i, s) for i, _, s in rows)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size + 1e-6
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total and sum(taken.values()) <= 1.5 * total
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in target)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns[:len(docs.columns)] == docs.columns and mixed.columns[-4:] == ["mix_size", "source_size", "target", "mix_taken"]
    assert {r.doc_id: r.mix_taken for r in mixed.collect()} == {i: t for i, t in again.items() if t}


def test_mix_on_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((i is not None, i or 0, len((t or "").split())) for i, t, _ in rows)
    kept = mixing.mixed_documents(docs).collect()
    assert sum(r.mix_taken for r in kept) == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    blank = documents(spark, [(1, None, "a"), (2, "", None)])
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def plain_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [500_000, 3])
def test_window_hits(spark, monkeypatch, most):
    """Small blocks of windows give the same hits."""
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
    rng = random.Random(13)
    word = lambda: rng.choice(["The", "a", "ÉTÉ", "x1", "zz", "fox"])
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 14)))) for i in range(8)] + [(8, "two words!"), (9, None), (10, ""), (None, KNOWN_TEXT), (11, KNOWN_TEXT), (11, KNOWN_TEXT), (12, "...")]
    rows = odd_rows() + [(100 + i, " ".join(word() for _ in range(60)) + "-" + rng.choice(items)[1 if i % 2 else 1].__str__(), None) for i in range(60)]
    docs = documents(spark, rows)
    benchmark = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, hits string")
    got = decontaminate.with_hits(docs.drop("found"), benchmark).collect()
    told = sorted(((r.doc_id, r.found.n_words, sum(r.found.hits[1::2]) - sum(r.found.hits[::2]), list(r.found["items"])) for r in got), key=repr)
    want = plain_hits([r[:2] for r in rows], items)
    assert told == want
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r for r in clean.where("doc_id IS NOT NULL").collect()}
    share = {d: (n_hit, n) for d, n, n_hit, _ in want}
    assert set(kept) == {d for d, (h, n) in share.items() if d is not None and (h == 0 or h < 0.2 * n)}
    texts = {i: t for i, t, _ in rows}
    for i, r in kept.items():
        assert r.text == texts[i] if share[i][0] == 0 else len(re.findall(r"\w+", r.text)) < len(re.findall(r"\w+", texts[i])) and r.n_chars == len(r.text)
    assert decontaminate.decontaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminated(docs, benchmark.limit(0)).count() == len(rows)


def test_text_blocks():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["a" * (3 << 20)] * 7 + [None, ""] + ["b" * (9 << 20)] * 2, "n": list(range(11))})
    blocks = list(text_blocks([batch, batch.slice(0, 0)]))
    assert [n for b in blocks for n in b.column("n").to_pylist()] == list(range(11)) and len(blocks) > 4


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_documents", "distinct_documents", "clean_of_benchmark", "without_secrets", "mixed"]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.where("n_chars <> char_length(text)").count() == 0, name
        if name == "benchmark decontamination":
            assert not [h for h in plain_hits([(r.doc_id, r.text) for r in docs.collect()], benchmark) if h[2]]
    assert docs.count() > 120
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    last = corpus_pipeline.mixed(spark, docs, SMALL).collect()
    whole = corpus_pipeline.run(spark, SMALL).collect()
    digest = lambda rows: sorted(hashlib.sha256(repr(tuple(r)).encode()).hexdigest() for r in rows)
    assert digest(last) == digest(whole) and all(0 < r.taken <= 2 * r.size for r in last)


def test_registered(spark):
    import __spark_entry__ as entry
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries()) and [n.split("_")[0] for n in registry.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(registry.SQL) <= set(registry.QUERIES)
