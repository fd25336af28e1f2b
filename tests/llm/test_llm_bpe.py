"""Byte-level BPE against the library tokenizer, on odd texts, small vocabularies and the whole table."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_rows import documents, odd_rows

from tracewell.llm import bpe, registry

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.VOCABULARY)


def library(ranks, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


def test_every_character_splits_as_in_the_library(ranks):
    ours, theirs = bpe.Encoder(ranks, public_tokenizers.PATTERN), library(ranks)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}b.{chr(c)}\n" for c in points[at:at + 50])
        assert numbers(ours.encode(text)) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["x", "ab", "abcdefghijklmnopqrstuvwxyz", "thé☃aß", " \n\t", "日本語", "'s 'll x"])
def test_long_matches(ranks, alphabet):
    rng, ours, theirs = random.Random(3), bpe.Encoder(ranks, public_tokenizers.PATTERN), library(ranks)
    for n in (1, 2, 3, 40, 700, 30_000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert numbers(ours.encode(text)) == theirs.encode_ordinary(text)


def test_vocabularies_with_ranks_in_any_order():
    """Joins may make pairs of a lower rank, which then go first."""
    rng = random.Random(4)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)}
        order = rng.sample(range(256, 5000), len(tokens))
        ranks = {bytes([b]): b for b in range(256)} | dict(zip(sorted(tokens), order))
        ours, theirs = bpe.Encoder(ranks, r"\w+|\W"), library(ranks, r"\w+|\W")
        texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 9))) for _ in range(20)] + ["", "a" * 300]
        want = [theirs.encode_ordinary(text) for text in texts]
        assert [numbers(ours.encode(text)) for text in texts] == want
        together = bpe.Encoder(ranks, r"\w+|\W")
        assert [numbers(x) for x in together.encode_all(texts)] == want


def test_texts_together_equal_texts_alone(ranks, monkeypatch):
    rng, theirs = random.Random(6), library(ranks)
    alphabet = "eeettaoinshrdlu  ,.'\n019éßXYZ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(300)] + ["aaaa aaaaa\n" * 9, "\x00 \x00\x00a\x00", "x" * 90]
    want = [theirs.encode_ordinary(t) for t in texts]
    for chars, together, remembered in ((6 << 20, 200_000, 300_000), (500, 7, 50), (1, 1, 1)):
        for name, value in (("LISTED_CHARS", chars), ("TOGETHER", together), ("REMEMBERED", remembered)):
            monkeypatch.setattr(bpe, name, value)
        assert [numbers(x) for x in bpe.Encoder(ranks, public_tokenizers.PATTERN).encode_all(texts)] == want


def test_pieces_of_long_texts_and_a_full_memory(ranks, monkeypatch):
    texts = [t or "" for _, t, _ in odd_rows()]
    for name, value in (("LISTED_CHARS", 100), ("LISTED", 7), ("REMEMBERED", 3), ("SHORT", 4), ("DECODED", 5)):
        monkeypatch.setattr(bpe, name, value)
    ours, theirs, tokens = bpe.Encoder(ranks, public_tokenizers.PATTERN), library(ranks), [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    for text in texts:
        packed = ours.encode(text)
        assert numbers(packed) == theirs.encode_ordinary(text) and len(ours) <= 3
        assert bpe.decode(np.frombuffer(packed, "<u4"), tokens).decode() == text


def test_operator_on_odd_rows(spark, ranks):
    rows, theirs = odd_rows(), library(ranks)
    docs = documents(spark, rows)
    got = bpe.with_decoded(bpe.with_token_ids(docs, PATH, to="ids"), PATH, ids="ids", to="back")
    assert got.columns == [*docs.columns, "ids", "back"]
    told = sorted(((r.doc_id, r.text, numbers(r.ids), bytes(r.back).decode()) for r in got.collect()), key=repr)
    assert told == sorted(((i, t, theirs.encode_ordinary(t or ""), t or "") for i, t, _ in rows), key=repr)
    assert bpe.with_token_ids(docs.limit(0), PATH, to="ids").count() == 0
    with pytest.raises(ValueError):
        bpe.with_token_ids(docs, PATH, to="Score")


def test_query_on_the_whole_table(spark, ranks):
    theirs = library(ranks)
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = theirs.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = registry.QUERIES["op13_byte_bpe"](spark, SMALL).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_bad_vocabulary(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.load_ranks(str(tmp_path / "few"))
