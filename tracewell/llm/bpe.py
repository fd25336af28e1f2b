"""Byte-level BPE encoding and decoding with a rank queue under a hierarchical bitmap.

Each match of the split pattern is encoded by itself. A match that is a vocabulary entry is one token. In any
other its bytes are a linked list, and the pair with the lowest rank is joined, the leftmost one among equals,
until no pair has a rank. The queue holds a bucket of list positions for every rank in use; a bitmap of words has
a bit for each bucket, and a summary above it a bit for each word that is not zero, so the next rank is found by two
find-first-sets. A join gives its neighbours new ranks; their old entries stay in the queue and are skipped when
met. The work is nearly linear in the match, however long it is.

A long match has a queue of its own. The short ones of a block of texts that are not known yet share one: their
lists lie side by side, and each rank's bucket is joined in all of them at once, in numpy. That is the same order for each
match unless a join makes a pair of a lower rank; such a match is done again by itself. Ids of short matches are
remembered per process, at most ``REMEMBERED`` of them. Long texts are split and decoded piece by piece.

Defined cases: null and empty texts have no ids; repeated rows are encoded each; an empty table gives no rows;
texts are encoded whole; an id outside the vocabulary is an error of the decoder; an input column with the name of an
added one is refused; other columns are not looked at. The vocabulary must hold every single byte, and each rank once.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm.base import new_column, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ranks that may be broadcast; bits of a rank within a word, and their mask (words have 256 bits).
MOST_RANKS, BITS, LOW = 1_000_000, 8, 255
#: Matches that a process remembers, and of how many characters at most; matches that share a queue.
REMEMBERED, SHORT, TOGETHER = 200_000, 64, 100_000
#: Characters of texts whose matches are listed at once, matches of a longer one, ids that are decoded at once.
LISTED_CHARS, LISTED, DECODED = 4 << 20, 1 << 16, 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file, one entry a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if len(ranks) > MOST_RANKS or len(set(ranks.values())) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: over {MOST_RANKS} entries, a repeated rank or a missing byte")
    return ranks


class Encoder(dict):
    """Match of the pattern -> its ids as little-endian 32-bit numbers; a missing one is worked out when asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.n_words = (max(ranks.values()) >> BITS) + 1
        self.bytes_ = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        halves = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        halves = np.array(sorted(halves) or [(-1, -1)], dtype=np.int64)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        self.pairs = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]

    def __missing__(self, match: str) -> bytes:
        ids = self.joined(match.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= SHORT:
            self.make_room(1)
            self[match] = packed
        return packed

    def make_room(self, n: int) -> None:
        if len(self) + n > REMEMBERED:
            self.clear()

    def learn(self, matches: Iterable[list[str]]) -> None:
        """Works out the short matches that are not known yet, all together."""
        every = set().union(*matches)
        self.make_room(len(every.difference(self)))
        new = {m: m.encode() for m in every.difference(self) if len(m) <= SHORT}
        self.update((m, struct.pack("<I", self.ranks[d])) for m, d in new.items() if d in self.ranks)
        several = [m for m, d in new.items() if d not in self.ranks]
        for at in range(0, len(several), TOGETHER):
            part = several[at:at + TOGETHER]
            self.update(zip(part, self.joined_together([new[m] for m in part]), strict=True))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 for those that are none."""
        wanted = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == wanted, self.pair_ranks[place], -1)

    def joined_together(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids of several matches, none of which is a token. Each match is followed by a byte that pairs with nothing."""
        lengths = np.array([len(m) for m in matches])
        ends = np.cumsum(lengths + 1) - 1
        whole = np.frombuffer(b"\0".join(matches) + b"\0", np.uint8)
        size, apart = len(whole), self.n_words << BITS
        token = self.bytes_[whole]
        token[ends] = apart
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        pair = np.append(self.rank_of(token[:-1], token[1:]), -1)
        alive, again = np.ones(size, bool), set()
        buckets: dict[int, list[np.ndarray]] = {}
        words, summary = [0] * self.n_words, 0

        def queue(places: np.ndarray) -> None:
            nonlocal summary
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist()
            for start, stop, rank in zip(cuts, [*cuts[1:], len(places)], ranks[cuts].tolist(), strict=True):
                if rank in buckets:
                    buckets[rank].append(places[start:stop])
                else:
                    buckets[rank] = [places[start:stop]]
                    words[rank >> BITS] |= 1 << (rank & LOW)
                    summary |= 1 << (rank >> BITS)

        if (first := np.flatnonzero(pair >= 0)).size:
            queue(first)
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << BITS | (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                summary &= summary - 1
            waiting = buckets.pop(rank)
            places = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            places = places[pair[places] == rank]
            if not places.size:
                continue
            if places.size > 1:
                places = np.unique(places)
                linked = after[places[:-1]] == places[1:]
                if linked.any():  # runs like aaaa: every second pair is taken, from the left
                    run = np.maximum.accumulate(np.where(np.append(True, ~linked), np.arange(len(places)), 0))
                    places = places[(np.arange(len(places)) - run) % 2 == 0]
            gone = after[places]
            end = after[gone]
            met = token[end]
            token[places] = rank
            pair[gone] = -1
            alive[gone] = False
            after[places] = end
            before[end] = places
            left = before[places]
            inside = left >= 0
            left = left[inside]
            right_rank = self.rank_of(token[places], token[end])
            left_rank = self.rank_of(token[left], token[places[inside]])
            pair[places] = right_rank
            pair[left] = left_rank
            # What stood to the right when the pair was joined, where the neighbour was joined in the same step.
            passing = np.flatnonzero(met != token[end])
            lower = [places[(right_rank >= 0) & (right_rank < rank)], left[(left_rank >= 0) & (left_rank < rank)]]
            if passing.size:
                between = self.rank_of(np.full(len(passing), rank), met[passing])
                lower.append(places[passing[(between >= 0) & (between < rank)]])
            for some in lower:
                if some.size:
                    again.update(np.searchsorted(ends, some).tolist())
            fresh = np.concatenate([places[right_rank >= 0], left[left_rank >= 0]])
            if fresh.size:
                queue(fresh)
        alive[ends] = False
        starts = ends - lengths
        packed = token[alive].astype("<u4").tobytes()
        counts = np.diff(np.searchsorted(np.flatnonzero(alive), np.append(starts, size)))
        stops = (np.cumsum(counts) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        for i in again:
            ids = self.joined(matches[i])
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def joined(self, data: bytes) -> list[int]:
        """Ids of one match. Position i is the token from byte i on; ``after`` and ``before`` link the tokens.

        ``buckets`` has the positions by rank, ``words`` a bit for each bucket, and ``summary`` a bit for each word
        that is not zero. A bucket is emptied from left to right; no entry can join it meanwhile, as a new pair
        is longer than the token just made. Should a lower rank turn up, the rest of the bucket waits again. It ends
        when no pair with a rank is ``live``, whatever old entries are left.
        """
        ranks, size, longest = self.ranks, len(data), self.longest
        if (whole := ranks.get(data)) is not None:
            return [whole]
        pairs = self.pairs
        pair: list[int | None] = [pairs[a][b] for a, b in zip(data, data[1:])]
        pair.append(None)
        # One link beyond the end, so that the last token has a neighbour without a pair.
        after, before = [*range(1, size + 1), size + 1], list(range(-1, size))
        buckets: dict[int, list[int]] = {}
        words, summary, live = [0] * self.n_words, 0, 0
        for i, rank in enumerate(pair):
            if rank is not None:
                live += 1
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> BITS] |= 1 << (rank & LOW)
                    summary |= 1 << (rank >> BITS)
        while live:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << BITS | (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                summary &= summary - 1
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            lower = False
            for place, i in enumerate(bucket):
                if pair[i] != rank:
                    continue
                if lower:
                    buckets[rank] = bucket[place:]
                    words[rank >> BITS] |= 1 << (rank & LOW)
                    summary |= 1 << (rank >> BITS)
                    break
                gone = after[i]
                after[i] = end = after[gone]
                if pair[gone] is not None:
                    pair[gone] = None
                    live -= 1
                before[end] = i
                pair[i] = None
                live -= 1
                left = before[i]
                if left >= 0 and pair[left] is not None:
                    pair[left] = None
                    live -= 1
                for j, stop in ((left, end), (i, after[end])):
                    if j < 0 or stop > size or stop - j > longest:
                        continue
                    new = ranks.get(data[j:stop])
                    if new is None:
                        continue
                    pair[j] = new
                    live += 1
                    lower = lower or new < rank
                    if new in buckets:
                        buckets[new].append(j)
                    else:
                        buckets[new] = [j]
                        words[new >> BITS] |= 1 << (new & LOW)
                        summary |= 1 << (new >> BITS)
        ids, i = [], 0
        while i < size:
            ids.append(ranks[data[i:after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, its matches listed a part at a time."""
        if len(text) <= LISTED_CHARS:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        matches = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: b"".join(map(self.__getitem__, islice(matches, LISTED))), b""))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text; texts are taken together up to ``LISTED_CHARS`` characters."""
        waiting: list[list[str]] = []
        chars = 0
        for text in texts:
            if waiting and chars + len(text) > LISTED_CHARS:
                yield from self.encode_listed(waiting)
                waiting, chars = [], 0
            if len(text) > LISTED_CHARS:
                yield self.encode(text)
            else:
                waiting.append(self.pattern.findall(text))
                chars += len(text)
        yield from self.encode_listed(waiting)

    def encode_listed(self, listed: list[list[str]]) -> Iterator[bytes]:
        self.learn(listed)
        for matches in listed:
            yield b"".join(map(self.__getitem__, matches))


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes of the tokens of ``ids``, one after the other."""
    return b"".join(b"".join(map(tokens.__getitem__, ids[i:i + DECODED].tolist())) for i in range(0, len(ids), DECODED))


ENCODERS: dict[tuple[str, str], Encoder] = {}


def process_encoder(shared, path: str, pattern: str) -> Encoder:
    """This process's encoder, so that later tasks find what earlier ones remembered."""
    if (path, pattern) not in ENCODERS:
        ENCODERS[path, pattern] = Encoder(shared.value, pattern)
    return ENCODERS[path, pattern]


def with_token_ids(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, to: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``to``: little-endian unsigned 32-bit numbers, one after the other."""
    new_column(docs, to)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @arrow_udf("binary")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = process_encoder(shared, path, pattern)
        for column in texts:
            yield pa.array(encoder.encode_all(x.as_py() or "" for x in column), type=pa.binary(), size=len(column))

    return docs.withColumn(to, encoded(F.col("text")))


def with_decoded(tokenised: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``tokenised`` with the bytes that column ``ids`` stands for in column ``to``."""
    new_column(tokenised, to)
    shared = tokenised.sparkSession.sparkContext.broadcast(load_ranks(path))

    @arrow_udf("binary")
    def decoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = [b""] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            tokens[rank] = token
        for column in columns:
            yield pa.array((decode(np.frombuffer(x.as_py() or b"", "<u4"), tokens) for x in column), type=pa.binary(), size=len(column))

    return tokenised.withColumn(to, decoded(F.col(ids)))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    tokenised = with_token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return with_decoded(tokenised, path).select(
        "doc_id", F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
