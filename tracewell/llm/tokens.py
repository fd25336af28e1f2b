"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic
programming carries the best score and its number of pieces. The rules are those of the unigram
tokenizers: blanks become a visible mark that starts a segment, and the text starts with one;
matches are tried from the longest to the shortest and only a strictly better score replaces an
earlier one; a character that is no piece of its own may be unknown at the lowest score less ten,
and an unknown character counts as its UTF-8 bytes.

The pieces and scores come from a vocabulary file. Its scores are whole numbers, so sums are
exact, and a text may be cut wherever no piece reaches across: before each mark, and around
characters that no piece contains. Counts of the stretches between are remembered per process, at
most ``REMEMBERED`` at a time.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; an empty table
gives no rows; texts are counted whole;
an input column with the name of the added one is refused; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm.base import new_column, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the tokenizer: mark of a blank, how far an unknown character is below the lowest score.
MARK, UNKNOWN_BELOW = "▁", 10.0
#: Pieces that may be broadcast, and stretches whose count a process remembers.
MOST_PIECES, REMEMBERED = 1_000_000, 1_000_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in order."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MOST_PIECES:
        raise ValueError(f"{path} has over {MOST_PIECES} pieces")
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Stretch -> tokens of its best path; a missing stretch is worked out when asked for."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_BELOW
        whole = all(score == int(score) for _, score in pieces) and not any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        apart = "".join(c for c in "\n\t\r" if whole and not any(c in piece for piece, _ in pieces))
        self.stretch = re.compile(f"{MARK}?[^{MARK}{apart}]+|{MARK}" + (f"|[{apart}]" if apart else ""))

    def __missing__(self, stretch: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[stretch] = count = self.best_path(stretch)
        return count

    def best_path(self, stretch: str) -> int:
        size, unknown = len(stretch), self.unknown
        best, tokens = [0.0] * (size + 1), [0] * (size + 1)
        done, top, pieces, single = -1, None, 0, False

        def close(end: int) -> None:
            """The last candidate for ``end``: its character alone, as unknown, unless that is a piece."""
            nonlocal top, pieces
            if not single and (top is None or best[end] + unknown > top):
                top, pieces = best[end] + unknown, tokens[end] + len(stretch[end].encode())
            best[end + 1], tokens[end + 1] = top, pieces

        for end, (length, score) in self.automaton.iter(stretch):
            while done < end:
                if done >= 0:
                    close(done)
                done, top, single = done + 1, None, False
            start = end + 1 - length
            if top is None or best[start] + score > top:
                top, pieces = best[start] + score, tokens[start] + 1
            single = single or length == 1
        while done < size:
            if done >= 0:
                close(done)
            done, top, single = done + 1, None, False
        return tokens[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.stretch.findall(marked if marked.startswith(MARK) else MARK + marked)))


def with_token_counts(docs: DataFrame, path: str = VOCABULARY, to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in column ``to``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    @arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for column in texts:
            yield pa.array((counter.count(x.as_py()) for x in column), type=pa.int64(), size=len(column))

    return docs.withColumn(new_column(docs, to), count(F.col("text")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
