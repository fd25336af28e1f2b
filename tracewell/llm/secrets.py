"""Secrets, and weak credential candidates that only count together.

The base patterns find assignments, access keys and long hex runs on their own. Other parts are
too weak alone: an identifier (a user or key name with its value), a secret (a run of 16 or more
letters and digits of mixed kind) and an endpoint (a URL or host with port). Within a scope - the
text between blank lines - the parts are joined by interval: a weak secret is reported if an
identifier and an endpoint, or a base span and one of them, begin no further than ``REACH``
characters from it, and the complementary parts are reported with it. Parts that do not meet
others are not reported.

Defined cases: null text is empty and has no spans; repeated rows are scanned each; an empty table
gives no rows; positions are code points, ends are exclusive; an input column with the name of the added one is
refused; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracewell.llm.base import new_column, table

#: Fixed values of the contract: base kinds in order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

IDENTIFIER = re.compile(r"""(?ai:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""")
IDENTIFIER_WORDS = ("user", "login", "account", "client", "key_id", "keyid", "access")
ENDPOINT = re.compile(r"""(?ai:\b[a-z][a-z0-9+.-]*://[^\s"'<>|]{4,}|\b[a-z0-9][a-z0-9.-]*\.[a-z]{2,}:[0-9]{2,5}\b)""")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Least entropy of a weak secret's characters, and how far its companions may begin from it.
SECRET_BITS, REACH = 3.0, 200
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
REDACTED = "[redacted]"

HEX_MAP = bytes(0x78 if b in b"0123456789abcdef" else 0x20 for b in range(256))
FOUND = "array<struct<kind: string, start: int, end: int>>"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns: start, end, kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if b"x" * HEX_LENGTH in text.encode().translate(HEX_MAP):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_mixed(value: str) -> bool:
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return bits >= SECRET_BITS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that have their complement within reach in the same scope."""
    lower = text.lower()
    identifiers = [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)] if any(w in lower for w in IDENTIFIER_WORDS) else []
    endpoints = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if ":" in text else []
    if not (identifiers or endpoints):
        return []
    covered = merged([*base, *endpoints])
    secrets = [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if is_mixed(m[0]) and not overlaps(covered, *m.span())]
    if not (secrets or base):
        return []
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    scoped = lambda parts: sorted((bisect_right(ends, a), a, b, kind) for a, b, kind in parts)
    names, places, strong = scoped(identifiers), scoped(endpoints), scoped(base)
    found = set()
    for part in scoped(secrets) + strong:
        near = [within(side, part) for side in (names, places, strong if part[3] == "secret" else [])]
        if len([side for side in near if side]) >= (1 if part[3] in KINDS[:3] else 2):
            found |= {x[1:] for side in near[:2] for x in side} | ({part[1:]} if part[3] == "secret" else set())
    return sorted(found)


def within(parts: list[tuple[int, int, int, str]], around: tuple[int, int, int, str]) -> list[tuple[int, int, int, str]]:
    """The parts of the same scope that begin within reach of ``around``; parts are sorted by scope and start."""
    scope, start, end, _ = around
    return parts[bisect_left(parts, (scope, start - REACH)):bisect_right(parts, (scope, end + REACH))]


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def overlaps(apart: list[tuple[int, int]], start: int, end: int) -> bool:
    """True if one of the stretches shares a character with start:end; only the last that begins before the end can."""
    i = bisect_left(apart, (end,))
    return i > 0 and apart[i - 1][1] > start


def all_spans(text: str) -> list[Span]:
    base = base_spans(text)
    return sorted({*base, *linked_spans(text, base)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def finder():
    @arrow_udf(FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for column in texts:
            yield pa.array(([{"kind": k, "start": a, "end": b} for a, b, k in all_spans(x.as_py() or "")] for x in column), type=kind, size=len(column))

    return find


def with_secrets(docs: DataFrame, to: str = "secrets") -> DataFrame:
    """``docs`` with column ``to``: kind, start and end of every span, by start, then kind."""
    return docs.withColumn(new_column(docs, to), finder()(F.col("text")))


def redact(text: str) -> str:
    """``text`` with each stretch covered by spans replaced by ``REDACTED``."""
    kept, at = [], 0
    for start, end, _ in all_spans(text):
        if start >= at:
            kept.append(text[at:start] + REDACTED)
        at = max(at, end)
    return "".join([*kept, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of each text replaced; texts without secrets stay as they are."""

    @arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array((None if x.as_py() is None else redact(x.as_py()) for x in column), type=pa.string(), size=len(column))

    fresh = "_" * max(map(len, docs.columns)) + "text"
    out = docs.withColumn(fresh, clean(F.col("text")))
    changed = ~F.col(fresh).eqNullSafe(F.col("text"))
    columns = {"text": F.col(fresh), "n_chars": F.when(changed, F.char_length(fresh)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[columns[c].alias(c) if columns.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(KINDS[:3]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))
