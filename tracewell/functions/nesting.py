"""Bracketed text as a table of groups, for nesting of any depth.

A pass takes out every group that holds no other, puts a numbered token in its place and keeps its
text; there are as many passes as levels. What is left, and each group's own text, has no brackets, so plain patterns
see only their own level. A group that is a query (it starts with SELECT or WITH, or is a set operation of such
groups) gets a token of another kind than an expression's; brackets around nothing but a query fall away.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import MARK, let

#: Token of an expression group and of a query: the number between two control characters. CLOSED comes before the
#: number that each closing bracket has in the text.
GROUP, QUERY, CLOSED = r"\x04\d+\x05", r"\x06\d+\x07", "\x08"
SET_OPERATORS = r"(?:UNION|INTERSECT|EXCEPT|MINUS)"
IS_QUERY = rf"(?i)^(?:(?:SELECT|WITH)\b|{QUERY} ?{SET_OPERATORS}\b)"
#: ``text`` is the top level; by group number: its own text, that with expression groups put back, that with all
#: groups put back, and the number of its closing bracket.
NESTED = "struct<text:string,surface:array<string>,inlined:array<string>,whole:array<string>,closed:array<int>>"


def depth(text: Column) -> Column:
    """Levels of brackets, 0 without any; null if they do not match.

    Taking out every pair that holds no other lowers the levels by one; where a few turns do not end it, the brackets are walked.
    """
    bare = F.regexp_replace(text, "[^()]+", "")
    turn = lambda left, level, whole: let(F.replace(left, F.lit("()"), F.lit("")), lambda less: F.when(less == "", level).otherwise(
        turn(less, level + 1, whole) if level < 4 else walked_depth(whole)))
    return F.when(~(text.contains("(") | text.contains(")")), 0).otherwise(let(bare, lambda b: turn(b, 1, b)))


def walked_depth(brackets: Column) -> Column:
    steps = F.filter(F.split(brackets, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(True).alias("sound"))
    walked = F.reduce(steps, start, lambda s, c: let(s["now"] + F.when(c == "(", 1).otherwise(-1), lambda now: F.struct(
        now.alias("now"), F.greatest(s["most"], now).alias("most"), (s["sound"] & (now >= 0)).alias("sound"))))
    return let(walked, lambda w: F.when(w["sound"] & (w["now"] == 0), w["most"]))


def pieces_between(text: Column, pattern: str) -> Column:
    """``text`` split at a pattern: a split at one character needs no pattern to be made anew for each text."""
    return F.split(F.regexp_replace(text, pattern, MARK), MARK)


def put_back(text: Column, groups: Column, token: str) -> Column:
    """``text`` with the tokens of one kind replaced by their groups in brackets."""
    numbers = F.regexp_extract_all(text, F.lit(token.replace(r"\d+", r"(\d+)")), F.lit(1))
    own = F.concat(F.transform(numbers, lambda n: F.concat(F.lit("("), F.get(groups, n.cast("int")), F.lit(")"))), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces_between(text, token), own, lambda piece, group: F.concat(piece, group)), "")
    marks = text.contains("\x05") if token == GROUP else text.contains("\x05") | text.contains("\x07")
    return F.when(marks, joined).otherwise(text)


ANY_TOKEN = r"[\x04\x06]\d+[\x05\x07]"


def nested(text: Column, levels: Column) -> Column:
    """The groups of ``text``, whose brackets match and are ``levels`` deep, as ``NESTED``.

    Text without a query in brackets has expression groups only, whose closing brackets need no numbers.
    """
    return let(text, lambda t: let(t.rlike(r"(?i)\( *(?:SELECT|WITH)\b"), lambda queries: _nested(t, levels, queries)))


def _nested(text: Column, levels: Column, queries: Column) -> Column:
    pieces = F.split(text, r"\)")
    numbered = let(pieces, lambda p: F.array_join(F.transform(p, lambda piece, i: F.when(
        i < F.size(p) - 1, F.concat(piece, F.lit(CLOSED), i.cast("string"), F.lit(")"))).otherwise(piece)), ""))
    strings, numbers = "CAST(array() AS array<string>)", "CAST(array() AS array<int>)"
    start = F.struct(F.when(queries, numbered).otherwise(text).alias("text"), *[F.expr(strings).alias(n) for n in ("surface", "inlined", "whole")], F.expr(numbers).alias("closed"))

    def token(content: Column, number: Column) -> Column:
        return F.when(queries & content.contains("\x07") & content.rlike(f"^{QUERY}$"), content).when(
            queries & content.rlike(IS_QUERY), F.concat(F.lit("\x06"), number, F.lit("\x07"))).otherwise(F.concat(F.lit("\x04"), number, F.lit("\x05")))

    def one_level(s: Column, _: Column) -> Column:
        pattern = r"\(([^()\x08]*)(?:\x08(\d+))?\)"
        found = F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(1)), lambda c: F.trim(c))
        return let(found, lambda groups: let(F.transform(groups, lambda c: put_back(c, s["inlined"], GROUP)), lambda inlined: F.struct(
            F.array_join(F.zip_with(pieces_between(s["text"], r"\([^()]*\)"), F.concat(F.transform(
                groups, lambda c, i: token(c, (i + F.size(s["surface"])).cast("string"))), F.array(F.lit(""))), lambda piece, t: F.concat(piece, t)), "").alias("text"),
            F.concat(s["surface"], groups).alias("surface"),
            F.concat(s["inlined"], inlined).alias("inlined"),
            F.concat(s["whole"], F.when(queries, F.transform(groups, lambda c: put_back(c, s["whole"], ANY_TOKEN))).otherwise(inlined)).alias("whole"),
            F.when(queries, F.concat(s["closed"], F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(2)), lambda n: n.cast("int")))).otherwise(
                s["closed"]).alias("closed"))))

    passes = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.expr(numbers))
    return F.reduce(passes, start.cast(NESTED), one_level)


def query_numbers(text: Column) -> Column:
    """Numbers of the query tokens in ``text``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\x06(\d+)\x07"), F.lit(1)), lambda n: n.cast("int"))
    return F.when(text.contains("\x07"), found).otherwise(F.expr("CAST(array() AS array<int>)"))


def without_queries(text: Column, instead: str, before: str = "") -> Column:
    """``text`` with ``instead`` in place of each query token, those after ``before`` with what stands there."""
    return F.when(text.contains("\x07"), F.regexp_replace(text, f"{before}{QUERY}", instead)).otherwise(text)
