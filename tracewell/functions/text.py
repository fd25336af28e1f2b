"""SQL text to arrays, with built-in string expressions only.

Everything stays inside one row, so text work is a map over the input: no shuffle,
no Python worker, and the cost of a definition is bounded by its own length.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import rules

MAX_DEPTH = 8
MARK = "\u0001"
LITERAL = r"'[^']*+(?:''[^']*+)*+'"
WORD = r"[A-Za-z_][\w$]*"
NAME = rf"{WORD}(?:\.{WORD})*"
NOT_CALL = r"(?![\w$.]|\s*\()"


def balanced(depth: int = MAX_DEPTH) -> str:
    """Pattern piece for text whose parentheses match, nested up to ``depth`` levels.

    Possessive quantifiers keep matching linear.
    """
    return reduce(lambda inner, _: rf"(?:[^()]++|\({inner}*+\))", range(depth), "(?:[^()]++)")


BALANCED = balanced()
GROUP = rf"\({BALANCED}*+\)"
CTE = rf"(?i)\b({WORD})\s*(?:\([^()]*\)\s*)?AS\s*\(\s*(SELECT\b{BALANCED}*+)\)"
CLAUSES = (
    r"SELECT|(?<!DISTINCT )FROM|WHERE|GROUP BY|HAVING|QUALIFY|ORDER BY|LIMIT|"
    r"UNION ALL|UNION|INTERSECT|EXCEPT|MINUS|"
    r"(?:(?:NATURAL|LEFT|RIGHT|FULL|INNER|CROSS|OUTER|LATERAL) )*JOIN|ON|USING"
)
#: A first look at one letter, as most words of a text begin none of the clauses.
CLAUSE_START = "(?=[" + "".join(sorted({word[0] for word in re.findall("[A-Z]+", CLAUSES)})) + "])"
SET_OPERATORS = ["UNION ALL", "UNION", "INTERSECT", "EXCEPT", "MINUS"]
AFTER_FROM = ["WHERE", "GROUP BY", "HAVING", "QUALIFY", "ORDER BY", "LIMIT", *SET_OPERATORS]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    The value is the start of an aggregate over nothing and the body its end: a transform of one element would copy
    the result, with all that is nested in it, at every level.
    """
    return F.reduce(F.array(), value, lambda bound, _: bound, lambda bound: body(bound))


def elements(name: str) -> Column:
    """An array column, to be exploded without being computed twice.

    For a bare column the optimizer adds a non-empty test below the generator and pushes it
    through the projections, which evaluates the whole expression again.
    """
    return F.filter(name, lambda x: x.isNotNull())


def only_if(condition: Column, value: Column) -> Column:
    """Generator of one value, or of no row at all.

    A filter on a computed column would be pushed below the projections and compute it again.
    """
    return F.explode(F.when(condition, F.array(value)))


def strip_comments(text: Column) -> Column:
    """Comments removed, literals kept. Patterns are tried only on text that has what they begin with, here and below."""
    return let(text, lambda t: F.when(t.contains("'") | t.contains("--") | t.contains("/*"), F.regexp_replace(
        t, rf"({LITERAL})|--[^\r\n]*|/\*(?s:.*?)\*/", "$1 ")).otherwise(t))


def mask_literals(text: Column) -> Column:
    """String literals emptied, so that nothing inside them looks like syntax."""
    return let(text, lambda t: F.when(t.contains("'"), F.regexp_replace(t, LITERAL, "''")).otherwise(t))


#: Characters that a quoted name may hold and a plain one may not, and words for them that a plain name may hold.
QUOTED_ONLY = " !#%&'()*+,-./:;<=>?@[\\]^`{|}~"


def spelled(name: Column, back: bool = False) -> Column:
    """``name`` with the characters of ``QUOTED_ONLY`` as words, or, ``back``, the words as characters."""
    pairs = F.array(*[F.array(F.lit(c), F.lit(f"_x{ord(c):02x}_")) for c in QUOTED_ONLY])
    return F.reduce(pairs, name, lambda t, p: F.replace(t, F.get(p, F.lit(int(back))), F.get(p, F.lit(int(not back)))))


def plain_names(text: Column) -> Column:
    """Quoted names as plain ones; a character that those cannot hold becomes ``_xHH_``."""
    pieces = lambda t: F.transform(F.split(t, '"'), lambda p, i: F.when((i % 2 == 1) & p.rlike(r"[^\w$]"), spelled(p)).otherwise(p))
    return let(text, lambda t: F.when(t.contains('"'), F.array_join(pieces(t), "")).otherwise(t))


def shown(name: Column) -> Column:
    """A name as it was quoted."""
    return let(name, lambda n: F.when(n.contains("_x"), spelled(n, back=True)).otherwise(n))


def one_line(text: Column) -> Column:
    """Blanks, tabs and line ends as single blanks, none at the ends."""
    uneven = lambda t: reduce(lambda a, c: a | t.contains(c), "\t\n\x0b\f\r", t.contains("  "))
    return let(text, lambda t: F.trim(F.when(uneven(t), F.regexp_replace(t, r"\s+", " ")).otherwise(t)))


def normalise_sql(text: Column) -> Column:
    """One-line text without comments, literals or quotes around names."""
    return one_line(plain_names(mask_literals(strip_comments(text))))


def top_level_items(text: Column) -> Column:
    """Pieces between commas that are outside parentheses, trimmed."""
    pieces = F.regexp_extract_all(text, F.lit(rf"((?:[^(),]++|{GROUP})++)"), F.lit(1))
    return F.filter(F.transform(pieces, lambda piece: F.trim(piece)), lambda piece: piece != "")


def segments(text: Column, keywords: str = CLAUSES, commas: bool = True, groups: bool = True) -> Column:
    """Clauses of one statement: array of (kw, txt) for every keyword outside parentheses.

    The keyword pass copies parenthesised groups unchanged, so a keyword is tagged
    only at depth zero; splitting at the tags yields text and keyword in turn. Without ``groups`` the text has none.
    """
    separators = (CLAUSE_START if keywords == CLAUSES else "") + rf"\b(?:{keywords})\b" + ("|," if commas else "")
    tagged = F.regexp_replace(text, rf"(?i)({GROUP})|({separators})", f"$1{MARK}$2{MARK}") if groups else F.regexp_replace(
        text, rf"(?i)({separators})", f"{MARK}$1{MARK}")
    parts = F.split(F.replace(tagged, F.lit(MARK + MARK), F.lit("")), MARK)
    return let(parts, lambda p: F.filter(
        F.transform(
            p,
            lambda part, i: F.when(
                i % 2 == 1,
                F.struct(
                    let(F.upper(part), lambda kw: F.when(kw.endswith("JOIN"), "JOIN").otherwise(kw)).alias("kw"),
                    F.trim(F.get(p, i + 1)).alias("txt"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    ))


def first_index(segs: Column, wanted: list[str], start: Column) -> Column:
    """One-based index of the first segment from ``start`` on with one of the keywords; 0 if none."""
    hits = F.transform(segs, lambda s, i: F.when(s["kw"].isin(wanted) & (i + 1 >= start), i + 1))
    return F.coalesce(F.array_min(hits), F.lit(0))


def table_struct(kw: Column, txt: Column, ordinal: Column) -> Column:
    """Table reference of one FROM or JOIN piece: name and lower-cased alias."""
    name = F.regexp_extract(txt, rf"^({NAME}){NOT_CALL}", 1)
    alias = F.regexp_extract(txt, rf"(?i)^{NAME} (?:AS )?({WORD})", 1)
    return F.struct(
        ordinal.cast("int").alias("ordinal"),
        F.when(kw == "JOIN", "join").otherwise("from").alias("clause"),
        name.alias("table_name"),
        F.lower(F.when(alias != "", alias).otherwise(F.substring_index(name, ".", -1))).alias("alias"),
    )


def from_part(segs: Column, names_table) -> Column:
    """The segments of a statement's FROM part whose text ``names_table`` accepts, in order."""
    return let(first_index(segs, ["FROM"], F.lit(1)), lambda start: let(
        first_index(segs, AFTER_FROM, start),
        lambda stop: F.filter(
            segs,
            lambda s, i: (start > 0) & (i + 1 >= start) & ((stop == 0) | (i + 1 < stop))
            & s["kw"].isin("FROM", "JOIN", ",") & names_table(s["txt"]),
        ),
    ))


def select_texts(segs: Column) -> Column:
    """Texts of the first select list, one per output column."""
    inside = let(first_index(segs, ["SELECT"], F.lit(1)), lambda start: let(
        first_index(segs, ["FROM", *AFTER_FROM], start),
        lambda stop: F.filter(
            segs, lambda s, i: (start > 0) & (i + 1 >= start) & ((stop == 0) | (i + 1 < stop))
        ),
    ))
    return F.transform(inside, lambda s: F.trim(F.regexp_replace(s["txt"], r"(?i)^(?:DISTINCT|ALL) ", "")))


NOT_ALIAS = r"(?!(?:END|NULL|ASC|DESC|TRUE|FALSE|FROM)$)"
NOT_AFTER = r"(?<!\b(?:OR|AND|NOT|LIKE|ILIKE|IN|IS|BETWEEN|THEN|ELSE|WHEN|CASE|DISTINCT|INTERVAL|AS))"


def split_alias(item: Column) -> Column:
    """Struct (expr, alias) of a select item; alias '' when there is none."""
    explicit = rf"(?i)^(.+) AS \"?({WORD})\"?$"
    implicit = rf"(?i)^(.*[\w)\]'\"\x05\x07]){NOT_AFTER} {NOT_ALIAS}({WORD})$"
    whole = lambda i: F.struct(i.alias("expr"), F.lit("").alias("alias"))
    parts = lambda i, pattern, other: let(F.regexp_extract(i, pattern, 2), lambda alias: F.when(
        alias != "", F.struct(F.trim(F.regexp_extract(i, pattern, 1)).alias("expr"), alias.alias("alias"))).otherwise(other))
    return let(item, lambda i: F.when(i.contains(" "), parts(i, explicit, parts(i, implicit, whole(i)))).otherwise(whole(i)))


def is_star(expr: Column) -> Column:
    return expr.contains("*") & expr.rlike(rf"^(?:{NAME}\.)?\*")


def is_column(expr: Column) -> Column:
    bare_words = [w.lower() for w in rules.EXPRESSION_KEYWORDS] + ["true", "false"]
    return expr.rlike(rf"^{NAME}$") & ~F.lower(expr).isin(bare_words)


def item_kind(expr: Column) -> Column:
    return F.when(is_star(expr), "star").when(is_column(expr), "column").otherwise("derived")


def output_name(expr: Column, alias: Column, position: Column) -> Column:
    """Name of an output column: alias, column name, short text without blanks and parentheses, or its position."""
    return (
        F.when(alias != "", alias)
        .when(is_star(expr), F.lit(None).cast("string"))
        .when(is_column(expr), F.substring_index(expr, ".", -1))
        .when(F.length(expr) < 50, F.translate(expr, " ()", "_"))
        .otherwise(F.concat(F.lit("column_"), position.cast("string")))
    )


def column_refs(expr: Column) -> Column:
    """Every ``qualifier.column`` and bare column of an expression: array of (qualifier, column_name).

    Words followed by a parenthesis are functions; type names of casts and paths into
    semi-structured values are dropped first.
    """
    casts = let(expr, lambda e: F.when(e.contains(" "), F.regexp_replace(e, rf"(?i)\bAS {WORD}(?:\s*\([^()]*\))?", "")).otherwise(e))
    plain = let(casts, lambda e: F.when(e.contains(":"), F.regexp_replace(e, rf"::?{WORD}(?:\.{WORD})*(?:\s*\([^()]*\))?", "")).otherwise(e))
    return named_refs(F.regexp_extract_all(plain, F.lit(rf"(?<![\w.$'])({NAME})(?![\w$.]|\s*\()"), F.lit(1)))


def named_refs(names: Column) -> Column:
    """References by their names, words of the language left out."""
    words = sorted(set(rules.EXPRESSION_KEYWORDS + rules.CLAUSE_WORDS))
    kept = F.filter(names, lambda n: ~F.lower(n).isin(words))
    return F.transform(kept, lambda n: let(F.substring_index(n, ".", -1), lambda last: F.struct(
        F.substring(n, F.lit(1), F.length(n) - F.length(last) - 1).alias("qualifier"), last.alias("column_name"))))


def expression_type(expr: Column) -> Column:
    """Root operator of an expression, lowest precedence first.

    Groups are emptied and CASE blocks folded, so only the outermost level is left
    to look at; the last operator of the lowest precedence is the root.
    """
    block = r"(?i)\bCASE\b(?:(?!\b(?:CASE|END)\b).)*+\bEND\b"
    folded = let(expr, lambda e: F.when(e.contains("("), F.regexp_replace(e, GROUP, "()")).otherwise(e))
    # A pass folds the innermost blocks, so there are no more passes than blocks.
    folded = let(folded, lambda f: F.when(f.rlike(r"(?i)\bCASE\b"), F.reduce(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(f, F.lit(r"(?i)\bCASE\b")))), f, lambda sofar, _: F.regexp_replace(sofar, block, "\u0002"))).otherwise(f))
    return let(F.trim(folded), root_type)


def root_type(folded: Column) -> Column:
    """Root operator of a folded expression."""
    function = F.upper(F.regexp_extract(folded, rf"^({WORD})\s*\(\)$", 1))
    known = F.create_map(*[F.lit(x) for pair in rules.FUNCTION_TYPES.items() for x in pair])
    last_term = F.regexp_extract(folded, r"([*/%])[^*/%]*$", 1)
    last_sum = F.regexp_extract(folded, r"[\w)'\u0002]\s*([+-])[^+-]*$", 1)
    named = F.when(folded.endswith("()"), F.nullif(F.try_element_at(known, function), F.lit("Anonymous")))
    return let(named, lambda type_: (
        F.when(folded == "\u0002", "Case")
        .when(type_.isNotNull(), type_)
        .when(folded.rlike(rf"^{WORD}\s*\(\)$"), "Anonymous")
        .when(folded.rlike(r"(?i)\bOR\b"), "Or")
        .when(folded.rlike(r"(?i)\bAND\b") & ~folded.rlike(r"(?i)\bBETWEEN\b"), "And")
        .when(folded.rlike(r"(?i)^NOT\b"), "Not")
        .when(folded.rlike(rf"(?i)^{WORD}\s*\(\)(?: (?:IGNORE|RESPECT) NULLS)? OVER\s*\(\)$"), "Window")
        .when(folded.rlike(r"(?i)[<>=]|\b(?:LIKE|ILIKE|IN|IS|BETWEEN)\b"), "Binary")
        .when(folded.rlike(r"\|\|"), "DPipe")
        .when(last_sum == "+", "Add")
        .when(last_sum == "-", "Sub")
        .when(last_term == "*", "Mul")
        .when(last_term == "/", "Div")
        .when(last_term == "%", "Mod")
        .when(folded.rlike(rf"::{WORD}(?:\(\))?$"), "Cast")
        .when(folded == "()", "Paren")
        .when(folded.rlike(r"^(?:''|-?\d+(?:\.\d+)?)$"), "Literal")
        .when(F.upper(folded) == "NULL", "Null")
        .when(F.upper(folded).isin("TRUE", "FALSE"), "Boolean")
        .when(F.upper(folded) == "CURRENT_TIMESTAMP", "CurrentTimestamp")
        .when(F.upper(folded) == "CURRENT_DATE", "CurrentDate")
        .when(folded.rlike(rf"^{NAME}$"), "Column")
        .otherwise("Anonymous")
    ))


#: Comments, strings and templates of program text, whichever begins first.
QUOTED_CODE = r"//[^\n]*|/\*(?s:.*?)\*/|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\(?s:.))*+`"


def mask_code(text: Column) -> Column:
    """``text`` of the same length, with blanks for the brackets inside comments, strings and templates."""
    brackets = "{}()[]<>"
    blank = F.transform(F.regexp_extract_all(text, F.lit(QUOTED_CODE), F.lit(0)), lambda q: F.translate(q, brackets, " " * len(brackets)))
    return F.array_join(F.zip_with(F.split(text, QUOTED_CODE), F.concat(blank, F.array(F.lit(""))), lambda piece, q: F.concat(piece, q)), "")
