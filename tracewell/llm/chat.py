r"""Chat formatting with a grammar round trip. DataFrame functions only.

Grammar::

    conversation := turn*
    turn         := "### " role level ": " body "</turn>" newline
    level        := "" | "~" | "~~"

A body never holds a control string (``###`` or ``</turn>``), so the parser needs no state: it
cuts at the turn ends, the header ends at its first ``": "``, and the level says how to read the
body. Rendering starts raw. The parser reads the rendered turn back; where role or text differ from
the source or the body is refused, the next level is tried: level 1 breaks control strings up with
``\e``, level 2 also writes each backslash as ``\s``. Level 2 is reversible for every text, as
each backslash is then the start of one of our own marks.

The loss mask is a list of spans (code points, end exclusive) of the assistants' bodies.

A conversation is one string, so its turns meet in one row: that is the product. All work on texts
is done per turn before.

Defined cases: null text or role is empty; turns are ordered by number, null first, then role and
text; repeated rows are turns of their own; rows without conversation id form one conversation;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.base import table

TURN, END = "###", "</turn>"
LEVELS = 3
#: Our marks: a broken control string, a backslash, and in roles a colon and a tilde.
BREAK, BACKSLASH, COLON, TILDE = "\\e", "\\s", "\\c", "\\t"
#: The turns that the contract adds: the template's own marks as text.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def swap(column: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def broken(text: Column) -> Column:
    """No pair of marks' first characters stays together, so no control string does."""
    return swap(text, [("##", f"#{BREAK}#"), ("</", f"<{BREAK}/")])


def escape(text: Column, level: int) -> Column:
    return [text, broken(text), broken(swap(text, [("\\", BACKSLASH)]))][level]


def unescape(body: Column, level: Column) -> Column:
    unbroken = swap(body, [(BREAK, "")])
    return F.when(level == 0, body).when(level == 1, unbroken).otherwise(swap(unbroken, [(BACKSLASH, "\\")]))


def escape_role(role: Column) -> Column:
    return broken(swap(role, [("\\", BACKSLASH), (":", COLON), ("~", TILDE)]))


def unescape_role(role: Column) -> Column:
    return swap(role, [(BREAK, ""), (COLON, ":"), (TILDE, "~"), (BACKSLASH, "\\")])


def header(role: Column, level: int) -> Column:
    return F.concat(F.lit(f"{TURN} "), escape_role(role), F.lit("~" * level + ": "))


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation; text null where the body is refused."""
    pieces = F.split(formatted, f"{END}\n", -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ": ", 1)
        body = F.substr(piece, F.char_length(head) + 3)
        role = F.rtrim(F.substr(head, F.lit(len(TURN) + 2)), F.lit("~"))
        level = F.char_length(head) - F.char_length(role) - len(TURN) - 1
        refused = ~F.startswith(piece, F.lit(f"{TURN} ")) | F.contains(body, F.lit(TURN)) | F.contains(body, F.lit(END))
        return F.struct(unescape_role(role).alias("role"), F.when(~refused, unescape(body, level)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def render(role: Column, text: Column) -> Column:
    """The turn at the first level at which the parser gives the source back: head and body."""
    tries = [F.struct(header(role, n).alias("head"), escape(text, n).alias("body")) for n in range(LEVELS)]
    same = [parse(F.concat(t["head"], t["body"], F.lit(f"{END}\n"))).eqNullSafe(F.array(F.struct(role.alias("role"), text.alias("text")))) for t in tries[:-1]]
    return F.when(same[0], tries[0]).when(same[1], tries[1]).otherwise(tries[2])


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): ``source`` turns, the
    ``formatted`` string and ``loss_mask`` spans."""
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    drawn = turns.withColumn("drawn", render(F.col("role"), F.col("text")))
    whole = F.concat("drawn.head", "drawn.body", F.lit(f"{END}\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.select("conv_id", "turn", "role", "text", whole.alias("whole"), F.char_length("drawn.head").alias("head"), F.char_length("drawn.body").alias("body"))
    placed = placed.withColumn("upto", F.sum(F.char_length("whole")).over(order)).withColumn("place", F.row_number().over(order))
    begin = F.col("upto") - F.char_length("whole") + F.col("head")
    kept = placed.select("conv_id", F.struct(
        "place", "role", "text", "whole", begin.alias("start"), (begin + F.col("body")).alias("end")).alias("t"))
    grouped = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), spans.alias("loss_mask"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask; each body's level stands in its header, just before it."""
    def text(span: Column) -> Column:
        before = F.substr(formatted, (span["start"] - 3).cast("int"), F.lit(4))
        level = F.char_length(before) - F.char_length(F.replace(before, F.lit("~"), F.lit("")))
        return unescape(F.substr(formatted, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")), level)

    return F.array_join(F.transform(mask, text), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"))
    done = format_conversations(rows.unionByName(added))
    read = done.select(
        "conv_id", "formatted", "source", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), (F.col("turns") == F.col("source")).alias("same"))


OP6_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS added(n, r)
), bodies AS (
    SELECT *, contains(text, '###') OR contains(text, '</turn>') AS marked, contains(text, '\e') AS clash FROM turns
), drawn AS (
    SELECT *, CASE WHEN NOT marked THEN 0 WHEN NOT clash THEN 1 ELSE 2 END AS level,
           CASE WHEN NOT marked THEN text
                ELSE replace(replace(CASE WHEN clash THEN replace(text, '\', '\s') ELSE text END, '##', '#\e#'), '</', '<\e/') END AS body,
           replace(replace(replace(replace(replace(role, '\', '\s'), ':', '\c'), '~', '\t'), '##', '#\e#'), '</', '<\e/') AS name
    FROM bodies
), joined AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length(name) + level + length(body) + 14) AS formatted_chars
    FROM drawn GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, true AS same
FROM joined
"""
