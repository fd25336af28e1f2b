"""A Merkle manifest of a data set: content-addressed records, and proofs found by descent from the root.

A row's leaf is the digest of its length-prefixed fields. The leaves of a language, in id order, are joined in
runs of ``WIDTH`` to nodes, these again, until one is left, its subroot; the subroots, in the order of their
languages, are joined likewise to the root. The manifest stores a record for each node made: its digest and
its children's.

A proof is asked for by a leaf's place, whose digits to the base ``WIDTH`` are the way down. Requests for the same
node travel as one row: at each level that row meets the record of its digest, takes the children that
the requests want, and hands each the children it did not take, to the left and to the right, as a path
segment. Below the last node each request has its path; reversed, it leads from the leaf to the root.

Everything is joined and grouped by place or digest, in groups of at most ``WIDTH``, so neither a hot
language nor the root is a hot key: leaves are sorted by range, numbered inside the ranges, and the ranges'
counts carried forward. Each level is written to the shared folder.

Defined cases: null fields are ``-``; a null language is one of its own, before the others; null ids come first
in theirs; rows with equal ids are ordered by leaf, and equal rows in any order, as they have one digest; a row
with a null id is never tampered with; a lone leaf is its subroot, and a lone subroot the root, with an empty proof;
an empty table gives no rows; all columns but the five fields are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.base import LOWER, UPPER, table
from tracewell.sources.storage import written

#: Fixed values of the contract: children of a node, fields of a leaf, and how often ids are tampered with.
WIDTH, FIELDS, TAMPERED_EVERY = 8, ["doc_id", "source", "lang", "n_chars", "text"], 3
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """Digest of a row's fields, with ``text`` in place of its own."""
    return digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def leaves_of(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: tree, doc_id, leaf, and ``changed``, the leaf after tampering, null where there is none."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("tree"), "doc_id", leaf_of(F.col("text")).alias("leaf"),
        F.when(tampered, leaf_of(F.translate("text", UPPER, LOWER))).alias("changed"), F.monotonically_increasing_id().alias("row"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (written) with ``rank``, their place from 0 in their tree, and ``left``, the rows of the tree."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    own, tree = Window.partitionBy("tree").orderBy("part"), Window.partitionBy("tree")
    before = placed.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", "tree", (F.sum("rows").over(own) - F.col("rows")).alias("before"), F.sum("rows").over(tree).alias("left"))
    inside = Window.partitionBy("part", "tree").orderBy(*order)
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1).join(before, ["part", "tree"])
    return numbered.select(*rows.columns, (F.col("before") + F.col("number")).alias("rank"), "left")


def levels_above(nodes: DataFrame) -> list[DataFrame]:
    """The records of each level above ``nodes`` (tree, rank, digest, left), the lowest level first.

    A record has its node's tree, rank, digest and ``left``, the number of nodes of the tree on its level, and
    ``children``, the digests below it. A tree ends on the level where one is left.
    """
    levels, most = [], nodes.agg(F.max("left")).first()[0] or 0
    while most > 1:
        runs = nodes.where("left > 1").groupBy("tree", F.expr(f"rank div {WIDTH}").alias("run"), "left").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda n: n["digest"]).alias("children"))
        above = runs.select(
            "tree", F.col("run").alias("rank"), digest(F.array_join("children", "")).alias("digest"),
            F.expr(f"(left + {WIDTH - 1}) div {WIDTH}").alias("left"), "children")
        nodes, most = written(above, "merkle-records"), -(-most // WIDTH)
        levels.append(nodes)
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node of each tree: tree, digest, height (0 where it is the tree's lone leaf)."""
    named = [leaves.select("tree", "digest", "left"), *[n.select("tree", "digest", "left") for n in levels]]
    return reduce(DataFrame.unionByName, [n.where("left = 1").select("tree", "digest", F.lit(h).alias("height")) for h, n in enumerate(named)])


def by_parent(wanted: DataFrame) -> DataFrame:
    """Requests for nodes (tree, rank, ..) as one row per parent: tree, rank, and ``asked``, the digits with what else is asked."""
    rest = [c for c in wanted.columns if c not in ("tree", "rank")]
    return wanted.groupBy("tree", F.expr(f"rank div {WIDTH}").alias("above")).agg(
        F.collect_list(F.struct((F.col("rank") % WIDTH).cast("int").alias("digit"), *rest)).alias("asked")
    ).withColumnRenamed("above", "rank")


def one_down(travelling: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    """``travelling`` (tree, rank, digest, path, root, subroot) one level lower, one row per child asked for in ``requests``.

    Nodes are found by their digest alone; equal nodes have one record. What else a request carries stays with it.
    """
    store = records.groupBy("digest").agg(F.first("children").alias("children"))
    met = travelling.join(requests, ["tree", "rank"]).join(store, "digest")
    asked = met.select("tree", "rank", "path", "root", "subroot", "children", F.explode("asked").alias("to"))
    left, right = F.expr("slice(children, 1, to.digit)"), F.expr("slice(children, to.digit + 2, size(children))")
    segment = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
    carried = [f for f in requests.schema["asked"].dataType.elementType.fieldNames() if f != "digit"]
    return asked.select(
        "tree", (F.col("rank") * WIDTH + F.col("to.digit")).alias("rank"), F.expr("children[to.digit]").alias("digest"),
        F.concat("path", F.array(segment)).alias("path"), "root", "subroot", *[F.col(f"to.{f}").alias(f) for f in carried])


def descended(starts: DataFrame, levels: list[DataFrame], requests: DataFrame) -> DataFrame:
    """``requests`` (tree, rank, ..), each with the digest it asked for, its path from the root on, root and subroot.

    ``starts`` are the tops of the trees (tree, digest, height, path, root, subroot). Trees of less height wait for their level.
    """
    asked = [requests]
    for _ in levels:
        asked.append(by_parent(asked[-1] if len(asked) == 1 else asked[-1].select("tree", "rank")))
    begin = lambda h: starts.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", "root", "subroot")
    travelling = begin(len(levels))
    for height in range(len(levels), 0, -1):
        lower = one_down(travelling, levels[height - 1], asked[height])
        if height > 1:
            travelling = written(lower.unionByName(begin(height - 1)), "merkle-descent")
    lone = begin(0).join(requests, ["tree", "rank"])
    return lower.unionByName(lone) if levels else lone


def manifest(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """Leaves (tree, rank, digest, doc_id, changed) with the levels of their trees, and subroots with the levels above them."""
    found = written(leaves_of(docs), "merkle-leaves")
    leaves = written(ranked(found, "doc_id", "leaf", "row").withColumnRenamed("leaf", "digest").drop("row"), "merkle-ranked")
    levels = levels_above(leaves.select("tree", "rank", "digest", "left"))
    subroots = written(tops(leaves, levels).withColumnRenamed("tree", "language").withColumn("tree", F.lit("")), "merkle-subroots")
    subroots = written(ranked(subroots, "language"), "merkle-languages")
    return leaves, levels, subroots, levels_above(subroots.select("tree", "rank", "digest", "left"))


def proofs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (the fields): doc_id, leaf, changed, subroot, root and path (left and right digests, leaf first)."""
    leaves, levels, subroots, upper = manifest(docs)
    root = tops(subroots, upper).select(
        "tree", "digest", "height", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    asked = subroots.select("tree", "rank", F.col("language"), F.col("height").alias("own_height"))
    starts = written(descended(root, upper, asked).select(
        F.col("language").alias("tree"), "digest", F.col("own_height").alias("height"), "path", "root", F.col("digest").alias("subroot")), "merkle-starts")
    found = descended(starts, levels, leaves.select("tree", "rank", "doc_id", "changed"))
    return found.select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "root", F.reverse("path").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda below, s: digest(s["left"], below, s["right"]))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proofs(table(spark, sf_dir, "documents").select(*FIELDS))
    siblings = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    told = found.select(
        "doc_id", "leaf", "subroot", "root", digest(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE codes AS (
    SELECT list(code ORDER BY first) AS code FROM (
        SELECT i.range AS first, list_reduce([i.range::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS code
        FROM range(256) i)
), fields AS (
    SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                           lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
    FROM documents, codes
), leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(text) || ':' || CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed
    FROM fields
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS row
    FROM leaves
), nodes(lang, height, rank, digest, n) AS (
    SELECT lang, 0, rank, leaf, n FROM numbered
    UNION ALL
    SELECT lang, height + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, height, rank // 8, n
), subroots AS (
    SELECT lang, height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper(height, rank, digest, n) AS (
    SELECT 0, rank, digest, n FROM subroots
    UNION ALL
    SELECT height + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY height, rank // 8, n
), runs AS (
    SELECT lang, height, rank // 8 AS run, list(digest ORDER BY rank) AS digests FROM nodes WHERE n > 1 GROUP BY ALL
), upper_runs AS (
    SELECT height, rank // 8 AS run, list(digest ORDER BY rank) AS digests FROM upper WHERE n > 1 GROUP BY ALL
), climbed(row, lang, height, rank, folded, siblings) AS (
    SELECT row, lang, 0, rank, changed, '' FROM numbered
    UNION ALL
    SELECT c.row, c.lang, c.height + 1, c.rank // 8,
           sha256(array_to_string(list_concat(digests[:c.rank % 8], [folded], digests[c.rank % 8 + 2:]), '')),
           siblings || array_to_string(list_concat(digests[:c.rank % 8], digests[c.rank % 8 + 2:]), '')
    FROM climbed c JOIN runs r ON c.lang IS NOT DISTINCT FROM r.lang AND c.height = r.height AND c.rank // 8 = r.run
), in_upper(row, height, rank, folded, siblings) AS (
    SELECT c.row, 0, s.rank, c.folded, c.siblings FROM climbed c JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang AND c.height = s.height
    UNION ALL
    SELECT c.row, c.height + 1, c.rank // 8,
           sha256(array_to_string(list_concat(digests[:c.rank % 8], [folded], digests[c.rank % 8 + 2:]), '')),
           siblings || array_to_string(list_concat(digests[:c.rank % 8], digests[c.rank % 8 + 2:]), '')
    FROM in_upper c JOIN upper_runs r ON c.height = r.height AND c.rank // 8 = r.run
), ended AS (
    SELECT row, arg_max(folded, height) AS folded, arg_max(siblings, height) AS siblings FROM in_upper GROUP BY row
), top AS (
    SELECT digest AS root FROM upper WHERE n = 1
)
SELECT d.doc_id, d.leaf, s.digest AS subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM numbered d JOIN ended e USING (row) JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang, top
"""
