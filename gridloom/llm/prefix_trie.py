"""Prefix trie of conversations: which openings they share, and what sharing them saves.

1. Turns get dense names, equal ones the same. Blocks of 2, 4, 8 ... turns at multiples of their length are named from the
   names of their halves, one round for each doubling.
2. Going down again, a prefix of d turns is the prefix without its smallest block and that block, as the binary digits of d
   say; it is named from those two names, one round for each doubling. Rounds grow with the logarithm of the longest
   conversation, and all rounds together handle each turn a few times.
3. Prefixes of one depth and name are one node. What a node needs of its subtree are sums over its members: a node below
   it is counted with the smallest conversation that holds it, so no node is sent to its ancestors and no path is walked.

A name that many turns or pairs have is joined by salts, a conversation of any length is numbered and summed in parts, and
ids that end at one node are joined in parts before they are digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, joined, lean, materialise, numbered, small_batches, table
from gridloom.llm.importance import CRC_TABLE, crc32_sql

#: Turns of one conversation that are summed together; ids that are joined to one string.
PART, IDS = 4096, 4096


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key, size) of every turn: its place from 0, a digest of role and text, and its text's UTF-8 bytes.

    Turns are ordered by turn, null first, equal ones by digest. Null roles and texts are empty; rows without a
    conversation are left out. A written table.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 32))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = materialise(rows.where("conv IS NOT NULL").withColumn("_tie", F.monotonically_increasing_id()))
    placed = numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("key"), F.col("_tie")], "pos")
    out = materialise(placed.select("conv", "pos", "key", "size"))
    for done in (rows, placed):
        discard(done)
    return out


def named(rows: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """The written table rows with `name`, a number from 0 for each distinct value of the keys, which leave."""
    spark = rows.sparkSession
    known = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.monotonically_increasing_id()))
    before, total = [], 0
    for task, n in known.groupBy(F.shiftright("_at", 33).alias("task")).count().orderBy("task").collect():  # a row per task
        before.append((task, total))
        total += n
    first = spark.createDataFrame(before or [(0, 0)], "_task long, _first long")
    dense = known.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(first), "_task").withColumn("name", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1))
    out = materialise(joined(rows, dense.select(*keys, "_n", "name"), keys, "_n", F.col(spread)).drop(*keys))
    discard(known)
    return out


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv, depth, name) for each turn: prefixes of one depth have one name if and only if they are equal. A written table."""
    blocks = [named(materialise(turns.select("conv", F.col("pos").alias("at"), "key")), ["key"], "conv")]
    while blocks[-1].where("at > 0").limit(1).count():
        half = blocks[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"))
        pairs = materialise(half.where("b IS NOT NULL"))
        blocks.append(named(pairs, ["a", "b"], "conv"))
        discard(pairs)
    # prefixes of m blocks: of the largest blocks no conversation has more than one
    prefixes = blocks[-1].select("conv", (F.col("at") + 1).alias("m"), "name")
    for block in blocks[-2::-1]:
        even = prefixes.select("conv", (F.col("m") * 2).alias("m"), "name")
        last = block.where("at % 2 = 0").select("conv", F.col("at").alias("before"), F.col("name").alias("b"))
        start = last.where("before = 0").select("conv", F.lit(1).cast("long").alias("m"), F.col("b").alias("name"))
        pairs = materialise(even.withColumnsRenamed({"m": "before", "name": "a"}).join(last, ["conv", "before"]).select("conv", (F.col("before") + 1).alias("m"), "a", "b"))
        odd = named(pairs, ["a", "b"], "conv").select("conv", "m", "name")
        following = materialise(even.unionByName(start).unionByName(odd))
        for done in (pairs, prefixes):
            discard(done)
        prefixes = following
    out = materialise(prefixes.select("conv", F.col("m").alias("depth"), "name"))
    for block in blocks:
        discard(block)
    return out


def _ends(members: DataFrame) -> DataFrame:
    """(depth, name, ends) for nodes that conversations end at: the SHA-256 of their ids, rising, joined by commas. Ids of
    a node are joined IDS at a time, wherever they are, and the strings digested as they stream by."""
    spark = members.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, node, ids = [], None, []
            for depth, name, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, name) != node or len(ids) == IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (depth, name), []
                ids.append(conv)
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "name", "first", "ids"), r, strict=True)) for r in out], pa.schema([("depth", pa.int64()), ("name", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        schema = pa.schema([("depth", pa.int64()), ("name", pa.int64()), ("ends", pa.string())])
        for b in batches:
            out = []
            for depth, name, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, name) != node:
                    if node:
                        out.append({"depth": node[0], "name": node[1], "ends": state.hexdigest()})
                    node, state = (depth, name), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if node:
            yield pa.RecordBatch.from_pylist([{"depth": node[0], "name": node[1], "ends": state.hexdigest()}], schema)

    order = ["depth", "name", "conv"]
    parts = members.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lean(strings), "depth long, name long, first long, ids string")
    return parts.repartition(n, "depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(lean(digests), "depth long, name long, ends string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, from the empty one.

    turns is (conv, pos, key, size), a written table with places from 0 without gaps, as turns_of() gives; conversations
    is (conv), each once, those without turns included. Gives conv_id (the smallest member: a conversation that begins
    with the prefix), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens ((members - 1) x bytes of the last text, summed over the subtree) and ends_sha256 (of the ids
    that end here). No conversation gives no rows.
    """
    lengths = conversations.join(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")), "conv", "left").select("conv", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    lengths = materialise(lengths.withColumn("_n", F.col("length")))
    names = prefix_names(turns)
    rows = turns.select("conv", (F.col("pos") + 1).alias("depth"), "size").join(names, ["conv", "depth"])
    rows = joined(rows, lengths, ["conv"], "_n", F.col("depth"))
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("name"), "length")
    rows = materialise(rows.select(root.columns).unionByName(root))
    nodes = materialise(rows.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("deepest")))

    # which turns stand for their node, and which of these are leaves
    own = nodes.select("conv", "depth", F.lit(True).alias("own"), (F.col("depth") == F.col("deepest")).alias("leaf"))
    above = own.select("conv", (F.col("depth") - 1).alias("depth"), F.lit(True).alias("child"))
    flagged = rows.join(own, ["conv", "depth"], "left").join(above, ["conv", "depth"], "left")
    flagged = flagged.withColumns({"saved": F.when(F.col("own"), 0).otherwise(F.col("size")), "part": F.floor(F.col("depth") / PART).cast("long")})
    flagged = materialise(flagged.select("conv", "depth", "name", "length", "part", "saved", F.col("child").isNotNull().cast("long").alias("child"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")))
    # what a conversation saves from a depth on, and whether it stands for a leaf: sums within parts, and over those after
    down = Window.partitionBy("conv", "part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = flagged.groupBy("conv", "part").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    sums = sums.select("conv", "part", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in "sl"))
    summed = flagged.withColumns({"s": F.sum("saved").over(down), "l": F.sum("leaf").over(down)}).join(sums, ["conv", "part"])
    totals = summed.groupBy("depth", "name").agg(F.sum("child").alias("n_children"), F.sum(F.col("l") + F.col("later_l")).alias("n_leaves"), F.sum(F.col("s") + F.col("later_s")).alias("saved_tokens"))
    ends = _ends(flagged.where("depth = length"))

    # the parent is the node of the representative's prefix that is one turn shorter
    top = (nodes.where("depth = 0").first() or [None] * 3)[2]  # one row at most
    lifted = materialise(nodes.where("depth > 1").select("conv", (F.col("depth") - 1).alias("depth")).join(names, ["conv", "depth"]))
    sizes = materialise(nodes.join(lifted.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("_n")), ["depth", "name"]).select("depth", "name", F.col("conv").alias("parent"), "_n"))
    parents = joined(lifted, sizes, ["depth", "name"], "_n", F.col("conv")).select("conv", (F.col("depth") + 1).alias("depth"), "parent")
    out = nodes.join(totals, ["depth", "name"]).join(ends, ["depth", "name"], "left").join(parents, ["conv", "depth"], "left")
    none = hashlib.sha256().hexdigest()
    out = materialise(
        out.select(
            F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(top).cast("long")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
        )
    )
    for done in (lengths, names, rows, nodes, flagged, lifted, sizes):
        discard(done)
    return out


def regrafted(turns: DataFrame, of: int = 5, modulo: int = 9) -> DataFrame:
    """turns with each conversation c begun anew: the first h turns of conversation c - c % of (all, if it has fewer, none
    if it isn't there), then c's own after its first h; h = crc32(decimal c) % modulo. A written table; a conversation may
    be left without turns."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")).withColumns({"h": F.crc32(F.col("conv").cast("string")) % modulo, "base": F.col("conv") - F.col("conv") % of})
    convs = materialise(convs)
    base = convs.select(F.col("conv").alias("base"), F.col("length").alias("given"))
    cut = materialise(convs.join(base, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"), F.col("length").alias("_n")))
    heads = turns.where(F.col("pos") < modulo).withColumnRenamed("conv", "base").join(cut.drop("_n"), "base").where("pos < taken").select(turns.columns)
    tails = joined(turns, cut, ["conv"], "_n", F.col("pos")).where("pos >= h").withColumn("pos", F.expr("pos - h + taken")).select(turns.columns)
    out = materialise(heads.unionByName(tails))
    for done in (convs, cut):
        discard(done)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return trie(regrafted(turns), turns.select("conv").distinct())


_NAMED = "sha256(concat(octet_length(encode(role)), ':', role, text))"
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
clean AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, {_NAMED}) AS p, {{'r': role, 't': text}} AS turn FROM clean),
own AS (SELECT c, c - c % 5 AS base, list(turn ORDER BY p) AS turns FROM t GROUP BY c),
head AS (SELECT *, {crc32_sql('CAST(c AS VARCHAR)', 'k')} % 9 AS h FROM own, crc),
re AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM head a LEFT JOIN own b ON b.c = a.base),
pre AS MATERIALIZED (SELECT c, d, turns[1:d] AS p, len(turns) AS l, CASE WHEN d > 0 THEN octet_length(encode(turns[d].t)) ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM re)),
nodes AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n, max(size) AS size, max(l) = d AS leaf, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE l = d), '') AS ends FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
up AS (SELECT a.d, a.p, sum(CASE WHEN b.leaf THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes) b JOIN nodes a ON a.d = b.k AND a.p = b.p[1:b.k] GROUP BY a.d, a.p)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN up ON up.d = x.d AND up.p = x.p LEFT JOIN kids ON kids.d = x.d AND kids.p = x.p LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]
"""
}
