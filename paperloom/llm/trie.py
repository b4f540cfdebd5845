"""Operator 12: the prefix trie of conversations, built family by family and merged.

A family is the conversations of one base id. One shuffle brings a family's turns together, as hashes and lengths; its
conversations are rebuilt there, and a pass over the depths, all members side by side, makes the family's small trie.
Only its nodes are shuffled for the global merge. What a node sums over its subtree is again gathered by family: each
global node counts once, at the family of its smallest member, and a pass from the deepest node up adds it to all nodes
above. No pass depends on the trie's height, and none holds more of a family than one level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, written
from .sharding import CRC_SQL, crc_sql

#: Conversations a family, and one more than the largest shared head.
FAMILY, HEADS = 5, 9
#: A node in more than 1/HOT of all family nodes is joined by broadcast: HOT nodes at most.
HOT = 2000
#: Ids of one block of a node's list of ends.
BLOCK = 1 << 16
ROOT = bytes(16)


def head_length(conv: Column) -> Column:
    """How many of its family's first turns a conversation begins with: unsigned crc32 of its decimal id, modulo HEADS."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt_turns(conversations: DataFrame, family: int = FAMILY, head: Column | None = None) -> DataFrame:
    """_base, depth, conv_id, _turn (16 bytes of hash), bytes, last: a row for each rebuilt turn, and one of depth 0 for each conversation.

    The first h turns come from the conversation of the base id, the others are the conversation's own after its first h.
    last marks the end of the rebuilt conversation. Partitions hold whole families.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("_turn"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    rows = rows.withColumn("_base", F.col("conv_id") - F.pmod("conv_id", F.lit(family).cast("bigint"))).repartition("_base")
    # both windows and the members' list use the shuffle by family
    own = Window.partitionBy("_base", "conv_id")
    rows = rows.withColumn("_h", head if head is not None else head_length(F.col("conv_id")))
    rows = rows.withColumn("_no", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "_turn"))).withColumn("_n", F.count(F.lit(1)).over(own))
    whole = Window.partitionBy("_base")
    rows = rows.withColumn("_m", F.coalesce(F.max(F.when(F.col("conv_id") == F.col("_base"), F.col("_n"))).over(whole), F.lit(0)))
    rows = rows.withColumn("_all", F.collect_set(F.when(F.col("_no") == 1, F.struct("conv_id", "_h", "_n"))).over(whole))
    # how much of the head there is, and where a member's rebuilt turns end
    head_of = lambda h: F.least(h.cast("bigint"), F.col("_m"))
    end_of = lambda h, n: head_of(h) + F.greatest(n - h, F.lit(0))
    as_row = lambda conv, depth, turn, size, end: F.struct(conv.alias("conv_id"), depth.cast("bigint").alias("depth"), turn.alias("_turn"), size.alias("bytes"), (depth == end).alias("last"))
    me, no, h = F.col("conv_id"), F.col("_no"), F.col("_h")
    start = F.when(no == 1, F.array(as_row(me, F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("bigint"), end_of(h, F.col("_n")))))
    # the head's turns go to every member that begins with them
    heads = F.when(
        (me == F.col("_base")) & (no < HEADS),
        F.transform(F.filter("_all", lambda x: x["_h"] >= no), lambda x: as_row(x["conv_id"], no, F.col("_turn"), F.col("bytes"), end_of(x["_h"], x["_n"]))),
    )
    mine = F.when(no > h, F.array(as_row(me, head_of(h) + no - h, F.col("_turn"), F.col("bytes"), end_of(h, F.col("_n")))))
    none = F.array().cast("array<struct<conv_id:bigint,depth:bigint,_turn:binary,bytes:bigint,last:boolean>>")
    made = rows.select("_base", F.explode(F.concat(*[F.coalesce(x, none) for x in (start, heads, mine)])).alias("_r"))
    return made.select("_base", "_r.depth", "_r.conv_id", "_r._turn", "_r.bytes", "_r.last")


NODES = "base long, depth long, node binary, parent binary, n_convs long, conv_id long, bytes long, ends array<long>"


def _types(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}
    return [(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")]


def _in_batches(rows, ddl: str, size: int = 8192):
    fields, made = _types(ddl), []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*made), fields)], names=[n for n, _ in fields])
    for row in rows:
        made.append(row)
        if len(made) == size:
            yield pack()
            made.clear()
    if made:
        yield pack()


def _family_nodes(batches):
    """Nodes of the small tries, from rows sorted by (_base, depth, conv_id); a node is known by the hash of its path."""
    base, depth, level, paths = None, -1, {}, {}
    for batch in batches:
        for b, d, conv, turn, size, last in zip(*(c.to_pylist() for c in batch.columns)):
            if b != base or d != depth:
                yield from ((base, depth, node, *entry) for node, entry in level.items())
                if b != base:
                    paths = {}
                base, depth, level = b, d, {}
            parent = paths.get(conv, b"")
            node = hashlib.blake2b(parent + turn, digest_size=16).digest() if d else ROOT
            paths[conv] = node
            if node in level:
                entry = level[node]
                entry[1] += 1
            else:
                # members come in order, so the first is the smallest
                entry = level[node] = [parent, 1, conv, size, []]
            if last:
                entry[4].append(conv)
                del paths[conv]
    yield from ((base, depth, node, *entry) for node, entry in level.items())


def family_nodes(rebuilt: DataFrame) -> DataFrame:
    """The nodes of every family's trie: NODES."""
    rows = rebuilt.sortWithinPartitions("_base", "depth", "conv_id")
    return map_arrow(rows, lambda batches: _in_batches(_family_nodes(batches), NODES), NODES)


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """node, depth, n_convs, conv_id, bytes, n_children, _families of the global trie, from family nodes."""
    sums = [F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("_families")]
    every = written(nodes.groupBy("node").agg(*sums))
    children = every.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_children"))
    return written(every.drop("parent").join(children, "node", "left").withColumn("n_children", F.coalesce("_children", F.lit(0)).cast("bigint")).drop("_children"))


def _with_merged(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Family nodes with the global node's members, children and smallest member; very frequent nodes are joined by broadcast."""
    own = nodes.select("base", "depth", "node", "parent", F.col("conv_id").alias("_own"))
    facts = merged.select("node", "conv_id", "n_convs", "bytes", "n_children", "_families")
    least = max(1, (merged.agg(F.sum("_families")).first()[0] or 0) // HOT)
    hot, rest = F.broadcast(facts.where(F.col("_families") > least).drop("_families")), facts.where(F.col("_families") <= least).drop("_families")
    return own.join(hot, "node").unionByName(own.join(hot.select("node"), "node", "left_anti").join(rest, "node"))


SUMS = "node binary, parent_conv_id long, leaves long, saved long"


def _family_sums(batches):
    """What each family adds to its nodes' subtree sums, from rows sorted by base and from the deepest nodes up.

    A row waits for its parent, which is one level above: no more rows wait than a level has.
    """
    below, waiting = {}, {}
    for batch in batches:
        for node, parent, own, conv, n, size, children in zip(*(c.to_pylist() for c in batch.columns)):
            leaves, saved = below.pop(node, (0, 0))
            # a global node counts at the family of its smallest member
            if own == conv:
                leaves, saved = leaves + (children == 0), saved + (n - 1) * size
            for child in waiting.pop(node, ()):
                yield child[0], conv, child[1], child[2]
            if node == ROOT:
                yield node, None, leaves, saved
                continue
            at = below.get(parent, (0, 0))
            below[parent] = at[0] + leaves, at[1] + saved
            waiting.setdefault(parent, []).append((node, leaves, saved))


def subtree_sums(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """node, parent_conv_id, n_leaves, saved_tokens of the global trie."""
    rows = _with_merged(nodes, merged).repartition("base").sortWithinPartitions("base", F.col("depth").desc())
    rows = rows.select("node", "parent", "_own", "conv_id", "n_convs", "bytes", "n_children")
    partial = map_arrow(rows, lambda batches: _in_batches(_family_sums(batches), SUMS), SUMS)
    return partial.groupBy("node").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _digests(batches):
    node, state = None, None
    for batch in batches:
        for one, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if one != node:
                if state:
                    yield node, state.hexdigest()
                node, state = one, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state:
        yield node, state.hexdigest()


def end_digests(nodes: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes at which conversations end: of their ids, ascending, comma-joined.

    Ids are gathered in blocks of BLOCK consecutive numbers; a node's blocks then pass as a stream, in order.
    """
    ends = nodes.select("node", F.explode("ends").alias("_end"))
    blocks = ends.groupBy("node", F.shiftright("_end", BLOCK.bit_length() - 1).alias("_block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_end")), lambda x: x.cast("string")), ",").alias("_ids"))
    rows = blocks.repartition("node").sortWithinPartitions("node", "_block").select("node", "_ids")
    ddl = "node binary, ends_sha256 string"
    return map_arrow(rows, lambda batches: _in_batches(_digests(batches), ddl), ddl)


def prefix_trie(conversations: DataFrame, family: int = FAMILY, head: Column | None = None) -> DataFrame:
    """The prefix trie of the rebuilt conversations (conv_id, turn, role, text), a row for each node.

    node (16 bytes that name it: zeros for the root), conv_id (smallest member), depth, parent_conv_id (of the root
    null), n_convs, n_children, n_leaves, saved_tokens (over the subtree, UTF-8 bytes of the last text of each node for
    every member but one) and ends_sha256. family: conversations of one base id; head: how many first turns a
    conversation takes from the base's (a column over conv_id, under HEADS).

    Nulls: rows without conv_id belong to no conversation and are left out; null turns come first; a null role or text is
    empty. Turns of one number are ordered by a hash of role and text, repeated rows stay as turns of their own. A
    conversation whose rebuilt form has no turn is a member of the root. Texts of any length are hashed where they are
    read (128 bits tell turns, and paths, apart) and never shuffled; a conversation of any length passes as a stream.
    Extra columns are ignored. An empty table has no node, not even the root.
    """
    nodes = written(family_nodes(rebuilt_turns(conversations, family, head)))
    merged = merged_nodes(nodes)
    sums, ends = written(subtree_sums(nodes, merged)), written(end_digests(nodes))
    out = merged.join(sums, "node").join(ends, "node", "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on its family's first turns."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")).drop("node")


OP12_SQL = f"""
WITH {CRC_SQL},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
parts AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth, md5(role || chr(1) || text) AS one, strlen(text) AS bytes FROM parts),
path AS (SELECT conv_id, depth, string_agg(one, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS node, bytes FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
parent AS (SELECT a.*, b.node AS parent, a.depth = max(a.depth) OVER (PARTITION BY a.conv_id) AS last FROM path a LEFT JOIN path b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
n AS (SELECT node, depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM parent GROUP BY 1, 2),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.parent = n.node AND m.depth = n.depth + 1) AS n_children FROM n),
sums AS (SELECT up.node, sum((k.n_convs - 1) * k.bytes) AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM k JOIN path up ON up.conv_id = k.conv_id AND up.depth <= k.depth GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN sums USING (node) LEFT JOIN n up ON up.node = k.parent AND up.depth = k.depth - 1
"""
