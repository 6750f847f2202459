"""A prefix trie of conversations, built level by level.

At each depth the live conversations are grouped by (parent node, next turn)
and the group's smallest id names the new node; then they move to it. A
conversation that is alone in its node shares nothing below it: the rest of
its turns is a chain of nodes of its own, known from its length, so it is no
longer live. Once nobody is live, joins from the deepest level up add leaves
and savings to parents.

Turns are compared by SHA-256. No step holds a conversation, a node or its
members in one task: positions come from a range-partitioned sort, hot turns
are pre-aggregated and joined back with skew handling, long lists of ids are
hashed from packed pieces in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import drop, materialize

#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that one packed piece holds, and nodes of a chain that one row becomes.
PIECE = 8_192
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, d, key, words): each turn at its place from 1, by ``turn`` (null first), ties by the hash of role and text.

    Null role or text counts as empty; rows without a conversation are left out,
    repeated rows stay. A conversation of any length may be split over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    by = ("conv_id", F.col("turn").asc_nulls_first(), "key")
    turns = turns.filter("conv_id is not null").repartitionByRange(*by).sortWithinPartitions(*by)
    turns = materialize(turns.select("conv_id", "key", "words", F.monotonically_increasing_id().alias("at")), "trie-sorted")
    turns = turns.withColumn("task", F.shiftright("at", 33))
    # a conversation's rows in one task are neighbours; tasks hold ranges in order
    parts = turns.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "task", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return turns.join(parts, ["conv_id", "task"]).select("conv_id", (F.col("at") + F.col("shift")).alias("d"), "key", "words")


def own_from(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("long")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and turns (conv_id, d, key, words) as rebuilt.

    The first h turns come from conversation c - c % 20 (all it has, if fewer;
    none, if it is absent), then c's own follow after its first h.
    """
    of_base = lambda c: c - c % 20
    c = F.col("conv_id")
    heads = turns.filter((F.col("d") <= 3) & (of_base(c) == c)).withColumnRenamed("conv_id", "base")
    given = heads.groupBy("base").agg(F.max("d").alias("given"))
    convs = turns.groupBy("conv_id").agg(F.max("d").alias("own")).withColumn("h", own_from(c)).withColumn("base", of_base(c))
    taken = F.least(F.col("h"), F.coalesce("given", F.lit(0)))
    convs = convs.join(given, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs, "trie-conversations")
    first = convs.filter("taken > 0").join(heads, "base").filter("d <= taken").select("conv_id", "d", "key", "words")
    rest = turns.filter(F.col("d") > own_from(c)).join(convs.select("conv_id", "h", "taken"), "conv_id").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "key", "words")
    # files hold ranges of depths, so that a level reads its own
    both = first.unionByName(rest).repartitionByRange("d", "conv_id").sortWithinPartitions("d", "conv_id")
    return convs.select("conv_id", "length"), materialize(both, "trie-turns")


def _pack(batches):
    """Sorted ids of a node, comma-joined in pieces."""
    for batch in batches:
        depth, node, conv = (np.asarray(x, np.int64) for x in batch.columns)
        if not len(conv):
            continue
        new = np.r_[True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(conv)]
        cuts = [(i, min(i + PIECE, e)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for i in range(s, e, PIECE)]
        at = [i for i, _ in cuts]
        packed = [",".join(map(str, conv[i:j].tolist())) for i, j in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(depth[at]), pa.array(node[at]), pa.array(conv[at]), pa.array(packed, pa.string())], names=["depth", "conv_id", "first", "packed"])


def _digest(batches):
    """The SHA-256 of each node's pieces, in order; one state at a time."""
    now, state = None, None
    for batch in batches:
        depth, node, sha = [], [], []
        for d, c, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (d, c) == now:
                state.update(b"," + packed.encode())
                continue
            if now is not None:
                depth.append(now[0]), node.append(now[1]), sha.append(state.hexdigest())
            now, state = (d, c), hashlib.sha256(packed.encode())
        yield _digests(depth, node, sha)
    if now is not None:
        yield _digests([now[0]], [now[1]], [state.hexdigest()])


def _digests(depth, node, sha) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(sha, pa.string())], names=["depth", "conv_id", "ends_sha256"])


def digests_of(members: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of the ascending ids ``conv`` of each node.

    Packing runs on ranges, so a node with any number of members is dealt over
    tasks; the hash itself is sequential and streams one row per 8,192 ids.
    """
    packed = members.select("depth", "conv_id", "conv").repartitionByRange("depth", "conv_id", "conv").sortWithinPartitions("depth", "conv_id", "conv")
    packed = packed.mapInArrow(_pack, "depth long, conv_id long, first long, packed string")
    packed = packed.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first")
    return packed.mapInArrow(_digest, "depth long, conv_id long, ends_sha256 string")


def build(conversations: DataFrame, *, rebuilt: bool = True) -> DataFrame:
    """One row per node: its smallest member, depth, parent, members, children, leaves, saved tokens and who ends there.

    ``conversations`` has (conv_id, turn, role, text); other columns are not
    read. With ``rebuilt`` conversations are put together from the first of
    their twenty first. A node's members are the conversations that begin with
    its turns; the root has none and holds all. ``saved_tokens`` counts, over
    the subtree, the words of each node's turn once for each member but one.
    An empty table gives no rows.
    """
    turns = ordered_turns(conversations)
    if rebuilt:
        convs, turns = rebuild(turns)
    else:
        turns = materialize(turns.repartitionByRange("d", "conv_id").sortWithinPartitions("d", "conv_id"), "trie-turns")
        convs = materialize(turns.groupBy("conv_id").agg(F.max("d").alias("length")), "trie-conversations")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    top = root.conv_id if root.n else 0
    live = convs.select("conv_id", F.lit(top).cast("long").alias("node"), "length")
    spark = conversations.sparkSession
    shared = spark.range(1 if root.n else 0).select(F.lit(top).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(root.n).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    levels, alone, ended = [shared], [], [live.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), F.col("node").alias("conv_id"), F.col("conv_id").alias("conv"))]
    depth = 0
    while not live.filter(F.col("length") > depth).isEmpty():
        depth += 1
        going = live.filter(F.col("length") >= depth).join(turns.filter(F.col("d") == depth).drop("d"), "conv_id")
        going = materialize(going, f"trie-at-{depth}")
        groups = going.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("length").alias("length"))
        groups = materialize(groups, f"trie-groups-{depth}")
        many = groups.filter("n > 1")
        moved = going.select("node", "key", "conv_id", "length").join(many.select("node", "key", "child"), ["node", "key"])
        live = materialize(moved.select("conv_id", F.col("child").alias("node"), "length"), f"trie-live-{depth}")
        drop(going)
        levels.append(many.select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n", "words"))
        alone.append(groups.filter("n = 1").select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), F.lit(depth).cast("long").alias("depth"), "length"))
        ended.append(live.filter(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("conv_id"), F.col("conv_id").alias("conv")))
    nodes = _roll_up(levels, alone)
    sums = digests_of(_all_of(ended))
    nodes = nodes.join(sums, ["depth", "conv_id"], "left").select(*COLUMNS, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    return nodes.unionByName(_chains(_all_of(alone))) if alone else nodes


def _all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _roll_up(levels: list[DataFrame], alone: list[DataFrame]) -> DataFrame:
    """The shared nodes with children, leaves and savings, from the deepest level to the root."""
    below, done = None, []
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if below is None:
            level = level.withColumns({"n_children": F.lit(0).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        else:
            sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            level = level.join(sums.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        level = level.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved"),
        )
        level = materialize(level, f"trie-up-{depth}")
        done.append(level)
        below = level.select("parent", "leaves", "saved")
        if depth:
            below = below.unionByName(alone[depth - 1].select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    return _all_of(done).toDF(*COLUMNS)


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes of conversations from where they are alone; long ones are dealt over tasks in stretches."""
    start = F.explode(F.sequence(F.col("depth"), F.col("length"), F.lit(PIECE).cast("long")))
    parts = alone.select("conv_id", "parent", "depth", "length", start.alias("from")).repartition("conv_id", "from")
    upto = F.least(F.col("from") + PIECE - 1, F.col("length"))
    each = parts.select("conv_id", "parent", F.col("depth").alias("top"), "length", F.explode(F.sequence(F.col("from"), upto)).alias("depth"))
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


#: crc32 is folded over the bytes of the id; prefixes are compared as lists of turn hashes.
ORACLE_SQL = r"""
WITH RECURSIVE crc_table(i, c, k) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list({'k': k, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, k) AS own FROM own GROUP BY c),
h AS (SELECT c, own, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 4)::BIGINT AS h FROM lists, crc),
seqs AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS s FROM h LEFT JOIN lists b ON b.c = h.c - h.c % 20),
paths AS (SELECT c, d, len(s) AS n, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w, sha256(coalesce(array_to_string(list_transform(s[1:d], lambda x: x.k), ','), '')) AS node,
    CASE WHEN d > 0 THEN sha256(coalesce(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), ','), '')) END AS parent FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM paths GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
under AS (SELECT DISTINCT a.d, a.node, b.d AS d2, b.node AS node2 FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT u.d, u.node, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((x.n_convs - 1) * x.w) AS saved FROM under u JOIN nodes x ON u.d2 = x.d AND u.node2 = x.node LEFT JOIN kids k ON k.d = x.d AND k.node = x.node GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.node = x.parent LEFT JOIN kids k ON k.d = x.d AND k.node = x.node JOIN sums s ON s.d = x.d AND s.node = x.node
"""
