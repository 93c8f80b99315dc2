"""Operator 11: prefix trie of conversations, as weighted whole sequences.

Conversations are rebuilt (the first h turns of the conversation that leads their five, then their own after h), identical
rebuilt conversations collapse into one sequence with a weight and a list of ends, and only one conversation of each
sequence - the smallest id - goes on.  A sequence is a leaf when it is no proper prefix of another (anti-join).  Its
prefixes, weighted, add up to the nodes.

Turns are known by two 64-bit hashes of role and text, prefixes by two running xors of hashes of (depth, turn): a prefix
needs no list of turns.  Positions and running values are two-level sums: turns are dealt by range of (conv_id, turn), so a
conversation of any length spreads over many parts, and parts are summed up per conversation afterwards.  Texts never move.

Sums over subtrees take no walk: members' bytes below a node are their own suffixes, and every node's bytes are counted
once by its owner, the smallest sequence through it.  A sequence owns the nodes from one depth to its end, so of another
sequence that passes a node, the owned bytes all lie below it.

Lists of ends are written as text by ranges of 4,096 ids and hashed in that order, range after range, so that a sequence with
any number of members needs the memory of one range.

Defined results: rows without a conv_id belong to no conversation and are left out; a null turn comes first, equal turns
go by role and then by a hash of role and text, repeated rows are turns of their own; null role or text is empty; for
negative ids c % 5 has the sign of c, as in SQL; other columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize

FAMILY, HEADS = 5, 9
ID_RANGE_BITS = 12
NODE = ["depth", "x", "y"]
ORDER = ["turn", "role", "a", "b"]


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, position, a, b, bytes, head, shift) and conversations (conv_id, lead, head, taken)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes")
    )
    turns = materialize(narrow.repartitionByRange("conv_id", *ORDER).withColumn("part", F.spark_partition_id()), "turns")
    pieces = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    own = F.col("conv_id") % FAMILY == 0
    head = F.when(own, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    leads = sizes.where(own).select(F.col("conv_id").alias("lead"), F.col("n").alias("in_lead"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lead"), head.alias("head")).join(leads, "lead", "left")
    convs = materialize(convs.select("conv_id", "lead", "head", F.least("head", F.coalesce("in_lead", F.lit(0))).alias("taken")), "convs")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(convs, "conv_id").select("conv_id", "part", "start", "head", (F.col("taken") - F.col("head")).alias("shift"))
    position = F.col("start") + F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*ORDER))
    return turns.join(starts, ["conv_id", "part"]).select("conv_id", "part", position.alias("position"), "a", "b", "bytes", "head", "shift"), convs


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, part, depth, x, y, bytes) and all conversations."""
    placed, convs = placed_turns(conversations)
    placed = materialize(placed, "placed")
    own = placed.where(F.col("position") > F.col("head")).select("conv_id", "part", (F.col("position") + F.col("shift")).alias("depth"), "a", "b", "bytes")
    asked = convs.where("taken > 0").select("conv_id", F.col("lead"), F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("depth"))
    first = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < HEADS)).select(F.col("conv_id").alias("lead"), F.col("position").alias("depth"), "a", "b", "bytes")
    heads = asked.join(first, ["lead", "depth"]).select("conv_id", F.lit(-1).alias("part"), "depth", "a", "b", "bytes")
    both = own.unionByName(heads)
    return both.select("conv_id", "part", "depth", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "a", "depth").alias("y"), "bytes"), convs


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, x, y, ids) in order of node and range -> (depth, x, y, ends_sha256)."""
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    now, state = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if node != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, state.hexdigest()), schema)], schema=schema)


def end_lists(ends: DataFrame) -> DataFrame:
    """ends (conv_id, depth, x, y) -> the hash of the ascending ids of every node where conversations end."""
    listed = F.array_join(F.array_sort(F.collect_list("conv_id")), ",")
    ranges = ends.groupBy(*NODE, F.shiftright("conv_id", ID_RANGE_BITS).alias("range")).agg(listed.alias("ids"))
    ordered = ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids")
    return ordered.mapInArrow(_hash_lists, "depth long, x long, y long, ends_sha256 string")


def weighted_prefixes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ends of all conversations; sequences (conv_id, depth, x, y, weight); and prefixes of the sequences with
    their weight, length, node, parent node and the bytes from there to the end."""
    totals = materialize(turns.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "totals")
    whole = totals.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("total"))
    nothing = F.lit(0).cast("long")
    ends = materialize(convs.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, nothing).alias(c) for c in (*NODE, "total")]), "ends")
    sequences = materialize(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.min("total").alias("total")), "sequences")

    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "part", *[F.coalesce(f(c).over(before), nothing).alias(f"{c}_before") for c, f in (("x", F.bit_xor), ("y", F.bit_xor), ("bytes", F.sum))])
    chosen = starts.join(sequences.select("conv_id", "weight", "total", F.col("depth").alias("length")), "conv_id")
    running = Window.partitionBy("conv_id", "part").orderBy("depth")
    so_far = turns.join(chosen, ["conv_id", "part"]).select(
        "conv_id", "weight", "length", "total", "depth", "bytes", F.col("x").alias("own_x"), F.col("y").alias("own_y"),
        *[F.col(f"{c}_before").bitwiseXOR(F.bit_xor(c).over(running)).alias(c) for c in ("x", "y")], (F.col("bytes_before") + F.sum("bytes").over(running)).alias("read"),
    )
    parent = [F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"parent_{c}") for c in ("x", "y")]
    inner = so_far.select("conv_id", "weight", "length", *NODE, *parent, (F.col("total") - F.col("read") + F.col("bytes")).alias("suffix"))
    root = sequences.select("conv_id", "weight", F.col("depth").alias("length"), *[nothing.alias(c) for c in NODE], *[F.lit(None).cast("long").alias(f"parent_{c}") for c in ("x", "y")], F.col("total").alias("suffix"))
    return ends, sequences, inner.unionByName(root)


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt_turns(conversations)
    ends, sequences, prefixes = weighted_prefixes(materialize(turns, "rebuilt"), convs)
    prefixes = materialize(prefixes, "prefixes")

    counted = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("suffix")).alias("read"), F.min_by("suffix", "conv_id").alias("own_suffix"), F.max("parent_x").alias("parent_x"), F.max("parent_y").alias("parent_y")
    )
    nodes = materialize(counted, "nodes")

    proper = prefixes.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min_by("own_suffix", "depth").alias("owned"))
    known = sequences.select("conv_id").join(leaves, "conv_id", "left").join(owned, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("leaf", "owned")])
    below = prefixes.select("conv_id", *NODE).join(known, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), (F.sum("owned") - F.min_by("owned", "conv_id")).alias("others"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.col("owner").alias("parent_conv_id"))
    full = nodes.join(below, NODE).join(children, NODE, "left").join(end_lists(ends.select("conv_id", *NODE)), NODE, "left").join(parents, ["depth", "parent_x", "parent_y"], "left")
    return full.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        (F.col("read") - F.col("own_suffix") - F.col("others")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: Rebuilt conversations as lists of turns, prefixes by slicing, subtrees by comparing prefixes; crc32 bit by bit.
ORACLE = """
WITH turns AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, step: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h FROM turns),
made AS (SELECT c.conv_id, CASE WHEN c.conv_id % 5 = 0 THEN c.own ELSE list_concat(coalesce(b.own[1 : c.h], []), c.own[c.h + 1 :]) END AS turns FROM h c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefix AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM made),
node AS (SELECT turns[1 : depth] AS seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends FROM prefix GROUP BY ALL),
up AS (SELECT *, seq[1 : depth - 1] AS parent FROM node),
kids AS (SELECT parent AS seq, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY parent),
full_ AS (SELECT up.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(up.seq[depth].t) END AS saved FROM up LEFT JOIN kids ON kids.seq = up.seq),
lower_ AS (SELECT seq[1 : d] AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_) GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN lower_ ON top = f.seq LEFT JOIN full_ p ON f.depth > 0 AND p.seq = f.parent
"""
