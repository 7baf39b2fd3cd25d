"""Operator 12: the prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it, and its owner is
the smallest of them. A member of a deeper node is one of the node above, so what a conversation owns is a suffix of
its path: from depth o on. That makes (owner, depth) the name of a node, and sums over a subtree sums over members:

* the tokens of a subtree's nodes, each once for each member but one, are what its members hold from the node's depth
  on minus what they own there, which leaves for a member the turns between the node's depth and o;
* a leaf is the last node of just one owner, so leaves are counted by a flag of each conversation;
* each child of a node is owned by one member, so children are counted in the same way.

Turns become slim rows early: two lanes of 64 bits of the SHA-256 of role and text with their position, and a length.
The exclusive or of the lanes along a path names its prefix. Windows over a conversation give its paths, a group-by of
the prefixes gives the owners, and a second one all sums. Each group-by also holds the least against the largest turn
digest of a prefix: as equal prefixes then have equal last turns and equal prefixes before them, two paths meet only
where every turn of theirs has the same 128 bits. Both are combined before they are shuffled, so a first turn that a
third of all conversations share costs no more than others; ids of equal conversations are joined in blocks of 2,048
numbers before a task hashes a node's blocks in order, and only that list of joined blocks passes through one task.

Defined cases: turns are ordered by turn (null first), equal ones by their digests; null role or text counts as empty;
rows with a null conv_id belong to no conversation; a conversation can be rebuilt from the first turns of another, be
left without turns, and is a member of the root all the same; repeated rows are turns of their own; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import Tables, shuffle_width, small_batches

#: Ids of a block that are joined into one text.
BLOCK = 2048
#: Turns that a conversation can take over from another, one less than this; and conversations that take over from one.
HEADS, FAMILY = 6, 100


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), body (the digest of role and text) and tokens (code points of the text) of every turn."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in (role_col, text_col))
    body = F.unhex(F.sha2(F.concat(F.length(role.cast("binary")).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = conversations.where(conversations[conv_col].isNotNull()).select(
        conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].cast("long").alias("turn"), body.alias("body"), F.length(text).cast("long").alias("tokens")
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "body")
    return slim.select("conv", F.row_number().over(order).alias("pos"), "body", "tokens")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations unchanged: (conv, depth, body, tokens) of each turn and (conv, size) of each conversation."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv").agg(F.max("pos").alias("size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with the first crc32(conv) % HEADS turns of each conversation replaced by those of its family's first, where that has them."""
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    every = sizes.select("conv", "own", taken.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("root"))
    roots = sizes.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("root"), F.col("own").alias("held"))
    every = every.join(roots, "root", "left").withColumn("k", F.least("h", F.coalesce("held", F.lit(0))))
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv").alias("root"), F.col("pos").alias("depth"), "body", "tokens")
    first = every.where("k > 0").select("root", "conv", "k").join(heads, "root").where("depth <= k").select("conv", "depth", "body", "tokens")
    rest = turns.join(every.select("conv", "h", "k"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "body", "tokens")
    return first.unionByName(rest), every.select("conv", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))


def lane(body, depth, k: int):
    """One of the two lanes of a turn: 64 bits that know its digest and its place."""
    digest = F.hex(F.unhex(F.sha2(F.concat(depth.cast("string").cast("binary"), F.lit(":").cast("binary"), body), 256)))
    high, low = (F.conv(F.substring(digest, 16 * k + 1 + at, 8), 16, 10).cast("long") for at in (0, 8))
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)


def same(column: str):
    """Stops the job where two turns of one prefix differ, which their 128 bits rule out but for chance."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.raise_error(F.lit("two prefixes share their lanes")).cast("long"))


def hashed(batches):
    """Rows of (owner, depth, block, ids) in order -> the SHA-256 of each node's ids; a node's rows are all in one task."""
    name, state = None, None
    for b in batches:
        out = []
        for owner, depth, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if name == (owner, depth):
                state.update(b"," + ids.encode())
                continue
            if name:
                out.append((*name, state.hexdigest()))
            name, state = (owner, depth), sha256(ids.encode())
        yield batch_of(out)
    if name:
        yield batch_of([(*name, state.hexdigest())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["conv_id", "depth", "ends_sha256"])


def trie(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    paths: conv, depth (from 1), body, tokens of each turn; sizes: conv, size of each conversation, those without turns too.
    """
    spark = ship(paths.sparkSession)
    small_batches(spark)
    t = Tables(spark)
    upto = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    lanes = paths.select("conv", "depth", "tokens", lane(F.col("body"), F.col("depth"), 0).alias("a"), lane(F.col("body"), F.col("depth"), 1).alias("b"))
    walked = lanes.select("conv", "depth", "tokens", "a", "b", F.bit_xor("a").over(upto).alias("p"), F.bit_xor("b").over(upto).alias("q"), F.sum("tokens").over(upto).alias("upto"))
    root = sizes.select("conv", F.lit(0).alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("tokens", "a", "b", "p", "q", "upto")))
    seen = t.write(walked.unionByName(root))
    convs = t.write(sizes)
    members = seen.join(convs, "conv")
    owners = members.groupBy("depth", "p", "q").agg(F.min("conv").alias("conv"), F.max("size").alias("longest"), same("a").alias("a"), same("b").alias("b"))
    owned = owners.groupBy("conv").agg(F.min("depth").alias("o"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"))
    known = t.write(convs.join(owned, "conv", "left").select("conv", "size", F.coalesce("o", F.col("size") + 1).alias("o"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    before = seen.select("conv", (F.col("depth") + 1).alias("o"), F.col("upto").alias("unowned"), F.col("p").alias("up"), F.col("q").alias("uq"))  # the path up to the first owned node
    edge = t.write(known.join(before, ["conv", "o"], "left"))
    t.drop(known)
    held = seen.join(edge, "conv")
    unowned = F.when(F.col("depth") < F.col("o"), F.coalesce("unowned", F.lit(0)) - F.col("upto") + F.col("tokens")).otherwise(0)
    child = ((F.col("o") <= F.col("depth") + 1) & (F.col("depth") < F.col("size"))).cast("long")
    nodes = t.write(
        held.groupBy("depth", "p", "q").agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(unowned).alias("saved_tokens"), same("a").alias("a"), same("b").alias("b")
        )
    )
    over = nodes.select((F.col("depth") + 1).alias("o"), F.col("p").alias("up"), F.col("q").alias("uq"), F.col("conv_id").alias("parent"))
    parents = edge.where("o between 1 and size").select(F.col("conv").alias("conv_id"), "o", "up", "uq").join(over, ["o", "up", "uq"]).select("conv_id", F.col("o").alias("depth"), "parent")
    ended = seen.join(convs, "conv").where("depth = size").select("conv", "depth", "p", "q").join(nodes.select("depth", "p", "q", "conv_id"), ["depth", "p", "q"])
    blocks = ended.groupBy("conv_id", "depth", F.floor(F.col("conv") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = blocks.repartition(shuffle_width(spark), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    ends = dealt.mapInArrow(hashed, "conv_id long, depth int, ends_sha256 string")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    found = nodes.join(parents, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    columns = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), *columns, F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(Tables(spark).write(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


OP12_SQL = f"""
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, max(pos) AS own FROM ranked GROUP BY conv_id),
checked AS (  -- crc32 of the ids' decimals: a fold over their characters, eight steps of one bit in each
  SELECT conv_id, own, conv_id - conv_id % {FAMILY} AS root,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda r, c: list_reduce(list_prepend(xor(r, c), list_transform(range(8), lambda z: z::BIGINT)), lambda b, z: xor(b >> 1, (b & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % {HEADS} AS h
  FROM sizes),
every AS (SELECT c.conv_id, c.own, c.root, c.h, least(c.h, coalesce(r.own, 0)) AS k FROM checked c LEFT JOIN sizes r ON r.conv_id = c.root),
turns AS (
  SELECT e.conv_id, r.pos AS depth, r.role, r.text FROM every e JOIN ranked r ON r.conv_id = e.root AND r.pos <= e.k
  UNION ALL
  SELECT e.conv_id, r.pos - e.h + e.k, r.role, r.text FROM every e JOIN ranked r ON r.conv_id = e.conv_id AND r.pos > e.h
  UNION ALL
  SELECT conv_id, 0, NULL, NULL FROM every),
walked AS (
  SELECT conv_id, depth, length(coalesce(text, '')) AS tokens, max(depth) OVER (PARTITION BY conv_id) AS size,
         string_agg(coalesce(sha256(role) || sha256(text), '/'), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM turns),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY path) AS owner FROM walked),
nodes AS (
  SELECT owner, depth, max(tokens) AS tokens, count(*) AS n_convs, max(size) = depth AS leaf, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends
  FROM named GROUP BY owner, depth),
pairs AS (
  SELECT DISTINCT a.owner AS owner, a.depth AS depth, b.owner AS low_owner, b.depth AS low_depth
  FROM named a JOIN named b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT p.owner, p.depth, count(*) FILTER (WHERE n.depth = p.depth + 1) AS n_children, count(*) FILTER (WHERE n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.tokens) AS saved
  FROM pairs p JOIN nodes n ON n.owner = p.low_owner AND n.depth = p.low_depth GROUP BY p.owner, p.depth),
parents AS (SELECT DISTINCT owner AS parent, low_owner AS owner, low_depth AS depth FROM pairs WHERE low_depth = depth + 1)
SELECT n.owner AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (owner, depth) LEFT JOIN parents p USING (owner, depth)
"""
