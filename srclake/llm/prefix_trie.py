"""Trie of conversation prefixes, encoded by preorder intervals.

A conversation is a sequence of turns (role, text); each distinct sequence of first turns is a node, the root the empty
one.  A turn's digest is 22 characters (132 bits of SHA-256 of role and text), so a conversation is a string of digests
and a node a prefix of such strings.

Spark sorts the conversations by these strings and deals them out by ranges of (string, id), so copies of one
conversation are split too.  Each task walks its sorted rows with a stack of open nodes: what a row shares with its
predecessor stays open, the rest is closed and handed on with its members' number, smallest id and first and last place.
Nodes that were open in several tasks are merged by one aggregate, whose partial rows are one a node and task, also for
the root.  By first place and depth the nodes are then in lexicographic preorder, and a node's subtree is the interval
of those that open up to its last place.  Opens and ends of subtrees are sorted together, and running sums, within tasks
and over the tasks' totals, give each node's subtree the number of its nodes and leaves and its savings as a difference
of two sums.  A node's ending members come as pieces of text in their order; SHA-256 runs over them as a stream.

Defined results: rows without a conv_id are left out.  Null roles and texts are empty.  Turns are ordered by turn, nulls
first, equal ones by digest; repeated rows are turns of their own.  A conversation without turns ends at the root.  No
conversations give no nodes.  Other columns are ignored.  A conversation is one row of digests (22 bytes a turn, however
long the texts are).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes, _scratch

#: Characters of a turn's digest.
DIGEST = 22
ROOT = bytes(16)
#: Characters in a piece of joined ids.
PIECE = 1 << 18
#: Parents of a thousandth of all nodes, and of HEAVY at least, are sent out: a thousand rows at most.
HEAVY = 1000
#: First turns that a rebuilt conversation may take from another.
HEAD = 5


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and items (array of digest, chars) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.base64(F.unhex(F.sha2(mark, 256))), 1, DIGEST)
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    items = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(items.alias("items"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """The first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(decimal c) % 6.

    What is joined to a conversation are HEAD items of the one it begins with, which a hundred share (twice as many
    around 0, as % keeps the sign)."""
    first = F.col("conv_id") - F.col("conv_id") % 100
    heads = sequences.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("_base"), F.slice("items", 1, HEAD).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    both = sequences.withColumn("_base", first).join(heads, "_base", "left")
    kept, none = F.slice("items", h + 1, F.size("items") + 1), F.slice("items", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("_head", none), 1, h), kept).alias("items"))


class Walk:
    """Nodes of sorted rows, with a stack of those that are open."""

    def __init__(self):
        self.stack: list[list] = []
        self.key, self.nodes, self.ends = "", [], []

    def open(self, node: bytes, parent: bytes | None, depth: int, at: int, chars: int) -> None:
        # node, parent, depth, first, last, smallest id, members, chars, has a child, [ids that end here], their characters
        self.stack.append([node, parent, depth, at, at, None, 0, chars, False, [], 0])

    def cut(self, node: list) -> None:
        """Hands on the ids that have ended at a node so far."""
        if node[9]:
            self.ends.append((node[0], node[9][0][0], ",".join(str(c) for _, c in node[9])))
            node[9], node[10] = [], 0

    def close(self, depth: int) -> None:
        """Closes the nodes below a depth."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            self.cut(node)
            if self.stack:
                up = self.stack[-1]
                up[4], up[6], up[8] = max(up[4], node[4]), up[6] + node[6], True
                up[5] = node[5] if up[5] is None else min(up[5], node[5])
            self.nodes.append(tuple(node[:9]))

    def add(self, at: int, conv: int, key: str, chars: list[int]) -> None:
        n = len(key) // DIGEST
        if not self.stack:
            self.open(ROOT, None, 0, at, 0)
            shared = 0
        else:
            shared, most = 0, min(n, len(self.key) // DIGEST)
            if key.startswith(self.key):
                shared = most
            while shared < most and key[shared * DIGEST : (shared + 1) * DIGEST] == self.key[shared * DIGEST : (shared + 1) * DIGEST]:
                shared += 1
            self.close(shared)
        for d in range(shared, n):
            up = self.stack[-1]
            node = hashlib.sha256(up[0] + key[d * DIGEST : (d + 1) * DIGEST].encode()).digest()[:16]
            self.open(node, up[0], d + 1, at, chars[d])
        top = self.stack[-1]
        top[4], top[5], top[6] = at, conv if top[5] is None else min(top[5], conv), top[6] + 1
        top[9].append((at, conv))
        top[10] += 20
        if top[10] > PIECE:
            self.cut(top)
        self.key = key

    def rows(self) -> pa.RecordBatch:
        n, e = len(self.nodes), len(self.ends)
        cols = list(zip(*self.nodes, strict=True)) or [()] * 9
        of = list(zip(*self.ends, strict=True)) or [()] * 3
        kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        more = [of[0], [None] * e, [None] * e, of[1], *[[None] * e] * 5]
        arrays = [pa.array([*a, *b], k) for a, b, k in zip(cols, more, kinds, strict=True)]
        self.nodes, self.ends = [], []
        return pa.RecordBatch.from_arrays([*arrays, pa.array([*[None] * n, *of[2]], pa.string()), pa.array([0] * n + [1] * e, pa.int32())], names=NAMES)


NAMES = ["node", "parent", "depth", "first", "last", "conv_id", "n_convs", "chars", "parental", "ends", "kind"]
PIECES = "node binary, parent binary, depth int, first long, last long, conv_id long, n_convs long, chars long, parental boolean, ends string, kind int"


def _pieces(sequences: DataFrame) -> DataFrame:
    key = F.array_join(F.transform("items", lambda t: t["digest"]), "").alias("key")
    rows = sequences.select("conv_id", key, F.transform("items", lambda t: t["chars"]).alias("chars"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.monotonically_increasing_id().alias("at"), "conv_id", "key", "chars")

    def run(batches):
        walk = Walk()
        for batch in batches:
            for at, conv, key, chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                walk.add(at, conv, key, chars)
                if len(walk.nodes) + 8 * len(walk.ends) > 20_000:
                    yield walk.rows()
        walk.close(-1)
        yield walk.rows()

    return ordered.mapInArrow(_bytes.tidy(run), PIECES)


def _ending(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256: of each node's pieces in order, read as a stream."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return pieces.select("node", "first", "ends").repartition("node").sortWithinPartitions("node", "first").mapInArrow(_bytes.tidy(run), "node binary, ends_sha256 string")


SUMS = ["opened", "leaves", "saved"]


def _intervals(nodes: DataFrame) -> DataFrame:
    """node, preorder, subtree_end (the first preorder number after the subtree), n_leaves, saved_tokens."""
    opens = nodes.select("node", F.col("first").alias("at"), F.lit(0).alias("closes"), "depth", F.lit(1).cast("long").alias("opened"), (~F.col("parental")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    ends = nodes.select("node", F.col("last").alias("at"), F.lit(1).alias("closes"), "depth", *(F.lit(0).cast("long").alias(c) for c in SUMS))
    order = ["at", "closes", "depth"]
    events = opens.unionByName(ends).repartitionByRange(*order).sortWithinPartitions(*order).select("node", "closes", *SUMS)

    def run(batches):
        part, total = TaskContext.get().partitionId(), np.zeros(len(SUMS), np.int64)
        for batch in batches:
            own = np.stack([batch.column(2 + i).to_numpy() for i in range(len(SUMS))])
            before = total[:, None] + np.cumsum(own, axis=1) - own
            total = total + own.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, before), *[pa.array(np.full(len(batch), v, np.int32)) for v in (part, 0)]], names=["node", "closes", *SUMS, "part", "kind"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), *(pa.array([int(v)]) for v in total), *[pa.array([v], pa.int32()) for v in (part, 1)]], names=["node", "closes", *SUMS, "part", "kind"])

    kind = "node binary, closes int, " + ", ".join(f"{c} long" for c in SUMS) + ", part int, kind int"
    stored = _scratch.saved(events.mapInArrow(_bytes.tidy(run), kind), "trie-sums")
    spark, seen, offsets = nodes.sparkSession, [0] * len(SUMS), []
    for r in stored.where("kind = 1").select("part", *SUMS).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], *seen))
        seen = [a + r[c] for a, c in zip(seen, SUMS, strict=True)]
    before = spark.createDataFrame(offsets, "part int, " + ", ".join(f"_{c} long" for c in SUMS))
    rows = stored.where("kind = 0").join(F.broadcast(before), "part").select("node", "closes", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in SUMS))
    sign = F.col("closes") * 2 - 1
    at = lambda closes: F.max(F.when(F.col("closes") == closes, F.col("opened")))
    return rows.groupBy("node").agg(at(0).alias("preorder"), at(1).alias("subtree_end"), F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of conv_id, items: node, parent, depth, conv_id (the smallest member), parent_conv_id, n_convs,
    n_children, preorder, subtree_end, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    pieces, path = _scratch.save(_pieces(sequences), "trie-pieces", "zstd", "kind")
    once = {"parent": F.max, "depth": F.max, "first": F.min, "last": F.max, "conv_id": F.min, "n_convs": F.sum, "chars": F.max, "parental": F.max}
    nodes = _scratch.saved(pieces.where("kind = 0").groupBy("node").agg(*(f(c).alias(c) for c, f in once.items())), "trie-nodes")
    ends = _scratch.saved(_ending(pieces.where("kind = 1")), "trie-ends")
    _scratch.drop(spark, path)
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    share = max(HEAVY, nodes.count() // HEAVY)
    # a parent of very many nodes is sent out, the others are joined
    heavy = nodes.join(children.where(F.col("n_children") >= share).select(F.col("parent").alias("node")), "node", "left_semi")
    up = lambda df, name: df.select(F.col("node").alias("parent"), F.col("conv_id").alias(name))
    known = nodes.join(F.broadcast(up(heavy, "_sent")), "parent", "left")
    rest = known.where("_sent IS NULL").join(up(nodes, "_joined"), "parent", "left").withColumn("parent_conv_id", F.col("_joined")).drop("_joined")
    every = known.where("_sent IS NOT NULL").withColumn("parent_conv_id", F.col("_sent")).unionByName(rest).drop("_sent")
    n = children.select(F.col("parent").alias("node"), "n_children")
    out = every.join(_intervals(nodes), "node").join(n, "node", "left").join(ends, "node", "left")
    return out.select("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "preorder", "subtree_end", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All conversations, each rebuilt with the first turns of another."""
    items = _scratch.saved(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    out = trie(rebuilt(items))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 bit by bit: eight steps for each byte of the decimal number.
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT conv_id, turn, length(text) AS chars, substring(to_base64(unhex(sha256(length(role) || ':' || role || text))), 1, {DIGEST}) AS digest FROM t
), o AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests, list(chars ORDER BY turn NULLS FIRST, digest) AS chars,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(y)::UBIGINT FOR y IN string_split(CAST(conv_id AS VARCHAR), '')]),
             lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda z, w: CASE WHEN z % 2 = 1 THEN xor(z >> 1, 3988292384::UBIGINT) ELSE z >> 1 END)), 4294967295::UBIGINT) % 6 AS h
  FROM m GROUP BY conv_id
), r AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.digests, []), 1, o.h), list_slice(o.digests, o.h + 1, len(o.digests))) AS digests,
         list_concat(list_slice(coalesce(b.chars, []), 1, o.h), list_slice(o.chars, o.h + 1, len(o.chars))) AS chars
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100
), p AS (
  SELECT conv_id, coalesce(array_to_string(digests, ''), '') AS path, chars, len(digests) AS n FROM r
), n AS MATERIALIZED (
  SELECT d AS depth, substring(path, 1, {DIGEST} * d) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN d = 0 THEN 0 ELSE chars[d] END) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM p) GROUP BY ALL
), c AS MATERIALIZED (
  SELECT substring(path, 1, {DIGEST} * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), l AS MATERIALIZED (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.path = n.path
), s AS (
  SELECT substring(path, 1, {DIGEST} * a) AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM l) GROUP BY ALL
)
SELECT l.conv_id, l.depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, l.ends_sha256
FROM l JOIN s ON s.path = l.path LEFT JOIN n u ON l.depth > 0 AND u.path = substring(l.path, 1, {DIGEST} * (l.depth - 1))
"""
