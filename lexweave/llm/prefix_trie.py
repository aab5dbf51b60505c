"""The trie of conversations by their turns, from sorted neighbours.

A turn that no other conversation has at the same place ends what a conversation can share,
so only the turns before it go on, as a path of 128-bit keys; the rest is a chain of its
own. Different paths are sorted over all partitions. In a partition the common prefixes of
neighbours are edges, taken from the deepest up: each joins two components (union-find) and
makes the node where they branch. Nodes that go on beyond a partition are contracted to their
sums under the hash of their prefix and merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import position_by_range
from ..session import scratch_path

BASE = 5  # a conversation begins like the one whose id is the last multiple of this
BORROWED = 9  # and borrows fewer turns than this
KEY = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def borrowed(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of all rebuilt conversations, and their turns (conv_id, d, key, n_bytes, size).

    Turns are ordered by turn, null first, then by role and key; a key is 128 bits of role
    and text. The first turns of a conversation are those of its base conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    turns = _stored(
        position_by_range(turns, "i", ["conv_id"], ["turn", "role", "key"]).select("conv_id", "i", "key", "n_bytes"), "turns"
    )
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    c = F.col("conv_id")
    plan = _stored(
        sizes.select(c, "n", (c - c % BASE).alias("base"), borrowed(c).alias("h"))
        .join(sizes.select(c.alias("base"), F.col("n").alias("base_n")), "base", "left")
        .withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
        "plans",
    )
    own = turns.join(plan, "conv_id").where("i > h").select(
        "conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("d"), "key", "n_bytes", "size"
    )
    lent = turns.where(F.col("i") < BORROWED).withColumnRenamed("conv_id", "base").join(plan, "base").where("i <= h").select(
        "conv_id", F.col("i").alias("d"), "key", "n_bytes", "size"
    )
    return plan.select("conv_id", "size"), _stored(own.unionByName(lent), "rebuilt")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many keys two paths begin with in common."""
    n = min(len(a), len(b)) // KEY * KEY
    if a[:n] == b[:n]:
        return n // KEY
    x, y = (np.frombuffer(p, np.uint8, n) for p in (a, b))
    return int((x != y).argmax()) // KEY


class Forest:
    """The branching nodes over sorted different paths, by union-find over neighbours' edges."""

    def __init__(self, paths: list[bytes]):
        self.depth = [len(p) // KEY for p in paths]
        self.parent = [-1] * len(paths)
        self.of = list(range(len(paths)))  # nodes that are the same
        self.low, self.high = list(range(len(paths))), list(range(len(paths)))
        self.root = list(range(len(paths)))  # components of paths
        self.top = list(range(len(paths)))  # and the node over each
        edges = np.array([shared_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
        for k in np.argsort(-edges, kind="stable").tolist():
            self.join(k, k + 1, int(edges[k]))
        over = self.top[self._find(self.root, 0)]
        if self.depth[over]:
            self._over(0, over)

    @staticmethod
    def _find(of: list[int], k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    def _over(self, depth: int, *children: int) -> int:
        self.depth.append(depth)
        self.parent.append(-1)
        self.of.append(len(self.of))
        self.low.append(min(self.low[c] for c in children))
        self.high.append(max(self.high[c] for c in children))
        for c in children:
            self.parent[c] = len(self.depth) - 1
        return len(self.depth) - 1

    def join(self, a: int, b: int, depth: int) -> None:
        """The components of neighbours a and b share ``depth`` turns; both lie below that."""
        a, b = self._find(self.root, a), self._find(self.root, b)
        x, y = self.top[a], self.top[b]
        if self.depth[x] > depth and self.depth[y] > depth:
            over = self._over(depth, x, y)
        else:
            over, under = (x, y) if self.depth[x] == depth else (y, x)
            if self.depth[under] == depth:
                self.of[under] = over
            else:
                self.parent[under] = over
            self.low[over], self.high[over] = min(self.low[x], self.low[y]), max(self.high[x], self.high[y])
        self.root[b] = a
        self.top[a] = over

    def nodes(self) -> list[tuple[int, int]]:
        """(node, the node over it or -1), the deepest first; nodes that are the same come once."""
        mine = [k for k in range(len(self.of)) if self.of[k] == k]
        over = {k: self._find(self.of, self.parent[k]) if self.parent[k] >= 0 else -1 for k in mine}
        return sorted(over.items(), key=lambda kv: -self.depth[kv[0]])


_NODES = (
    "kind int, node binary, above binary, above_conv long, path binary, conv_id long, depth long, "
    "n_convs long, n_children long, n_leaves long, saved long"
)
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()] + [pa.int64()] * 6


def part_nodes(rows: list[dict], before: int, after: int) -> Iterator[tuple]:
    """Nodes of one sorted part as rows of ``_NODES``, with the part's share of all sums.

    ``before`` and ``after`` are the turns shared with the part before and the part after
    (-1: there is none). A node that goes on beyond the part has its prefix's hash as ``node``.
    Kind 1 rows say which node a path ends at, for the chains that hang there.
    """
    paths = [r["keys"] for r in rows]
    forest = Forest(paths)
    nodes = forest.nodes()
    last = len(paths) - 1
    n, conv, tails, ends = ({k: 0 for k, _ in nodes} for _ in range(4))
    for r, row in enumerate(rows):
        k = forest._find(forest.of, r)
        n[k] += row["n"]
        tails[k] += row["tails"]
        ends[k] += row["ends"]
        conv[k] = row["conv_id"]
    path_of = {forest._find(forest.of, r): r for r in range(len(rows))}
    conv = {k: conv[k] if k in path_of else None for k, _ in nodes}
    children, leaves, saved = ({k: 0 for k, _ in nodes} for _ in range(3))

    def crosses(k: int, d: int) -> bool:
        return forest.low[k] == 0 and d <= before or forest.high[k] == last and d <= after

    def digest(k: int, d: int) -> bytes | None:
        return hashlib.md5(paths[forest.low[k]][: d * KEY]).digest() if crosses(k, d) else None

    found = []  # all but who is above, which is complete only in the end
    for k, over in nodes:
        depth, up = forest.depth[k], forest.depth[over] if over >= 0 else -1
        lens = rows[forest.low[k]]["lens"]
        continued = before if forest.low[k] == 0 else -1  # so deep the node began in an earlier part
        goes_on = forest.high[k] == last and depth <= after
        if not children[k] and not tails[k] and not goes_on and path_of.get(k) is not None and not leaves[k]:
            leaves[k] = 1
        leaves[k] += tails[k]
        total, below = saved[k], children[k] + tails[k]
        for d in range(depth, up, -1):
            if d:
                total += (n[k] - (d > continued)) * lens[d - 1]
            found.append((k, over, d, below, leaves[k], total))
            below = int(d > continued)
        if over >= 0:
            n[over] += n[k]
            conv[over] = conv[k] if conv[over] is None else min(conv[over], conv[k])
            children[over] += below
            leaves[over] += leaves[k]
            saved[over] += total
    for k, over, d, below, leaf, total in found:
        up = k if d - 1 > (forest.depth[over] if over >= 0 else -1) else over
        above = digest(up, d - 1) if d else None
        path = hashlib.md5(paths[path_of[k]]).digest() if d == forest.depth[k] and ends.get(k) else None
        yield (
            0, digest(k, d), above, None if above or not d else conv[up], path, conv[k], d, n[k], below, leaf, total,
        )
    for k, r in path_of.items():
        if tails[k]:
            node = digest(k, forest.depth[k])
            yield (1, None, node, None if node else conv[k], hashlib.md5(paths[r]).digest(), None, None, None, None, None, None)


def _parts(paths: DataFrame) -> DataFrame:
    """The nodes of all parts of the sorted paths, as ``_NODES``."""
    ordered = _stored(paths.repartitionByRange("keys").withColumn("part", F.spark_partition_id()), "paths")
    # The first and last path of each part: as many as the sort made parts.
    edges = ordered.groupBy("part").agg(F.min("keys").alias("low"), F.max("keys").alias("high")).orderBy("part").collect()
    shared = [shared_turns(bytes(a["high"]), bytes(b["low"])) for a, b in zip(edges, edges[1:])]
    bounds = {e["part"]: (x, y) for e, x, y in zip(edges, [-1, *shared], [*shared, -1])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            made = list(part_nodes(rows, *bounds[rows[0]["part"]]))
            for i in range(0, len(made), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*made[i : i + 10_000]), _TYPES)], names=[f.split()[0] for f in _NODES.split(", ")]
                )

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from out(held)
                    held = []
                held.append(row)
        if held:
            yield from out(held)

    return ordered.repartition("part").sortWithinPartitions("part", "keys").mapInArrow(run, _NODES)


def _ends(members: DataFrame) -> DataFrame:
    """(path, ends_sha256): the hash of the ids that end at each path, read in order.

    A hash over one list can't be cut, so the ids of a path pass one task, as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for batch in batches:
            done = []
            for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = path, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], names=["path", "ends_sha256"])

    return members.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id") \
        .mapInArrow(run, "path binary, ends_sha256 string")


def trie(df: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``conv_id, turn, role, text``).

    conv_id (the smallest member), depth, parent_conv_id (the parent's smallest member; the
    root has none), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A
    conversation is rebuilt from the first turns of its base conversation and its own later ones
    (``rebuilt``). Null roles and texts are empty; a null turn comes first; turns with one number
    are ordered by role and content, and rows stored twice are two turns. Rows
    without conv_id belong to no conversation. A conversation without turns is a member of
    the root. An empty table has no nodes. Other columns are ignored.

    Turns are compared by 128 bits. A part of the sorted paths is held by one task; the
    first and last path of each part pass the driver.
    """
    convs, turns = rebuilt(df)
    alone = turns.groupBy("d", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1") \
        .groupBy("conv_id").agg(F.min("d").alias("u"))
    marked = _stored(turns.join(alone, "conv_id", "left"), "marked")
    shared = marked.where("u IS NULL OR d < u").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("d", "key", "n_bytes"))).alias("turns")
    )
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    members = _stored(
        convs.join(shared, "conv_id", "left").join(alone, "conv_id", "left").select(
            "conv_id", F.coalesce(key, F.lit(b"")).alias("keys"),
            F.coalesce(F.transform("turns", lambda t: t["n_bytes"]), F.array().cast("array<bigint>")).alias("lens"),
            F.col("u").isNotNull().alias("tail"),
        ).withColumn("path", F.unhex(F.md5("keys"))),
        "members",
    )
    paths = members.groupBy("keys").agg(
        F.first("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
        F.count_if("tail").alias("tails"), F.count_if(~F.col("tail")).alias("ends"),
    )
    made = _stored(_parts(paths), "nodes")
    inner = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "above", "above_conv", "path"]
    nodes = made.where("kind = 0")
    merged = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        F.max("above").alias("above"), F.max("above_conv").alias("above_conv"), F.max("path").alias("path"),
    )
    names = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("above_merged"))
    above = F.coalesce("above_merged", "above_conv")
    whole = (
        nodes.where("node IS NULL").select(*inner).unionByName(merged.select(*inner)).join(names, "above", "left")
        .join(_ends(members.where(~F.col("tail"))), "path", "left")
        .select(
            "conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )
    # What hangs at a shared node and is one conversation's own.
    hung = made.where("kind = 1").join(names, "above", "left").select("path", above.alias("hung"))
    hung = members.where("tail").select("conv_id", "path").join(hung, "path").select("conv_id", "hung")
    own = marked.where("d >= u")
    first = own.where("d = u").join(hung, "conv_id")
    later = own.where("d > u").withColumn("hung", F.col("conv_id"))
    columns = ["conv_id", "d", "size", "hung"]
    chains = first.select(*columns).unionByName(later.select(*columns)).select(
        "conv_id", F.col("d").alias("depth"), F.col("hung").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("d") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("size"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return whole.unionByName(chains)


TRIE_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                          md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
       FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(i) AS n, conv_id - conv_id % {BASE} AS base, xor(4294967295, list_reduce(
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda a, x: list_reduce(range(8), lambda b, z: xor(b >> 1, (b & 1) * 3988292384), xor(a, x)), 4294967295)) % {BORROWED} AS h
      FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT conv_id, k + i - h AS d, role, text FROM t JOIN p USING (conv_id) WHERE i > h
      UNION ALL SELECT p.conv_id, i, role, text FROM p JOIN t ON t.conv_id = p.base WHERE i <= h),
s AS (SELECT p.conv_id, coalesce(list(struct_pack(role, text) ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS turns
      FROM p LEFT JOIN r USING (conv_id) GROUP BY ALL),
m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS d, turns FROM s),
x AS (SELECT conv_id, d, len(turns) AS size, turns[1:d] AS prefix, coalesce(strlen(turns[d].text), 0) AS n_bytes FROM m),
y AS (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM x),
nodes AS (SELECT node, d, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
          FROM y GROUP BY node, d, prefix),
up AS (SELECT nodes.*, y.node AS parent FROM nodes LEFT JOIN y ON y.conv_id = nodes.node AND y.d = nodes.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (node, d)),
sums AS (SELECT y.node, y.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.n_bytes) AS saved
         FROM full_ f JOIN y ON y.conv_id = f.node AND y.d <= f.d GROUP BY ALL)
SELECT f.node AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s USING (node, d)"""
