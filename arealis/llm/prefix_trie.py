"""Trie of conversation prefixes from vertical bitmaps.

A shard is a run of conversations in the order of their ids. Its index maps
(position, turn) to the set of its conversations with that turn there, as a bitmap.
The trie of a shard follows depth first: the members of a child are the members of
its parent and the posting of one more turn, so one intersection makes a node. Its
number of bits is the count of members, and the bits that also are in the bitmap of
conversations of that length are those that end there.

Nodes of all shards meet by the digest of their turns, as partial sums that are
combined before they move, so a first turn that a third of all conversations share
is one row per shard. What a subtree sums over distinct nodes is summed over members
instead: each node belongs to its smallest member, so a second walk over the shards,
given the depth from which a conversation owns its nodes, adds up partial sums of the
same kind. No step walks the trie level by level. The ids that end at a node
stay one text per shard and stream through the digest in the order of shards.

Turns are told apart by MD5 digests of role and text, nodes by digests of those. A
null role or text is empty; null turn numbers come first; turns of one number are in
the order of their digests, and rows that repeat one are turns of their own. Rows
without an id belong to no conversation. Without conversations there is no node. A
sequence may be empty. Other columns are ignored. The turns of one conversation
(16 bytes and a length each, no texts) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, stored

#: Conversations, and turns, of one shard (the last conversation may exceed the turns).
SHARD = 4_096
SHARD_TURNS = 1 << 17
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, digest, size): light rows, no text moves. ``size`` is in UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )


def sequences(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, for ``turn_digests()``
    dealt by the column ``by`` (the id or a function of it)."""
    in_order = F.sort_array(F.collect_list(F.struct("turn", "digest", "size")))
    return turns.groupBy(*dict.fromkeys([by, "conv_id"])).agg(
        F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")
    )


def with_shared_heads(turns: DataFrame, group: int = 5, lengths: int = 9) -> DataFrame:
    """Sequences rebuilt to share heads: the first h turns are those of the first
    conversation of each ``group`` ids, h = crc32(id) % ``lengths``; then the own
    turns follow after the first h."""
    lead = F.col("conv_id") - F.col("conv_id") % group
    own = sequences(turns.withColumn("lead", lead).repartition("lead"), "lead")
    heads = own.where("conv_id = lead").select(F.col("lead"), F.slice("turns", 1, lengths - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths).cast("int")
    return own.join(heads, "lead", "left").select(
        "conv_id",
        F.concat(
            F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0)),
            F.slice("turns", h + 1, F.size("turns")),
        ).alias("turns"),
    )


def set_bits(bits: int) -> np.ndarray:
    """Places of the ones of a bitmap, ascending."""
    data = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little"))


class Shard:
    """Postings of a run of conversations, and the nodes of its trie."""

    def __init__(self, digests: list[list[bytes]]):
        self.digests = digests
        longest = max(map(len, digests), default=0)
        self.postings: list[dict[bytes, int]] = [{} for _ in range(longest)]
        self.ending = [0] * (longest + 1)
        for i, turns in enumerate(digests):
            bit = 1 << i
            self.ending[len(turns)] |= bit
            for at, t in zip(self.postings, turns):
                at[t] = at.get(t, 0) | bit

    def nodes(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(parent's number, depth, members, key); numbered as they come, parents first."""
        stack = [(-1, 0, (1 << len(self.digests)) - 1, b"")]
        number = 0
        while stack:
            parent, depth, members, key = stack.pop()
            yield parent, depth, members, key
            left = members & ~self.ending[depth]
            while left:
                low = (left & -left).bit_length() - 1
                turn = self.digests[low][depth]
                child = members & self.postings[depth][turn]
                left ^= child
                stack.append((number, depth + 1, child, hashlib.md5(key + turn).digest()))
            number += 1


def _shards(batches: Iterator[pa.RecordBatch], most: int, most_turns: int) -> Iterator[tuple[pa.Table, list[list[bytes]], list[np.ndarray]]]:
    """Runs of rows with their digests and sizes, whole conversations each."""

    def ready(parts):
        t = pa.Table.from_batches(parts)
        digests, sizes = [], []
        for c in t.column("turns").chunks:
            flat, ends = c.flatten(), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))
            d, s = flat.field("digest").to_pylist(), flat.field("size").to_numpy(zero_copy_only=False)
            for a, b in zip([0, *ends[:-1]], ends):
                digests.append(d[a:b])
                sizes.append(s[a:b])
        return t, digests, sizes

    held, rows, turns = [], 0, 0
    for b in batches:
        at = 0
        lengths = b.column("turns").value_lengths().to_numpy(zero_copy_only=False)
        while at < b.num_rows:
            running = turns + np.cumsum(lengths[at:])
            n = min(most - rows, max(int(np.searchsorted(running, most_turns)), 0 if rows else 1), b.num_rows - at)
            if n:
                held.append(b.slice(at, n))
                rows, turns, at = rows + n, turns + int(lengths[at : at + n].sum()), at + n
            if at < b.num_rows or rows >= most:
                yield ready(held)
                held, rows, turns = [], 0, 0
    if held:
        yield ready(held)


def _partial_nodes(most: int, most_turns: int):
    kind = pa.schema(
        [
            ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
            ("size", pa.int64()), ("total", pa.int64()), ("first", pa.int64()), ("ends", pa.string()),
        ]
    )

    def run(batches):
        for t, digests, sizes in _shards(batches, most, most_turns):
            ids = t.column("conv_id").to_numpy()
            shard = Shard(digests)
            key, parent, depth, low, count, size, ends = [], [], [], [], [], [], []
            for up, d, members, k in shard.nodes():
                smallest = (members & -members).bit_length() - 1
                key.append(k)
                parent.append(up)
                depth.append(d)
                low.append(int(ids[smallest]))
                count.append(members.bit_count())
                size.append(int(sizes[smallest][d - 1]) if d else 0)
                here = members & shard.ending[d]
                ends.append(",".join(map(str, ids[set_bits(here)].tolist())) if here else None)
            total = [n * b for n, b in zip(count, size)]
            for i in range(len(key) - 1, 0, -1):
                total[parent[i]] += total[i]
            above = [None if up < 0 else key[up] for up in parent]
            columns = [key, above, depth, low, count, size, total, [int(ids[0])] * len(key), ends]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return run


def _partial_sums(most: int, most_turns: int):
    kind = pa.schema([("key", pa.binary()), ("own", pa.int64()), ("n_leaves", pa.int64())])

    def run(batches):
        for t, digests, sizes in _shards(batches, most, most_turns):
            owns_from = t.column("owns_from").to_pylist()
            leaf = t.column("leaf").to_pylist()
            key, parent, own, leaves = [], [], [], []
            for up, d, members, k in Shard(digests).nodes():
                smallest = (members & -members).bit_length() - 1
                since = owns_from[smallest]
                owned = since is not None and since <= d
                key.append(k)
                parent.append(up)
                own.append(int(sizes[smallest][d - 1]) if owned and d else 0)
                leaves.append(int(owned and leaf[smallest] and d == len(digests[smallest])))
            for i in range(len(key) - 1, 0, -1):
                own[parent[i]] += own[i]
                leaves[parent[i]] += leaves[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([key, own, leaves], kind)], schema=kind)

    return run


def _ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each key, a shard's text at a time."""
    now, digest = None, None
    for b in batches:
        keys, out = [], []
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k == now:
                digest.update(b",")
            else:
                if digest:
                    keys.append(now)
                    out.append(digest.hexdigest())
                now, digest = k, hashlib.sha256()
            digest.update(text.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(out, pa.string())})
    if digest:
        yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})


def prefix_trie(built: DataFrame, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of ``built(conv_id, turns)``, one row per id: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of the
    subtree, ends_sha256."""
    built = stored(built)
    runs = built.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    partial = stored(
        runs.mapInArrow(
            _partial_nodes(shard, shard_turns),
            "key binary, parent_key binary, depth long, conv_id long, n_convs long, size long, total long, first long, ends string",
        )
    )
    nodes = stored(
        partial.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
            F.sum("n_convs").alias("n_convs"), F.sum("total").alias("total"),
        )
    )
    children = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    placed = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    owners = placed.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.bool_or(F.col("n_children") == 0).alias("leaf"))
    sums = (
        built.join(owners, "conv_id", "left")
        .sortWithinPartitions("conv_id")  # the first member of a shard is its smallest
        .mapInArrow(_partial_sums(shard, shard_turns), "key binary, own long, n_leaves long")
        .groupBy("key")
        .agg(F.sum("own").alias("own"), F.sum("n_leaves").alias("n_leaves"))
    )
    ends = (
        partial.where("ends IS NOT NULL").select("key", "first", "ends")
        .repartition("key").sortWithinPartitions("key", "first").mapInArrow(_ends_digests, "key binary, ends_sha256 string")
    )
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return salted_lookup(placed.join(sums, "key").join(ends, "key", "left"), ["parent_key"], above).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


# The same table as SQL. The CRC is written out; a node is the joined digests of its turns.
ORACLE = r"""
WITH t AS (SELECT conv_id AS c, role, text, strlen(coalesce(text, '')) AS b, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, b, g, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS p FROM t),
i AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
                    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)),
                4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT i.c, o.p, b, g FROM i JOIN o ON o.c = i.c - i.c % 5 AND o.p <= i.h UNION ALL SELECT i.c, o.p, b, g FROM i JOIN o ON o.c = i.c AND o.p > i.h),
pre AS (SELECT c, row_number() OVER w AS d, b, md5(string_agg(g, '') OVER w) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY p) UNION ALL SELECT c, 0, 0, '' FROM i),
n AS (SELECT d, k, min(c) AS m, count(*) AS n_convs, any_value(b) AS b FROM pre GROUP BY d, k),
up AS (SELECT n.d, n.k, q.k AS parent FROM n JOIN pre q ON q.c = n.m AND q.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM up GROUP BY ALL),
s AS (SELECT a.d, a.k, sum((n_convs - 1) * n.b) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
      FROM n LEFT JOIN kids USING (d, k) JOIN pre a ON a.c = n.m AND a.d <= n.d GROUP BY ALL),
z AS (SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM pre JOIN (SELECT c, max(d) AS d FROM pre GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, pn.m AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM n JOIN s USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN z USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN n pn ON pn.d = n.d - 1 AND pn.k = up.parent
"""
