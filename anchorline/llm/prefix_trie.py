"""The prefix trie of conversations, from neighbours in sorted order.

Each conversation is one row: its key, 16 bytes of a digest for each turn, and the code points of each turn's text.
Rows are sorted by key in ranges, also inside a group of equal keys, and cut into blocks of bounded size.  In
a block, neighbours are linked by the number of first turns that they share (LCP).  A union-find takes these links
in descending depth: whenever components merge, that is a branching node, and the component holds its members.
The nodes in between follow from the same components, since nothing merges there.

A block's forest is contracted to what can go on outside of it: the nodes on the paths to its first and its last
key.  All others are complete.  Open nodes of different blocks are one node if their prefix has the same digest; their
counts are added, and what they add to the nodes above them is summed up along one path each.

In memory: one block (BLOCK_TURNS turns and, at most, one conversation more).  Member lists are hashed in the order of
ids, as pieces of bounded size where a node goes on over several blocks.

Defined results: a null role or text counts as empty; turns are ordered by turn (null first), then by a digest of role
and text; repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; a
conversation without turns ends at the root; no conversation, no node.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorline.llm.common import materialize, table

#: Turns and conversations of a block; ids in a piece of a member list.
BLOCK_TURNS, BLOCK_ROWS, PIECE_IDS = 400_000, 100_000, 4_096
DIGEST = 16
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_FOREST = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("side", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string()),
])
_DDL = "kind string, block long, side int, depth long, conv_id long, parent_conv_id long, node binary, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string"


def turn_digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits for a turn's role and text."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, digests and sizes (code points of the text) of its turns, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).alias("size")).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes"))


def with_shared_heads(found: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c anew: the first h turns of conversation c - c % group, then its own after its first h; h = crc32(decimal c) % most."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = found.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), *[F.slice(c, 1, most - 1).alias(f"__{c}") for c in ("digests", "sizes")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")

    def rebuilt(c: str, kind: str) -> Column:
        head = F.slice(F.coalesce(f"__{c}", F.array().cast(f"array<{kind}>")), F.lit(1), h)
        return F.concat(head, F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c)

    return found.withColumn("__at", base).join(heads, F.col("__at") == F.col("__base"), "left").select("conv_id", rebuilt("digests", "string"), rebuilt("sizes", "int"))


def in_key_order(found: DataFrame, *further: str) -> DataFrame:
    """Rows with their key (digests and sizes as given by ``sequences``), sorted by key and id in ranges of both."""
    keyed = found.select("conv_id", F.unhex(F.array_join("digests", "")).alias("key"), *further)
    return keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")


def shared_turns(offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """LCP in turns of each row with the row before it (0 for the first one); offsets in turns, two words a turn."""
    depth = np.diff(offsets)
    shorter = np.minimum(depth[1:], depth[:-1])
    out = np.zeros(len(depth), np.int64)
    if shorter.sum():
        at = np.cumsum(shorter) - shorter
        within = np.arange(int(shorter.sum())) - np.repeat(at, shorter)
        a, b = np.repeat(offsets[:-2], shorter) + within, np.repeat(offsets[1:-1], shorter) + within
        same = (words[a] == words[b]).all(1)
        differs = np.where(same, np.iinfo(np.int64).max, within)
        some = shorter > 0
        out[1:][some] = np.minimum(np.minimum.reduceat(differs, at[some]), shorter[some])
    return out


class Forest:
    """Nodes of depth 1 or more over distinct sorted keys, by union-find over the links to the key before.

    Node k is the prefix of length ``depth[k]`` of key ``first[k]``, the first one that has it; its members are the keys first[k] to
    stop[k] - 1.  Nodes stand in depth-first order.  ``above[i]`` is the key whose component key i joined, ``joins[k]`` the number of components that merged at node k.
    """

    def __init__(self, depths: np.ndarray, lcp: np.ndarray, least: np.ndarray):
        n = len(depths)
        self.depths, self.lcp = depths, lcp
        own = depths - lcp
        self.begin = np.cumsum(own) - own
        self.first = np.repeat(np.arange(n), own)
        self.depth = np.arange(int(own.sum())) - self.begin[self.first] + lcp[self.first] + 1
        self.stop, self.least = np.empty(len(self.first), np.int64), np.empty(len(self.first), np.int64)
        self.above, self.joins = np.zeros(n, np.int64), np.zeros(len(self.first), np.int64)
        parent, stop, least = np.arange(n), np.arange(1, n + 1), least.copy()
        deepest_first = np.argsort(-self.depth, kind="stable")
        descending = -self.depth[deepest_first]
        links = 1 + np.argsort(-lcp[1:], kind="stable")
        levels, at = np.unique(-lcp[links], return_index=True)
        cuts = [*at.tolist(), len(links)]
        done = 0
        for k, level in enumerate((-levels).tolist()):
            if level < 1:
                break
            # nodes deeper than this level: their components are as they are now
            done = self._record(deepest_first, done, int(np.searchsorted(descending, -level, "left")), stop, least)
            merge = links[cuts[k] : cuts[k + 1]]
            left = self._find(parent, merge - 1)
            # links of one level that follow each other all join the first one's component
            new = np.r_[True, left[1:] != merge[:-1]]
            top = left[new][np.cumsum(new) - 1]
            parent[merge] = top
            np.maximum.at(stop, top, stop[merge])
            np.minimum.at(least, top, least[merge])
            self.above[merge] = top
            np.add.at(self.joins, self.begin[top] + level - lcp[top] - 1, 1)
        self._record(deepest_first, done, len(self.first), stop, least)

    def _record(self, order: np.ndarray, done: int, end: int, stop: np.ndarray, least: np.ndarray) -> int:
        now = order[done:end]
        self.stop[now], self.least[now] = stop[self.first[now]], least[self.first[now]]
        return end

    @staticmethod
    def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
        root = parent[x]
        while True:
            further = parent[root]
            if (further == root).all():
                parent[x] = root
                return root
            root = parent[further]

    def node(self, key: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The place of a node by its first key."""
        return self.begin[key] + depth - self.lcp[key] - 1

    def parents(self) -> np.ndarray:
        """Of each node the place of the node above; -1 is the root."""
        inner = self.depth - 1 > self.lcp[self.first]
        up = np.where(inner, self.first, self.above[self.first])
        return np.where(self.depth == 1, -1, self.node(up, self.depth - 1))

    def children(self) -> np.ndarray:
        return self.joins + (self.depth < self.depths[self.first])


def _prefixes(key: bytes) -> list[bytes]:
    """Digests of all prefixes of a key, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()[:DIGEST]]
    for k in range(0, len(key), DIGEST):
        h.update(key[k : k + DIGEST])
        out.append(h.copy().digest()[:DIGEST])
    return out


def _block_forest(block: int, key: pa.Array, ids: np.ndarray, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The forest of a block: complete nodes, and the open ones on the paths to its first and last key."""
    offsets = np.frombuffer(key.buffers()[1], np.int32 if pa.types.is_binary(key.type) else np.int64)[key.offset : key.offset + len(key) + 1].astype(np.int64)
    data = key.buffers()[2]
    words = np.frombuffer(data, np.uint64, (len(data) // 8 // 2) * 2).reshape(-1, 2) if data is not None and len(data) >= DIGEST else np.zeros((0, 2), np.uint64)
    offsets //= DIGEST
    lcp, depth = shared_turns(offsets, words), np.diff(offsets)
    new = np.r_[True, (lcp[1:] < depth[1:]) | (lcp[1:] < depth[:-1])]
    rows = np.flatnonzero(new)
    cut = np.r_[rows, len(ids)]
    least = ids[rows]
    forest = Forest(depth[rows], lcp[rows], least)
    n, first, stop, down = len(rows), forest.first, forest.stop, forest.depth
    members = cut[stop] - cut[first]
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = flat[offsets[rows][first] + down - 1]
    children, parents = forest.children(), forest.parents()
    open_ = (first == 0) | (stop == n)
    own = np.where(open_, 0, (members - 1) * size)
    leaf = np.where(open_, 0, children == 0).astype(np.int64)

    def below(value: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree: the rest of its first key's own nodes, and all of those of the keys after it."""
        total = np.r_[0, np.cumsum(value)]
        ends = np.r_[forest.begin, len(first)]
        return total[ends[stop]] - total[: len(first)]

    saved, leaves = below(own), below(leaf)
    text_ids = list(map(str, ids.tolist()))
    end = forest.node(np.arange(n), depth[rows])
    ends = np.full(len(first), NO_MEMBERS, object)
    pieces: list[tuple[bytes, str]] = []
    last = n - 1
    raw = lambda i: key[int(rows[i])].as_py()
    path_of = {0: _prefixes(raw(0)), last: _prefixes(raw(last))}
    for i in range(n):
        mine = text_ids[cut[i] : cut[i + 1]]
        if depth[rows[i]] and not open_[end[i]]:
            ends[end[i]] = hashlib.sha256(",".join(mine).encode()).hexdigest()
        else:
            name = path_of[0 if i == 0 else last][int(depth[rows[i]])]
            pieces.extend((name, ",".join(mine[k : k + PIECE_IDS])) for k in range(0, len(mine), PIECE_IDS))

    def batch(m: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in _FOREST], schema=_FOREST)

    closed = np.flatnonzero(~open_)
    if len(closed):
        up = parents[closed]
        beneath_open = (up < 0) | open_[up]
        names = [None] * len(closed)
        for k in np.flatnonzero(beneath_open).tolist():
            p = int(up[k])
            names[k] = path_of[0][0] if p < 0 else path_of[0 if first[p] == 0 else last][int(down[p])]
        yield batch(
            len(closed), kind=["node"] * len(closed), block=np.full(len(closed), block), depth=down[closed], conv_id=forest.least[closed], parent_conv_id=pa.array(forest.least[np.maximum(up, 0)], mask=beneath_open), parent=names,
            n_convs=members[closed], n_children=children[closed], n_leaves=leaves[closed], saved_tokens=saved[closed], size=size[closed], ends=ends[closed].tolist(),
        )
    # open nodes, by path; the root is node -1
    inner = np.bincount(parents[closed] + 1, minlength=len(first) + 1)
    listed: set[int] = set()
    rows_out: list[tuple] = []
    for side, i in enumerate((0, last)):
        names = path_of[i]
        chain = [-1, *(np.arange(forest.begin[0], forest.begin[0] + depth[rows[0]]).tolist() if side == 0 else np.flatnonzero(stop == n).tolist())]
        for d, k in enumerate(chain):
            above = names[d - 1] if d else None
            if k in listed:
                rows_out.append((side, d, names[d], above, None, 0, 0, 0, 0, 0))
            elif k < 0:
                rows_out.append((side, d, names[d], above, int(least.min()), len(ids), int(inner[0]), int(leaf.sum()), int(own.sum()), 0))
            else:
                rows_out.append((side, d, names[d], above, int(forest.least[k]), int(members[k]), int(inner[k + 1]), int(leaves[k]), int(saved[k]), int(size[k])))
            listed.add(k)
    side, d, name, above, conv, convs, kids, leaf_sum, saved_sum, length = zip(*rows_out, strict=True)
    yield batch(len(rows_out), kind=["open"] * len(rows_out), block=[block] * len(rows_out), side=side, depth=d, node=name, parent=above, conv_id=conv, n_convs=convs, n_children=kids, n_leaves=leaf_sum, saved_tokens=saved_sum, size=length)
    if pieces:
        yield batch(len(pieces), kind=["ends"] * len(pieces), block=[block] * len(pieces), depth=range(len(pieces)), node=[p for p, _ in pieces], ends=[t for _, t in pieces])


def blocks_of(batches: Iterator[pa.RecordBatch], rows: int, turns: int) -> Iterator[tuple[int, pa.Table]]:
    """Numbered runs of sorted rows with about ``turns`` turns each; the number orders the runs of all tasks."""
    held: list[pa.RecordBatch] = []
    have, number = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        at = 0
        per_row = np.diff(batch.column("sizes").offsets.to_numpy()).astype(np.int64) + 1
        total = np.r_[0, np.cumsum(per_row)]
        while at < batch.num_rows:
            room = max(1, int(np.searchsorted(total, total[at] + turns - have, "right")) - 1 - at)
            part = batch.slice(at, min(room, rows - sum(b.num_rows for b in held)))
            held.append(part)
            have += int(total[at + part.num_rows] - total[at])
            at += part.num_rows
            if have >= turns or sum(b.num_rows for b in held) >= rows or at < batch.num_rows:
                yield number, pa.Table.from_batches(held)
                held, have, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held)


def _forests(batches: Iterator[pa.RecordBatch], rows: int, turns: int) -> Iterator[pa.RecordBatch]:
    for number, block in blocks_of(batches, rows, turns):
        block = block.combine_chunks()
        whole = [block.column(c).combine_chunks() for c in ("key", "conv_id", "sizes")]
        key, ids, sizes = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in whole]
        yield from _block_forest(number, key, ids.to_numpy(zero_copy_only=False), sizes)


def _digest_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node; the pieces come in order, and none is kept."""
    node, running = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for name, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != node:
                if running:
                    out.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pa.record_batch([pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["node", "ends_sha256"])
    if running:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def trie_nodes(found: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """All nodes of the trie over rows of conv_id (distinct), digests and sizes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    forest = materialize(in_key_order(found, "sizes").mapInArrow(lambda batches: _forests(batches, block_rows, block_turns), _DDL), "prefix-forest")
    open_ = forest.where("kind = 'open'").select("block", "side", "depth", "node", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")
    merged = open_.groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min(F.struct("block", "side")).alias("owner"), F.max("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    among = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("__open_children"))
    merged = merged.join(among, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("__open_children", F.lit(0))).drop("__open_children")
    merged = materialize(merged, "prefix-open")
    # what a node itself adds stands once, on one path to it, and counts for all nodes above on this path
    adds = merged.select(F.col("owner.block").alias("block"), F.col("owner.side").alias("side"), "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    upward = Window.partitionBy("block", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    paths = open_.select("block", "side", "depth", "node").join(adds, ["block", "side", "depth"], "left")
    sums = paths.select("node", *[F.sum(F.coalesce(c, F.lit(0))).over(upward).alias(c) for c in ("own", "leaf")]).groupBy("node").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    pieces = forest.where("kind = 'ends'").select("node", "block", "depth", "ends").repartition("node").sortWithinPartitions("node", "block", "depth")
    digests = pieces.select("node", "ends").mapInArrow(_digest_members, "node binary, ends_sha256 string")
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    opened = merged.join(sums, "node").join(digests, "node", "left").join(names, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256")
    )
    closed = forest.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    inside = closed.where("parent is null").select(opened.columns)
    # a block names at most its own nodes here, so no name is hotter than a block
    known = open_.select("block", F.col("node").alias("parent")).distinct().join(names, "parent")
    beneath = closed.where("parent is not null").drop("parent_conv_id").join(known, ["block", "parent"]).select(opened.columns)
    return inside.unionByName(beneath).unionByName(opened)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(with_shared_heads(sequences(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = """
with recursive crc_table as (
  select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, _k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, x)) t),
ids as (select distinct conv_id c from conversations where conv_id is not null),
heads as (
  select c, c - c % 100 base,
         xor(list_reduce(list_transform(string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint)),
                         lambda r, b: xor(r // 256, t[cast(xor(r, b) % 256 as integer) + 1]), cast(4294967295 as bigint)), 4294967295) % 6 h
  from ids, crc_table),
turns as (
  select conv_id c, coalesce(role, '') role, coalesce(text, '') txt,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p
  from conversations where conv_id is not null),
parts as (
  select h.c, 0 piece, t.p, t.role, t.txt from heads h join turns t on t.c = h.base and t.p <= h.h
  union all
  select h.c, 1, t.p, t.role, t.txt from heads h join turns t on t.c = h.c and t.p > h.h),
rebuilt as (select c, role, txt, row_number() over (partition by c order by piece, p) d from parts),
chained as (
  select c, d, length(txt) len, sha256(string_agg(sha256(concat(length(role), ':', role, txt)), '') over (partition by c order by d rows unbounded preceding)) node from rebuilt
  union all
  select c, 0, 0, sha256('') from ids),
placed as (
  select c, d, len, node, min(c) over (partition by d, node) rep, lag(node) over (partition by c order by d) up, max(d) over (partition by c) dmax from chained),
nodes as (
  select d, node, min(c) conv_id, any_value(up) up, count(*) n_convs, max(len) len,
         sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where d = dmax), '')) ends_sha256
  from placed group by d, node),
kids as (select d - 1 d, up node, count(*) n from nodes where d > 0 group by 1, 2),
full_nodes as (
  select n.*, coalesce(k.n, 0) n_children from nodes n left join kids k on k.d = n.d and k.node = n.node),
upward as (
  select p.d, p.node, sum(case when f.conv_id = p.c then (f.n_convs - 1) * f.len else 0 end) over w saved,
         sum(case when f.conv_id = p.c and f.n_children = 0 then 1 else 0 end) over w leaves
  from placed p join full_nodes f on f.d = p.d and f.node = p.node
  window w as (partition by p.c order by p.d desc rows unbounded preceding)),
sums as (select d, node, sum(saved) saved, sum(leaves) leaves from upward group by d, node)
select f.conv_id, f.d depth, u.conv_id parent_conv_id, f.n_convs, f.n_children, cast(s.leaves as bigint) n_leaves, cast(s.saved as bigint) saved_tokens, f.ends_sha256
from full_nodes f join sums s on s.d = f.d and s.node = f.node left join full_nodes u on u.d = f.d - 1 and u.node = f.up
"""
