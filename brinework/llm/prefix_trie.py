"""The trie of all prefixes of conversations. Conversations become sequences of turn digests; equal sequences are one, and
distinct ones are sorted over all blocks of a range partitioning. In the array of longest common prefixes (LCP) of
neighbours, the nearest smaller values on both sides bound each node's interval: the Cartesian tree of the array, in which
nodes of one interval and equal LCP are merged and the depths between a node and its parent are put back. All figures of a
node are sums and minima over its interval.

Blocks work at the same time. A value that has no smaller one on a side of its own block goes on beyond that edge, as deep
as the LCP across the edge, through each block whose minimum isn't smaller and into the first whose minimum is. Blocks give
such open nodes as partial sums, two spines each, and a window over each depth joins them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm.common import cut

#: Bytes of a turn's digest; turns of a block, about; conversation ids of one range that are listed in one row.
WIDTH, BLOCK_TURNS, CHUNK = 16, 250_000, 4096

_NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What a block gives for each node or part of one; ``x - n_convs * above - y`` is what sharing the subtree's texts saves.
_NODES = """block int, depth long, open_left boolean, open_right boolean, conv_id long, n_convs long, n_children long,
n_leaves long, x long, above long, y long, ends string, parent_conv_id long, parent_side string"""


def sequences(conversations: DataFrame, together: Column | None = None) -> DataFrame:
    """(conv_id, together, turns): each conversation's turns in order, as structs of ``key`` (a digest of role and text) and
    ``size`` (UTF-8 bytes of the text). Turns of a conversation stand by ``turn``, null first, equal ones by digest; a null
    role or text is empty; rows without a conv_id belong to none. ``together``: what rows are shuffled by, so that
    conversations with one value of it are in one task; the conv_id if not given."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), (together if together is not None else F.col("conv_id")).alias("together"),
        F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("key"), F.octet_length(text).cast("long").alias("size")).alias("turn"),
    )
    listed = turns.repartition("together").groupBy("together", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", "together", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns), where each conversation c begins with the first h turns of conversation ``c - c % every``, h being
    the crc32 of c's decimal digits modulo ``most``, and goes on with its own turns after its first h."""
    listed = sequences(conversations, F.col("conv_id").cast("long") - F.col("conv_id").cast("long") % every)
    heads = F.when(F.col("conv_id") == F.col("together"), F.slice("turns", 1, most - 1))
    with_head = listed.withColumn("head", F.max(heads).over(Window.partitionBy("together")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    return with_head.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """How many digests two paths have in common from the start."""
    n = F.least(F.length(a), F.length(b)) / WIDTH

    def unit(path, i):
        return path.substr(((i - 1) * WIDTH + 1).cast("int"), F.lit(WIDTH))

    first_other = F.array_position(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: unit(a, i) == unit(b, i)), False)
    return F.when(n < 1, 0).when(first_other == 0, n).otherwise(first_other - 1).cast("long")


def _nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each position but the ends, the nearest position with a smaller value on the left and on the right. The ends
    hold values smaller than all others."""
    left, right, open_ = [0] * len(values), [0] * len(values), [0]
    for i in range(1, len(values)):
        v = values[i]
        while values[open_[-1]] > v:
            right[open_.pop()] = i
        left[i] = left[open_[-1]] if values[open_[-1]] == v else open_[-1]
        open_.append(i)
    return left, right


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair, from the minima of runs of 1, 2, 4, ... values."""
    level, out, steps = values, np.empty(len(low), values.dtype), np.log2(high - low).astype(np.int64)
    for s in range(int(steps.max(initial=0)) + 1):
        at = np.flatnonzero(steps == s)
        out[at] = np.minimum(level[low[at]], level[high[at] - (1 << s)])
        level = np.minimum(level[: -(1 << s)], level[1 << s :]) if len(level) > 1 << s else level
    return out


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _block(block: int, paths: list[bytes], sizes: list[np.ndarray], n: list[int], least: list[int], ends: list[str], before: int, after: int) -> pa.RecordBatch:
    """Nodes of the trie of a block's sorted distinct sequences; ``before`` and ``after`` are the LCPs across its edges."""
    m, n, least = len(paths), np.array(n, np.int64), np.array(least, np.int64)
    depth = np.array([len(p) // WIDTH for p in paths], np.int64)
    start = _offsets(depth)
    units = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, WIDTH // 8)
    held = _offsets(np.concatenate(sizes))

    def bytes_to(k, d):
        """Bytes of sequence k's texts down to depth d."""
        return held[start[k] + np.maximum(d, 0)] - held[start[k]]

    # LCPs of neighbours: the first place of their shorter length where they differ
    short = np.minimum(depth[:-1], depth[1:])
    at = _offsets(short)
    place = np.arange(at[-1]) - np.repeat(at[:-1], short)
    other = (units[np.repeat(start[:-2], short) + place] != units[np.repeat(start[1:-1], short) + place]).any(axis=1)
    lcp, some = short.copy(), np.flatnonzero(short)
    if len(some):
        lcp[some] = np.minimum.reduceat(np.where(other, place, np.iinfo(np.int64).max), at[:-1][some])
        lcp = np.minimum(lcp, short)
    alone, real = np.concatenate([[-1], lcp, [-1]]), np.concatenate([[before], lcp, [after]])

    # intervals: merged nodes of the Cartesian tree, and single sequences that go deeper than their neighbours
    left, right = (np.array(x[1:-1], np.int64) for x in _nearest_smaller(alone.tolist()))
    _, first, which, joins = np.unique(left * (m + 1) + right, return_index=True, return_inverse=True, return_counts=True)
    single = np.flatnonzero(depth > np.maximum(alone[:-1], alone[1:]))
    low, high = np.concatenate([left[first], single]), np.concatenate([right[first], single + 1])
    bottom = np.concatenate([lcp[first], depth[single]])
    joins = np.concatenate([joins, np.zeros(len(single), np.int64)])
    top = np.maximum(alone[low], alone[high])
    edge = np.where(alone[low] >= alone[high], low, high)
    # the interval above is that of the LCP at the edge; the root's has none, and is its own here
    above = np.where(top >= 0, which[np.clip(edge - 1, 0, max(m - 2, 0))], np.arange(len(low))) if m > 1 else np.zeros(len(low), np.int64)

    # a node for each depth from below the interval above down to its own
    reps = bottom - top
    of = np.repeat(np.arange(len(low)), reps)
    d = np.repeat(top + 1, reps) + np.arange(reps.sum()) - np.repeat(_offsets(reps)[:-1], reps)
    lo, hi = low[of], high[of]

    def opened(lo, hi, d):
        return (lo == 0) & (d <= before), (hi == m) & (d <= after)

    open_left, open_right = opened(lo, hi, d)
    total = bytes_to(np.arange(m), depth)
    counts, x = _offsets(n), _offsets(n * total)
    leaves = _offsets(depth > real[1:])
    made = _offsets(total - bytes_to(np.arange(m), real[:-1]))
    y = made[hi] - made[lo + 1] + total[lo] - bytes_to(lo, np.where(lo == 0, np.maximum(d - 1, before), d - 1))
    goes_on = (d < depth[lo]) & ~((lo == 0) & (d + 1 <= before))
    children = np.where(d == bottom[of], joins[of], 0) + goes_on
    ended = np.array(ends, dtype=object)[lo]
    ended[(depth[lo] != d) | open_left] = None
    smallest = _range_least(least, low, high)
    parent = np.where(d > top[of] + 1, of, above[of])
    left_too, right_too = opened(low[parent], high[parent], d - 1)
    side = np.where(d == 0, None, np.where(left_too, "head", np.where(right_too, "tail", None)))
    known = (d > 0) & ~left_too & ~right_too
    data = [np.full(len(d), block), d, open_left, open_right, smallest[of], counts[hi] - counts[lo], children, leaves[hi] - leaves[lo], x[hi] - x[lo], bytes_to(lo, d - 1), y]
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 7]
    arrays = [pa.array(v, type=t) for v, t in zip(data, types)]
    arrays += [pa.array(ended, type=pa.string()), pa.array(smallest[parent], mask=~known, type=pa.int64()), pa.array(side, type=pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _NODES.replace("\n", " ").split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each block of sorted rows. Rows of one path follow each other with ascending lists of ids, which go into
    one running digest."""
    rows: tuple[list, ...] = ([], [], [], [], [])
    digest, edges = None, None

    def done():
        if digest is not None:
            rows[4].append(digest.hexdigest())
            yield _block(edges[0], *rows, *edges[1:])

    for batch in batches:
        for block, path, sizes, n, least, ids, before, after in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if edges is not None and edges[0] == block and rows[0][-1] == path:
                rows[2][-1] += n
                rows[3][-1] = min(rows[3][-1], least)
                digest.update(b"," + ids.encode())
                continue
            if edges is not None and edges[0] != block:
                yield from done()
                for part in rows:
                    part.clear()
            elif digest is not None:
                rows[4].append(digest.hexdigest())
            edges, digest = (block, before, after), hashlib.sha256(ids.encode())
            for part, value in zip(rows, (path, np.array(sizes, np.int64), n, least)):
                part.append(value)
    yield from done()


def trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each distinct sequence of first turns of ``conversations`` (conv_id, turns as of ``sequences``; conv_ids
    are distinct), the empty one at depth 0 included: conv_id (smallest member), depth, parent_conv_id (the parent's; null for
    the root), n_convs (members), n_children, n_leaves (childless nodes in the subtree, itself included), saved_tokens
    (over the subtree, members but one times bytes of the node's last text) and ends_sha256 (digest of the ascending,
    comma-joined ids of members that end there). Conversations without turns are members of the root. An empty input has
    no node.

    A path (16 bytes for a turn) is one value. Equal paths are first counted by ranges of ids, so that a very common
    conversation fills no task; its list of ids passes through one task in turn, as a digest is made of it, and is never
    held whole. Two conversations are taken as equal where 128 bits of sha256 of each turn are."""
    hexed = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    paths = conversations.select("conv_id", F.unhex(hexed).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = cut(
        paths.groupBy("path", F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk"))
        .agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    )
    turns = chunks.agg(F.sum(F.length("path") / WIDTH + 1)).first()[0] or 0
    placed = chunks.repartitionByRange(max(1, ceil(turns / block_turns)), "path").sortWithinPartitions("path", "chunk")
    blocks = cut(placed.withColumn("block", F.spark_partition_id()))

    ends = blocks.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    row = Window.partitionBy(F.lit(0)).orderBy("block")  # a row for each block
    around = ends.select("block", "first", "last", F.lag("last").over(row).alias("earlier"), F.lead("first").over(row).alias("later"))
    across = around.select("block", *(F.coalesce(F.when(b.isNotNull(), _common(a, b)), F.lit(-1)).cast("long").alias(k) for a, b, k in ((F.col("first"), F.col("earlier"), "before"), (F.col("last"), F.col("later"), "after"))))
    # three numbers for each block are broadcast; the blocks stay where they are
    rows = blocks.join(F.broadcast(across), "block").select("block", "path", "sizes", "n", "least", "ids", "before", "after", "chunk")
    nodes = cut(rows.sortWithinPartitions("block", "path", "chunk").mapInArrow(_blocks, _NODES))

    # open nodes: one run of blocks at a depth for each, begun by a part that isn't open on the left
    start = ~F.col("open_left")
    along = Window.partitionBy("depth").orderBy("block", start)
    parts = nodes.where("open_left or open_right").withColumn("run", F.sum(start.cast("long")).over(along))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "x", "y")]
    begun = F.max(F.when(start, F.struct("block", "parent_side")))
    whole = parts.groupBy("depth", "run").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("above").alias("above"), F.max("ends").alias("ends"), begun.alias("begun"))
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "x", "y", "above", "ends"]
    whole = whole.select(*names, F.lit(None).cast("long").alias("parent_conv_id"), F.col("begun.block").alias("block"), F.col("begun.parent_side").alias("parent_side"))
    found = nodes.where("not open_left and not open_right").select(*names, "parent_conv_id", "block", "parent_side").unionByName(whole)
    parents = parts.select("block", F.when(start, "tail").otherwise("head").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.min("conv_id").over(Window.partitionBy("depth", "run")).alias("_parent"))
    linked = found.where("parent_side is not null").join(parents, ["block", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    saved = (F.col("x") - F.col("n_convs") * F.col("above") - F.col("y")).alias("saved_tokens")
    return found.where("parent_side is null").unionByName(linked).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))


def oracle(every: int = 5, most: int = 9) -> str:
    """DuckDB SQL of ``trie(rebuilt(conversations))``; the crc32 is worked out bit by bit."""
    return rf"""
WITH t AS (
  SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM (
    SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b
    FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (
  SELECT conv_id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(s) + 1),
      lambda i: list_transform(range(0, 8), lambda j: CAST((ascii(substr(s, CAST(i AS INTEGER), 1)) >> CAST(j AS INTEGER)) & 1 AS BIGINT))))),
    lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)) AS c
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
h AS (SELECT conv_id, conv_id - conv_id % {every} AS base, xor(c, 4294967295) % {most} AS h FROM bits),
r AS (
  SELECT h.conv_id, t.i, t.k, t.b FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h
  UNION ALL SELECT h.conv_id, t.i + 1000000000, t.k, t.b FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, k, b FROM r),
p AS (SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, b FROM s),
q AS (SELECT conv_id, d, path, b FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM h),
m AS (SELECT conv_id, max(d) AS len FROM q GROUP BY conv_id),
n AS (
  SELECT path, d, min(q.conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b,
    coalesce(string_agg(CAST(q.conv_id AS VARCHAR), ',' ORDER BY q.conv_id) FILTER (WHERE d = len), '') AS ends
  FROM q JOIN m ON m.conv_id = q.conv_id GROUP BY path, d),
c AS (SELECT u.path, count(v.path) AS n_children FROM n u LEFT JOIN n v ON v.d = u.d + 1 AND substr(v.path, 1, CAST(64 * u.d AS INTEGER)) = u.path GROUP BY u.path),
z AS (
  SELECT u.path, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.b) AS saved
  FROM n u JOIN n v ON v.d >= u.d AND substr(v.path, 1, CAST(64 * u.d AS INTEGER)) = u.path JOIN c ON c.path = v.path GROUP BY u.path)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, c.n_children, CAST(z.n_leaves AS BIGINT) AS n_leaves,
  CAST(z.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN c ON c.path = n.path JOIN z ON z.path = n.path
  LEFT JOIN n a ON a.d = n.d - 1 AND a.path = substr(n.path, 1, CAST(64 * (n.d - 1) AS INTEGER)) AND n.d > 0
"""
