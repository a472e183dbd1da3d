"""Trie of conversation prefixes, by union-find over the edges between sorted neighbours.

Conversations become strings of 16-byte turn keys. Equal strings are one, and the distinct ones are sorted
by ranges. Two neighbours share as many turns as their longest common prefix (LCP) says; joining neighbours
by descending LCP makes a branching node with every merge, and the turns between two such nodes are nodes
with one child.

A block of the sorted strings gives a forest of its own. Only prefixes of a block's first and last string
can have members in other blocks. They are contracted to rows keyed by their digest, corrected by what
neighbouring blocks share, and added up across blocks; everything else is final where it was made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage
from telemetry_ops.llm.text import column, small_batches

#: Bytes of a turn's key, of the strings of a block, and of one stretch of conversation ids.
KEY, BLOCK_BYTES, STRETCH_BYTES = 16, 16 << 20, 1 << 20
#: Conversations share the first turns of the one that opens their hundred.
SHARED, HEADS = 100, 6
NOBODY = hashlib.sha256(b"").hexdigest()
SPINE_BYTES = 400

STRINGS = "conv_id long, keys binary, chars array<long>"
_STRINGS = pa.schema([("conv_id", pa.int64()), ("keys", pa.binary()), ("chars", pa.list_(pa.int64()))])
STRETCHES = "string binary, first long, no_id boolean, ids string, n long"
ENDS = "string binary, conv_id long, n_convs long, ends_sha256 string"

#: ``block`` and ``place`` order the blocks; ``parent_prefix`` names a parent that other blocks may share.
NODES = (
    "kind string, block long, place long, prefix binary, parent_prefix binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, on_left boolean, on_right boolean, "
    "tokens long, first binary, last binary"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_NODES = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in NODES.split(", "))])


# ---------------------------------------------------------------- rebuilding


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of hundred, opening conversation first, conversation and turn to one string each."""
    base, head, head_chars, opened = object(), b"", [], None
    current, keys, chars, opens, h = object(), bytearray(), [], False, 0
    done, held = [], 0

    def close():
        nonlocal head, head_chars
        whole = bytes(keys), list(chars)
        if opens:
            head, head_chars = whole[0][: KEY * HEADS], whole[1][:HEADS]
        return {"conv_id": current, "keys": head[: KEY * h] + whole[0][KEY * h :], "chars": head_chars[:h] + whole[1][h:]}

    for batch in batches:
        names = ("base", "conv_id", "opens", "h", "key", "chars")
        for b, c, o, n, key, size in zip(*(column(batch, name) for name in names)):
            if (b, c) != (base, current):
                if opened:
                    done.append(close())
                    held += len(done[-1]["keys"])
                if b != base:
                    head, head_chars = b"", []
                base, current, opens, h, opened = b, c, o, n, True
                keys.clear(), chars.clear()
            keys += key
            chars.append(size)
        if done and held > 1 << 20:
            yield pa.RecordBatch.from_pylist(done, _STRINGS)
            done, held = [], 0
    if opened:
        done.append(close())
    if done:
        yield pa.RecordBatch.from_pylist(done, _STRINGS)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``STRINGS`` per conversation: keys and code points of its rebuilt turns, in order.

    A turn's key is the head of a SHA-256 digest of role and text, so texts are not shuffled, only some 60
    bytes a turn. A hundred's conversations lie together, the one that opens it first, and stream by.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(
        (conv - conv % SHARED).alias("base"), conv.alias("conv_id"), (conv % SHARED == 0).alias("opens"),
        (F.crc32(F.coalesce(conv.cast("string"), F.lit("")).cast("binary")) % HEADS).alias("h"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("whole"),
        F.length(text).cast("long").alias("chars"),
    )
    rows = rows.withColumn("key", F.substring("whole", 1, KEY)).drop("whole")
    order = ["base", F.desc_nulls_last("opens"), "conv_id", F.asc_nulls_first("turn"), "key"]
    return small_batches(rows).repartition("base").sortWithinPartitions(*order).mapInArrow(_rebuild, STRINGS)


# ---------------------------------------------------------------- ends


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order of string and id to stretches of one string, joined by commas."""
    names = [f.split()[0] for f in STRETCHES.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
    current, first, none, ids, size, done, out = None, None, False, [], 0, [], 0

    def close():
        return (current, first, none, ",".join(ids), len(ids))

    for batch in batches:
        for string, conv in zip(column(batch, "string"), column(batch, "conv_id")):
            if string != current or size > STRETCH_BYTES:
                if ids:
                    done.append(close())
                    out += size + 60
                current, first, none, ids, size = string, conv, conv is None, [], 0
            first = conv if first is None else first
            ids.append("" if conv is None else str(conv))
            size += len(ids[-1]) + 1
        if out > STRETCH_BYTES:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
            done, out = [], 0
    if ids:
        done.append(close())
    if done:
        yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [f.split()[0] for f in ENDS.split(", ")], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    current, done = None, []
    for batch in batches:
        for string, first, ids, n in zip(*(column(batch, c) for c in ("string", "first", "ids", "n"))):
            if current and current[0] == string:
                current[2] += n
                current[3].update(b"," + ids.encode())
                current[1] = first if current[1] is None else current[1]
            else:
                if current:
                    done.append((*current[:3], current[3].hexdigest()))
                current = [string, first, n, hashlib.sha256(ids.encode())]
        if len(done) > 4096:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
            done = []
    if current:
        done.append((*current[:3], current[3].hexdigest()))
        yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)


def _ended(strings: DataFrame) -> DataFrame:
    """``ENDS`` per distinct string. A digest is sequential, so the ids of one string pass through one task, packed into stretches."""
    ids = strings.select("string", "conv_id")
    packed = ids.repartitionByRange("string", "conv_id").sortWithinPartitions("string", "conv_id").mapInArrow(_stretch, STRETCHES)
    order = ["string", F.desc("no_id"), "first"]
    return packed.repartition("string").sortWithinPartitions(*order).drop("no_id").mapInArrow(_ends, ENDS)


# ---------------------------------------------------------------- forest of a block


@dataclass
class Node:
    """A node of the compressed trie of one block: strings ``lo`` to ``hi`` share its ``depth`` turns."""

    depth: int
    lo: int
    hi: int
    n: int = 0
    conv: int | None = None
    ends: str = NOBODY
    below: list[Node] = field(default_factory=list)
    leaves: int = 0
    saved: int = 0


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def common_turns(a: np.ndarray, b: np.ndarray) -> int:
    """Leading turns that two strings of keys share."""
    m = min(len(a), len(b))
    apart = np.flatnonzero(a[:m] != b[:m])
    return int(apart[0]) if len(apart) else m


def as_turns(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, dtype=f"V{KEY}")


def forest(strings: list[tuple]) -> Node:
    """The root of a block's trie. ``strings``: sorted and distinct ``(keys, prefix sums of chars, n, conv, ends)``.

    Edges join neighbours in descending order of their LCP. A component is a subtree, represented by its
    top; an edge as deep as a top adds to that node, a shallower one makes a new node above both tops.
    """
    turns = [as_turns(s[0]) for s in strings]
    lcp = np.array([common_turns(a, b) for a, b in zip(turns, turns[1:])], dtype=np.int64)
    top = [Node(len(t), i, i, s[2], s[3], s[4]) for i, (t, s) in enumerate(zip(turns, strings))]
    parent = list(range(len(strings)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = [1] * len(strings)
    for edge in np.argsort(-lcp, kind="stable"):
        depth, a, b = int(lcp[edge]), find(int(edge)), find(int(edge) + 1)
        left, right = top[a], top[b]
        node = Node(depth, left.lo, right.hi, left.n + right.n, _least(left.conv, right.conv))
        for side in (left, right):
            if side.depth == depth:
                node.below += side.below
                node.ends = side.ends if side.ends != NOBODY else node.ends
            else:
                node.below.append(side)
        if size[a] < size[b]:
            a, b = b, a
        parent[b], top[a], size[a] = a, node, size[a] + size[b]
    root = top[find(0)]
    return root if root.depth == 0 else Node(0, 0, len(strings) - 1, root.n, root.conv, NOBODY, [root])


def _totals(root: Node, strings: list[tuple]) -> list[Node]:
    """Fills in leaves and savings from below; returns all nodes, parents first."""
    order = [root]
    for node in order:  # grows while it is walked
        order.extend(node.below)
    for node in reversed(order):
        sums = strings[node.lo][1]
        node.leaves = sum(c.leaves for c in node.below) if node.below else 1
        for c in node.below:  # the turns between the two nodes are nodes with one child
            node.saved += c.saved + (c.n - 1) * int(sums_between(strings[c.lo][1], node.depth, c.depth - 1))
        if node.depth:
            node.saved += (node.n - 1) * int(sums_between(sums, node.depth - 1, node.depth))
    return order


def sums_between(sums: np.ndarray, begin: int, end: int) -> int:
    """Code points of turns ``begin + 1`` to ``end``, from running sums that start with 0."""
    return int(sums[end] - sums[begin]) if end > begin else 0


def _block_rows(strings: list[tuple], block: int, place: int) -> Iterator[dict]:
    """Nodes of a block, one per depth; those of its first and last string as ``spine``, and its ``edge``."""
    root, final = forest(strings), len(strings) - 1
    order = _totals(root, strings)
    yield {"kind": "edge", "block": block, "place": place, "first": strings[0][0], "last": strings[final][0]}
    above = {id(c): p for p in order for c in p.below}
    shared: dict[int, bytes] = {}  # digests of nodes in which other blocks may have members
    for node in order:
        over = above.get(id(node))
        keys, sums = strings[node.lo][:2]
        begin = over.depth + 1 if over else 0
        spine = node.lo == 0 or node.hi == final
        digests = _prefix_digests(keys, max(0, begin - 1), node.depth) if spine else {}
        if spine:
            shared[id(node)] = digests[node.depth]
        saved = node.saved
        for depth in range(node.depth, begin - 1, -1):
            inner = depth < node.depth
            if inner:
                saved += (node.n - 1) * sums_between(sums, depth - 1, depth)
            row = {
                "kind": "spine" if spine else "node", "block": block, "place": place, "depth": depth, "conv_id": node.conv, "n_convs": node.n,
                "n_children": 1 if inner else len(node.below), "n_leaves": node.leaves, "saved_tokens": saved,
                "ends_sha256": NOBODY if inner else node.ends,
            }
            up = over if depth == begin else node
            if spine:
                row |= {"on_left": node.lo == 0, "on_right": node.hi == final, "prefix": digests[depth], "tokens": int(sums[depth])}
            if up is not None:
                row["parent_conv_id"] = up.conv
                if spine or id(up) in shared:
                    row["parent_prefix"] = digests[depth - 1] if spine else shared[id(up)]
            yield row


def _prefix_digests(keys: bytes, begin: int, end: int) -> dict[int, bytes]:
    running, found = hashlib.sha256(keys[: KEY * begin]), {}
    for depth in range(begin, end + 1):
        found[depth] = running.copy().digest()
        running.update(keys[KEY * depth : KEY * (depth + 1)])
    return found


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings of a partition to the nodes of its blocks, one block in memory at a time."""
    strings, size, place, part = [], 0, 0, 0

    def rows():
        held = []
        for row in _block_rows(strings, part, place):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, _NODES)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _NODES)

    for batch in batches:
        names = ("part", "keys", "chars", "n_convs", "conv_id", "ends_sha256")
        for part, keys, chars, n, conv, ends in zip(*(column(batch, c) for c in names)):  # noqa: B020
            if strings and size + len(keys) > BLOCK_BYTES:
                yield from rows()
                strings, size, place = [], 0, place + 1
            strings.append((keys, np.concatenate([[0], np.cumsum(chars, dtype=np.int64)]).astype(np.int64), n, conv, ends))
            size += 2 * len(keys) + 200
    if strings:
        yield from rows()


# ---------------------------------------------------------------- across blocks


SHARES = "block long, place long, left long, right_longer boolean"


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, turns that its first string shares with the string before, and whether its last one goes on behind it."""
    names, before, waiting = [f.split()[0] for f in SHARES.split(", ")], None, None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        done = []
        for block, place, first, last in zip(*(column(batch, c) for c in ("block", "place", "first", "last"))):
            shared = -1 if before is None else common_turns(as_turns(before), as_turns(first))
            if waiting:
                done.append((*waiting, shared * KEY == len(before)))
            waiting, before = (block, place, shared), last
        if done:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
    if waiting:
        yield pa.record_batch([pa.array([v], k) for v, k in zip((*waiting, False), kinds)], names)


def _merged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spine rows as they stand in their blocks, and added up across blocks.

    The first block that holds a prefix owns it: it alone takes its turn's tokens off once and counts it as a
    child. Counts of a block that does not own the first ``left`` turns of its first string are corrected along
    that string, and a last string that goes on in the next block is no leaf.
    """
    edges = rows.where("kind = 'edge'").select("block", "place", "first", "last")
    bounds = stage(edges.repartition(1).sortWithinPartitions("block", "place").mapInArrow(_boundaries, SHARES), "boundaries")
    spine = rows.where("kind = 'spine'").join(broadcast_if_small(bounds, bounds.count(), 64), ["block", "place"])
    shared = F.col("on_left") & (F.col("depth") <= F.col("left"))
    # Running tokens at the deepest shared turn: of one row per block at most.
    reach = spine.where(F.col("on_left") & (F.col("depth") == F.col("left"))).select("block", "place", F.col("tokens").alias("reach"))
    spine = spine.join(broadcast_if_small(reach, reach.count(), 64), ["block", "place"], "left")
    above = spine.where("on_left").select("block", "place", (F.col("depth") + 1).alias("depth"), F.col("tokens").alias("before"))
    spine = spine.join(above, ["block", "place", "depth"], "left")
    gone = F.when(shared, F.col("reach") - F.coalesce("before", F.lit(0))).otherwise(0)
    spine = stage(
        spine.withColumn("saved_tokens", F.col("saved_tokens") + gone)
        .withColumn("n_children", F.col("n_children") - F.when(F.col("on_left") & (F.col("depth") < F.col("left")), 1).otherwise(0))
        .withColumn("n_leaves", F.col("n_leaves") - F.when(F.col("on_right") & F.col("right_longer"), 1).otherwise(0)),
        "spines",
    )
    whole = spine.groupBy("prefix").agg(
        F.max("parent_prefix").alias("parent_prefix"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOBODY, F.col("ends_sha256"))), F.lit(NOBODY)).alias("ends_sha256"),
    )
    return spine.select("block", "place", "prefix"), stage(whole, "merged-spines")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` to one row per distinct sequence of first turns, in columns ``RESULT``.

    Turns are ordered by turn (null first), then by their digest; a null role or text is empty. Rows with a null
    ``conv_id`` are one conversation that no other opens, whose id is written as the empty text; it is the
    smallest member only where it is the only one. Equal turns that repeat are turns of their own. Without any
    conversation there is no row, not even a root. Other columns are ignored. A conversation's keys, 24
    bytes a turn, must fit into a task's memory.
    """
    strings = stage(rebuilt(conversations).withColumn("string", F.unhex(F.sha2("keys", 256))), "strings")
    distinct = strings.select("string", "keys", "chars").distinct().join(_ended(strings), "string")
    ordered = distinct.repartitionByRange("keys").sortWithinPartitions("keys").withColumn("part", F.spark_partition_id().cast("long"))
    rows = stage(small_batches(ordered).mapInArrow(_forests, NODES), "forests")
    spine, whole = _merged(rows)

    known = whole.select("prefix", F.col("conv_id").alias("of_parent"))
    n = whole.count()
    small = broadcast_if_small(known, n, SPINE_BYTES)
    parents = small.withColumnRenamed("prefix", "parent_prefix")
    top = whole.join(parents, "parent_prefix", "left").withColumn("parent_conv_id", F.col("of_parent"))
    # Looked up per block, so that a prefix with very many children is no hot key.
    local = spine.join(small, "prefix").withColumnRenamed("prefix", "parent_prefix")
    nodes = rows.where("kind = 'node'")
    hung = nodes.where("parent_prefix is not null").drop("parent_conv_id").join(local, ["block", "place", "parent_prefix"])
    inner = nodes.where("parent_prefix is null")
    return inner.select(*RESULT).unionByName(hung.withColumn("parent_conv_id", F.col("of_parent")).select(*RESULT)).unionByName(top.select(*RESULT))
