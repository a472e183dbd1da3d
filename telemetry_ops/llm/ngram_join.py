"""Exact Jaccard self-join of documents on word 5-grams by a token-group matrix.

Equal sets are one class. Shingles have one global order: hash order with the most frequent ones
last. Two sets that reach the similarity share ``k`` shingles within their first ``n - ceil(t n) + k``, for any
``k``, so only these enter the matrix, and those that one class alone has leave it again. Classes that share a popular
shingle and are about as long form groups of bounded size. The matrix row of a group is the union
of its members' shingles; two groups meet if their rows share ``k`` of them, for the ``k`` of their sizes. A query overlaps no member of a group by
more than it overlaps the union, so a group is opened only for queries that pass this bound: first
over the leading shingles alone, then, for the few pairs of groups that are left, over the whole sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage
from telemetry_ops.llm.components import components
from telemetry_ops.llm.text import column, hash_words, lists, most_frequent, slices, small_batches, split_words, tidy

WORDS = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 4, 5
#: Shingles that are put last in the order. They steer the cost only: any order finds all links.
LATE_SHINGLES = 1 << 17
#: Documents among which a shingle must occur this often to be counted as frequent.
FREQUENT, PER_BYTES = 3, 8 << 20
#: Members and shingles of a group; a larger set is a group of its own.
GROUP_MEMBERS, GROUP_SHINGLES = 64, 1 << 17
#: Members that a block of groups should hold; a cell is two blocks.
BLOCK_BYTES = 8 << 20
#: Groups that a cell has taken out at a time.
KEPT_GROUPS = 256
#: One more leading shingle, and one more to be shared, for so many shingles of a set.
PER_SHARED = 25
LATE = np.int64(1) << np.int64(62)
WHOLE = np.int64(2**63 - 1)

SETS = "doc_id long, n int, d1 long, d2 long, cut long, shingles array<long>"


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle keys (62 bits) of each lower-cased text."""
    codes, distinct, ends = split_words([t.lower() if t else t for t in texts])
    h = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    m = max(0, len(h) - WORDS + 1)
    key = np.zeros(m, np.uint64)
    for i in range(WORDS):
        key = (key ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    found, begin = [], 0
    for end in ends.tolist():
        n = end - begin
        if n >= WORDS:
            own = key[begin : end - WORDS + 1]
        else:
            own = np.zeros(min(n, 1), np.uint64)
            for i in range(n):
                own = (own ^ h[begin + i] ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
                own ^= own >> np.uint64(32)
        found.append(np.unique(own >> np.uint64(2)).astype(np.int64))
        begin = end
    return found


@tidy
def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", PER_BYTES):
            sets = [s for part in slices(piece, "text") for s in shingle_sets(column(part, "text"))]
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= FREQUENT
            yield pa.record_batch([pa.array(keys[often]), pa.array(counts[often])], ["shingle", "n"])


def late_shingles(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles of all documents, by lossy counting; at most ``LATE_SHINGLES``."""
    counts = texts.select("text").mapInArrow(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = stage(counts, "frequent-shingles")
    top = most_frequent(counts, "shingle", "n", LATE_SHINGLES)
    return np.sort(top["shingle"].to_numpy(np.int64))


def _sets(late: np.ndarray, whole: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n, d1, d2, cut, kept = [], [], [], [], []
                for s in shingle_sets(column(piece, "text")):
                    if len(late) and len(s):
                        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        s = np.sort(np.where(late[at] == s, s | LATE, s))
                    size = len(s)
                    u = s.view(np.uint64)
                    mixed = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    n.append(size)
                    d1.append(u.sum(dtype=np.uint64))
                    d2.append((mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64))
                    prefix = size - (NUM * size + DEN - 1) // DEN + 1 if size else 0
                    reach = size if whole else min(size, prefix + prefix // 2 + 4)  # beyond what enters the matrix
                    cut.append(WHOLE if reach == size else s[reach])
                    kept.append(s[:reach])
                yield pa.record_batch(
                    [
                        piece.column(piece.schema.get_field_index("doc_id")),
                        pa.array(n, pa.int32()),
                        pa.array(np.array(d1, np.uint64).view(np.int64)),
                        pa.array(np.array(d2, np.uint64).view(np.int64)),
                        pa.array(np.array(cut, np.int64)),
                        lists(kept, pa.int64()),
                    ],
                    ["doc_id", "n", "d1", "d2", "cut", "shingles"],
                )

    return run


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of these sizes share at least: NUM * union <= DEN * overlap."""
    return -(-NUM * (a + b) // (NUM + DEN))


def overlaps(a: list[np.ndarray], b: list[np.ndarray], na: np.ndarray, nb: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray):
    """Queries of ``a`` that open group ``b``, and upper bounds of their overlaps with its members.

    ``rest``: shingles of a set beyond the given ones. Without any, the bounds are exact.
    """
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def rows(sets):
        m = np.zeros((len(sets), len(common)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
            m[i, at[common[at] == s] if len(common) else []] = 1
        return m

    ma = rows(a)
    union = ma.sum(1).astype(np.int64) + rest_a  # overlap with the group's union
    open_ = np.flatnonzero(union >= -(-NUM * na // DEN))
    if not len(open_):
        return open_, np.zeros((0, len(b)), np.int64)
    bound = np.rint(ma[open_] @ rows(b).T).astype(np.int64) + np.minimum(rest_a[open_][:, None], rest_b[None, :])
    return open_, bound


class Group:
    """Members of a group, as the kernel needs them."""

    def __init__(self, ids, copies, n, cut, sets):
        self.ids, self.copies, self.n, self.cut = ids, copies, n.astype(np.int64), cut
        # Half keys may collide inside a set; what is lost so counts as not given.
        self.sets = [np.unique(s) for s in sets]

    def below(self, theta) -> tuple[list[np.ndarray], np.ndarray]:
        """Shingles below a key, and how many more each set has."""
        sets = self.sets if theta == WHOLE else [s[: np.searchsorted(s, theta)] for s in self.sets]
        return sets, self.n - np.array([len(s) for s in sets])


class Cell:
    """The members of a cell, left where Arrow put them; a few groups at a time are taken out."""

    def __init__(self, members: pa.Table):
        self.columns = [members[c].to_numpy() for c in ("doc_id", "copies", "n", "cut")]
        shingles = members["shingles"].combine_chunks()
        self.ends, self.flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        g = members["g"].to_numpy()
        self.order = np.argsort(g, kind="stable")
        self.names, self.first = np.unique(g[self.order], return_index=True)
        self.first = np.append(self.first, len(g))
        self.taken: OrderedDict[int, Group] = OrderedDict()

    def group(self, g: int) -> Group:
        if g not in self.taken:
            k = int(np.searchsorted(self.names, g))
            rows = self.order[self.first[k] : self.first[k + 1]]
            self.taken[g] = Group(*(c[rows] for c in self.columns), [self.flat[self.ends[i] : self.ends[i + 1]] for i in rows])
            if len(self.taken) > KEPT_GROUPS:
                self.taken.popitem(last=False)
        self.taken.move_to_end(g)
        return self.taken[g]


def _ordered(pairs: pa.Table) -> Iterator[tuple[int, int]]:
    """Pairs by their first group, which is then taken out once."""
    a, b = pairs["ga"].to_numpy(), pairs["gb"].to_numpy()
    for i in np.lexsort((b, a)).tolist():
        yield int(a[i]), int(b[i])


def _hits(a: Group, b: Group) -> tuple[np.ndarray, np.ndarray]:
    theta = min(a.cut.min(), b.cut.min())
    sets_a, rest_a = a.below(theta)
    sets_b, rest_b = b.below(theta)
    open_, bound = overlaps(sets_a, sets_b, a.n, b.n, rest_a, rest_b)
    hit = bound >= _need(a.n[open_][:, None], b.n[None, :])
    if a is b:
        hit &= open_[:, None] < np.arange(len(b.n))[None, :]
    i, j = np.nonzero(hit)
    return open_[i], j


def _bound(pairs: pa.Table, members: pa.Table) -> pa.Table:
    """The pairs of groups that some pair of members may link."""
    cell = Cell(members)
    kept = [(x, y) for x, y in _ordered(pairs) if len(_hits(cell.group(x), cell.group(y))[0])]
    return pa.table({"ga": pa.array([k[0] for k in kept], pa.int64()), "gb": pa.array([k[1] for k in kept], pa.int64())})


def _links(pairs: pa.Table, members: pa.Table) -> pa.Table:
    """Per opened pair of groups: how many documents each class links with, and a spanning forest."""
    cell = Cell(members)
    node, other, linked = [], [], []
    for x, y in _ordered(pairs):
        a, b = cell.group(x), cell.group(y)
        i, j = _hits(a, b)
        if a is not b:
            j = j + len(a.ids)
        ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
        copies = a.copies if a is b else np.concatenate([a.copies, b.copies])
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        top = list(range(len(ids)))

        def root(k, top=top):
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for u, v in zip(i.tolist(), j.tolist()):
            u, v = root(u), root(v)
            if u != v:
                top[max(u, v)] = min(u, v)
        for k in np.flatnonzero(count).tolist():
            node.append(int(ids[k]))
            other.append(int(ids[root(k)]))
            linked.append(int(count[k]))
    return pa.table({c: pa.array(v, pa.int64()) for c, v in (("a", node), ("b", other), ("linked", linked))})


def _meet(pairs: DataFrame, members: DataFrame, kernel, schema: str) -> DataFrame:
    """Apply a kernel to pairs of groups, in cells of two blocks of groups.

    A group's members are sent once to every cell where it has a pair, not once per pair; blocks hold
    about ``BLOCK_BYTES`` of members, so that a cell fits a worker, whatever the number of pairs.
    """
    width = 4 if dict(members.dtypes)["shingles"] == "array<int>" else 8
    volume = members.agg(F.sum(F.size("shingles").cast("long") * width + 32)).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = pairs.select("ga", "gb", F.least(block("ga"), block("gb")).alias("u"), F.greatest(block("ga"), block("gb")).alias("v"))
    ends = pairs.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.explode(F.array_distinct(F.array("ga", "gb"))).alias("g")).distinct()
    sent = ends.join(members, "g").select("cu", "cv", "g", "doc_id", "copies", "n", "cut", "shingles")
    return pairs.groupBy("u", "v").cogroup(sent.groupBy("cu", "cv")).applyInArrow(kernel, schema)


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id, n_links``.

    ``class_id`` is the smallest id with the same set; ``n_links`` counts the other documents that the
    document links with, copies included. Null, empty and blank texts have no shingle and stay alone.
    A row without an id is returned alone, with null class and component. A repeated id counts as one
    more document that bears the same id. Columns beyond ``doc_id`` and ``text`` are not read.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    late = late_shingles(texts)
    sets = stage(texts.mapInArrow(_sets(late, False), SETS), "shingle-sets")
    key = ["d1", "d2", "n"]
    classes = stage(
        sets.where("doc_id is not null and n > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")),
        "shingle-classes",
    )
    members = classes.groupBy(F.col("class_id").alias("doc_id")).agg(F.sum("copies").alias("copies"))
    # Copies leave; only a broadcast that is counted as small spares the shuffle of all sets.
    spare = stage(
        sets.where("doc_id is not null and n > 0").select("doc_id", *key).join(classes, key).where("doc_id <> class_id").select("doc_id", *key).distinct(),
        "shingle-copies",
    )
    spare = broadcast_if_small(spare, spare.count(), 48)
    heads = sets.where("doc_id is not null and n > 0").join(spare, ["doc_id", *key], "left_anti")
    # Rows that repeat id and set are rare, and only they call for one more shuffle of the sets.
    repeated = sets.where("doc_id is not null and n > 0").groupBy("doc_id", *key).count().where("count > 1").limit(1).count() > 0
    single = (lambda df: df.dropDuplicates(["doc_id", *key])) if repeated else (lambda df: df)
    heads = single(heads)
    prefix = F.col("n") - F.expr(f"int(({NUM} * n + {DEN - 1}) div {DEN})") + 1 + F.expr(f"int(n div {PER_SHARED})")
    entries = heads.select("doc_id", F.explode(F.slice("shingles", 1, prefix)).alias("shingle"))
    entries = stage(
        entries.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where("df > 1").distinct(),
        "token-entries",
    )
    sizes = heads.groupBy("doc_id").agg(F.max("n").alias("n"))
    anchors = (
        entries.groupBy("doc_id")
        .agg(F.max(F.struct("df", "shingle")).getField("shingle").alias("anchor"))
        .join(sizes, "doc_id")
        .withColumn("bin", F.floor(F.log("n") / F.lit(np.log(DEN / NUM))).cast("int"))
    )
    parts = anchors.groupBy("anchor", "bin").agg(
        F.greatest(F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("parts")
    )
    groups = stage(
        anchors.join(parts, ["anchor", "bin"])
        .withColumn("g", F.xxhash64("anchor", "bin", F.pmod(F.xxhash64("doc_id"), "parts")))
        .join(members, "doc_id")
        .select("doc_id", "g", "bin", "copies"),
        "token-groups",
    )
    matrix = stage(entries.join(groups, "doc_id").select("shingle", "g", "bin").distinct(), "token-group-matrix")
    other = matrix.select("shingle", F.col("g").alias("gb"), F.col("bin").alias("bin_b"))
    met = (
        matrix.withColumnRenamed("g", "ga")
        .join(other, "shingle")
        .where("ga < gb and abs(bin - bin_b) <= 1")
        .groupBy("ga", "gb")
        .agg(F.count("*").alias("shared"), F.min(F.least("bin", "bin_b")).alias("least_bin"))
        # Every set of a bin is at least as long as the bin's lower edge.
        .where(F.col("shared") >= 1 + F.floor(F.pow(F.lit(DEN / NUM), F.col("least_bin")) * (1 - 1e-9) / PER_SHARED))
        .select("ga", "gb")
        .unionByName(groups.groupBy("g").count().where("count > 1").select(F.col("g").alias("ga"), F.col("g").alias("gb")))
    )
    # Half a key is enough for a bound: a collision can only raise it.
    half = lambda c: F.shiftright(c, 32).cast("int")
    short = stage(
        heads.join(broadcast_if_small(groups, groups.count(), 40), "doc_id").select(
            "g", "doc_id", "copies", "n", half(F.col("cut")).alias("cut"), F.transform("shingles", half).alias("shingles")
        ),
        "group-members",
    )
    near = stage(_meet(met, short, _bound, "ga long, gb long"), "open-groups")
    opened = near.select(F.col("ga").alias("g")).unionByName(near.select(F.col("gb").alias("g"))).distinct()
    inside = stage(groups.join(opened, "g", "left_semi"), "open-members")
    n_inside = inside.count()
    wanted = broadcast_if_small(inside.select("doc_id"), n_inside, 16)
    whole = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(late, True), SETS)
    whole = single(whole.join(spare, ["doc_id", *key], "left_anti"))
    whole = stage(whole.join(broadcast_if_small(inside, n_inside, 40), "doc_id").select("g", "doc_id", "copies", "n", "cut", "shingles"), "whole-members")
    links = stage(_meet(near, whole, _links, "a long, b long, linked long"), "links")
    found = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("class_id")).agg(F.sum("linked").alias("linked"))
    named = (
        classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(counts, "class_id", "left")
        .select(
            *key,
            "class_id",
            F.coalesce("component", "class_id").alias("component"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    # Most classes have one row; only copies meet on a common key, where adaptive skew splitting applies.
    return sets.select("doc_id", *key).join(named, key, "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
