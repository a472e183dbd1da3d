"""Prefix trie: every node against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from telemetry_ops.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, base long, keys string, depth string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t, key=lambda t: t[0])] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 6
        opening = own.get(int(c - (abs(c) % 100) * (1 if c >= 0 else -1)), []) if c is not None else []
        whole[c] = tuple(opening[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1]) if node else 0
    found = []
    for node, cs in members.items():
        ends = sorted((c for c in cs if whole[c] == node), key=lambda c: (c is not None, c or 0))
        text = ",".join("" if c is None else str(c) for c in ends)
        found.append((least(cs), len(node), least(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)
    return sorted((tuple(r[f] for f in FIELDS) for r in P.conversation_trie(df.repartition(5)).collect()), key=repr)


def talks(seed, n=150):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for k in range(rng.randrange(1, 9)):
            rows.append((c, k, rng.choice(["user", "assistant"]) if k % 3 else "user", rng.choice(["yes", "no", "", None, "ünï 😀"])))
    for c in range(200, 260):
        rows += [(c, k, "user", f"same {k}") for k in range(8)]  # a third of all conversations are one
    return rows


def test_every_node(spark):
    rows = talks(0)
    assert trie(spark, rows) == brute(rows)


def test_many_blocks(spark):
    """One range of strings per task, so that prefixes span several blocks."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "37"}
    before = {k: spark.conf.get(k) for k in names}
    rows = talks(7, 90) + [(c, k, "user", "deep") for c in range(300, 420, 7) for k in range(30 + c % 20)]
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert trie(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nulls_ties_negative_ids_and_empty_table(spark):
    rows = [(None, 0, None, None), (None, 1, "user", "x"), (-7, 0, "user", "</s>"), (-7, None, "user", "first"), (0, 0, "a", "b"), (0, 1, "a", "c")]
    rows += [(5, 3, "user", "long " * 50_000), (101, 0, "user", "no opening")]
    assert trie(spark, rows) == brute(rows)
    tied = [(500, 1, "user", t) for t in ("b", "a", "a")]
    assert len(trie(spark, tied)) == len(trie(spark, tied[::-1])) == 4 - min(3, zlib.crc32(b"500") % 6) + min(3, zlib.crc32(b"500") % 6)
    assert trie(spark, []) == []


def test_forest_of_a_block():
    """Merges of one depth share a node, and a string that others extend is a node with children."""
    key = lambda s: b"".join(hashlib.md5(c.encode()).digest() for c in s)
    texts = sorted({"", "a", "ab", "abc", "abd", "abe", "b", "bcdef", "bcdeg"}, key=key)
    root = P.forest([(key(t), list(range(len(t) + 1)), 1, k, f"end {t}") for k, t in enumerate(texts)])
    shape = lambda n: (n.depth, n.n, n.ends, sorted(map(shape, n.below)))
    leaf = lambda t: (len(t), 1, f"end {t}", [])
    ab = (2, 4, "end ab", [leaf("abc"), leaf("abd"), leaf("abe")])
    b = (1, 3, "end b", [(4, 2, P.NOBODY, [leaf("bcdef"), leaf("bcdeg")])])
    assert shape(root) == (0, 9, "end ", sorted([(1, 5, "end a", [ab]), b]))
