import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from permscan.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string, _chunk int"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    spoken = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            spoken[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [turn[2:] for turn in sorted(v)] for c, v in spoken.items()}
    paths = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        paths[conv] = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(int)
    for conv, path in paths.items():
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += (len(convs) - 1) * words
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], sha))
    return sorted(out, key=lambda r: r[:2])


def figures(spark, rows, **settings):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    found = trie.prefix_trie(table, **settings)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])


def talk(seed, conversations=80):
    draw = random.Random(seed)
    return [
        (conv, turn, draw.choice(["user", "bot", None]), draw.choice(["one two", "one", "", "a b\tc", None]))
        for conv in range(conversations)
        for turn in range(draw.choice([0, 1, 2, 3, 5, 8]))
    ]


def test_nodes_equal_brute_force(spark):
    rows = talk(1)
    assert figures(spark, rows) == brute(rows)


@pytest.mark.parametrize("shard_rows", [11, 60])
def test_conversations_longer_than_a_shard(spark, shard_rows):
    # Two conversations hold most of the turns and share a long prefix.
    rows = talk(2, 30)
    rows += [(conv, turn, "user", f"word {turn % 2}") for conv in (21, 23) for turn in range(20, 110 + conv)]
    assert figures(spark, rows, shard_rows=shard_rows) == brute(rows)


def test_many_copies_of_a_conversation(spark):
    rows = [(conv, turn, "user", f"t {turn}") for conv in range(1, 1500) for turn in range(2)]
    assert figures(spark, rows, shard_rows=400) == brute(rows)


def test_nulls_repeated_rows_and_long_texts(spark):
    rows = [
        (None, 0, "user", "in no conversation"),
        (7, None, None, None),
        (7, None, None, None),
        (7, 3, "user", "same turn"),
        (7, 3, "user", "same turn"),
        (27, 0, "user", "word " * 100_000),
        (-5, 1, "user", "negative id"),
        (40, None, "", ""),
    ]
    # -5 belongs to conversation 0 as its remainder keeps the sign.
    rebuilt = [r for r in rows if r[0] != -5]
    found = [r for r in figures(spark, rebuilt)]
    assert found == brute(rebuilt)
    assert sum(r[3] for r in figures(spark, rows) if r[1] == 0) == 4


def test_turns_of_equal_number_have_a_fixed_order(spark):
    rows = [(3, 1, "user", text) for text in ("a", "b", "c", "d")]
    assert figures(spark, rows) == figures(spark, rows[::-1])


def test_empty_table_has_no_nodes(spark):
    assert figures(spark, []) == []


def test_slot_table_is_minimal_perfect_and_verified():
    draw = np.random.default_rng(1)
    lanes = [draw.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2)]
    table = trie.SlotTable(*lanes)
    assert sorted(table.find(*lanes)) == list(range(5000))
    strange = [lanes[0], lanes[1] ^ np.uint64(1)]
    assert (table.find(*strange) == -1).all()
    assert trie.SlotTable(np.zeros(0, np.uint64)).size == 0
