"""Prefix trie of conversations against plain Python."""

from __future__ import annotations

import random

import pytest

import brute
from marketmood.llm import conversation_trie
from marketmood.llm.queries import REGISTRY
from marketmood.llm.radix_tree import Node, RadixTree

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def as_rows(found):
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def talks(seed, n):
    """Conversations of few different turns, some equal, some prefixes of others, one very common."""
    draw = random.Random(seed)
    rows = []
    for conv in draw.sample(range(-n, 3 * n), n):
        length = draw.choice((0, 1, 2, 3, 5, 9, 12, 40))
        for turn in range(length):
            same = conv % 3 == 0 or turn == 0
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", "common é" if same else draw.choice(("a", "bb", "", None)), "x"))
        if length == 3:
            rows.append((conv, None, None, "before all", "x"))
    return rows


@pytest.mark.parametrize(("parts", "range_bytes"), [(1, 1 << 22), (3, 1 << 22), (7, 300), (2, 1)])
def test_trie_equals_plain_python(spark, parts, range_bytes):
    rows = talks(parts, 60) + [(None, 1, "user", "nobody's", "x")]
    found = conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), parts, range_bytes)
    assert as_rows(found) == sorted(brute.prefix_trie([r[:4] for r in rows]), key=str)


def test_copies_over_many_ranges(spark):
    rows = [(c, t, "user", "turn %d" % t, "x") for c in range(0, 500, 5) for t in range(4)]
    rows += [(c, t, "user", "turn %d" % t, "x") for c in range(500, 700, 5) for t in range(8)]
    found = as_rows(conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), 6, 200))
    assert found == sorted(brute.prefix_trie([r[:4] for r in rows]), key=str)
    assert len(found) == 9


def test_empty_and_turnless_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.conversation_trie(empty).count() == 0
    # Conversation 7 takes all it has from conversation 5, which does not exist.
    rows = [(7, 0, None, None, "x"), (101, 0, "user", "z" * 3_000_000, "x"), (None, None, None, None, None)]
    rows += [(200, t, "user", "t%d" % (t % 7), "x") for t in range(700)]
    found = as_rows(conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert found == sorted(brute.prefix_trie([r[:4] for r in rows]), key=str)


def test_repeated_rows_are_repeated_turns(spark):
    rows = [(5, 0, "user", "b", "x"), (5, 0, "user", "a", "x"), (5, 0, "user", "a", "x")]
    found = as_rows(conversation_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    again = as_rows(conversation_trie.conversation_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)))
    assert found == again and [r[1] for r in found] == [0, 1, 2, 3]


def test_query_equals_plain_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert as_rows(REGISTRY["op11_prefix_trie"](spark, sf_dir)) == sorted(brute.prefix_trie([tuple(r) for r in rows]), key=str)


def test_node_layouts_grow_and_keep_order():
    tree, draw, rooms = RadixTree(), random.Random(3), []
    labels = draw.sample(range(256), 256)
    for i, label in enumerate(labels):
        tree.add(bytes([9, 9, label, 1]), i)
        rooms.append(next(tree.root.children()).room)
    assert [rooms.index(r) + 1 for r in (4, 16, 48, 256)] == [2, 5, 17, 49]
    branch = next(tree.root.children())
    assert branch.path == b"\x09\x09" and [c.path[0] for c in branch.children()] == list(range(256))
    assert [c.ends for c in branch.children()] == [[labels.index(x)] for x in range(256)]


def test_paths_split_where_keys_part():
    tree = RadixTree()
    for i, key in enumerate((b"abcdef", b"abcxyz", b"abc", b"", b"abcdef")):
        tree.add(key, i)
    assert tree.root.ends == [3]
    (branch,) = tree.root.children()
    assert isinstance(branch, Node) and (branch.path, branch.depth, branch.ends) == (b"abc", 3, [2])
    assert [(c.path, c.depth, c.ends) for c in branch.children()] == [(b"def", 6, [0, 4]), (b"xyz", 6, [1])]
