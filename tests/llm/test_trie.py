"""Prefix trie of conversations against sets of prefixes in plain Python."""

import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from brookcal.llm import queries, trie


def turns_of(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            found[conv].append(((turn is not None, turn or 0), tie, role, text))
    return {c: [x[2:] for x in sorted(v)] for c, v in found.items()}


def rebuilt(conv):
    out = {}
    for c, own in conv.items():
        h = crc32(str(c).encode()) % 9
        out[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def nodes(paths):
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k, v in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    out = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in v if len(paths[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(v), len(k), parent, len(v), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_find_close_skips_blocks():
    rng = random.Random(3)
    for size in (1, 5, 60, 40_000):
        signs, depth, left = [], 0, size
        while left or depth:
            if left and (not depth or rng.random() < 0.55):
                signs.append(1)
                depth, left = depth + 1, left - 1
            else:
                signs.append(-1)
                depth -= 1
        stack, want = [], {}
        for i, s in enumerate(signs):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        # the last parenthesis of a forest may close at the end only, so it is wrapped
        marks = trie.Parentheses(np.array([1, *signs, -1], dtype=np.int8))
        got = marks.find_close(marks.opens)
        assert got.tolist() == [len(signs) + 1, *[want[i] + 1 for i in sorted(want)]]
        leaves = marks.leaves(marks.opens, got)
        assert leaves[0] == sum(a > 0 > b for a, b in zip(signs, signs[1:]))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn int, role string, text string, path string, node string")


ODD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "é"), (0, 1, "assistant", "tie"), (0, None, "user", "first"), (0, None, None, None),
    (1, 5, "user", "hi"), (1, 5, "user", "hi"), (2, 0, None, ""), (2, 0, "", None), (None, 0, "user", "nobody"), (-3, 1, "user", "x" * 50_000),
    (-5, 0, "", "ab"), (-4, 0, "a", "b"), (7, None, None, None), (9, 0, "user", "hi"),
]


def test_odd_rows(spark):
    df = conversations(spark, ODD)
    assert rows_of(trie.prefix_trie(trie.turn_paths(df))) == nodes(turns_of(ODD))


def test_no_conversations(spark):
    assert trie.prefix_trie(trie.turn_paths(conversations(spark, []))).count() == 0
    nobody = conversations(spark, [(None, 0, "user", "hi")])
    assert trie.prefix_trie(trie.turn_paths(nobody)).count() == 0


def test_query_over_odd_rows(spark, tmp_path):
    conversations(spark, ODD).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(queries.op11_prefix_trie(spark, str(tmp_path))) == nodes(rebuilt(turns_of(ODD)))


@pytest.mark.parametrize("block_nodes", [1, 60, 10**6])
def test_blocks_and_levels_do_not_matter(spark, monkeypatch, block_nodes):
    """Copies, a first turn shared by most, a long conversation and conversations that begin others."""
    monkeypatch.setattr(trie, "LEVEL_PATHS", 40)
    rng = random.Random(5)
    rows = []
    for c in range(1_500):
        kind = rng.random()
        if kind < 0.3:
            own = ["same", "turns", "again"]
        elif kind < 0.7:
            own = ["same", *[rng.choice("abc") for _ in range(rng.randint(0, 9))]]
        else:
            own = [rng.choice("uvwxyz") for _ in range(rng.randint(1, 6))]
        rows += [(c, t, "user", x) for t, x in enumerate(own)]
    rows += [(5_000, t, "user", f"long {t}") for t in range(700)] + [(5_001, t, "user", f"long {t}") for t in range(650)]
    paths = trie.turn_paths(conversations(spark, rows).repartition(5))
    assert rows_of(trie.prefix_trie(paths, block_nodes, ids_in_chunk=7)) == nodes(turns_of(rows))
