"""The trie against a plain one of dictionaries, with tiny shards, queues and runs."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from foliolens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, h string, pos string"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, own = defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))  # the remainder has the sign of c
        own[c] = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1]) if node else 0
    digest = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(own[c]) == len(node)).encode()).hexdigest()
    return sorted([(min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n], digest(n))
                   for n, cs in members.items()], key=repr)


def found(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, "d", "h", "p") for r in rows], SCHEMA)
    out = prefix_trie.trie(df, **parameters).drop("prefix")
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def conversations(seed, n, longest=7, words=("yes", "no", "ä long reply", "")):
    pick = random.Random(seed)
    return [(c, t if pick.random() < 0.95 else None, pick.choice(["user", "assistant", None]), pick.choice(words))
            for c in pick.sample(range(-50, 4 * n), n) for t in range(pick.randrange(1, longest))]


@pytest.mark.parametrize("parameters", [{}, dict(shard_turns=30, queue_rows=3, id_run=2), dict(shard_turns=0, queue_rows=1)])
def test_trie_equals_plain_trie(spark, parameters):
    rows = conversations(1, 120)
    rows += rows[:15] + [(None, 1, "user", "nobody's"), (100, 0, "user", "base"), (100, 1, None, None), (200, None, "user", "x" * 60_000)]
    assert found(spark, rows, **parameters) == plain(rows)


def test_one_conversation_holds_most_rows(spark):
    """It is cut over all tasks, is the base of others, and ends at the same node as its copies."""
    pick = random.Random(3)
    lines = [pick.choice(["a", "b"]) for _ in range(300)]
    rows = [(100, t, "user", x) for t, x in enumerate(lines)] + [(101, t, "user", x) for t, x in enumerate(lines)]
    rows += [(c, t, "user", x) for c in range(102, 140) for t, x in enumerate(lines[:pick.randrange(1, 9)])]
    for parameters in ({}, dict(shard_turns=40, queue_rows=2, id_run=3)):
        assert found(spark, rows, **parameters) == plain(rows)
    turns = prefix_trie.digested(spark.createDataFrame([(*r, "d", "h", "p") for r in rows], SCHEMA), "conv_id", "turn", "role", "text")
    keys = ["conv_id", "turn", "digest"]
    dealt = turns.repartitionByRange(8, *keys).sortWithinPartitions(*keys)
    scanned = prefix_trie.stored(dealt.mapInArrow(prefix_trie.stretches, prefix_trie.TURN))
    before = prefix_trie.carries(scanned)
    assert len(before) >= 4  # the long conversations go on from part to part
    whole = prefix_trie.carried(scanned, before)
    assert [r["pos"] for r in whole.where("conv_id = 100").orderBy("pos").collect()] == list(range(1, 301))


def test_empty_table_and_turnless_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "x")]) == []
    turnless = [(c, 0, "user", "only") for c in range(1, 30)]  # with no base, a first turn is often left out
    assert found(spark, turnless) == plain(turnless)


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_queue_spills_and_stays_in_order(limit):
    pick = random.Random(limit)
    queue, left = prefix_trie.SpillingQueue(limit, fan_in=2), []
    for level in range(40, 0, -1):
        for h in sorted({bytes([pick.randrange(20)]) * 16 for _ in range(12)}):
            due = [m for m in left if m[:2] == (-level, h)]
            left = [m for m in left if m[:2] > (-level, h)]
            assert queue.take((-level, h)) == (len(due), sum(m[2] for m in due), sum(m[3] for m in due))
            for _ in range(pick.randrange(4)):
                message = (1 - level, bytes([pick.randrange(20)]) * 16, pick.randrange(9), pick.randrange(9))
                queue.push(message)
                left.append(message)
