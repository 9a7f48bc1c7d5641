"""The trie of conversation prefixes against plain Python, in one shard and in many."""

import hashlib
import zlib

import numpy as np
import pytest

from urbanpulse.llm import prefixes

COLUMNS = "conv_id long, turn long, role string, text string, path string, kind string, first long"


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))

    def key(t):
        digest = hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()
        return (t[0] is not None, t[0] or 0, digest)

    own = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, own_members in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(own_members) - 1) * len(k[-1][1]) if k else 0
    return sorted((min(m), len(k), -1 if not k else min(members[k[:-1]]), len(m), len(children.get(k, ())), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == k))).encode()).hexdigest()) for k, m in members.items())


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "p", "k", 1) for r in rows], COLUMNS)
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefixes.prefix_trie(table, **options).collect())


def talks(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(int(c), t, ("user", "assistant", None)[t % 3], f"say {rng.integers(0, 2 + t)} é") for c in rng.choice(900, n, False) - 300
            for t in range(rng.integers(0, 9))]
    same = [(1_000 + c, t, "user", f"the same {t}") for c in range(60) for t in range(7)]
    long = [(5_001, t, "user", f"long {t}") for t in range(150)]
    odd = [(None, 1, "user", "no id"), (77_700, None, None, None), (77_701, None, "user", ""), (77_701, None, "user", ""), (77_701, 2, "a", "b"),
           (77_702, 2, "b", "tie"), (77_702, 2, "a", "tie"), (9_999, 0, "user", "x")]
    return rows + same + long + odd


@pytest.mark.parametrize("shard", (prefixes.SHARD, 400, 40))
def test_equals_plain_python(spark, shard):
    rows = talks(shard, 150)
    assert got(spark, rows, shard=shard) == plain(rows)


def test_one_group_of_equal_conversations_over_many_shards(spark):
    rows = [(c, t, "user", "t" * t) for c in range(300) for t in range(3)] + [(c, 0, "user", "other") for c in range(300, 303)]
    assert got(spark, rows, shard=50) == plain(rows)


def test_closing_parentheses_of_random_trees():
    rng = np.random.default_rng(1)
    for size in (1, 2, 63, 500, 5_000):
        depth = [0]
        while len(depth) < size:
            depth.append(int(rng.integers(1, depth[-1] + 2)) if rng.random() < 0.3 else depth[-1] + 1)
        tree = prefixes.Parentheses(np.array(depth))
        subtree = (tree.closes() - tree.opens + 1) // 2
        ends = [next((j for j in range(i + 1, size) if depth[j] <= depth[i]), size) for i in range(size)]
        assert subtree.tolist() == [e - i for i, e in enumerate(ends)]
        assert tree.leaf.tolist() == [n == 1 for n in subtree.tolist()]


def test_empty_table_and_a_single_conversation(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, 1, "user", "a")]) == plain([(100, 1, "user", "a")])
