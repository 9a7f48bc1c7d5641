"""Near-duplicate operators against brute force."""

import hashlib
import itertools
import random

import numpy as np
import odd
import pytest

from urbanpulse.llm import jaccard, neighbours, repeats
from urbanpulse.llm.components import components


def groups(ids, links):
    """Smallest id reachable from each."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299)]
    found = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert found == {u: c for u, c in want.items() if u != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(seed):
    """Texts of many lengths, each with copies that differ in some words."""
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.choice([1, 2, 4, 9, 11, 19, 20, 40, 80, 200]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(5))
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    common = " ".join("w%d" % i for i in range(60))
    return texts + [common + f" end{i} end{i}" for i in range(40)]  # one large group


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, words, percent):
    docs = odd.documents(spark, odd.TEXTS + near_copies(words))
    got = odd.by_id(jaccard.join_documents(docs, words, percent))
    rule = jaccard.Rule(words, percent)
    sets = {r.doc_id: jaccard.word_set((r.text or "").encode(), words) for r in docs.collect() if r.doc_id is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if rule.linked(sets[a], sets[b])]
    want = groups(sets, links)
    assert len(links) > 100
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert jaccard.join_documents(docs.limit(0)).count() == 0 and jaccard.join_documents(docs).count() == docs.count()


def chained(n):
    """Each text shares its second half with the next one's first half, so all are chained by candidates; every third has a near copy."""
    halves = [" ".join(f"w{i}x{k}" for k in range(25)) for i in range(n + 1)]
    texts = [f"{a} {b}" for a, b in zip(halves, halves[1:])]
    return texts + [t.rsplit(" ", 1)[0] + " other" for t in texts[::3]]


@pytest.mark.parametrize("crowd", [64, 2])
def test_chained_candidates_are_no_cluster(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd, raising=False)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    compared, blocks = [], jaccard.in_blocks
    monkeypatch.setattr(jaccard, "in_blocks", lambda members: compared.append(members.count()) or blocks(members))
    texts = chained(60)
    got = odd.by_id(jaccard.join_documents(odd.documents(spark, texts), 5, 80))
    rule = jaccard.Rule(5, 80)
    sets = [jaccard.word_set(t.encode(), 5) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if rule.linked(sets[a], sets[b])]
    assert len(links) == 20 and {i: r.component_id for i, r in got.items()} == groups(range(len(texts)), links)
    assert bool(compared) == (crowd == 2)  # small groups are never compared as a whole


def test_links_beside_the_leader(spark):
    rows = [(g, c, 10 * g) for g in range(50) for c in (10 * g, 10 * g + 1, 10 * g + 2, 10 * g + 10)]  # each group has the next one's leader
    members = jaccard.in_several(spark.createDataFrame(rows, "group long, class long, leader long"), spark.createDataFrame([(11, 10)], "u long, component long"))
    known = spark.createDataFrame([(c, 10 if c % 10 < 2 else 9) for c in {r[1] for r in rows}], "class long, size long")
    want = {(b, a) for g in range(50) for a, b in itertools.combinations((10 * g, 10 * g + 1, 10 * g + 2, 10 * g + 10), 2)} - {(11, 10)}
    assert {r.classes for r in members.collect()} == {4}
    assert {tuple(r) for r in jaccard.pairs_across(members, known, jaccard.Rule(5, 90)).collect()} == want
    assert {tuple(r) for r in jaccard.pairs_across(members, known, jaccard.Rule(5, 95)).collect()} == {p for p in want if (p[0] % 10 < 2) == (p[1] % 10 < 2)}


def token_sets(seed, n=60):
    """Sets of many sizes, in runs of which each differs a little from the one before."""
    rng, sets = np.random.default_rng(seed), []
    while len(sets) < n:
        own = rng.integers(0, 2**63, int(rng.choice([1, 3, 10, 40, 200, 900]))).astype(np.uint64)
        for _ in range(6):
            sets.append(np.unique(own))
            own = np.where(rng.random(len(own)) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 2**63, len(own)).astype(np.uint64), own)
            own = own[: max(1, len(own) - int(rng.integers(0, 1 + len(own) // 10)))]
    return sets


def test_sketches_differ_in_no_more_bits_than_sets():
    sets = token_sets(1)
    for percent in (50, 80, 90):
        rule = jaccard.Rule(5, percent)
        sketches = jaccard.Sketches([jaccard.sketch(s, rule.sketch_bits(len(s))) for s in sets])
        i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(sets)), 2)))
        apart, size = sketches.apart(i, j), np.array([len(s) for s in sets])
        assert all(d <= len(np.setxor1d(sets[a], sets[b])) for a, b, d in zip(i, j, apart))
        linked = np.array([rule.linked(set(sets[a].tolist()), set(sets[b].tolist())) for a, b in zip(i, j)])
        may = rule.may_link(size[i], size[j], apart)
        assert linked.any() and may[linked].all() and may.sum() < len(may) / 4


@pytest.mark.parametrize("crowd, block", [(64, 256), (4, 256), (4, 8)])
def test_unlike_classes_of_a_group_are_no_pairs(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rule, sets = jaccard.Rule(5, 80), token_sets(2)
    known = spark.createDataFrame(
        [(c, len(s), bytearray(jaccard.sketch(s, rule.sketch_bits(len(s))))) for c, s in enumerate(sets)], "class long, size long, sketch binary")
    groups = spark.createDataFrame([(g, c, 0) for g in (1, 2) for c in range(len(sets))], "group long, class long, leader long")
    members = jaccard.in_several(groups, spark.createDataFrame([(c, c // 2 * 2) for c in range(1, 60, 2)], "u long, component long"))
    got = {tuple(r) for r in jaccard.pairs_across(members, known, rule).collect()}
    across = {(b, a) for a, b in itertools.combinations(range(len(sets)), 2) if a // 2 != b // 2}
    want = {(b, a) for b, a in across if rule.linked(set(sets[a].tolist()), set(sets[b].tolist()))}
    assert want and want <= got <= across and len(got) < len(across) / 4
    few = {tuple(r) for r in jaccard.pairs_across(members, known, rule, 1).collect()}
    assert (None, None) in few and few - {(None, None)} < got
    assert {(b // 2, a // 2) for b, a in few - {(None, None)}} == {(b // 2, a // 2) for b, a in got}


def test_near_copies_join_by_few_links(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(300)] = f"new{i}"
        texts.append(" ".join(copy))
    edges, joined = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: edges.append(links.distinct().count()) or joined(links))
    got = odd.by_id(jaccard.join_documents(odd.documents(spark, texts), 3, 90))
    rule = jaccard.Rule(3, 90)
    sets = [jaccard.word_set(t.encode(), 3) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if rule.linked(sets[a], sets[b])]
    assert len(links) > 5_000 and {i: r.component_id for i, r in got.items()} == groups(range(len(texts)), links)
    assert max(edges) < 1.2 * len(texts)


def test_pairs_beyond_the_most_alike(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "KEPT", 1, raising=False)
    rng, texts = random.Random(3), []
    for walk in range(6):
        words = [f"w{walk}x{k}" for k in range(120)]
        for step in range(30):
            texts.append(" ".join(words))
            for _ in range(rng.choice([1, 2, 3, 4])):
                words[rng.randrange(120)] = f"n{walk}x{step}"
    got = odd.by_id(jaccard.join_documents(odd.documents(spark, texts), 5, 80))
    rule = jaccard.Rule(5, 80)
    sets = [jaccard.word_set(t.encode(), 5) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if rule.linked(sets[a], sets[b])]
    want = groups(range(len(texts)), links)
    assert 6 < len(set(want.values())) < 150 and {i: r.component_id for i, r in got.items()} == want


def test_bands_hold_all_partners():
    for words, percent in ((3, 90), (5, 80), (1, 50)):
        rule = jaccard.Rule(words, percent)
        for a in range(1, 400):
            band = rule.band(a)
            for b in range(a, a * 100 // percent + 1):
                assert rule.band(b) in (band, band + 1)
                both = -(-percent * (a + b) // (100 + percent))  # least intersection of linked sets
                assert a + b - 2 * both <= rule.differ(band)


def test_allocation_meets_the_bound():
    for size, differ, documents in itertools.product((1, 5, 50, 600, 20_000), (0, 1, 5, 60, 2000), (1, 10**4, 10**9)):
        one, two, spare = jaccard.allocate(size, differ, documents)
        assert one + 2 * two - spare >= differ + 1
    assert jaccard.allocate(60, 40, 10**9)[1] > 0  # small segments, many documents: deletions pay


def test_one_deletion_neighbourhoods_meet():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        b = a[1:]  # differs in one token: any segment with budget 2 meets
        plan = (0, 1, 0)
        assert np.intersect1d(jaccard.signatures(a, 3, plan), jaccard.signatures(b, 3, plan)).size
        c = np.unique(np.append(b, np.uint64(5)))
        assert np.intersect1d(jaccard.signatures(a, 3, plan), jaccard.signatures(c, 3, plan)).size


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # several blocks in one component
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (v + 0.1 * rng.standard_normal(12)).tolist()) for i, v in enumerate(base[:40])]
    rows += [(300 + i, (base[0] + 0.15 * rng.standard_normal(12)).tolist()) for i in range(70)]
    rows += [(400 + i, (2 * base[1]).tolist()) for i in range(30)]
    odd_rows = [(500, None), (501, [0.0] * 12), (502, [float("nan")] * 12), (503, [1.0, None]), (504, []), (505, [1e300] * 12), (506, [1.0] * 11), (507, [2.0] * 11)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd_rows + rows[:1]], "vec_id long, embedding array<double>, class string")
    got = neighbours.near_duplicates(frame).collect()
    assert len(got) == len(rows) + len(odd_rows) + 1
    valid = rows + rows[:1]
    x = np.array([v for _, v in valid])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    ids = [i for i, _ in valid]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))]
    want, degree = groups(set(ids), links), dict(zip(ids, (close.sum(axis=1) - 1).tolist()))
    mine = {r.vec_id: r for r in got}
    assert all(mine[i].component_id == want[i] for i in ids)
    assert sum(mine[i].n_links for i in ids) >= 0.97 * sum(degree[i] for i in ids)
    assert all(mine[i].n_links <= degree[i] for i in ids)
    assert [tuple(mine[i])[1:4] for i in range(500, 506)] == [(0, i, True) for i in range(500, 506)]
    assert (mine[506].n_links, mine[507].component_id, mine[507].kept) == (1, 506, False)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def near(rng, v, cosine):
    """A vector with this cosine to the unit vector v."""
    side = rng.standard_normal(len(v))
    side -= side @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def exact(rows):
    """(component, links) of each id by brute force."""
    x = np.array([v for _, v in rows])
    close = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= 0.9
    ids = [i for i, _ in rows]
    least = groups(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    return {i: (least[i], n - 1) for i, n in zip(ids, close.sum(axis=1).tolist())}


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")


def test_tight_groups_that_link_across(spark):
    rng = np.random.default_rng(2)
    a = near(rng, np.eye(64)[0], 0.5)
    b = near(rng, a, 0.925)
    rows = [(i, near(rng, a if i < 12 else b, 0.9975)) for i in range(24)] + [(100 + i, rng.standard_normal(64)) for i in range(300)]
    want = exact(rows)
    assert {want[i][0] for i in range(24)} == {0} and min(want[i][1] for i in range(24)) > 12
    got = {r.vec_id: (r.component_id, r.n_links) for r in neighbours.near_duplicates(vector_frame(spark, rows)).collect()}
    assert got == want


def with_a_large_group(seed):
    """A large group of near copies, 20 pairs and other vectors."""
    rng = np.random.default_rng(seed)
    hot = near(rng, np.eye(64)[0], 0.5)
    rows = [(i, near(rng, hot, 0.999)) for i in range(200)] + [(1_000 + i, near(rng, np.eye(64)[i], 0.95)) for i in range(20)]
    return rows + [(2_000 + i, np.eye(64)[i]) for i in range(20)] + [(3_000 + i, rng.standard_normal(64)) for i in range(200)]


def test_audit_sees_pairs_beside_a_large_group(spark):
    rows = with_a_large_group(4)
    vectors = spark.createDataFrame([(i, v.tobytes(), 1) for i, v in rows], "id long, vec binary, copies long")
    links = [(i, n) for i, (_, n) in exact(rows).items() if n]
    for known, recall in ((links, 1.0), ([x for x in links if x[0] < 200], 0.0)):
        counted = spark.createDataFrame(known, "id long, links long")
        assert neighbours.audited(vectors, counted, 0.9) == recall


def test_exact_where_the_search_finds_too_little(spark, monkeypatch):
    rows = with_a_large_group(5)
    compared = neighbours.compared
    monkeypatch.setattr(neighbours, "compared", lambda *a: compared(*a).where("u < 1000 AND v < 1000"))
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1, raising=False)
    monkeypatch.setattr(neighbours, "RETRIES", 0, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    got = {r.vec_id: (r.component_id, r.n_links) for r in neighbours.near_duplicates(vector_frame(spark, rows)).collect()}
    assert got == exact(rows)


def brute_repeats(rows):
    first, out = {}, {}
    for doc, raw in sorted(rows, key=lambda r: r[0]):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i:i + 50], doc) < doc:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark):
    rng = random.Random(1)
    letters = "ab" if rng.random() < 0 else "abcdefgh \n"
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (49, 50, 51, 60, 84, 100, 400)]
    texts = []
    for _ in range(120):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut:], "é" * rng.randrange(0, 3) + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 70)))]
        texts.append("".join(parts))
    docs = odd.documents(spark, odd.TEXTS + texts)
    got = odd.by_id(repeats.remove_repeats(docs))
    want = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None])
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert repeats.remove_repeats(docs).count() == docs.count()
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
