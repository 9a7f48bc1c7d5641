"""Exact Jaccard join of documents on word shingles by universe-partition pigeonhole (operator 3).

Documents are sets of hashed word shingles. Sets fall into size bands so that partners lie in the same or the
next band. For a pair of bands at most H tokens may differ, so tokens are hashed into segments, each
segment is given a budget, and some segment differs in fewer tokens than its budget if the budgets sum up to more than
H: budget 1 is met by equal segments, budget 2 also by segments that are equal up to one deleted token. A segment's
name is the sum of its tokens' hashes, so a deletion is a subtraction.

Only a subset of a document's segments is filed: segments without tokens, which many documents share, have budget
0. To make up for them there are `spare` more segments than H asks for; the few documents with more empty segments
than that file the empty ones too, so two such documents still meet. The allocation of each band is the cheapest
one: a signature costs one row and the rows it is expected to meet, which follow from the number of documents of
the band and the tokens of a segment.

Documents with the same set are one class. Classes that share a signature are a group of candidates; its smallest class is its leader.
Each class has a sketch, the parities of its tokens hashed into bits: two sets differ in at least as many tokens as their
sketches do in bits (of the same width; folding halves it). So pairs whose sketches differ too much are no links, and only the
others are verified exactly on the words. First each class is paired with the smallest of its leaders whose sketch allows a link.
Where all are links, all classes of a group are one component already. Similar classes share a signature, hence a group, so only
groups that hold several components are looked at again: the sketches of classes in different components are compared within a
task, those of groups of more than CROWD classes in blocks, without the blocks inside one component. Of the pairs that may be
links a group gives the KEPT most alike for each two components; where there were more, this is repeated with the components
found and more pairs, at last all. So neither candidates nor texts of unlike classes travel, large groups of near copies cost
a few pairs for each class, and no link between components is missed.

Texts without words, and null texts, have no shingles and link with nothing. Rows that repeat a doc_id are
joined each; a null doc_id takes part, but names a component only if no other does (null then). Only doc_id and text are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.components import components
from urbanpulse.llm.neighbours import whole_groups
from urbanpulse.llm.packing import dealt, mix, packed_parts, whole_parts
from urbanpulse.llm.text import Memory, slices
from urbanpulse.session import materialise, small_side

WORDS, PERCENT = 3, 90
RARITY = 3.0
SLICE_CHARS = 1_000_000
BLOCK = 1_024  # classes of a block of sketches
CROWD = 2_048  # classes of a group that is compared at once
KEPT = 16  # pairs verified for two components of a group, 64 times as many each time that is not enough
SKETCH_BITS = 1 << 16  # widest sketch; sets that need more pass more often
COMPARED = 1 << 20  # words of sketches compared at a time
HELD = 500_000  # signatures packed at a time
REMEMBERED = 100_000  # words whose names a task keeps; others are named again
PARTS = 8  # of signatures for each task that looks for candidates, one in memory at a time


class Rule:
    """Shingle width and least similarity in percent, with the size bands that follow from it."""

    def __init__(self, words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent = words, percent
        self.lows = [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def differ(self, band: int) -> int:
        """Most tokens in which partners of band and the same or next band may differ."""
        high = self.lows[band] * 100 // self.percent
        return (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def may_link(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes that differ in at least `apart` tokens can be linked."""
        near = apart.astype(np.int64) * (100 + self.percent) <= (a + b) * (100 - self.percent)
        return near & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))

    def sketch_bits(self, size: int) -> int:
        """A power of two, several times the tokens in which partners of a set of this size may differ."""
        differ = (size + size * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        return min(SKETCH_BITS, 64 << max(0, (8 * differ - 1) // 64).bit_length())

    def linked(self, a: set, b: set) -> bool:
        both = len(a & b)
        return bool(both) and 100 * both >= self.percent * (len(a) + len(b) - both)


def allocate(size: float, differ: int, documents: int) -> tuple[int, int, int]:
    """Segments with budget 1 and with budget 2, and how many spare ones are among the former, at the least cost.

    RARITY is how much rarer each further token makes it that unrelated documents agree on a segment.
    """
    best = (math.inf, 0, 0, 0)
    most = (differ + 2) // 2
    for two in sorted({round(most * k / 8) for k in range(9)}):
        one, spare = max(0, differ + 1 - 2 * two), 0
        for _ in range(20 if one > 1 else 0):
            empty = (one + spare) * math.exp(-size / (one + spare + two))
            if (wanted := math.ceil(empty + 4 * math.sqrt(empty))) <= spare:
                break
            spare = wanted
        tokens = size / (one + spare + two)
        met = documents * math.exp(-RARITY * tokens)
        deep = documents * math.exp(-tokens)  # files with empty segments, as these have no spare ones
        cost = (one + spare) * (1 + met) + two * (1 + tokens) * (1 + (met + deep) * (1 + tokens))
        best = min(best, (cost, one + spare, two, spare))
    return best[1:]


def word_names(words: list[bytes]) -> np.ndarray:
    """64-bit names of words, the same in every process."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data + np.uint64(1), mix(place, place)), dtype=np.uint64)])
    return mix(lengths.astype(np.uint64), total[starts + lengths] - total[starts])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The set of names of n-word shingles, sorted; fewer words are one shingle."""
    n = min(n, len(words))
    if not n:
        return words[:0]
    out = words[:len(words) - n + 1]
    for k in range(1, n):
        out = mix(out, words[k:len(words) - n + 1 + k])
    return np.unique(out)


def sets_of(batch: pa.RecordBatch, memory: Memory, n: int):
    """(row, set) for every text of a batch."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
    for a, b in slices(lengths, SLICE_CHARS):
        words = [(t or b"").lower().split() for t in batch.column("text").slice(a, b - a).cast(pa.binary()).to_pylist()]
        names = memory([w for ws in words for w in ws])
        at = 0
        for row, own in enumerate(words, a):
            yield row, shingles(names[at:at + len(own)], n)
            at += len(own)


def class_name(tokens: np.ndarray) -> int:
    """Name of a set: the mixed sum of its tokens' names."""
    return int(mix(mix(tokens, tokens).sum(dtype=np.uint64)[None], np.array([len(tokens)], np.uint64)).view(np.int64)[0])


def set_rows(batches, n: int):
    memory = Memory(word_names, REMEMBERED)
    for batch in batches:
        rows = [(len(s), class_name(s) if len(s) else None) for _, s in sets_of(batch, memory, n)]
        size, name = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(name, pa.int64())],
                                         ["doc_id", "n_shingles", "class"])


def signatures(tokens: np.ndarray, band: int, plan: tuple[int, int, int]) -> np.ndarray:
    """Names of the segments that are filed, and of the one-deletion neighbourhoods of those with budget 2, which come first."""
    one, two, spare = plan
    segment = (mix(np.array([band], np.uint64), tokens) % np.uint64(one + two)).astype(np.int64)
    names = mix(tokens, tokens)
    sums = np.zeros(one + two, np.uint64)
    np.add.at(sums, segment, names)
    filed = np.bincount(segment, minlength=one + two) > 0
    filed[:two] = True
    if (~filed).sum() > spare:
        filed[:] = True
    place = np.arange(one + two, dtype=np.uint64) + np.uint64(band << 32)
    out = [mix(place[filed], sums[filed])]
    if two:
        deep = np.flatnonzero(segment < two)
        out.append(mix(place[segment[deep]], sums[segment[deep]] - names[deep]))
    return np.unique(np.concatenate(out)) if two else out[0]


def signature_rows(batches, rule: Rule, plans: dict[int, tuple[int, int, int]], parts: int):
    """Signatures of the different sets of each batch, packed by part."""
    memory = Memory(word_names, REMEMBERED)

    def packed() -> pa.RecordBatch:
        sig = np.concatenate(names)
        return packed_parts((sig % np.uint64(parts)).astype(np.int64), sig, np.zeros(len(sig), np.uint64), np.concatenate(owners))

    for batch in batches:
        seen, names, owners, held = set(), [], [], 0
        for _, tokens in sets_of(batch, memory, rule.words):
            if not len(tokens) or (name := class_name(tokens)) in seen:
                continue
            seen.add(name)
            band = rule.band(len(tokens))
            for scheme in (band, band - 1):
                if scheme in plans:
                    own = signatures(tokens, scheme, plans[scheme])
                    names.append(own)
                    owners.append(np.full(len(own), name))
                    held += len(own)
            if held > HELD:
                yield packed()
                names, owners, held = [], [], 0
        if names:
            yield packed()


def candidate_rows(batches):
    """Different groups of classes that share a signature: (group, class, leader), the leader is the smallest class."""
    for sig, _, name in whole_parts(batches):
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
        sig, name = sig[new], name[new]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        start, at = np.flatnonzero(first), np.cumsum(first) - 1
        count = np.diff(start, append=len(sig))
        names = mix(name.view(np.uint64), name.view(np.uint64))
        group = mix(np.add.reduceat(names, start), count.astype(np.uint64))
        chosen = np.zeros(len(start), bool)
        chosen[np.unique(group, return_index=True)[1]] = True
        rows = (chosen & (count > 1))[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(group[at[rows]].view(np.int64)), pa.array(name[rows]), pa.array(name[start][at[rows]])], ["group", "class", "leader"])


def pair_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def word_set(text: bytes, n: int) -> set:
    words = text.lower().split()
    n = min(n, len(words))
    return set(zip(*[words[k:] for k in range(n)])) if n else set()


def verified(batches, rule: Rule):
    """The pairs that are similar enough."""
    unsqueeze = zstandard.ZstdDecompressor().decompress
    held: tuple[int | None, set] = (None, set())
    for batch in batches:
        good = []
        for v, a, b in zip(*[batch.column(c).to_pylist() for c in ("v", "v_text", "u_text")]):
            if v != held[0]:
                held = (v, word_set(unsqueeze(a), rule.words))
            good.append(rule.linked(held[1], word_set(unsqueeze(b), rule.words)))
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def sketch(tokens: np.ndarray, bits: int) -> bytes:
    """Bit by bit whether an odd number of tokens falls on it."""
    place = (mix(np.uint64(1), tokens) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of some rows, folded to a common width when two are compared."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.width, self.folded = raw, np.array([len(r) // 8 for r in raw], np.int64), {}

    def of_width(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Folded sketches of the rows that are at least as wide, and where each row's is."""
        if words not in self.folded:
            rows = np.flatnonzero(self.width >= words)
            out, at = np.empty((len(rows), words), np.uint64), np.zeros(len(self.raw), np.int64)
            at[rows] = np.arange(len(rows))
            for k, r in enumerate(rows.tolist()):
                out[k] = np.bitwise_xor.reduce(np.frombuffer(self.raw[r], np.uint64).reshape(-1, words), axis=0)
            self.folded[words] = out, at
        return self.folded[words]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows i and j differ."""
        out, words = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(words).tolist():
            own, (folded, at) = np.flatnonzero(words == w), self.of_width(w)
            for some in np.array_split(own, 1 + len(own) * w // COMPARED):
                out[some] = np.bitwise_count(folded[at[i[some]]] ^ folded[at[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


def alike_leaders(batches, rule: Rule):
    """The pairs whose sketches allow a link."""
    for batch in batches:
        n = batch.num_rows
        both = Sketches(batch.column("u_sketch").to_pylist() + batch.column("v_sketch").to_pylist())
        apart = both.apart(np.arange(n), np.arange(n, 2 * n))
        alike = rule.may_link(batch.column("u_size").to_numpy(), batch.column("v_size").to_numpy(), apart)
        yield batch.select(["u", "v"]).filter(pa.array(alike))


def alike_pairs(batches, rule: Rule, most: int | None):
    """(u, v), u > v, whose sketches allow a link and whose components differ, from rows sorted by group: the `most` most alike
    ones (None: all) for each two components. A row of nulls says that there were more."""
    for table in whole_groups(batches):
        group, side, name, component, size = (table.column(c).to_numpy() for c in ("group", "side", "class", "component", "size"))
        sketches, found = Sketches(table.column("sketch").to_pylist()), []
        two_sided = np.isin(group, np.unique(group[side > 0]))
        for step in range(1, len(group)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            i = np.flatnonzero(same & (component[step:] != component[:-step]) & ~(two_sided[step:] & (side[step:] == side[:-step])))
            apart = sketches.apart(i, i + step)
            alike = rule.may_link(size[i], size[i + step], apart)
            found.append((i[alike], i[alike] + step, apart[alike]))
        i, j, apart = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        order = np.lexsort((name[j], name[i], apart, high, low, group[i]))
        i, j, low, high = i[order], j[order], low[order], high[order]
        new = np.ones(len(i), bool)
        new[1:] = (group[i][1:] != group[i][:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(new)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        keep = np.ones(len(i), bool) if most is None else rank < most
        yield pair_batch(np.maximum(name[i], name[j])[keep], np.minimum(name[i], name[j])[keep])
        if not keep.all():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["u", "v"])


def in_blocks(members: DataFrame) -> DataFrame:
    """(group, side, class, component, size, sketch): the pairs of blocks of each group, without those inside one component.

    A component of many classes has blocks of its own; classes of small ones are dealt into common blocks.
    """
    members = members.withColumnRenamed("group", "cluster")
    of_component = members.groupBy("cluster", "component").agg(F.count("*").alias("own"))
    small = F.sum(F.when(F.col("own") < BLOCK, F.col("own")).otherwise(0))
    of_cluster = of_component.groupBy("cluster").agg(F.ceil(small / BLOCK).alias("common"))
    large = of_component.where(F.col("own") >= BLOCK).select("cluster", "component", F.ceil(F.col("own") / BLOCK).alias("blocks"))
    kinds = large.select("cluster", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).union(
        of_cluster.where("common > 0").select("cluster", F.lit(None).cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("common") - 1))))
    kinds = kinds.select("cluster", F.col("component").alias("theirs"), F.col("block").alias("their_block"))
    placed = members.join(large, ["cluster", "component"], "left").join(of_cluster, "cluster").select(
        "cluster", "class", "component", "size", "sketch", F.when(F.col("blocks").isNotNull(), F.col("component")).alias("mine"),
        F.pmod(F.xxhash64("class"), F.coalesce("blocks", "common")).alias("my_block"))
    pairs = placed.join(kinds, "cluster").where(~F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False)))
    me, they = F.struct("mine", "my_block"), F.struct(F.col("theirs").alias("mine"), F.col("their_block").alias("my_block"))
    key = lambda x: F.xxhash64(F.coalesce(x["mine"], F.lit(0)), x["mine"].isNull(), x["my_block"])
    a, b = key(me), key(they)
    return pairs.select(
        F.xxhash64("cluster", F.least(a, b), F.greatest(a, b)).alias("group"), (a > b).cast("int").alias("side"), "class", "component", "size", "sketch")


def in_several(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(group, class, leader, component, classes) of the groups whose classes lie in several components; classes: how many they are."""
    named = groups.join(parts.withColumnRenamed("u", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    own = named.groupBy("group").agg(F.count("*").alias("classes"), F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(own.where("low <> high").select("group", "classes"), "group")


def pairs_across(members: DataFrame, known: DataFrame, rule: Rule, most: int | None = None) -> DataFrame:
    """Different pairs (u, v), u > v, of classes of a group that lie in different components and whose sizes and sketches allow a link.

    Of each two components of a group the `most` most alike ones (None: all), and one row of nulls if there are more. Classes
    that have no sketches are compared by size.
    """
    sketches = known.select("class", "size", F.coalesce("sketch", F.lit(bytes(8))).alias("sketch") if "sketch" in known.columns else F.lit(bytes(8)).alias("sketch"))
    sized = members.join(sketches, "class")
    rows = sized.where(F.col("classes") <= CROWD).select("group", F.lit(0).alias("side"), "class", "component", "size", "sketch")
    many = members.where(F.col("classes") > CROWD)
    if not many.isEmpty():
        large = materialise(sized.where(F.col("classes") > CROWD).select("group", "class", "component", "size", "sketch"))
        rows = rows.unionByName(in_blocks(large))
    grouped = rows.repartition(shuffle_parts(members), "group").sortWithinPartitions("group")
    return grouped.mapInArrow(lambda b: alike_pairs(b, rule, most), "u long, v long").distinct()


def class_rows(batches, rule: Rule):
    """Size, sketch and text of the rows whose class is the one asked for, or any if none is."""
    memory, squeeze = Memory(word_names, REMEMBERED), zstandard.ZstdCompressor(3).compress
    for batch in batches:
        kept, rows, asked = [], [], batch.column("class").to_pylist()
        for row, tokens in sets_of(batch, memory, rule.words):
            if len(tokens) and (name := class_name(tokens)) == (name if asked[row] is None else asked[row]):
                kept.append(row)
                rows.append((name, len(tokens), sketch(tokens, rule.sketch_bits(len(tokens)))))
        texts = [squeeze(t) for t in batch.column("text").take(pa.array(kept, pa.int64())).cast(pa.binary()).to_pylist()]
        names, sizes, sketches = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(texts, pa.binary())],
                                         ["class", "size", "sketch", "text"])


def plans_of(sets: DataFrame, rule: Rule) -> dict[int, tuple[int, int, int]]:
    """The allocation of each band, from the sizes of all sets; one row for each size and no more is read."""
    bands: dict[int, list[int]] = {}
    for row in sets.where("n_shingles > 0").groupBy("n_shingles").count().toLocalIterator():
        own = bands.setdefault(rule.band(row.n_shingles), [0, 0])
        own[0] += row["count"]
        own[1] += row.n_shingles * row["count"]
    plans = {}
    for band in {b for own in bands for b in (own, own - 1) if b >= 0}:
        n, total = (sum(x) for x in zip(*[bands.get(b, [0, 0]) for b in (band, band + 1)]))
        plans[band] = allocate(total / n, rule.differ(band), n)
    return plans


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release(df: DataFrame) -> None:
    """Let the shuffle files of plans that nothing refers to any more go now: Spark removes them when the driver collects its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def linked_classes(docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(u, component) of the classes that have links, joined by all links between similar classes."""
    partitions = shuffle_parts(docs)
    plans = plans_of(sets, rule)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    packed = texts.select("text").mapInArrow(lambda b: signature_rows(b, rule, plans, PARTS * partitions), "part int, blob binary")
    groups = materialise(dealt(packed, partitions).mapInArrow(candidate_rows, "group long, class long, leader long").distinct())
    del packed
    release(docs)
    asked = groups.select("class").distinct()
    wanted = small_side(asked.join(sets.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "class"))
    rows = texts.where("doc_id IS NOT NULL").join(wanted, "doc_id")
    if not wanted.where("doc_id IS NULL").isEmpty():  # classes of rows without a doc_id only
        rows = rows.unionByName(texts.where("doc_id IS NULL").withColumn("class", F.lit(None).cast("long")))
    known = materialise(rows.mapInArrow(
        lambda b: class_rows(b, rule), "class long, size long, sketch binary, text binary").dropDuplicates(["class"]))

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        """The pairs with these columns of both classes."""
        for side in "uv":
            pairs = pairs.join(known.select(F.col("class").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        return materialise(sides(pairs, "text").mapInArrow(lambda b: verified(b, rule), "u long, v long"))

    leaders = groups.where("class <> leader").select(F.col("class").alias("u"), F.col("leader").alias("v")).distinct()
    alike = sides(leaders, "size", "sketch").mapInArrow(lambda b: alike_leaders(b, rule), "u long, v long")
    tested = materialise(alike.groupBy("u").agg(F.min("v").alias("v")))
    links = verify(tested)
    release(docs)
    parts, most = components(links), KEPT
    while True:
        several = materialise(in_several(groups, parts))
        pairs = materialise(pairs_across(several, known, rule, most))
        release(docs)
        new = pairs.where("u IS NOT NULL").join(tested, ["u", "v"], "left_anti")
        found = verify(new)
        release(docs)
        if not found.isEmpty():
            links = links.union(found)
            parts = components(links)
        if pairs.where("u IS NULL").isEmpty():
            return parts
        tested, most = tested.union(pairs.where("u IS NOT NULL")).distinct(), most * 64 if most < 64 * KEPT else None


def join_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rule = Rule(words, percent)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = materialise(texts.mapInArrow(lambda b: set_rows(b, words), "doc_id long, n_shingles long, class long"))
    parts = linked_classes(docs, sets, rule).withColumnRenamed("u", "class")
    classes = sets.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = classes.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = named.join(smallest, "component").select("class", "component_id")
    return sets.join(of_class, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
