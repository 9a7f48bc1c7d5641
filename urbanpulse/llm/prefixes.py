"""A trie of conversation prefixes: which turns are shared, by how many conversations, and what sharing them saves.

Conversations become paths of turn digests, sorted by range into shards. A shard's trie is a sequence of balanced parentheses,
an opening for each node in preorder. Blocks of the running excess keep their minima in a tree, with which the closing
parenthesis of every node is found; it delimits the subtree. The rank of pairs "()" counts leaves in it, and differences
of cumulative arrays give its conversations and savings.

Nodes on the first and the last path of a shard (its spines) may go on in other shards. What a shard knows of them goes on as two
paths with sums beside their nodes; these paths are sorted into shards again, until one shard holds all that are left.
Each round leaves two paths a shard, so no task holds the whole trie. A conversation is one row of digests (36 bytes a turn).
Ids of conversations that end at a spine node travel as compressed runs and are hashed in order, run by run.

Null roles and texts are empty. Turns with the same number, or none, come in the order of SHA-256 of role and text; repeated rows are
repeated turns. Rows without conv_id are left out. An empty table has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.session import materialise, small_side

HEADS = 6  # a conversation takes over 0 to HEADS - 1 turns
FAMILY = 100  # conversations that share a base
SHARD = 200_000  # turns and conversations of a shard
BLOCK = 64  # parentheses of an excess block
DIGEST = 32  # bytes
NO_ID = 2**63 - 1  # greater than or equal to every conv_id
SUMS = ("n", "first", "kids", "leaves", "saved")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of the turns in a row), chars (code points of their texts) of every rebuilt conversation.

    A conversation takes the first h turns of its family's first conversation and then its own after its first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.char_length(text).alias("chars")).alias("t"))
    own = materialise(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")))
    bases = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    known = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h}).join(bases, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    path = F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return known.select("conv_id", path.alias("p")).select(
        "conv_id", F.unhex(F.array_join(F.transform("p", lambda t: t["digest"]), "")).alias("path"),
        F.transform("p", lambda t: t["chars"]).alias("chars"))


class Parentheses:
    """Balanced parentheses of a forest given by the depths of its nodes in preorder."""

    def __init__(self, depth: np.ndarray):
        self.opens = 2 * np.arange(len(depth)) - depth
        step = np.full(2 * len(depth), -1, np.int64)
        step[self.opens] = 1
        pairs = np.concatenate([(step[:-1] == 1) & (step[1:] == -1), [False]])
        self.leaf = pairs[self.opens]
        self.excess = np.cumsum(step)
        blocks = -(-len(step) // BLOCK)
        padded = np.full(blocks * BLOCK, NO_ID, np.int64)
        padded[:len(step)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        width = 1 << max(0, int(blocks - 1).bit_length())
        least = np.full(width, NO_ID, np.int64)
        least[:blocks] = self.blocks.min(axis=1)
        self.least = [least]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))

    def closes(self) -> np.ndarray:
        """For every node the place of its closing parenthesis: the first later one with an excess below its own."""
        out = np.empty(len(self.opens), np.int64)
        for a in range(0, len(out), 1 << 16):  # so many at a time, for memory
            out[a:a + (1 << 16)] = self.close(self.opens[a:a + (1 << 16)])
        return out

    def close(self, at: np.ndarray) -> np.ndarray:
        below = self.excess[at] - 1
        block = at // BLOCK
        inside = (self.blocks[block] <= below[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        far = np.flatnonzero(~inside.any(axis=1))
        block[far] = self.next_block(block[far], below[far])
        inside[far] = self.blocks[block[far]] <= below[far][:, None]
        return block * BLOCK + inside.argmax(axis=1)

    def next_block(self, block: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The first later block with a minimum of at most `below`: up the tree to a right neighbour that has one, then down."""
        node, height = block.copy(), np.full(len(block), -1)
        for level, least in enumerate(self.least):
            up = height < 0
            right = up & (node % 2 == 0)
            right[right] = least[np.minimum(node[right] + 1, len(least) - 1)] <= below[right]
            node[right] += 1
            height[right] = level
            node[up & ~right] //= 2
        for level in range(len(self.least) - 2, -1, -1):
            down = height > level
            node[down] *= 2
            skip = down.copy()
            skip[down] = self.least[level][node[down]] > below[down]
            node[skip] += 1
        return node


class Shard:
    """The trie of paths that come in their order, with sums added at its nodes."""

    def __init__(self):
        self.depth, self.parent, self.digest, self.chars = [0], [-1], [b""], [0]
        self.path, self.first_path = [0], None
        self.before = b""

    def add(self, path: bytes, chars: list[int]) -> list[int]:
        """The nodes of a path, the root first; new ones follow in preorder."""
        size, shared = len(path), 0
        most = min(size, len(self.before))
        if path[:most] == self.before[:most]:
            shared = most // DIGEST
        else:
            while path[shared * DIGEST:(shared + 1) * DIGEST] == self.before[shared * DIGEST:(shared + 1) * DIGEST]:
                shared += 1
        del self.path[shared + 1:]
        for d in range(shared, size // DIGEST):
            self.parent.append(self.path[-1])
            self.path.append(len(self.depth))
            self.depth.append(d + 1)
            self.digest.append(path[d * DIGEST:(d + 1) * DIGEST])
            self.chars.append(chars[d])
        self.before = path
        if self.first_path is None:
            self.first_path = list(self.path)
        return self.path

    def keys(self, nodes: Iterable[int]) -> dict[int, bytes]:
        """Names of nodes, which must come in preorder and with all that lead to them: digests of their turns."""
        out: dict[int, bytes] = {}
        for v in nodes:
            out[v] = hashlib.sha256(out.get(self.parent[v], b"") + self.digest[v]).digest()
        return out


NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, key binary, parent_key binary")
SPINES = "path binary, chars array<int>, " + ", ".join(f"{c} array<long>" for c in SUMS)
SHARDED = f"kind string, {NODES}, run long, ids binary, {SPINES}"
EMPTY = hashlib.sha256(b"").hexdigest()


def record(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    given = {c: x if isinstance(x, pa.Array) else pa.array(x, schema.field(c).type) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.rsplit(" ", 1) for c in SHARDED.split(", "))])


def shard_rows(batches: Iterable[pa.RecordBatch], lowest: bool, alone: bool) -> Iterator[pa.RecordBatch]:
    """Nodes that are settled in this shard, its spines, and the ids that end at them.

    lowest: rows are conversations, else paths with sums. alone: no other shard has any row, so nothing stays open.
    """
    shard, sums, ends = Shard(), {c: {} for c in SUMS}, {}
    for batch in batches:
        rows = batch.to_pydict()
        for i, path in enumerate(rows["path"]):
            nodes = shard.add(path, rows["chars"][i])
            if lowest:
                ends.setdefault(nodes[-1], []).append(rows["conv_id"][i])
            else:
                for c in SUMS:
                    into, join = sums[c], min if c == "first" else int.__add__
                    for node, value in zip(nodes, rows[c][i]):
                        into[node] = join(into[node], value) if node in into else value
    if shard.first_path is None:
        return
    size = len(shard.depth)
    depth, parent, chars = (np.array(x, np.int64) for x in (shard.depth, shard.parent, shard.chars))
    given = {c: np.full(size, NO_ID if c == "first" else 0, np.int64) for c in SUMS}
    if lowest:
        sums = {"n": {v: len(ids) for v, ids in ends.items()}, "first": {v: ids[0] for v, ids in ends.items()}}
    for c, values in sums.items():
        given[c][np.fromiter(values, np.int64, len(values))] = np.fromiter(values.values(), np.int64, len(values))
    open_ = np.zeros(size, bool)
    if not alone:
        open_[shard.first_path] = open_[shard.path] = True

    tree = Parentheses(depth)
    subtree = (tree.closes() - tree.opens + 1) // 2
    here = np.arange(size)

    def within(values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        running = np.concatenate([[0], np.cumsum(values)])
        return running[here + subtree] - running[here]

    settled = ~open_
    n = within(given["n"])
    leaves = within(given["leaves"] + (tree.leaf & (given["kids"] == 0) & settled))
    saved = within(given["saved"] + np.where(settled, (n - 1) * chars, 0))
    first, kids = given["first"], given["kids"]
    hangs = settled & (here > 0)  # what an open node hands to its open parent is added up in the next round
    upward = np.flatnonzero(hangs)[np.argsort(-depth[hangs], kind="stable")]
    for level in np.split(upward, np.flatnonzero(np.diff(depth[upward])) + 1):
        np.minimum.at(first, parent[level], first[level])
    np.add.at(kids, parent[hangs], 1)
    schema, names = arrow_schema(), shard.keys(np.flatnonzero(open_ | (not lowest)).tolist())

    at = np.flatnonzero(settled)
    inner = np.where(here > 0, ~open_[parent], True)[at]
    above = np.where(here > 0, parent, 0)[at]
    columns = {
        "kind": ["node"] * len(at), "conv_id": first[at], "depth": depth[at], "n_convs": n[at], "n_children": kids[at],
        "n_leaves": leaves[at], "saved_tokens": saved[at],
        "parent_conv_id": pa.array(first[above], mask=~inner | (at == 0)),
        "parent_key": [None if known else names[v] for v, known in zip(above.tolist(), inner)],
        "key": [names.get(v) for v in at.tolist()],
        "ends_sha256": [hashed(ends.get(int(v), ())) for v in at] if lowest else [None] * len(at),
    }
    for a in range(0, len(at), 50_000):
        yield record({c: x[a:a + 50_000] for c, x in columns.items()}, schema)
    runs = [(v, ids) for v, ids in ends.items() if open_[v]]
    if runs:
        yield record({"kind": ["ends"] * len(runs), "key": [names[v] for v, _ in runs], "run": [ids[0] for _, ids in runs],
                      "ids": [zstandard.ZstdCompressor().compress(np.array(ids, "<i8").tobytes()) for _, ids in runs]}, schema)
    if not alone:
        yield record(spines(shard, open_, {"n": n, "leaves": leaves, "saved": saved}, first, kids), schema)


def spines(shard: Shard, open_: np.ndarray, totals: dict[str, np.ndarray], first: np.ndarray, kids: np.ndarray) -> dict[str, list]:
    """The first and the last path with what hangs on their nodes, which is what the subtree has less that of open children."""
    lower = np.flatnonzero(open_)[1:]
    sums = {"first": first, "kids": kids}
    for c, total in totals.items():
        sums[c] = total.copy()
        np.subtract.at(sums[c], np.array(shard.parent)[lower], total[lower])
    told, out = set(), {c: [] for c in ("kind", "path", "chars", *SUMS)}
    for path in (shard.first_path, shard.path):
        if told and path == shard.first_path:
            continue
        out["kind"].append("spine")
        out["path"].append(b"".join(shard.digest[v] for v in path))
        out["chars"].append([shard.chars[v] for v in path[1:]])
        for c in SUMS:
            out[c].append([(NO_ID if c == "first" else 0) if v in told else int(sums[c][v]) for v in path])
        told.update(path)
    return out


def hashed(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def ended(runs: DataFrame) -> DataFrame:
    """key, ends_sha256 from runs of ids; the runs of a key are hashed one after the other."""
    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != now and state:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])
                told = ",".join(map(str, np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), "<i8").tolist()))
                if key != now:
                    now, state = key, hashlib.sha256(told.encode())
                else:
                    state.update(f",{told}".encode())
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return runs.select("key", "run", "ids").repartition("key").sortWithinPartitions("key", "run").mapInArrow(stream, "key binary, ends_sha256 string")


def sharded(rows: DataFrame, order: list[str | Column], lowest: bool, shard: int) -> tuple[DataFrame, bool]:
    """The rows of shards, written; whether one shard held everything."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("chars") + 1).alias("turns")).first()
    parts = min(-(-(size["turns"] or 0) // shard), -(-size["n"] // 4))  # four paths a shard, so that rounds come to an end
    alone = parts <= 1
    dealt = rows.repartition(1) if alone else rows.repartitionByRange(parts, *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_rows(batches, lowest, alone)

    return materialise(dealt.sortWithinPartitions(*order).mapInArrow(run, SHARDED)), alone


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    conv_id is the smallest conversation that starts with the node's turns; saved_tokens are code points that need not be kept,
    in the whole subtree; ends_sha256 hashes the ids of conversations that end at the node.
    """
    out = [c.split()[0] for c in NODES.split(", ")][:8]
    told, alone = sharded(materialise(rebuilt(conversations)), ["path", "conv_id"], True, shard)
    nodes = told.where("kind = 'node'")
    if alone:
        return nodes.select(*out)
    ends = ended(told.where("kind = 'ends'"))
    upper = None
    while not alone:
        told, alone = sharded(told.where("kind = 'spine'").select(*[c.split()[0] for c in SPINES.split(", ")]), ["path"], False, shard)
        found = told.where("kind = 'node'")
        upper = found if upper is None else upper.unionByName(found)
    upper = upper.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    upper = materialise(upper.select(nodes.columns[1:11]))
    every = nodes.select(upper.columns).unionByName(upper)
    tops = small_side(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    hanging = every.where("parent_key IS NOT NULL").drop("parent_conv_id").join(tops, "parent_key").withColumnRenamed("_parent", "parent_conv_id")
    return every.where("parent_key IS NULL").select(*out).unionByName(hanging.select(*out))
