"""Near-duplicate vectors by NN-descent (operator 2).

A graph of the K nearest neighbours found so far is begun from random-projection trees and refined: the
neighbours of a vector, both those it lists and those that list it, are compared with each other,
and every vector keeps the best K it has met. Pairs with cosine >= threshold are links; what a comparison joins by
links stays joined, also where a list has no room for the pair.

A list whose K-th neighbour is still a link is saturated: there may be more. Then the search is repeated outside the
components found, so that lists hold vectors of other components only, until no list is saturated. Within a component
the vectors are compared in blocks, and only the number of links of each leaves a task, so all its links are counted.

Recall is audited: the links of a bounded sample of vectors are counted by brute force. The share known is averaged over
vectors, apart for those with few and with many links, so a large group does not hide small ones. While any of these
shares is below RECALL, further trees follow, more of them the deeper they are. If ATTEMPTS do not reach it, all
vectors are compared with all others in blocks, which is exact.

Equal vectors are one class, compared once and counted by their number, so copies do not grow the work. Groups
that meet in a task are bounded: crowded tree leaves and long lists of listers are dealt into chunks by hash.

Vectors that are null, zero, or hold a null or non-finite component link with nothing, nor do vectors of
different length. Rows that repeat a vec_id count as that many vectors with one component. Rows with a null
vec_id take no part in links; they are returned with 0 links, no component and kept false. Only vec_id and embedding are read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanpulse.llm.components import components
from urbanpulse.session import materialise

THRESHOLD = 0.9
K = 10
TREES, ROUNDS = 6, 3
LEAF, CHUNK, BLOCK, WIDE = 48, 40, 512, 8_192
SHARED = 0.856  # chance that a plane has both ends of a pair at cosine 0.9 on one side
AUDIT = 1_024  # vectors in the audit for each power of two of links found
RECALL, ATTEMPTS = 0.97, 4


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows scaled to length 1, in double precision. Raw rows are of one length."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(batches):
    """Valid vectors as bytes of doubles; null for others."""
    for batch in batches:
        rows = []
        for v in batch.column("embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            rows.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], ["vec_id", "vec"])


def leaves(batches, trees: list[int], depth: int):
    """(leaf, id, home, vec, least): each vector in one leaf of every tree, the signs of `depth` random projections."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = unit([raw[i] for i in at])
            for tree in trees:
                key = (tree, size)
                if key not in planes:
                    planes[key] = np.random.default_rng([tree, size]).standard_normal((x.shape[1], depth))
                code = ((x @ planes[key]) > 0) @ (1 << np.arange(depth, dtype=np.int64))
                leaf = (code * 1_000 + tree) * 65_536 + size // 8 % 65_536
                ids, home = (batch.column(c).take(pa.array(at)) for c in ("id", "home"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), ids, home, pa.array([raw[i] for i in at], pa.binary()), pa.array(np.full(len(at), -2.0))],
                    ["pivot", "id", "home", "vec", "least"])


def whole_groups(batches):
    """Rows sorted by group, several whole groups at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        group = table.column("group").to_numpy()
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def local_join(batches, k: int, threshold: float):
    """(u, v, cosine, link): for each member of a group its best k fellows of other homes that beat its least neighbour,
    and the first member it is joined with by links of the group (cosine -2)."""
    for table in whole_groups(batches):
        group, ids, home, least = (table.column(c).to_numpy() for c in ("group", "id", "home", "least"))
        raw = table.column("vec").to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        length = np.array([len(r) for r in raw])
        for width in np.unique(2 ** np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)).tolist():
            mine = np.flatnonzero((sizes <= width) & (sizes > width // 2) & (sizes > 1))
            for some in np.array_split(mine, max(1, len(mine) * width * width // 400_000)) if len(mine) else ():
                for size in np.unique(length[starts[some]]).tolist():
                    yield best_fellows(some[length[starts[some]] == size], width, starts, sizes, ids, home, least, raw, k, threshold)


def best_fellows(groups, width, starts, sizes, ids, home, least, raw, k, threshold):
    place = np.arange(width)
    there = place < sizes[groups][:, None]
    at = np.where(there, starts[groups][:, None] + place, starts[groups][:, None])
    x = unit([raw[i] for i in at.ravel()]).reshape(len(groups), width, -1)
    cosine = x @ x.transpose(0, 2, 1)
    own, homes = ids[at], home[at]
    cosine[~(there[:, None, :] & there[:, :, None]) | (homes[:, :, None] == homes[:, None, :])] = -3
    top = min(k, width - 1)
    fellow = np.argpartition(-cosine, top - 1, axis=2)[:, :, :top]
    value = np.take_along_axis(cosine, fellow, 2)
    better = (value > least[at][:, :, None]) & (value > -2)
    g, u, _ = np.nonzero(better)
    v, value = fellow[better], value[better]
    first = first_joined(cosine >= threshold)
    h, w = np.nonzero(first != place)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([own[g, u], own[h, w]])), pa.array(np.concatenate([own[g, v], own[h, first[h, w]]])),
         pa.array(np.concatenate([value, np.full(len(h), -2.0)])), pa.array(np.concatenate([value >= threshold, np.full(len(h), True)]))],
        ["u", "v", "cosine", "link"])


def first_joined(close: np.ndarray) -> np.ndarray:
    """The first place that each place of a group is joined with, directly or through others."""
    width = close.shape[-1]
    first = np.broadcast_to(np.arange(width), close.shape[:-1]).copy()
    while True:
        least = np.minimum(first, np.where(close, first[:, None, :], width).min(axis=2))
        if (least == first).all():
            return first
        first = least


def compared(members: DataFrame, chunk: int, k: int, threshold: float) -> DataFrame:
    """Compare the members (pivot, id, home, vec, least) of each pivot, crowded ones in chunks dealt by hash."""
    spark = members.sparkSession
    crowd = members.groupBy("pivot").agg(F.count("*").alias("n"))
    dealt = members.join(crowd, "pivot").withColumn(
        "group", F.xxhash64("pivot", F.pmod(F.xxhash64("id", "pivot"), F.ceil(F.col("n") / chunk))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("group", "id", "home", "vec", "least").repartition(n, "group").sortWithinPartitions("group")
    return rows.mapInArrow(lambda b: local_join(b, k, threshold), "u long, v long, cosine double, link boolean")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(u, v, cosine, link, listed): the lists of the best k, and links that no list has room for."""
    best = Window.partitionBy("u").orderBy(F.desc("cosine"), "v")
    return materialise(pairs.groupBy("u", "v").agg(F.max("cosine").alias("cosine"), F.max("link").alias("link"))
                       .withColumn("listed", (F.row_number().over(best) <= k) & (F.col("cosine") > -2)).where("listed OR link"))


def refined(graph: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: neighbours of neighbours, in both directions."""
    listed = graph.where("listed")
    least = listed.groupBy("u").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("least"))
    known = vectors.join(least.withColumnRenamed("u", "id"), "id", "left").select("id", "home", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))
    lists = listed.select(F.col("u").alias("pivot"), F.col("v").alias("id")).union(listed.select("v", "u")).distinct()
    members = lists.join(known, "id").select("pivot", "id", "home", "vec", "least")
    members = members.union(known.select(F.col("id").alias("pivot"), "id", "home", "vec", "least"))
    return nearest(graph.drop("listed").union(compared(members, CHUNK, k, threshold)), k)


def outside(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """The listed pairs of different homes."""
    home = vectors.select("id", "home")
    pairs = graph.where("listed").drop("listed").join(home.toDF("u", "hu"), "u").join(home.toDF("v", "hv"), "v")
    return pairs.where("hu <> hv").select("u", "v", "cosine", "link")


def block_links(batches, threshold: float, joined: bool):
    """(id, links, first) of the rows of each pair of blocks: `side` 0 is compared with side 1, or with itself if there is none.
    first: a row that this one is joined with by links of the pair of blocks, the same for all so joined (itself if not `joined`)."""
    for table in whole_groups(batches):
        group = table.column("group").to_numpy()
        bounds = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1)) if len(group) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            ids, copies, side = (table.column(c).slice(a, b - a).to_numpy() for c in ("id", "copies", "side"))
            x = unit(table.column("vec").slice(a, b - a).to_pylist())
            links, first = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for at in range(0, len(ids), BLOCK):
                close = x[at:at + BLOCK] @ x.T >= threshold
                own = np.arange(at, at + len(close))
                if side.any():
                    close &= side[own][:, None] != side[None, :]
                else:
                    close[np.arange(len(own)), own] = False
                links[own] = close @ copies
                for row in np.flatnonzero(close.any(axis=1)) if joined else ():
                    met = np.unique(np.append(first[close[row]], first[at + row]))
                    if len(met) > 1:
                        first[np.isin(first, met)] = met[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[first])], ["id", "links", "first"])


def block_pairs(parts: DataFrame, threshold: float, block: int, joined: bool) -> DataFrame:
    """(id, links, first) for each pair of blocks of each component, from parts (id, component, vec, copies)."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = parts.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = pairs.select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("group"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "vec", "copies")
    rows = rows.repartition(n, "group").sortWithinPartitions("group")
    return rows.mapInArrow(lambda b: block_links(b, threshold, joined), "id long, links long, first long")


def links_within(parts: DataFrame, threshold: float) -> DataFrame:
    """(id, links): copies of other classes linked with each, from parts (id, component, vec, copies)."""
    return block_pairs(parts, threshold, BLOCK, False).groupBy("id").agg(F.sum("links").alias("links"))


def exact_links(vectors: DataFrame, count: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, component) and (id, links) from all pairs of vectors of one length."""
    block = max(BLOCK, min(WIDE, count // 32))
    found = materialise(block_pairs(vectors.withColumn("component", F.length("vec")), threshold, block, True))
    parts = components(found.where("first <> id").select(F.col("id").alias("u"), F.col("first").alias("v"))).withColumnRenamed("u", "id")
    return parts, found.groupBy("id").agg(F.sum("links").alias("links"))


def brute_links(batches, asked: list[tuple[int, bytes]], threshold: float):
    """(id, links): copies among these vectors that each asked vector links with, itself excepted."""
    ids = np.array([i for i, _ in asked])
    by_size: dict[int, np.ndarray] = {}
    for i, (_, raw) in enumerate(asked):
        by_size.setdefault(len(raw), []).append(i)
    total = np.zeros(len(asked), np.int64)
    for batch in batches:
        raw, own, copies = batch.column("vec").to_pylist(), batch.column("id").to_numpy(), batch.column("copies").to_numpy()
        sizes = np.array([len(r) for r in raw])
        for size, mine in by_size.items():
            for at in np.array_split(np.flatnonzero(sizes == size), len(raw) // 2_000 + 1):
                if len(at):
                    close = unit([asked[i][1] for i in mine]) @ unit([raw[i] for i in at]).T >= threshold
                    close &= ids[mine][:, None] != own[at][None, :]
                    total[mine] += close @ copies[at]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "links"])


def audited(vectors: DataFrame, counted: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Share of the links of a vector that `counted` (id, links) has, against brute force: the least of the averages over
    vectors with about the same number of links. About `sample` vectors for each power of two of links found are asked."""
    power = lambda links: F.floor(F.log2(links + 1)).cast("int")
    held = vectors.join(counted, "id", "left").select("id", "vec", F.coalesce("links", F.lit(0)).alias("links")).withColumn("power", power(F.col("links")))
    share = {r.power: min(1.0, sample / r["count"]) for r in held.groupBy("power").count().collect()}
    if not share:
        return 1.0
    of_power = F.element_at(F.create_map(*[F.lit(x) for item in share.items() for x in item]), F.col("power"))
    drawn = held.withColumn("share", of_power).where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = drawn.select("id", "vec", "links", "share").collect()
    if not rows:
        return 1.0
    sent = vectors.sparkSession.sparkContext.broadcast([(r.id, bytes(r.vec)) for r in rows])
    true = vectors.select("id", "vec", "copies").mapInArrow(lambda b: brute_links(b, sent.value, threshold), "id long, links long")
    true = {r.id: r.true for r in true.groupBy("id").agg(F.sum("links").alias("true")).collect()}
    sums: dict[int, list[float]] = {}
    for r in rows:
        if true[r.id]:
            of = sums.setdefault((true[r.id] + 1).bit_length(), [0.0, 0.0])
            of[0] += min(1.0, r.links / true[r.id]) / r.share
            of[1] += 1 / r.share
    return min((known / n for known, n in sums.values()), default=1.0)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """vec_id, n_links, component_id, kept, vector_valid of every row."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    given = materialise(rows.mapInArrow(packed, "vec_id long, vec binary").withColumn("class", F.sha2("vec", 256)))
    valid = given.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    vectors = materialise(valid.groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    count = vectors.count()
    depth = max(1, min(40, int(np.ceil(np.log2(max(count, 2) / LEAF)))))
    each = max(TREES, int(np.ceil(SHARED**-depth)))
    graph, parts = None, None
    for attempt in range(ATTEMPTS):
        trees = list(range(attempt * each, (attempt + 1) * each))
        apart = vectors.withColumn("home", F.col("id")) if parts is None else materialise(
            vectors.join(parts, "id", "left").withColumn("home", F.coalesce("component", "id")))
        begun = compared(apart.select("id", "home", "vec").mapInArrow(
            lambda b, t=trees: leaves(b, t, depth), "pivot long, id long, home long, vec binary, least double"), LEAF, k, threshold)
        graph = nearest(begun if graph is None else begun.union(outside(graph, apart)), k)
        for _ in range(ROUNDS):
            graph = refined(graph, apart, k, threshold)
        edges = graph.where("link").select("u", "v")
        parts = components(edges if parts is None else edges.union(parts)).withColumnRenamed("u", "id")
        saturated = not graph.where("listed AND link").groupBy("u").count().where(F.col("count") >= k).isEmpty()
        ends = parts.union(parts.select("component", "component")).distinct()
        counted = materialise(links_within(vectors.join(ends, "id"), threshold))
        if not saturated and audited(vectors, counted, threshold) >= RECALL:
            break
    else:
        parts, counted = exact_links(vectors, count, threshold)
    named = vectors.join(parts, "id", "left").join(counted, "id", "left").select(
        "class", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = given.join(named, "class", "left")
    linked = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"), F.col("vec").isNotNull().alias("vector_valid"))
