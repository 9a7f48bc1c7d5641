"""k-means stop zones named from west to east, all starts in one pass over the data.

The first centres of each start are drawn as k-means++ draws them, with numbers from MD5 of seed, start, centre and stop: the
stop with the least -ln(u) / distance squared is one drawn in proportion to it. An iteration is one aggregate over (start,
cluster); batches add up on their executor, and the driver holds the centres only. Starts that have settled are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.fixed import KMEANS_ITERATIONS, KMEANS_STARTS, KMEANS_ZONES, ZONE_SEED
from urbanpulse.session import materialise

DRAW_DIGITS = 13  # hexadecimal digits of an MD5 that make a number between 0 and 1
CHUNK = 20_000  # rows whose distances are held at a time


def uniform(*named: Column) -> Column:
    """A number between 0 and 1, the same for the same names."""
    text = F.concat_ws(":", *[c.cast("string") for c in named])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("bigint") + 0.5) / float(16**DRAW_DIGITS)


def away(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every centre."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _points(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch.column("x")
    for a in range(0, batch.num_rows, CHUNK):
        part = column.slice(a, CHUNK)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def first_centres(rows: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """Centres to begin with, (starts, k, features); rows: id and x. Fewer than k if there are no more different points."""
    chosen: list[np.ndarray] = [np.zeros((0, 0))] * starts

    def race(number: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.concatenate([
                    np.stack([away(x, c).min(axis=1) if len(c) else np.ones(len(x)) for c in chosen], axis=1) for x in _points(batch)]
                ) if batch.num_rows else np.zeros((0, starts))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(list(near))], ["id", "x", "near"])
        return run

    for number in range(k):
        told = rows.mapInArrow(race(number), "id string, x array<double>, near array<double>")
        own = told.select("id", "x", F.posexplode("near").alias("start", "d")).where("d > 0")
        time = -F.log(uniform(F.lit(seed), F.col("start"), F.lit(number), F.col("id"))) / F.col("d")
        won = own.groupBy("start").agg(F.min_by("x", F.struct(time.alias("t"), F.col("id"))).alias("x")).collect()
        for r in won:
            chosen[r["start"]] = np.vstack([chosen[r["start"]].reshape(-1, len(r["x"])), r["x"]])
    if not len(chosen[0]):
        return np.zeros((starts, 0, 0))
    least = min(map(len, chosen))
    return np.stack([c[:least] for c in chosen])


def _sums(centres: dict[int, np.ndarray]):
    """Per task: members, sums and cost of each (start, cluster)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for x in _points(batch):
                for start, own in centres.items():
                    d = away(x, own)
                    at = d.argmin(axis=1)
                    cost = d[np.arange(len(x)), at]
                    for c in np.unique(at).tolist():
                        mine = at == c
                        got = held.setdefault((start, c), [0, np.zeros(x.shape[1]), 0.0])
                        got[0] += int(mine.sum())
                        got[1] += x[mine].sum(axis=0)
                        got[2] += float(cost[mine].sum())
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array([s for s, _ in held]), pa.array([c for _, c in held]), pa.array([v[0] for v in held.values()]),
                pa.array([v[1] for v in held.values()]), pa.array([v[2] for v in held.values()])], ["start", "cluster", "n", "sums", "cost"])
    return run


def lloyd(rows: DataFrame, centres: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and costs of all starts once nothing moves, or after so many iterations. A cluster without members stays where it is."""
    centres, moving = centres.copy(), set(range(len(centres)))
    cost = np.full(len(centres), np.inf)
    for step in range(iterations + 1):
        told = rows.mapInArrow(_sums({s: centres[s] for s in sorted(moving)}),
                               "start long, cluster long, n long, sums array<double>, cost double")
        dims = range(centres.shape[2])
        added = told.groupBy("start", "cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in dims]).alias("sums"), F.sum("cost").alias("cost")).collect()
        new = centres.copy()
        for s in moving:
            cost[s] = sum(r["cost"] for r in added if r["start"] == s)
        for r in added:
            new[r["start"], r["cluster"]] = np.array(r["sums"]) / r["n"]
        if step == iterations:
            break
        moving = {s for s in moving if not np.allclose(new[s], centres[s], rtol=0, atol=1e-12)}
        centres = new
        if not moving:
            break
    return centres, cost


def kmeans_zones(stops: DataFrame, k: int = KMEANS_ZONES, starts: int = KMEANS_STARTS, seed: int = ZONE_SEED,
                 features: Sequence[str] = ("stop_lat", "stop_lon"), west_east: str = "stop_lon", row_id: str = "stop_id",
                 iterations: int = KMEANS_ITERATIONS) -> DataFrame:
    """Stops with a `zone` label. Of several starts the cheapest is kept (the first of equal ones); labels are ranked by the centre's longitude.

    Stops that lack a feature have no zone. With fewer different points than k there are as many zones as points.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = materialise(stops.where(whole).select(F.col(row_id).cast("string").alias("id"), x.alias("x")))
    begun = first_centres(rows, k, starts, seed)
    if not begun.size:
        return stops.withColumn("zone", F.lit(None).cast("string"))
    centres, cost = lloyd(rows, begun, iterations)
    best = centres[int(np.argmin(np.round(cost, 9)))]
    axis = list(features).index(west_east)
    order = sorted(range(len(best)), key=lambda c: (best[c][axis], c))
    def distance(centre: np.ndarray) -> Column:
        apart = F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(apart, F.lit(0.0), lambda t, d: t + d)

    at = F.array_min(F.array(*[F.struct(distance(own).alias("d"), F.lit(c).alias("c")) for c, own in enumerate(best)])).getField("c")
    name = F.get(F.array(*[F.lit(f"zone_{order.index(c)}") for c in range(len(best))]), at)
    return stops.select(*stops.columns, F.when(whole, name).alias("zone"))
