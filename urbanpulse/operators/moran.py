"""Global and local Moran's I over grid zones.

Neighbours come from an equi join on the eight shifted cell indices, never from pairs of zones; cells without any look
for the nearest centroids in squares that grow until they must hold them. The statistics are joins and sums.

Permutations are orders of a group's zones by MD5 of seed, number and zone, so any engine draws the same. A permutation is one
group of rows: its values in order are one array, whose products along the links are summed where they are, and whose first
values stand in for a zone's neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.fixed import ISLAND_NEIGHBOURS, LISA_ALPHA, MIN_ZONES, PERMUTATIONS, ZONE_SEED
from urbanpulse.functions.rounding import rounded
from urbanpulse.session import beside, materialise

# Squares of the first search hold about so many zones if these lie evenly.
NEAR_ZONES = 8
# Sums that differ by less count as equal: their order of adding differs.
TOLERANCE = 1e-9
QUADRANTS = ("HH", "LH", "LL", "HL")


def _shifts() -> Column:
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around])


def queen_edges(zones: DataFrame, group: Sequence[str] = ("city",)) -> DataFrame:
    """Directed neighbour pairs (i, j) of cells that touch, within a group."""
    group = list(group)
    shifted = zones.select(*group, F.col("zone_id").alias("i"), "cx", "cy", F.explode(_shifts()).alias("s")).select(
        *group, "i", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    return shifted.join(zones.select(*group, "cx", "cy", F.col("zone_id").alias("j")), [*group, "cx", "cy"]).select(
        *group, "i", "j")


def nearest_centroids(islands: DataFrame, zones: DataFrame, group: Sequence[str], nearest: int) -> DataFrame:
    """(group, i, j, rank): the nearest other zones of each island, ties in cell order.

    Zones are joined by squares of a side that doubles: what lies within a side of an island is in its own or a neighbouring square, so
    an island whose last wanted neighbour is that near is done.
    """
    group = list(group)
    extent = zones.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.greatest(F.max("centroid_lat") - F.min("centroid_lat"), F.max("centroid_lon") - F.min("centroid_lon")).alias("_span"))
    side = F.greatest(F.col("_span") * F.sqrt(NEAR_ZONES / F.col("_n")), F.lit(1e-12))
    sized = extent.select(*group, F.least(F.lit(nearest), F.col("_n") - 1).alias("_want"), side.alias("_side"), "_span")
    left = materialise(beside(islands.select(*group, F.col("zone_id").alias("i"), "centroid_lat", "centroid_lon"), sized, group).where("_want > 0"))
    done = None
    sized = materialise(sized)
    while not left.isEmpty():
        square = lambda c: F.floor(F.col(c) / F.col("_side"))
        around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
        asking = left.withColumn("_a", around).select(
            *group, "i", "centroid_lat", "centroid_lon", "_want", "_side", "_span",
            (square("centroid_lat") + F.col("_a.x")).alias("_x"), (square("centroid_lon") + F.col("_a.y")).alias("_y"))
        # a round's side is the same for all islands of a group that are left
        sides = left.groupBy(*group).agg(F.first("_side").alias("_side"))
        placed = beside(zones.select(*group, F.col("zone_id").alias("j"), "cx", "cy", F.col("centroid_lat").alias("_lat"),
                                     F.col("centroid_lon").alias("_lon")), sides, group)
        placed = placed.select(*group, "j", "cx", "cy", "_lat", "_lon", F.floor(F.col("_lat") / F.col("_side")).alias("_x"),
                               F.floor(F.col("_lon") / F.col("_side")).alias("_y"))
        met = asking.join(placed, [*group, "_x", "_y"]).where("i <> j")
        away = (F.pow(F.col("_lat") - F.col("centroid_lat"), F.lit(2.0)) + F.pow(F.col("_lon") - F.col("centroid_lon"), F.lit(2.0)))
        order = W.partitionBy(*group, "i").orderBy("_away", "cx", "cy")
        close = met.withColumn("_away", away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_want"))
        whole = F.count(F.lit(1)).over(W.partitionBy(*group, "i")) == F.col("_want")
        near = (F.max("_away").over(W.partitionBy(*group, "i")) < F.col("_side") * F.col("_side")) | (F.col("_side") > F.col("_span"))
        found = materialise(close.withColumn("_done", whole & near).where("_done").select(*group, "i", "j", "rank"))
        done = found if done is None else done.unionByName(found)
        left = materialise(left.join(found.select(*group, "i").distinct(), [*group, "i"], "left_anti").withColumn("_side", F.col("_side") * 2))
    return done if done is not None else zones.limit(0).select(*group, F.lit("").alias("i"), F.lit("").alias("j"), F.lit(0).alias("rank"))


def _first_come(group: Sequence[str]):
    """Which islands link: taken by cell order, one that an earlier island already linked gets no own links.

    Its rows are the nearest zones of a group's islands, a few for each.
    """
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        linked, kept = set(), []
        for (_, _, i), own in pdf.sort_values(["cx", "cy", "rank"], kind="stable").groupby(["cx", "cy", "i"], sort=False):
            if i in linked:
                continue
            linked.update([i, *own["j"]])
            kept.append(own)
        out = pd.concat(kept) if kept else pdf.iloc[:0]
        return out[[*group, "i", "j"]]

    return link


def edges(zones: DataFrame, group: Sequence[str] = ("city",), nearest: int = ISLAND_NEIGHBOURS) -> DataFrame:
    """Queen neighbours, and for cells without any the nearest centroids, linked both ways."""
    group = list(group)
    queen = queen_edges(zones, group)
    touching = queen.select(*group, F.col("i").alias("zone_id")).distinct()
    islands = materialise(zones.select(*group, "zone_id", "cx", "cy", "centroid_lat", "centroid_lon").join(
        touching, [*group, "zone_id"], "left_anti"))
    if islands.isEmpty():
        return queen
    near = nearest_centroids(islands, zones, group, nearest).join(
        islands.select(*group, F.col("zone_id").alias("i"), "cx", "cy"), [*group, "i"])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in zones.select(*group).schema.fields])
    made = near.groupBy(*group).applyInPandas(_first_come(group), f"{schema}, i string, j string")
    back = made.select(*group, F.col("j").alias("i"), F.col("i").alias("j"))
    return queen.unionByName(made).unionByName(back).distinct()


def weights(links: DataFrame, group: Sequence[str] = ("city",)) -> DataFrame:
    """Row-standardised weights: each neighbour of i has 1 / (number of neighbours)."""
    degree = links.groupBy(*group, "i").agg(F.count(F.lit(1)).alias("degree"))
    return links.join(degree, [*group, "i"]).withColumn("w", 1.0 / F.col("degree"))


def centred(zones: DataFrame, metric: str, group: Sequence[str] = ("city",), min_zones: int = MIN_ZONES) -> DataFrame:
    """Zones with a value, in groups of at least `min_zones`, with deviations z and the group's sum of squares."""
    group = list(group)
    valued = zones.where(F.col(metric).isNotNull()).withColumn("y", F.col(metric).cast("double"))
    base = valued.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("_mean"),
        (F.max("y") > F.min("y")).alias("_varies")).where(F.col("n") >= min_zones)
    z = valued.join(base, group).withColumn("z", F.when(F.col("_varies"), F.col("y") - F.col("_mean")).otherwise(0.0))
    return z.select(*group, "zone_id", "cx", "cy", "centroid_lat", "centroid_lon", "y", "z", "n")


def lagged(zones: DataFrame, links: DataFrame, group: Sequence[str] = ("city",)) -> DataFrame:
    """Each zone's deviation z and the mean deviation of its neighbours."""
    group = list(group)
    near = weights(links, group).join(zones.select(*group, F.col("zone_id").alias("j"), F.col("z").alias("_zj")), [*group, "j"])
    lag = near.groupBy(*group, F.col("i").alias("zone_id")).agg(
        F.sum(F.col("w") * F.col("_zj")).alias("lag"), F.first("degree").alias("degree"),
        F.sort_array(F.collect_list("j")).alias("neighbours"))
    return zones.join(lag, [*group, "zone_id"], "left")


def global_moran(lag: DataFrame, group: Sequence[str] = ("city",)) -> DataFrame:
    """I, its expectation and the mean neighbour count; I is null for a constant metric."""
    return lag.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_zones"),
        F.avg(F.coalesce("degree", F.lit(0))).alias("avg_neighbours"),
        F.try_divide(
            F.count(F.lit(1)) * F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))),
            F.count_if(F.col("degree") > 0) * F.sum(F.col("z") * F.col("z")),
        ).alias("I"),
        F.try_divide(F.lit(-1.0), F.count(F.lit(1)) - 1).alias("EI"),
    )


def local_moran(lag: DataFrame, group: Sequence[str] = ("city",)) -> DataFrame:
    """Local I (n-1 scale) and quadrant of each zone."""
    squares = lag.groupBy(*group).agg(F.sum(F.col("z") * F.col("z")).alias("_squares"))
    high, near_high = F.col("z") > 0, F.coalesce(F.col("lag"), F.lit(0.0)) > 0
    quadrant = F.when(high & near_high, "HH").when(near_high, "LH").when(~high, "LL").otherwise("HL")
    return lag.join(squares, list(group)).select(
        *group, "zone_id", "cx", "cy", "z", "lag", "degree",
        F.try_divide((F.col("n") - 1) * F.col("z") * F.coalesce("lag", F.lit(0.0)), F.col("_squares")).alias("local_i"),
        quadrant.alias("quadrant"))


def permuted(lag: DataFrame, group: Sequence[str], permutations: int, seed: int) -> DataFrame:
    """(group, zone_id, z, lag, degree, p, rank): every zone's place in each permutation, from 1."""
    drawn = lag.select(*group, "zone_id", "z", "lag", "degree").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    name = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("p").cast("string"), "zone_id").cast("binary"))
    return drawn.withColumn("rank", F.row_number().over(W.partitionBy(*group, "p").orderBy(name, "zone_id")))


def reaches(value: Column, observed: Column) -> Column:
    return value + TOLERANCE * (1 + F.abs(observed)) >= observed


def permutation_counts(lag: DataFrame, group: Sequence[str] = ("city",), permutations: int = PERMUTATIONS,
                       seed: int = ZONE_SEED) -> DataFrame:
    """Counts of random statistics at least as large as the observed: (group, zone_id, draws, global_reached, local_reached).

    In a permutation the zone that comes k-th by name has the value of the zone with rank k. For the local test a zone keeps its
    own value, and the first of the others stand in for its neighbours.
    """
    group = list(group)
    drawn = permuted(lag, group, permutations, seed)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "z"))), lambda r: r["z"])
    values = materialise(drawn.groupBy(*group, "p").agg(in_order.alias("_v"), F.max("degree").alias("_widest"),
                                                        F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))).alias("_observed")))
    # products along the links, by the places of their ends in the order of names
    place = lag.select(*group, F.col("zone_id"), F.row_number().over(W.partitionBy(*group).orderBy("zone_id")).alias("at"))
    links = lag.where("degree > 0").select(*group, "zone_id", "degree", F.explode("neighbours").alias("j"))
    ends = links.join(place, [*group, "zone_id"]).join(
        place.select(*group, F.col("zone_id").alias("j"), F.col("at").alias("at_j")), [*group, "j"])
    near = ends.groupBy(*group, "at", "degree").agg(F.collect_list("at_j").alias("ats"))
    lists = near.groupBy(*group).agg(F.collect_list(F.struct("at", "degree", "ats")).alias("_near"))
    v = lambda i: F.get("_v", i - 1)
    of_zone = lambda n: v(n["at"]) * F.aggregate(n["ats"], F.lit(0.0), lambda t, j: t + v(j)) / n["degree"]
    total = F.aggregate("_near", F.lit(0.0), lambda t, n: t + of_zone(n))
    global_reached = beside(values, lists, group).groupBy(*group).agg(
        F.count_if(reaches(total, F.col("_observed"))).alias("global_reached"))
    first = F.transform(F.sequence(F.lit(0), F.col("_widest") + 1), lambda k: F.aggregate(
        F.slice("_v", F.lit(1), k.cast("int")), F.lit(0.0), lambda t, x: t + x))
    starts = values.select(*group, "p", first.alias("_first"))
    d = F.coalesce("degree", F.lit(0))
    others = F.when(F.col("rank") <= d, F.get("_first", d + 1) - F.col("z")).otherwise(F.get("_first", d))
    mean, own = F.coalesce(F.try_divide(others, d), F.lit(0.0)), F.coalesce("lag", F.lit(0.0))
    local = drawn.join(starts, [*group, "p"]).groupBy(*group, "zone_id").agg(
        F.count(F.lit(1)).alias("draws"), F.count_if(reaches(F.col("z") * mean, F.col("z") * own)).alias("local_reached"))
    return local.join(global_reached, group, "left").withColumn("global_reached", F.coalesce("global_reached", F.col("draws")))


def folded_p(reached: Column, draws: Column) -> Column:
    """One-sided pseudo p-value of the nearer tail."""
    return (F.least(reached, draws - reached) + 1) / (draws + 1)


def moran(zones: DataFrame, metric: str, group: Sequence[str] = ("city",), permutations: int = PERMUTATIONS,
          alpha: float = LISA_ALPHA, seed: int = ZONE_SEED, min_zones: int = MIN_ZONES) -> tuple[DataFrame, DataFrame]:
    """Global table (one row per group) and local table (one row per zone) with permutation p-values."""
    group = list(group)
    z = centred(zones, metric, group, min_zones)
    lag = materialise(lagged(z, edges(z, group), group))
    counts = permutation_counts(lag, group, permutations, seed)
    overall = counts.groupBy(*group).agg(F.first("draws").alias("_draws"), F.first("global_reached").alias("_reached"))
    glob = global_moran(lag, group).join(overall, group).select(
        *group, F.lit(metric).alias("metric"), "n_zones", rounded("avg_neighbours", 2).alias("avg_neighbours"),
        rounded("I", 4).alias("I"), rounded("EI", 4).alias("EI"),
        F.when(F.col("I").isNotNull(), folded_p(F.col("_reached"), F.col("_draws"))).alias("p_sim"))
    p = folded_p(F.col("local_reached"), F.col("draws"))
    loc = local_moran(lag, group).join(counts, [*group, "zone_id"]).select(
        *group, F.lit(metric).alias("metric"), "zone_id", "cx", "cy", "local_i", p.alias("p_sim"),
        F.when(p < alpha, F.col("quadrant")).otherwise("ns").alias("cluster"))
    return glob, loc


def cluster_counts(local: DataFrame, group: Sequence[str] = ("city",)) -> DataFrame:
    """Zones per cluster label, one column each."""
    return local.groupBy(*group, "metric").agg(
        *[F.count_if(F.col("cluster") == q).alias(q) for q in (*QUADRANTS, "ns")])
