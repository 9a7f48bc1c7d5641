"""Zones, weights and Moran's I on small grids checked by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanpulse.operators import moran as m
from urbanpulse.operators import zones
from urbanpulse.operators.kmeans import kmeans_zones

SCHEMA = "city string, zone_id string, cx int, cy int, centroid_lat double, centroid_lon double, v double"


def grid(spark, values, skip=()):
    rows = [("c", f"{x}_{y}", x, y, x * 0.01, y * 0.01, float(v)) for (x, y), v in values.items() if (x, y) not in skip]
    return spark.createDataFrame(rows, SCHEMA)


def board(n, f):
    return {(x, y): f(x, y) for x in range(n) for y in range(n)}


def index(zones_df):
    z = m.centred(zones_df, "v")
    return m.global_moran(m.lagged(z, m.edges(z))).collect()


def test_queen_neighbours(spark):
    degree = {r["i"]: r["count"] for r in m.queen_edges(grid(spark, board(3, lambda x, y: 1))).groupBy("i").count().collect()}
    assert degree["1_1"] == 8 and degree["0_0"] == 3 and degree["0_1"] == 5


def test_known_indices(spark):
    assert index(grid(spark, board(4, lambda x, y: (x + y) % 2)))[0]["I"] == pytest.approx(-0.18333, abs=1e-5)
    assert index(grid(spark, board(4, lambda x, y: x >= 2)))[0]["I"] == pytest.approx(0.6125)
    flat = index(grid(spark, board(4, lambda x, y: 5)))[0]
    assert flat["I"] is None and flat["n_zones"] == 16
    assert index(grid(spark, {(0, i): i for i in range(7)})) == []


def brute_links(cells, centroid):
    """Neighbour lists by the plain definition, islands in cell order."""
    near = {c: [o for o in cells if o != c and max(abs(o[0] - c[0]), abs(o[1] - c[1])) == 1] for c in cells}
    for c in sorted(cells):
        if near[c]:
            continue
        away = sorted((o for o in sorted(cells) if o != c), key=lambda o: sum((a - b) ** 2 for a, b in zip(centroid[o], centroid[c])))
        near[c] = away[:2]
        for o in away[:2]:
            if c not in near[o]:
                near[o].append(c)
    return {(f"{a}_{b}", f"{x}_{y}") for (a, b), v in near.items() for x, y in v}


def test_islands_follow_cell_order(spark):
    cells = {(0, 0): 1, (0, 1): 2, (5, 5): 3, (5, 8): 4, (9, 9): 5, (20, 20): 6, (20, 22): 7, (30, 3): 8}
    got = {(r["i"], r["j"]) for r in m.edges(grid(spark, cells)).collect()}
    assert got == brute_links(list(cells), {c: (c[0] * 0.01, c[1] * 0.01) for c in cells})


def test_local_and_permutations(spark):
    values = board(6, lambda x, y: 10 * (x < 3) + (x * 7 + y * 3) % 5)
    frame = grid(spark, values)
    glob, local = m.moran(frame, "v", permutations=199)
    g = glob.first()
    assert g["I"] > 0.5 and g["p_sim"] == pytest.approx(1 / 200) and g["EI"] == pytest.approx(-1 / 35, abs=1e-4)
    rows = {r["zone_id"]: r for r in local.collect()}
    y = {f"{a}_{b}": v for (a, b), v in values.items()}
    mean = np.mean(list(y.values()))
    z = {k: v - mean for k, v in y.items()}
    links = brute_links(list(values), {c: (c[0], c[1]) for c in values})
    for zone in ("0_0", "2_3", "5_5"):
        lag = np.mean([z[j] for i, j in links if i == zone])
        assert rows[zone]["local_i"] == pytest.approx(35 * z[zone] * lag / sum(v * v for v in z.values()))
    assert rows["0_2"]["cluster"] == "HH" and rows["5_3"]["cluster"] == "LL"
    assert all(0 < r["p_sim"] <= 0.51 for r in rows.values())
    again = {r["zone_id"]: r["p_sim"] for r in m.moran(frame.repartition(5), "v", permutations=199)[1].collect()}
    assert again == {k: r["p_sim"] for k, r in rows.items()}
    counts = m.cluster_counts(local).first()
    assert sum(counts[c] for c in ("HH", "LH", "LL", "HL", "ns")) == 36


def test_cells_and_minimum(spark):
    city = zones.city_table(spark, (("C", "OP", 60.0, 10.0, 0.0625, 0.125),))
    at = [(f"a{i}", 60.001, 10.001) for i in range(15)] + [(f"b{i}", 60.02, 10.03) for i in range(14)] + [("edge", 60.0625, 10.0), ("far", 61.0, 10.0)]
    stops = spark.createDataFrame(at, "stop_id string, stop_lat double, stop_lon double")
    kept = zones.grid_zones(stops, city)
    assert kept.count() == 15 and kept.select("zone_id").distinct().count() == 1
    inside = zones.with_cells(stops, city)
    assert inside.where("stop_id = 'edge'").count() == 0 and inside.count() == 29
    row = inside.where("stop_id = 'a0'").first()
    assert (row["cx"], row["cy"]) == (int((60.001 - 59.9375) / (1 / 111)), int((10.001 - 9.875) / (1 / (111 * np.cos(np.radians(60.0))))))


def test_islands_of_a_wide_city_find_their_nearest(spark):
    """A city of any extent: cells that lie in clumps, far apart and on a line."""
    rng = np.random.default_rng(2)
    cells = {(int(x) * 3, int(y) * 3): 1 for x, y in rng.integers(0, 400, (300, 2))} | {(5000 + 7 * k, 0): 1 for k in range(60)}
    got = {(r["i"], r["j"]) for r in m.edges(grid(spark, cells)).collect()}
    assert got == brute_links(list(cells), {c: (c[0] * 0.01, c[1] * 0.01) for c in cells})


def test_permutations_are_orders_by_md5(spark):
    """Counts against the plain definition, with ties, a hub and an island."""
    import hashlib

    cells = {**board(4, lambda x, y: (x * y) % 3), (9, 9): 5, (9, 12): 2, (12, 9): 0}
    frame = grid(spark, cells)
    z = m.centred(frame, "v")
    lag = m.lagged(z, m.edges(z))
    rows = {r["zone_id"]: r for r in lag.collect()}
    names = sorted(rows)
    reached, local = 0, dict.fromkeys(names, 0)
    total = lambda v: sum(v[a] * np.mean([v[b] for b in rows[a]["neighbours"]]) for a in names)
    value = {a: rows[a]["z"] for a in names}
    for p in range(1, 50):
        order = sorted(names, key=lambda a: hashlib.md5(f"7:{p}:{a}".encode()).hexdigest())
        reached += total({a: value[o] for a, o in zip(names, order)}) + 1e-9 >= total(value)
        for a in names:
            mean = np.mean([value[o] for o in order if o != a][:rows[a]["degree"]])
            local[a] += value[a] * mean + 1e-9 >= value[a] * rows[a]["lag"]
    got = {r["zone_id"]: r for r in m.permutation_counts(m.materialise(lag), permutations=49, seed=7).collect()}
    assert {a: r["local_reached"] for a, r in got.items()} == local
    assert {(r["global_reached"], r["draws"]) for r in got.values()} == {(reached, 49)}


def test_only_own_operator_counts(spark):
    zoned = spark.createDataFrame([("C", "OP", "s", "z")], "city string, operator string, stop_id string, zone_id string")
    up = spark.createDataFrame([("OP", "s", 10), ("OP", "s", None), ("XX", "s", 99)], "operator string, stop_id string, arrival_delay bigint")
    out = zones.zone_activity(up, zoned).first()
    assert (out["activity"], out["delay"], out["n_delay_obs"]) == (2, 10.0, 1)


def test_kmeans_names_west_to_east(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{c}_{i}", float(60 + rng.normal() * 0.001), float(10 + c + rng.normal() * 0.001)) for c in (2, 0, 1) for i in range(30)]
    out = kmeans_zones(spark.createDataFrame(rows, "stop_id string, stop_lat double, stop_lon double"), 3, 3)
    means = [r["x"] for r in out.groupBy("zone").agg(F.avg("stop_lon").alias("x")).orderBy("zone").collect()]
    assert means == sorted(means) and means == pytest.approx([10, 11, 12], abs=0.01)
