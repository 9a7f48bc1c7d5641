"""Grid zones, adjacency, spatial autocorrelation and clustering.

Customers are stops: a nation maps to a city, the position inside the city's box follows
from key and balance. Orders are stop updates at their customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import corr_sql, r6, table
from urbanpulse.fixed import CITIES, days
from urbanpulse.functions.geo import in_box, tile_corner, tile_x, tile_y
from urbanpulse.operators import moran as m
from urbanpulse.operators import zones
from urbanpulse.operators.kmeans import kmeans_zones
from urbanpulse.plans.reports import spatial_report, zonal_correlations
from urbanpulse.session import materialise

register = Register()

CELL_KM = 4.0
MIN_STOPS = 2
# box for the closed-box filter, around the first city
BOX = {"lat_min": 59.85, "lat_max": 60.00, "lon_min": 10.60, "lon_max": 10.85}


def stops(spark: SparkSession, sf: str) -> DataFrame:
    city = zones.city_table(spark, CITIES).withColumn(
        "n", F.coalesce(*[F.when(F.col("city") == c[0], i) for i, c in enumerate(CITIES)]))
    placed = table(spark, sf, "customer").withColumn("n", (F.col("c_nationkey") % 6).cast("int")).join(F.broadcast(city), "n")
    return placed.select(
        "city", F.col("c_custkey").cast("string").alias("stop_id"),
        (F.col("lat_c") + F.col("dlat") * ((F.col("c_custkey") * 37 % 211) / 100.0 - 1.05)).alias("stop_lat"),
        (F.col("lon_c") + F.col("dlon") * ((F.floor("c_acctbal") % 199 + 199) % 199 / 99.0 - 1.0)).alias("stop_lon"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return zones.grid_zones(stops(spark, sf), zones.city_table(spark, CITIES), CELL_KM, MIN_STOPS)


def updates(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 1440) * 60
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("stop_id"), F.timestamp_seconds(at).alias("minute"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 900 - 100).alias("arrival_delay"))


CITY_ROWS = ", ".join(f"({i}, '{c[0]}', {c[2]}, {c[3]}, {c[4]}, {c[5]})" for i, c in enumerate(CITIES))
STOPS = f"""city(n, city, lat_c, lon_c, dlat, dlon) AS (VALUES {CITY_ROWS}),
stops AS (SELECT city, c_custkey::VARCHAR AS stop_id, lat_c::DOUBLE AS lat_c, lon_c::DOUBLE AS lon_c, dlat::DOUBLE AS dlat, dlon::DOUBLE AS dlon,
  lat_c::DOUBLE + dlat::DOUBLE * ((c_custkey * 37 % 211) / 100.0::DOUBLE - 1.05::DOUBLE) AS stop_lat,
  lon_c::DOUBLE + dlon::DOUBLE * ((CAST(floor(c_acctbal) AS BIGINT) % 199 + 199) % 199 / 99.0::DOUBLE - 1.0::DOUBLE) AS stop_lon
  FROM customer JOIN city ON n = c_nationkey % 6)"""
CELLS = f"""{STOPS}, cells AS (
  SELECT *, CAST(floor((stop_lat - (lat_c - dlat)) / ({CELL_KM} / 111.0::DOUBLE)) AS INTEGER) AS cx,
    CAST(floor((stop_lon - (lon_c - dlon)) / ({CELL_KM} / (111.0::DOUBLE * cos(radians(lat_c))))) AS INTEGER) AS cy
  FROM stops WHERE abs(stop_lat - lat_c) < dlat AND abs(stop_lon - lon_c) < dlon),
zoned AS (SELECT *, city || '_' || cx || '_' || cy AS zone_id FROM cells),
kept AS (SELECT * FROM zoned WHERE zone_id IN (SELECT zone_id FROM zoned GROUP BY zone_id HAVING count(*) >= {MIN_STOPS})),
zones AS (SELECT city, zone_id, cx, cy, avg(stop_lat) AS centroid_lat, avg(stop_lon) AS centroid_lon, CAST(count(*) AS BIGINT) AS n_stops
  FROM kept GROUP BY ALL)"""
UPDATES = """upd AS (SELECT o_custkey::VARCHAR AS stop_id, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS minute,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 900 - 100 END AS arrival_delay FROM orders)"""
ACTIVITY = f"""{CELLS}, {UPDATES}, act AS (SELECT city, zone_id, CAST(count(*) AS BIGINT) AS activity, avg(arrival_delay) AS delay,
  CAST(count(arrival_delay) AS BIGINT) AS n_delay_obs FROM upd JOIN kept USING (stop_id) GROUP BY ALL)"""


@register(f"WITH {CELLS} SELECT city, stop_id, cx, cy, zone_id FROM kept")
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("city", "stop_id", "cx", "cy", "zone_id")


@register(f"""WITH {CELLS} SELECT city, zone_id, cx, cy, round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon, n_stops FROM zones""")
def zone_summary(spark: SparkSession, sf: str) -> DataFrame:
    inside = zones.with_cells(stops(spark, sf), zones.city_table(spark, CITIES), CELL_KM)
    out = zones.zone_summary(inside, MIN_STOPS)
    return out.select("city", "zone_id", "cx", "cy", r6(F.col("centroid_lat"), "centroid_lat"), r6(F.col("centroid_lon"), "centroid_lon"), "n_stops")


@register(f"""WITH {CELLS} SELECT zone_id, round(lat_c - dlat + cx * ({CELL_KM} / 111.0::DOUBLE), 6) AS south,
  round(lat_c - dlat + (cx + 1) * ({CELL_KM} / 111.0::DOUBLE), 6) AS north,
  round(lon_c - dlon + cy * ({CELL_KM} / (111.0::DOUBLE * cos(radians(lat_c)))), 6) AS west,
  round(lon_c - dlon + (cy + 1) * ({CELL_KM} / (111.0::DOUBLE * cos(radians(lat_c)))), 6) AS east
FROM (SELECT DISTINCT zone_id, cx, cy, lat_c, lon_c, dlat, dlon FROM kept)""")
def zone_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxed = zones.zone_boxes(zones.zone_summary(cells(spark, sf)), zones.city_table(spark, CITIES), CELL_KM)
    return boxed.select("zone_id", *[r6(F.col(c), c) for c in ("south", "north", "west", "east")])


@register(f"""WITH {STOPS} SELECT city, CAST(count(*) AS BIGINT) AS n, round(avg(stop_lat), 6) AS lat FROM stops
  WHERE stop_lat BETWEEN 59.85 AND 60.00 AND stop_lon BETWEEN 10.60 AND 10.85 GROUP BY city""")
def box_filter(spark: SparkSession, sf: str) -> DataFrame:
    inside = stops(spark, sf).where(in_box(F.col("stop_lat"), F.col("stop_lon"), BOX))
    return inside.groupBy("city").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("stop_lat"), "lat"))


@register(f"""WITH {STOPS}, t AS (SELECT CAST(trunc((stop_lon + 180) / 360 * 4096) AS INTEGER) AS x,
  CAST(trunc((1 - asinh(tan(radians(stop_lat))) / pi()) / 2 * 4096) AS INTEGER) AS y FROM stops)
SELECT x, y, CAST(count(*) AS BIGINT) AS n, round(x / 4096.0 * 360 - 180, 6) AS lon,
  round(degrees(atan(sinh(pi() * (1 - 2 * y / 4096.0)))), 6) AS lat FROM t GROUP BY x, y""")
def tile_bins(spark: SparkSession, sf: str) -> DataFrame:
    binned = stops(spark, sf).select(tile_x(F.col("stop_lon"), 12).alias("x"), tile_y(F.col("stop_lat"), 12).alias("y"))
    lon, lat = tile_corner(F.col("x"), F.col("y"), 12)
    return binned.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).select("x", "y", "n", r6(lon, "lon"), r6(lat, "lat"))


@register(f"""WITH {ACTIVITY} SELECT zones.city, zones.zone_id, n_stops, activity, round(delay, 6) AS delay, n_delay_obs
FROM zones LEFT JOIN act ON act.zone_id = zones.zone_id""")
def zone_activity(spark: SparkSession, sf: str) -> DataFrame:
    zoned = materialise(cells(spark, sf).drop("operator"))
    out = zones.zones_with_metrics(zones.zone_summary(zoned), zones.zone_activity(updates(spark, sf), zoned))
    return out.select("city", "zone_id", "n_stops", "activity", r6(F.col("delay"), "delay"), "n_delay_obs")


@register(f"""WITH {CELLS}, {UPDATES}, zm AS (SELECT city, zone_id, minute, count(*) AS activity, avg(arrival_delay) AS delay
  FROM upd JOIN kept USING (stop_id) GROUP BY ALL)
SELECT city, strftime(minute, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n, CAST(sum(activity) AS BIGINT) AS activity, round(avg(delay), 6) AS delay
FROM zm GROUP BY ALL""")
def zone_minutes(spark: SparkSession, sf: str) -> DataFrame:
    zm = zones.zone_minutes(updates(spark, sf), cells(spark, sf))
    return zm.groupBy("city", F.date_format("minute", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("activity").alias("activity"), r6(F.avg("delay"), "delay"))


@register(f"""WITH {CELLS}, {UPDATES}, zm AS (SELECT city, zone_id, minute, count(*) AS activity FROM upd JOIN kept USING (stop_id) GROUP BY ALL),
fl AS (SELECT *, isodow(minute) <= 5 AND extract(hour FROM minute) IN (7, 8, 9, 15, 16, 17) AS peak FROM zm)
SELECT city, zone_id, round(avg(activity) FILTER (peak), 6) AS mean_peak, round(avg(activity) FILTER (NOT peak), 6) AS mean_offpeak,
  CAST(count(*) FILTER (peak) AS BIGINT) AS n_peak_minutes, CAST(count(*) FILTER (NOT peak) AS BIGINT) AS n_offpeak_minutes,
  round(avg(activity) FILTER (peak) / avg(activity) FILTER (NOT peak), 6) AS ratio FROM fl GROUP BY ALL""")
def zone_peak_ratio(spark: SparkSession, sf: str) -> DataFrame:
    out = zones.zone_peak_ratio(zones.zone_minutes(updates(spark, sf), cells(spark, sf)))
    return out.select("city", "zone_id", *[r6(F.col(c), c) for c in ("mean_peak", "mean_offpeak")],
                      "n_peak_minutes", "n_offpeak_minutes", r6(F.col("ratio"), "ratio"))


EDGES = "edges AS (SELECT a.city, a.zone_id AS i, b.zone_id AS j FROM {z} a JOIN {z} b ON a.city = b.city AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.zone_id <> b.zone_id)"


@register(f"WITH {CELLS}, {EDGES.format(z='zones')} SELECT city, i, j FROM edges")
def queen_edges(spark: SparkSession, sf: str) -> DataFrame:
    return m.queen_edges(zones.zone_summary(cells(spark, sf)))


def activity_zones(spark: SparkSession, sf: str) -> DataFrame:
    zoned = materialise(cells(spark, sf).drop("operator"))
    return zones.zones_with_metrics(zones.zone_summary(zoned), zones.zone_activity(updates(spark, sf), zoned))


def lagged(spark: SparkSession, sf: str) -> DataFrame:
    z = m.centred(activity_zones(spark, sf), "activity")
    return materialise(m.lagged(z, m.edges(z)))


# zones with a value in cities that have at least eight, and their neighbours' mean deviation;
# isolated cells take their two nearest centroids, linked both ways
LAG = f"""WITH RECURSIVE {ACTIVITY}, zv AS (SELECT zones.*, activity::DOUBLE AS y, count(*) OVER (PARTITION BY zones.city) AS n
    FROM zones JOIN act ON act.zone_id = zones.zone_id),
z AS (SELECT *, y - avg(y) OVER (PARTITION BY city) AS z FROM zv WHERE n >= 8),
{EDGES.format(z='z')},
lonely AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY cx, cy) AS k FROM z WHERE zone_id NOT IN (SELECT i FROM edges)),
near AS (SELECT city, k, i, list(j ORDER BY r) AS js FROM (
  SELECT a.city, a.k, a.zone_id AS i, b.zone_id AS j, row_number() OVER (PARTITION BY a.zone_id
    ORDER BY pow(a.centroid_lat - b.centroid_lat, 2) + pow(a.centroid_lon - b.centroid_lon, 2), b.cx, b.cy) AS r
  FROM lonely a JOIN z b ON a.city = b.city AND a.zone_id <> b.zone_id) WHERE r <= 2 GROUP BY ALL),
walk AS (
  SELECT city, 0::BIGINT AS k, []::VARCHAR[] AS linked, ''::VARCHAR AS i, []::VARCHAR[] AS js FROM (SELECT DISTINCT city FROM near)
  UNION ALL
  SELECT w.city, n.k, CASE WHEN list_contains(w.linked, n.i) THEN w.linked ELSE list_concat(w.linked, n.js) END,
    n.i, CASE WHEN list_contains(w.linked, n.i) THEN []::VARCHAR[] ELSE n.js END
  FROM walk w JOIN near n ON n.city = w.city AND n.k = w.k + 1),
extra AS (SELECT city, i, unnest(js) AS j FROM walk),
links AS (SELECT city, i, j FROM edges UNION SELECT city, i, j FROM extra UNION SELECT city, j, i FROM extra),
lag AS (SELECT z.city, z.zone_id, z.cx, z.cy, any_value(z.n) AS n, any_value(z.z) AS z, avg(o.z) AS lag, CAST(count(*) AS BIGINT) AS degree
  FROM z JOIN links ON links.i = z.zone_id JOIN z o ON o.zone_id = links.j GROUP BY ALL)"""


@register(f"""{LAG} SELECT city, CAST(count(*) AS BIGINT) AS n_zones, round(avg(degree), 6) AS avg_neighbours,
  round(sum(z * lag) / sum(z * z), 6) AS moran_i, round(-1.0 / (count(*) - 1), 6) AS expected FROM lag GROUP BY city""")
def morans_i(spark: SparkSession, sf: str) -> DataFrame:
    out = m.global_moran(lagged(spark, sf))
    return out.select("city", "n_zones", r6(F.col("avg_neighbours"), "avg_neighbours"), r6(F.col("I"), "moran_i"), r6(F.col("EI"), "expected"))


@register(f"""{LAG} SELECT city, zone_id, degree, round((n - 1) * z * lag / sum(z * z) OVER (PARTITION BY city), 6) AS local_i,
  CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN lag > 0 THEN 'LH' WHEN z > 0 THEN 'HL' ELSE 'LL' END AS quadrant FROM lag""")
def lisa_local(spark: SparkSession, sf: str) -> DataFrame:
    return m.local_moran(lagged(spark, sf)).select("city", "zone_id", "degree", r6(F.col("local_i"), "local_i"), "quadrant")


def significance_sql(metric: str) -> str:
    """WITH body that ends in `tested`: zones with the counts of 999 permutations that reach what is observed."""
    lag = LAG.replace("activity::DOUBLE AS y", f"{metric}::DOUBLE AS y").replace(
        "FROM zones JOIN act ON act.zone_id = zones.zone_id)", f"FROM zones JOIN act ON act.zone_id = zones.zone_id WHERE {metric} IS NOT NULL)")
    return f"""{lag},
perm AS MATERIALIZED (SELECT city, zone_id, z, lag, degree, p, row_number() OVER (PARTITION BY city, p ORDER BY md5('42:' || p || ':' || zone_id)) AS r
  FROM lag, range(1, 1000) t(p)),
place AS (SELECT city, zone_id, row_number() OVER (PARTITION BY city ORDER BY zone_id) AS k FROM lag),
ends AS (SELECT l.city, a.k AS ka, b.k AS kb, d.degree FROM links l JOIN place a ON a.zone_id = l.i JOIN place b ON b.zone_id = l.j JOIN lag d ON d.zone_id = l.i),
total AS (SELECT e.city, x.p, sum(x.z * y.z / e.degree) AS t FROM ends e JOIN perm x ON x.city = e.city AND x.r = e.ka
  JOIN perm y ON y.city = e.city AND y.p = x.p AND y.r = e.kb GROUP BY ALL),
seen AS (SELECT city, sum(z * lag) AS t FROM lag GROUP BY city),
whole AS (SELECT city, count(*) FILTER (total.t + 1e-9 * (1 + abs(seen.t)) >= seen.t) AS reached FROM total JOIN seen USING (city) GROUP BY city),
pre AS MATERIALIZED (SELECT city, p, r, sum(z) OVER (PARTITION BY city, p ORDER BY r) AS s FROM perm),
loc AS (SELECT q.city, q.zone_id, count(*) FILTER (q.z * ((pre.s - CASE WHEN q.r <= q.degree THEN q.z ELSE 0 END) / q.degree)
    + 1e-9 * (1 + abs(q.z * q.lag)) >= q.z * q.lag) AS reached
  FROM perm q JOIN pre ON pre.city = q.city AND pre.p = q.p AND pre.r = q.degree + CASE WHEN q.r <= q.degree THEN 1 ELSE 0 END GROUP BY ALL),
tested AS (SELECT lag.*, whole.reached AS g, loc.reached AS l FROM lag JOIN whole USING (city) JOIN loc ON loc.zone_id = lag.zone_id)"""


@register(f"""{significance_sql("activity")} SELECT city, 'activity' AS metric, CAST(count(*) AS BIGINT) AS n_zones, round(avg(degree), 2) AS avg_neighbours,
  round(sum(z * lag) / sum(z * z), 4) AS "I", round(-1.0 / (count(*) - 1), 4) AS "EI", (least(any_value(g), 999 - any_value(g)) + 1) / 1000 AS p_sim
FROM tested GROUP BY city""")
def moran_significance(spark: SparkSession, sf: str) -> DataFrame:
    """Global I with its permutation p-value."""
    return m.moran(activity_zones(spark, sf), "activity")[0]


@register(f"""{significance_sql("activity")} SELECT city, zone_id, round((n - 1) * z * lag / sum(z * z) OVER (PARTITION BY city), 6) AS local_i,
  (least(l, 999 - l) + 1) / 1000 AS p_sim, CASE WHEN (least(l, 999 - l) + 1) / 1000 >= 0.05 THEN 'ns' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN lag > 0 THEN 'LH'
  WHEN z > 0 THEN 'HL' ELSE 'LL' END AS cluster FROM tested""")
def lisa_significance(spark: SparkSession, sf: str) -> DataFrame:
    """Local I of every zone with its conditional permutation p-value."""
    out = m.moran(activity_zones(spark, sf), "activity")[1]
    return out.select("city", "zone_id", r6(F.col("local_i"), "local_i"), "p_sim", "cluster")


@register(f"""{significance_sql("delay")}, named AS (SELECT city, CASE WHEN (least(l, 999 - l) + 1) / 1000 >= 0.05 THEN 'ns' WHEN z > 0 AND lag > 0 THEN 'HH'
  WHEN lag > 0 THEN 'LH' WHEN z > 0 THEN 'HL' ELSE 'LL' END AS c FROM tested)
SELECT city, 'delay' AS metric, {", ".join(f"CAST(count(*) FILTER (c = '{q}') AS BIGINT) AS {q}" for q in ("HH", "LH", "LL", "HL", "ns"))}
FROM named GROUP BY city""")
def lisa_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Zones per cluster label after the conditional permutation test."""
    return m.cluster_counts(m.moran(activity_zones(spark, sf), "delay")[1])


def kmeans_sql(points: str, axis: int, rounds: int = 60, k: int = 6, starts: int = 10, seed: int = 42) -> str:
    """CTEs from `pts(id, x)` to `zoned(id, zone)`: k-means++ by exponential races on MD5, then rounds of nearest centre and mean."""
    sql = [points, f"st AS (SELECT unnest(range({starts})) AS s)"]
    race = "-ln((('0x' || substr(md5('{seed}:' || s || ':{c}:' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    for c in range(k):
        if not c:
            sql.append(f"i0 AS MATERIALIZED (SELECT s, [arg_min(x, {race.format(seed=seed, c=0)})] AS cs FROM pts, st GROUP BY s)")
        else:
            sql.append(f"""i{c} AS MATERIALIZED (SELECT s, list_append(any_value(cs), arg_min(x, {race.format(seed=seed, c=c)} / d)) AS cs
  FROM (SELECT s, id, x, cs, list_min(list_transform(cs, lambda c: list_distance(c, x) ** 2)) AS d FROM pts JOIN i{c - 1} ON true) WHERE d > 0 GROUP BY s)""")
    before = f"i{k - 1}"
    for r in range(rounds):
        sql.append(f"""a{r} AS MATERIALIZED (SELECT s, id, x, list_position(ds, list_min(ds)) AS c FROM (
  SELECT s, id, x, list_transform(cs, lambda c: list_distance(c, x)) AS ds FROM pts JOIN {before} ON true)),
r{r} AS MATERIALIZED (SELECT s, list(m ORDER BY c) AS cs FROM (SELECT s, c, list(v ORDER BY j) AS m FROM (
  SELECT s, c, j, avg(v) AS v FROM (SELECT s, c, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{r}) GROUP BY ALL) GROUP BY ALL) GROUP BY s)""")
        before = f"r{r}"
    return ",\n".join(sql) + f""",
cost AS (SELECT s, sum(list_min(list_transform(cs, lambda c: list_distance(c, x) ** 2))) AS cost FROM pts JOIN {before} ON true GROUP BY s),
best AS (SELECT cs FROM {before} JOIN cost USING (s) ORDER BY round(cost, 9), s LIMIT 1),
named AS (SELECT c, row_number() OVER (ORDER BY c[{axis}]) - 1 AS z FROM (SELECT unnest(cs) AS c FROM best)),
zoned AS (SELECT id, 'zone_' || arg_min(z, list_distance(c, x)) AS zone FROM pts, named GROUP BY id)"""


@register(f"""WITH {kmeans_sql("pts AS MATERIALIZED (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS x FROM embeddings)", 2)}
SELECT zone, CAST(count(*) AS BIGINT) AS n_stops, round(avg(x[2]), 6) AS lon FROM zoned JOIN pts USING (id) GROUP BY zone""")
def kmeans_stop_zones(spark: SparkSession, sf: str) -> DataFrame:
    """k-means on all dimensions of all vectors, zones named along the second."""
    vectors = table(spark, sf, "embeddings")
    names = ["stop_lat", "stop_lon", *[f"d{i}" for i in range(2, vectors.agg(F.max(F.size("embedding"))).first()[0] or 2)]]
    points = vectors.select(F.col("vec_id").cast("string").alias("stop_id"),
                            *[F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(names)])
    zoned = kmeans_zones(points, features=names)
    return zoned.groupBy("zone").agg(F.count(F.lit(1)).alias("n_stops"), r6(F.avg("stop_lon"), "lon"))


@register(f"""WITH {STOPS}, {UPDATES}, per AS (SELECT stop_id, date_trunc('month', minute) AS minute, arrival_delay FROM upd),
{kmeans_sql("pts AS MATERIALIZED (SELECT stop_id AS id, [stop_lat, stop_lon] AS x FROM stops WHERE stop_id IN (SELECT stop_id FROM per))", 2)},
monthly AS (SELECT zone, minute, CAST(count(*) AS DOUBLE) AS activity, avg(arrival_delay) AS delay FROM per JOIN zoned ON id = stop_id GROUP BY ALL),
warm AS (SELECT date_trunc('month', o_orderdate) AS minute, avg(o_totalprice) AS t FROM orders GROUP BY ALL)
SELECT zone, CAST(count(*) AS BIGINT) AS n_pt_activity, CASE WHEN count(*) >= 4 THEN round({corr_sql("t", "activity")}, 3) END AS r_pt_activity,
  CAST(count(delay) AS BIGINT) AS n_pt_delay_mean, CASE WHEN count(delay) >= 4 THEN round({corr_sql("t", "delay")}, 3) END AS r_pt_delay_mean
FROM monthly JOIN warm USING (minute) GROUP BY zone""")
def zonal_report(spark: SparkSession, sf: str) -> DataFrame:
    """k-means zones of all stops against the mean order price as temperature."""
    up = updates(spark, sf).withColumn("minute", F.date_trunc("month", "minute"))
    temperature = table(spark, sf, "orders").groupBy(
        F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("minute")).agg(F.avg("o_totalprice").alias("road_temperature"))
    return zonal_correlations(up, stops(spark, sf).select("stop_id", "stop_lat", "stop_lon"), temperature)[0]


@register()
def city_window_report(spark: SparkSession, sf: str) -> DataFrame:
    """Global Moran's I of activity, delay and peak ratio for all cities in two windows."""
    windows = (days("first", "1995-01-01", "1998-06-30"), days("second", "1998-07-01", "2001-12-31"))
    by_city = stops(spark, sf)
    return spatial_report(updates(spark, sf), by_city, zones.city_table(spark), windows, cell_km=CELL_KM, min_stops=MIN_STOPS)["global"]


QUERIES, ORACLES = register.queries, register.oracles
