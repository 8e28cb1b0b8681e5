"""Places, tiles, stations, names, attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.functions import names
from phasegrid.operators import geo
from phasegrid.queries.cubes import query, six, table
from phasegrid.sources.tables import carried_attributes, clicked_dates, kml_point
from phasegrid.sources.text import parse_products

#: Suppliers and customers as stations on a plain of longitudes and latitudes.
STATIONS = "st AS (SELECT s_suppkey AS name, -104.0 + (s_suppkey * 37 % 1000) / CAST(250 AS DOUBLE) AS lon, 30.0 + (s_suppkey * 53 % 1000) / CAST(333 AS DOUBLE) AS lat FROM supplier)"
PLACES = "pl AS (SELECT c_custkey AS name, -104.0 + (c_custkey * 37 % 1009) / CAST(250 AS DOUBLE) AS lon, 30.0 + (c_custkey * 53 % 997) / CAST(333 AS DOUBLE) AS lat, c_nationkey FROM customer)"


def _stations(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("name"), (-104.0 + (k * 37 % 1000) / F.lit(250.0)).alias("lon"), (30.0 + (k * 53 % 1000) / F.lit(333.0)).alias("lat"))


def _places(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("name"), (-104.0 + (k * 37 % 1009) / F.lit(250.0)).alias("lon"), (30.0 + (k * 53 % 997) / F.lit(333.0)).alias("lat"), "c_nationkey")


@query(f"WITH {PLACES} SELECT c_nationkey, round(min(lon), 6) + 0.0 AS left_, round(max(lon), 6) + 0.0 AS right_, round(min(lat), 6) + 0.0 AS bottom_, round(max(lat), 6) + 0.0 AS top_ FROM pl GROUP BY 1")
def swath_extent(spark, sf):
    g = _places(spark, sf).groupBy("c_nationkey").agg(F.min("lon").alias("left_"), F.max("lon").alias("right_"), F.min("lat").alias("bottom_"), F.max("lat").alias("top_"))
    return six(g, "left_", "right_", "bottom_", "top_")


TILES = PLACES + """, box AS (SELECT min(lon) AS l, max(lon) AS r, min(lat) AS b, max(lat) AS t FROM pl),
num AS (SELECT *, CAST(round_even((r - l - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE), 0) AS INTEGER) AS nx, CAST(round_even((t - b - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE), 0) AS INTEGER) AS ny FROM box),
dim AS (SELECT *, (r - l + (nx - 1) * 0.1::DOUBLE) / nx AS w, (t - b + (ny - 1) * 0.1::DOUBLE) / ny AS h FROM num),
tiles AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, b + i * (h - 0.1::DOUBLE) AS lat, l + j * (w - 0.1::DOUBLE) AS lon, h AS height, w AS width FROM dim, range(100) y(i), range(100) x(j) WHERE i < ny AND j < nx)"""


def _tiles(spark, sf):
    return geo.tiles(geo.extent(_places(spark, sf)), 0.5, 0.1)


@query(f"WITH {TILES} SELECT i, j, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(height, 6) + 0.0 AS height, round(width, 6) + 0.0 AS width FROM tiles")
def tile_grid(spark, sf):
    return six(_tiles(spark, sf), "lat", "lon", "height", "width")


@query(f"WITH {TILES} SELECT i, j, (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || printf('%.1f', abs(lat)) || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) || printf('%.1f', abs(lon)) AS name, round(CAST(printf('%.1f', lat) AS DOUBLE), 1) + 0.0 AS lat1, round(CAST(printf('%.1f', lon) AS DOUBLE), 1) + 0.0 AS lon1 FROM tiles ORDER BY lat DESC, lon")
def tile_names(spark, sf):
    t = _tiles(spark, sf).orderBy(F.desc("lat"), "lon").select("i", "j", names.tile_name(F.col("lat"), F.col("lon")).alias("name"))
    lon, lat = names.tile_place(F.col("name"))
    return t.select("i", "j", "name", (lat + 0.0).alias("lat1"), (lon + 0.0).alias("lon1"))


@query(f"WITH {TILES}, box2 AS (SELECT c_nationkey AS id, min(lon) AS l, min(lon) + 0.7 AS r, min(lat) AS b, min(lat) + 0.9 AS t FROM pl GROUP BY 1) SELECT CAST(i * 100 + j AS INTEGER) AS a_id, id AS b_id FROM tiles JOIN box2 x ON lon < x.r AND x.l < lon + width AND lat < x.t AND x.b < lat + height")
def tile_overlap(spark, sf):
    a = _tiles(spark, sf).select((F.col("i") * 100 + F.col("j")).alias("a_id"), F.col("lon").alias("left"), (F.col("lon") + F.col("width")).alias("right"), F.col("lat").alias("bottom"), (F.col("lat") + F.col("height")).alias("top"))
    b = _places(spark, sf).groupBy(F.col("c_nationkey").alias("b_id")).agg(F.min("lon").alias("left"), (F.min("lon") + 0.7).alias("right"), F.min("lat").alias("bottom"), (F.min("lat") + 0.9).alias("top"))
    return geo.overlapping(a, b, 0.5)


@query(f"WITH {PLACES} SELECT CAST(floor(lat) AS BIGINT) AS band, count(*) AS n, CAST(min(name) AS BIGINT) AS first FROM pl WHERE lon BETWEEN -103.2 AND -101.4 AND lat BETWEEN 30.4 AND 32.1 GROUP BY 1")
def stations_in_box(spark, sf):
    p = _places(spark, sf).filter(geo.in_box(-103.2, -101.4, 30.4, 32.1))
    return p.groupBy(F.floor("lat").alias("band")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


RING = [(-103.5, 30.2), (-101.0, 30.6), (-100.5, 32.5), (-102.0, 31.4), (-103.8, 32.2), (-103.5, 30.2)]
EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(RING, RING[1:]))


@query(f"WITH {PLACES}, e(x0, y0, x1, y1) AS (VALUES {EDGES}) SELECT name, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM pl, e GROUP BY 1, pl.lon, pl.lat HAVING sum(CASE WHEN (y0 > pl.lat) <> (y1 > pl.lat) AND pl.lon < x0 + (pl.lat - y0) * (x1 - x0) / CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END THEN 1 ELSE 0 END) % 2 = 1")
def stations_in_polygon(spark, sf):
    return six(geo.in_polygon(_places(spark, sf).select("name", "lon", "lat"), RING), "lon", "lat")


@query(f"WITH {STATIONS} SELECT name, CAST(round_even((lat - 33.25) / -0.03::DOUBLE, 0) AS INTEGER) AS prow, CAST(round_even((lon + 104.1) / 0.04::DOUBLE, 0) AS INTEGER) AS pcol FROM st")
def rowcol_of_latlon(spark, sf):
    row, col = geo.pixel_of(F.col("lat"), F.col("lon"), 33.25, -0.03, -104.1, 0.04)
    return _stations(spark, sf).select("name", row.alias("prow"), col.alias("pcol"))


@query(f"WITH {STATIONS}, {PLACES}, d AS (SELECT st.name, pl.name AS prow, CAST(pl.c_nationkey AS BIGINT) AS pcol, power(st.lat - pl.lat, 2) + power(st.lon - pl.lon, 2) AS d FROM st, pl) SELECT name, arg_min(prow, (d, prow, pcol)) AS prow, arg_min(pcol, (d, prow, pcol)) AS pcol, round(sqrt(min(d)), 6) + 0.0 AS distance FROM d GROUP BY 1")
def nearest_pixel(spark, sf):
    grid = _places(spark, sf).select(F.col("name").alias("prow"), F.col("c_nationkey").cast("bigint").alias("pcol"), "lat", "lon")
    return six(geo.nearest(_stations(spark, sf), grid), "distance")


@query("SELECT s_suppkey AS name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def stations_with_data(spark, sf):
    data = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("name"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name")).join(data, "name", "left_semi")


@query(f"WITH {STATIONS}, {PLACES}, c AS (SELECT name AS c_id, lon AS cx, lat AS cy, 0.02::DOUBLE + 0.01::DOUBLE * (name % 5) AS r FROM st), n AS (SELECT c_id, count(*) AS n FROM c JOIN pl ON power(lon - cx, 2) + power(lat - cy, 2) <= r * r GROUP BY 1) SELECT c_id, coalesce(n, 0) AS n_points, n IS NOT NULL AS known FROM c LEFT JOIN n USING (c_id)")
def points_in_circles(spark, sf):
    c = _stations(spark, sf).select(F.col("name").alias("c_id"), F.col("lon").alias("cx"), F.col("lat").alias("cy"), (0.02 + F.lit(0.01) * (F.col("name") % 5)).alias("r"))
    return geo.in_circles(_places(spark, sf).select(F.col("lon").alias("x"), F.col("lat").alias("y")), c)


@query("SELECT s_suppkey AS name, '{\"type\":\"Polygon\",\"coordinates\":[[[' || x || ',' || y || '],[' || x1 || ',' || y || '],[' || x1 || ',' || y1 || '],[' || x || ',' || y1 || '],[' || x || ',' || y || ']]]}' AS geojson FROM (SELECT s_suppkey, s_suppkey % 90 AS x, s_suppkey % 45 AS y, s_suppkey % 90 + 2 AS x1, s_suppkey % 45 + 1 AS y1 FROM supplier)")
def tile_geojson(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("name"), geo.box_ring(k % 45, k % 90, F.lit(1), F.lit(2)).alias("geojson"))


@query("SELECT s_suppkey AS name, round(x, 6) + 0.0 AS area2 FROM (SELECT s_suppkey, 4.0::DOUBLE AS x FROM supplier)")
def geojson_area(spark, sf):
    """Polygons written as GeoJSON and read back: twice their area."""
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select(k.alias("name"), geo.box_ring(k % 45, k % 90, F.lit(1), F.lit(2)).alias("g"))
    shape = F.from_json("g", "type string, coordinates array<array<array<double>>>")
    ring = F.transform(shape["coordinates"][0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return t.select("name", ring.alias("ring")).select("name", geo.ring_area_sign(F.col("ring")).alias("area2"))


@query("SELECT s_suppkey AS name, '<Placemark><name>' || s_name || '</name><Point><coordinates>' || s_suppkey || ',' || s_nationkey || '</coordinates></Point></Placemark>' AS kml FROM supplier")
def station_kml(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), kml_point(F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey")).alias("kml"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS mission, strftime(o_orderdate, '%Y%m%d') AS d, o_orderkey % 60000 + 10000 AS orbit FROM orders)
SELECT o_orderkey, mission, 'IW' AS mode, 'SLC' AS product, CAST(strptime(d, '%Y%m%d') AS DATE) AS date, CAST(((orbit - CASE WHEN mission = 'S1A' THEN 73 ELSE 27 END) % 175) + 1 AS INTEGER) AS path FROM n WHERE ((orbit - CASE WHEN mission = 'S1A' THEN 73 ELSE 27 END) % 175) + 1 = 78""")
def products_of_path(spark, sf):
    o = table(spark, sf, "orders")
    name = F.format_string("%s_IW_SLC__1SDV_%sT004512_%sT004539_%06d_00A1B2_C3D4.SAFE", F.when(F.col("o_orderkey") % 2 == 0, "S1A").otherwise("S1B"), F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 60000 + 10000)
    p = parse_products(o.select(name.alias("name"), "o_orderkey"), path=78, keep=("o_orderkey",))  # orders may share a name
    return p.select("o_orderkey", "mission", "mode", "product", "date", "path")


@query("SELECT p_partkey AS id, 'p_' || p_size || '_x.tif' AS replaced, p_size AS n_kept FROM part")
def names_and_attributes(spark, sf):
    """Extensions replaced; attributes in capitals and the coordinates left behind."""
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    attributes = F.map_from_arrays(F.array(F.lit("CLASS"), F.lit("units"), F.lit("coordinates")), F.array(F.lit("x"), size, F.lit("lat lon")))
    return p.select(F.col("p_partkey").alias("id"), names.replace_extension(F.concat(F.lit("p_"), size, F.lit("_x.unw")), ".tif").alias("replaced"), F.element_at(carried_attributes(attributes), "units").cast("int").alias("n_kept"))


@query("SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS value FROM orders WHERE o_orderstatus = 'P'")
def ignore_list_lines(spark, sf):
    return clicked_dates(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("date")))


@query("SELECT event_id, CAST(strptime(strftime(ts, 'S1A_%Y%m%d.geo')[5:12], '%Y%m%d') AS DATE) AS date FROM events")
def date_in_name(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("S1A_"), F.date_format("ts", "yyyyMMdd"), F.lit(".geo")).alias("name"))
    return e.select("event_id", names.date_in(F.col("name")).alias("date"))
