"""Queries over the rasters that the embeddings table stands in for, each with its SQL.

A vector of 64 numbers is an 8 x 8 raster. The SQL is written for another engine and shares
nothing with the DataFrame code but the definition of the rasters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.operators import colours, corners, edit, inspect, layers, lettering, prepare, regions, trace
from tilework.plans import vectorize
from tilework.sources import drawings, pictures, tiles
from tilework.storage import materialize


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _pixels(spark: SparkSession, sf_dir: str, levels: int = 4) -> DataFrame:
    return tiles.tile_pixels(_vectors(spark, sf_dir), levels)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, x, y, v): the rasters in 256 levels."""
    return _pixels(spark, sf_dir, 256).select("img_id", "x", "y", F.col("rgb").bitwiseAND(255).alias("v"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label_runs(tiles.row_runs(_pixels(spark, sf_dir)))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label_pixels(_pixels(spark, sf_dir))


_PX = """WITH RECURSIVE val AS (
  SELECT vec_id AS img_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)
), px AS (
  SELECT img_id, i % 8 AS x, i // 8 AS y, CAST(greatest(0, least(3, floor((v + 0.5) * 4))) AS INT) * 5592405 AS rgb FROM val
), v8 AS (
  SELECT img_id, i % 8 AS x, i // 8 AS y, CAST(greatest(0, least(255, floor((v + 0.5) * 256))) AS INT) AS v FROM val
), pal AS (SELECT img_id, rgb, count(*) AS area FROM px GROUP BY ALL)"""

_NEAR = """, near AS (
  SELECT p.img_id, p.x, p.y, p.rgb, q.rgb AS near FROM px p JOIN px q USING (img_id) WHERE abs(p.x - q.x) + abs(p.y - q.y) = 1
)"""

_REG = """, reach AS (
  SELECT img_id, rgb, y * 8 + x AS p, y * 8 + x AS q FROM px
  UNION
  SELECT r.img_id, r.rgb, r.p, n.y * 8 + n.x FROM reach r JOIN px n ON n.img_id = r.img_id AND n.rgb = r.rgb
    AND abs(n.x - r.q % 8) + abs(n.y - r.q // 8) = 1
), lab AS (
  SELECT img_id, rgb, p % 8 AS x, p // 8 AS y, CAST((min(q) // 8) * 131072 + min(q) % 8 AS BIGINT) AS region_id FROM reach GROUP BY img_id, rgb, p
), reg AS (
  SELECT img_id, region_id, any_value(rgb) AS rgb, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lab GROUP BY img_id, region_id
), sides AS (
  SELECT p.img_id, p.region_id AS a, q.region_id AS b FROM lab p JOIN lab q USING (img_id)
  WHERE ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) AND p.region_id <> q.region_id
), adj AS (SELECT img_id, least(a, b) AS region_a, greatest(a, b) AS region_b, count(*) AS border FROM sides GROUP BY ALL)"""

_Z = ", z AS (SELECT img_id, region_id, rgb, area, row_number() OVER (PARTITION BY img_id ORDER BY area DESC, region_id) AS z FROM reg)"

_EDGES = """, e AS (
  SELECT p.img_id, p.x, p.y, CASE WHEN q.y = p.y THEN 'h' ELSE 'v' END AS dir, p.rgb AS here, q.rgb AS there
  FROM px p JOIN px q USING (img_id) WHERE ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) AND p.rgb <> q.rgb
)"""

_ROW = """, d0 AS (SELECT *, (lead(rgb) OVER w % 256 - rgb % 256) * 1000 AS d FROM px WINDOW w AS (PARTITION BY img_id, y ORDER BY x)),
d1 AS (SELECT *, lag(d) OVER w AS p, lead(d) OVER w AS n FROM d0 WINDOW w AS (PARTITION BY img_id, y ORDER BY x))"""

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str]] = {}


def _add(name: str, run: Query, sql: str) -> None:
    REGISTRY[name] = run, sql


_add("palette_histogram", lambda s, d: tiles.palette(_pixels(s, d)), f"{_PX} SELECT img_id, rgb, area FROM pal")
_add(
    "inspect_summary",
    lambda s, d: inspect.summary(_pixels(s, d)),
    f"""{_PX}, st AS (SELECT *, lead(rgb) OVER (PARTITION BY img_id, y ORDER BY x) AS nx FROM px),
f AS (SELECT img_id, max(x) + 1 AS width, max(y) + 1 AS height, count(DISTINCT rgb) AS colours, CAST(count(*) FILTER (nx = rgb) AS DOUBLE) / count(nx) AS flat_share,
  bool_and(rgb // 65536 = rgb // 256 % 256 AND rgb // 256 % 256 = rgb % 256) AS grey FROM st GROUP BY img_id)
SELECT img_id, width, height, false AS transparent, colours, flat_share,
  CASE WHEN colours > CASE WHEN grey THEN 64 ELSE 256 END AND flat_share < 0.5 THEN 'photo' WHEN greatest(width, height) <= 256 AND colours <= 64 THEN 'pixel_art' ELSE 'artwork' END AS kind,
  CASE WHEN greatest(width, height) < 48 THEN 'low' WHEN greatest(width, height) <= 160 THEN 'medium' ELSE 'high' END AS quality FROM f""",
)
_add(
    "two_colour_share",
    lambda s, d: inspect.two_colour_share(_pixels(s, d)),
    f"""{_PX}, r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY area DESC, rgb) AS r, sum(area) OVER (PARTITION BY img_id) AS n FROM pal)
SELECT img_id, max(rgb) FILTER (r = 1) AS first_rgb, max(rgb) FILTER (r = 2) AS second_rgb, CAST(sum(area) FILTER (r <= 2) AS BIGINT) AS covered, CAST(max(n) AS BIGINT) AS pixels FROM r GROUP BY img_id""",
)
_add("edge_counts", lambda s, d: regions.edges(_pixels(s, d)).groupBy("img_id", "dir").agg(F.count("*").alias("edges")), f"{_PX}{_EDGES} SELECT img_id, dir, count(*) AS edges FROM e GROUP BY ALL")
_add(
    "row_runs",
    lambda s, d: tiles.row_runs(_pixels(s, d)),
    f"""{_PX}, c AS (SELECT *, CASE WHEN rgb IS DISTINCT FROM lag(rgb) OVER (PARTITION BY img_id, y ORDER BY x) THEN 1 ELSE 0 END AS c FROM px),
r AS (SELECT *, sum(c) OVER (PARTITION BY img_id, y ORDER BY x) AS r FROM c)
SELECT img_id, y, min(x) AS x0, max(x) AS x1, any_value(rgb) AS rgb FROM r GROUP BY img_id, y, r""",
)
_add("lone_pixels", lambda s, d: regions.lone_pixels(_pixels(s, d)), f"{_PX}{_NEAR} SELECT img_id, x, y, rgb FROM near GROUP BY ALL HAVING count(*) FILTER (near = rgb) = 0")
_add("border_pixels", lambda s, d: regions.border_pixels(_pixels(s, d)), f"{_PX}{_NEAR} SELECT img_id, x, y, rgb FROM near WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY ALL HAVING count(*) FILTER (near = rgb) = 0")
_add(
    "checker_cells",
    lambda s, d: inspect.checker_cells(_pixels(s, d)),
    f"""{_PX}, r AS (SELECT *, lead(rgb) OVER (PARTITION BY img_id, y ORDER BY x) AS r FROM px),
d AS (SELECT *, lead(rgb) OVER w AS b, lead(r) OVER w AS c FROM r WINDOW w AS (PARTITION BY img_id, x ORDER BY y))
SELECT img_id, x, y FROM d WHERE rgb = c AND r = b AND rgb <> r""",
)
_add(
    "softness",
    lambda s, d: inspect.softness(_pixels(s, d)),
    f"""{_PX}{_ROW} SELECT img_id, count(*) AS edges, count(*) FILTER (d * coalesce(p, 0) * 4 >= d * d OR d * coalesce(n, 0) * 4 >= d * d) AS soft_edges
FROM (SELECT * REPLACE (CAST(d AS BIGINT) AS d) FROM d1) WHERE d <> 0 GROUP BY img_id""",
)
_add("halo_steps", lambda s, d: inspect.halos(_pixels(s, d)), f"{_PX}{_ROW} SELECT img_id, count(*) FILTER (CAST(d AS BIGINT) * p < 0 AND CAST(d AS BIGINT) * n < 0 AND abs(p) < abs(d) AND abs(n) < abs(d)) AS halo_steps FROM d1 GROUP BY img_id")
_add(
    "enlarged_factor",
    lambda s, d: inspect.enlarged(_pixels(s, d)),
    f"""{_PX}{_EDGES}, a AS (SELECT img_id, 1 + CASE WHEN dir = 'h' THEN x ELSE y END AS a FROM e),
f AS (SELECT img_id, bool_and(a % 2 = 0) AS f2, bool_and(a % 4 = 0) AS f4 FROM a GROUP BY img_id)
SELECT DISTINCT px.img_id, CASE WHEN coalesce(f4, true) THEN 4 WHEN f2 THEN 2 ELSE 1 END AS factor FROM px LEFT JOIN f USING (img_id)""",
)
_add(
    "dither_tiles",
    lambda s, d: inspect.dither_tiles(_pixels(s, d), periods=(2,)),
    f"""{_PX}, c AS (SELECT img_id, x // 4 AS bx, y // 4 AS by_, x % 2 AS i, y % 2 AS j, count(DISTINCT rgb) AS n, min(rgb) AS rgb FROM px GROUP BY ALL)
SELECT img_id, bx * 4 AS x, by_ * 4 AS y, 2 AS period FROM c GROUP BY img_id, bx, by_ HAVING max(n) = 1 AND count(DISTINCT rgb) > 1""",
)
_add("long_runs", lambda s, d: inspect.long_runs(_pixels(s, d), 60), f"{_PX}{_EDGES} SELECT px.img_id, any_value(coalesce(n, 0)) AS edges, any_value(coalesce(n, 0)) >= 60 AS is_long FROM px LEFT JOIN (SELECT img_id, count(*) AS n FROM e GROUP BY img_id) USING (img_id) GROUP BY px.img_id")
_add("region_areas", lambda s, d: regions.region_table(_runs(s, d)).select("img_id", "region_id", "rgb", "area"), f"{_PX}{_REG} SELECT img_id, region_id, rgb, area FROM reg")
_add("region_bbox", lambda s, d: regions.region_table(_runs(s, d)).select("img_id", "region_id", "x0", "y0", "x1", "y1"), f"{_PX}{_REG} SELECT img_id, region_id, x0, y0, x1, y1 FROM reg")
_add("rectangle_regions", lambda s, d: regions.rectangles(regions.region_table(_runs(s, d))), f"{_PX}{_REG} SELECT * FROM reg WHERE (x1 - x0 + 1) * (y1 - y0 + 1) = area")
_add("region_adjacency", lambda s, d: regions.adjacency(_labelled(s, d)), f"{_PX}{_REG} SELECT * FROM adj")
_add(
    "region_moments",
    lambda s, d: regions.ellipses(_runs(s, d)),
    f"""{_PX}{_REG}, s AS (SELECT img_id, region_id, count(*) AS area, CAST(2 * sum(x) AS DOUBLE) / (2 * count(*)) AS cx, CAST(sum(y) AS DOUBLE) / count(*) AS cy,
  CAST(6 * sum(x * x) AS DOUBLE) / (6 * count(*)) AS xx, CAST(2 * sum(x * y) AS DOUBLE) / (2 * count(*)) AS xy, CAST(sum(y * y) AS DOUBLE) / count(*) AS yy FROM lab GROUP BY img_id, region_id)
SELECT img_id, region_id, area, cx, cy, xx - cx * cx AS mxx, xy - cx * cy AS mxy, yy - cy * cy AS myy FROM s""",
)
_add(
    "outline_corners",
    lambda s, d: regions.corner_counts(_pixels(s, d), _labelled(s, d)),
    f"""{_PX}{_REG}, v AS (SELECT img_id, region_id, x, y, x + i.i AS vx, y + j.j AS vy FROM lab, range(0, 2) i(i), range(0, 2) j(j)),
c AS (SELECT img_id, region_id, vx, vy, count(*) AS n, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM v GROUP BY ALL),
s AS (SELECT img_id, region_id, CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 2 AND nx = 2 AND ny = 2 THEN 2 ELSE 0 END) AS BIGINT) AS convex, count(*) FILTER (n = 3) AS concave FROM c GROUP BY img_id, region_id)
SELECT *, CAST(1 - (convex - concave) // 4 AS BIGINT) AS holes FROM s""",
)
_add(
    "palette_merge_once",
    lambda s, d: colours.nearest_pair(tiles.palette(_pixels(s, d))),
    f"""{_PX}, pair AS (
  SELECT a.img_id, a.rgb AS rgb_a, b.rgb AS rgb_b, a.area AS n, b.area AS m,
    CAST(9 * (a.rgb % 256 - b.rgb % 256) * (a.rgb % 256 - b.rgb % 256) * a.area * b.area AS DOUBLE) / (a.area + b.area) AS cost
  FROM pal a JOIN pal b ON a.img_id = b.img_id AND a.rgb < b.rgb
), first AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY cost, rgb_a, rgb_b) AS r FROM pair)
SELECT img_id, rgb_a, rgb_b, CAST(65793 * ((2 * ((rgb_a % 256) * n + (rgb_b % 256) * m) + n + m) // (2 * (n + m))) AS INT) AS merged FROM first WHERE r = 1""",
)


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that are left when each raster's colours are merged to two."""
    px = _pixels(spark, sf_dir)
    less = colours.recoloured(px, colours.reduced_palette(tiles.palette(px), 2))
    return regions.region_table(regions.label_runs(tiles.row_runs(less)))


def _merge_sql(k: int) -> str:
    """A merge of the nearest pair of clusters c{k}, in rasters that have more than two: clusters c{k + 1} and the map m{k + 1}."""
    return f"""
pr{k} AS (SELECT a.img_id, a.id AS ia, b.id AS ib, row_number() OVER (PARTITION BY a.img_id ORDER BY CAST(9 * (a.v - b.v) * (a.v - b.v) * a.n * b.n AS DOUBLE) / (a.n + b.n), a.id, b.id) AS r,
  CAST((2 * (a.v * a.n + b.v * b.n) + a.n + b.n) // (2 * (a.n + b.n)) AS BIGINT) AS v, a.n + b.n AS n
  FROM c{k} a JOIN c{k} b ON a.img_id = b.img_id AND a.id < b.id WHERE a.img_id IN (SELECT img_id FROM c{k} GROUP BY img_id HAVING count(*) > 2)),
b{k} AS (SELECT * FROM pr{k} WHERE r = 1),
c{k + 1} AS (SELECT c.img_id, c.id, coalesce(b.v, c.v) AS v, coalesce(b.n, c.n) AS n FROM c{k} c LEFT JOIN b{k} b ON b.img_id = c.img_id AND b.ia = c.id
  WHERE NOT EXISTS (SELECT 1 FROM b{k} g WHERE g.img_id = c.img_id AND g.ib = c.id)),
m{k + 1} AS (SELECT m.img_id, m.rgb, coalesce(b.ia, m.id) AS id FROM m{k} m LEFT JOIN b{k} b ON b.img_id = m.img_id AND b.ib = m.id)"""


# rasters have four colours at most, so two merges
_add(
    "reduced_to_two_colours",
    _reduced,
    _PX.replace("), px AS (", "), px0 AS (").replace("FROM px GROUP", "FROM px0 GROUP")
    + ", c0 AS (SELECT img_id, rgb AS id, CAST(rgb % 256 AS BIGINT) AS v, area AS n FROM pal), m0 AS (SELECT img_id, rgb, rgb AS id FROM pal),"
    + _merge_sql(0) + "," + _merge_sql(1)
    + ", px AS (SELECT p.img_id, p.x, p.y, CAST(65793 * c2.v AS INT) AS rgb FROM px0 p JOIN m2 ON m2.img_id = p.img_id AND m2.rgb = p.rgb JOIN c2 ON c2.img_id = p.img_id AND c2.id = m2.id)"
    + _REG + " SELECT * FROM reg",
)


def _dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    shades = px.select("img_id", "rgb").distinct().where("rgb = 5592405").withColumn("to_rgb", F.lit(11184810))
    return regions.region_table(regions.label_runs(tiles.row_runs(colours.recoloured(px, shades)))).select("img_id", "region_id", "rgb", "area")


_add("dissolved_regions", _dissolved, _PX.replace("* 5592405 AS rgb FROM val", "AS l, CASE WHEN l = 1 THEN 11184810 ELSE l * 5592405 END AS rgb FROM val") + _REG + " SELECT img_id, region_id, rgb, area FROM reg")
_add(
    "alpha_flatten",
    lambda s, d: prepare.flatten_alpha(tiles.tile_rgba(_vectors(s, d))),
    f"""{_PX}, ch AS (SELECT img_id, (y * 8 + x) // 4 AS p, (y * 8 + x) % 4 AS c, v FROM v8),
w AS (SELECT img_id, p, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) AS a FROM ch GROUP BY img_id, p),
o AS (SELECT img_id, p % 4 AS x, p // 4 AS y, (r * a + 255 * (255 - a) + 127) // 255 AS r, (g * a + 255 * (255 - a) + 127) // 255 AS g, (b * a + 255 * (255 - a) + 127) // 255 AS b FROM w)
SELECT img_id, x, y, CAST(r * 65536 + g * 256 + b AS INT) AS rgb FROM o""",
)
_add("region_fill", lambda s, d: colours.region_fills(_labelled(s, d), _values(s, d)), f"{_PX}{_REG} SELECT img_id, region_id, median(v) AS median, min(v) AS low, max(v) AS high FROM lab JOIN v8 USING (img_id, x, y) GROUP BY img_id, region_id")
_add(
    "gradient_fit",
    lambda s, d: colours.gradient_fits(_labelled(s, d), _values(s, d)),
    f"""{_PX}{_REG}, s AS (SELECT img_id, region_id, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(v)::BIGINT AS sv, sum(x * x)::BIGINT AS sxx, sum(x * y)::BIGINT AS sxy, sum(y * y)::BIGINT AS syy,
  sum(x * v)::BIGINT AS sxv, sum(y * v)::BIGINT AS syv FROM lab JOIN v8 USING (img_id, x, y) GROUP BY img_id, region_id),
m AS (SELECT *, n * sxx - sx * sx AS a, n * sxy - sx * sy AS b, n * syy - sy * sy AS c, n * sxv - sx * sv AS d, n * syv - sy * sv AS e FROM s),
k AS (SELECT *, a * c - b * b AS det FROM m),
g AS (SELECT *, CASE WHEN det <> 0 THEN CAST(c * d - b * e AS DOUBLE) / det END AS slope_x, CASE WHEN det <> 0 THEN CAST(a * e - b * d AS DOUBLE) / det END AS slope_y FROM k)
SELECT img_id, region_id, n, slope_x, slope_y, (sv - slope_x * sx - slope_y * sy) / n AS base FROM g""",
)
_add("stack_order", lambda s, d: layers.stack_order(regions.region_table(_runs(s, d))), f"{_PX}{_REG}{_Z} SELECT * FROM z")
def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return layers.under_strips(layers.stack_order(regions.region_table(runs)), regions.adjacency(regions.run_pixels(runs)))


_add(
    "under_strips",
    _strips,
    f"""{_PX}{_REG}{_Z} SELECT adj.img_id, CASE WHEN a.z < b.z THEN region_a ELSE region_b END AS lower, CASE WHEN a.z < b.z THEN region_b ELSE region_a END AS upper, border
FROM adj JOIN z a ON a.img_id = adj.img_id AND a.region_id = region_a JOIN z b ON b.img_id = adj.img_id AND b.region_id = region_b""",
)
_add(
    "fields_under_dots",
    lambda s, d: layers.fields_under_dots(_labelled(s, d)),
    f"""{_PX}{_REG}, s AS (SELECT img_id, region_a AS dot, region_b AS field FROM adj UNION ALL SELECT img_id, region_b, region_a FROM adj),
i AS (SELECT img_id, dot, min(field) AS field FROM s GROUP BY img_id, dot HAVING count(*) = 1)
SELECT i.img_id, field, count(*) AS dots, CAST(sum(area) AS BIGINT) AS dot_area FROM i JOIN reg ON reg.img_id = i.img_id AND region_id = dot
WHERE x0 > 0 AND y0 > 0 AND x1 < 7 AND y1 < 7 GROUP BY i.img_id, field""",
)
_add("colour_groups", lambda s, d: layers.colour_groups(regions.region_table(_runs(s, d))), f"{_PX}{_REG} SELECT img_id, region_id, rgb, dense_rank() OVER (PARTITION BY img_id ORDER BY rgb) AS group_id FROM reg")
_add(
    "cut_out_background",
    lambda s, d: regions.region_table(prepare.cut_out_background(_runs(s, d))).select("img_id", "region_id", "rgb", "area"),
    f"""{_PX}{_REG}, ed AS (SELECT * FROM lab WHERE x IN (0, 7) OR y IN (0, 7)),
g AS (SELECT img_id, rgb, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, rgb) AS r FROM ed GROUP BY img_id, rgb),
gone AS (SELECT DISTINCT ed.img_id, region_id FROM ed JOIN g ON g.img_id = ed.img_id AND g.rgb = ed.rgb AND r = 1)
SELECT img_id, region_id, rgb, area FROM reg ANTI JOIN gone USING (img_id, region_id)""",
)
_add(
    "sharpened",
    lambda s, d: prepare.sharpened(_values(s, d)),
    f"""{_PX}, n AS (SELECT p.img_id, p.x, p.y, p.v, sum(q.v) AS s, count(*) AS n FROM v8 p JOIN v8 q USING (img_id) WHERE abs(p.x - q.x) + abs(p.y - q.y) = 1 GROUP BY ALL)
SELECT img_id, x, y, CAST(greatest(0, least(255, v + (v - s // n))) AS INT) AS v FROM n""",
)
_add(
    "without_halo",
    lambda s, d: prepare.without_halo(_values(s, d)),
    f"""{_PX}, m AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM v8 WINDOW w AS (PARTITION BY img_id, y ORDER BY x))
SELECT img_id, x, y, CASE WHEN l IS NOT NULL AND r IS NOT NULL AND (v > greatest(l, r) OR v < least(l, r)) THEN CASE WHEN abs(v - l) < abs(v - r) THEN l ELSE r END ELSE v END AS v FROM m""",
)
_add(
    "faint_areas",
    lambda s, d: prepare.faint_areas(_values(s, d), 64, 192),
    f"""{_PX}, sp AS (SELECT p.img_id, p.x, p.y, max(q.v) - min(q.v) AS s FROM v8 p JOIN v8 q USING (img_id) WHERE abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY ALL)
SELECT p.img_id, p.x, p.y FROM sp p JOIN sp q USING (img_id) WHERE greatest(abs(p.x - q.x), abs(p.y - q.y)) = 1 AND p.s > 0 AND p.s <= 64 GROUP BY ALL HAVING max(q.s) < 192""",
)
_add(
    "median_filter",
    lambda s, d: prepare.median_filter(_pixels(s, d)),
    f"""{_PX}, n AS (SELECT p.img_id, p.x, p.y, list_sort(list(q.rgb)) AS s FROM px p JOIN px q USING (img_id) WHERE abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY ALL)
SELECT img_id, x, y, s[(len(s) + 1) // 2] AS rgb FROM n""",
)
_add(
    "two_colour_sharp",
    lambda s, d: prepare.two_colour_sharp(_pixels(s, d), inspect.two_colour_share(_pixels(s, d))).groupBy("img_id", "rgb").agg(F.count("*").alias("area")),
    f"""{_PX}, r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY area DESC, rgb) AS r FROM pal),
t AS (SELECT img_id, max(rgb) FILTER (r = 1) AS a, coalesce(max(rgb) FILTER (r = 2), max(rgb)) AS b FROM r GROUP BY img_id)
SELECT img_id, CASE WHEN abs(rgb % 256 - a % 256) <= abs(rgb % 256 - b % 256) THEN a ELSE b END AS rgb, count(*) AS area FROM px JOIN t USING (img_id) GROUP BY ALL""",
)
_add(
    "enlarged_twice",
    lambda s, d: prepare.enlarged_twice(_pixels(s, d)).select("img_id", "x", "y", "rgb"),
    f"""{_PX}, n AS (SELECT p.*, coalesce(l.rgb, p.rgb) AS l, coalesce(r.rgb, p.rgb) AS r, coalesce(u.rgb, p.rgb) AS u, coalesce(b.rgb, p.rgb) AS b FROM px p
  LEFT JOIN px l ON l.img_id = p.img_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN px r ON r.img_id = p.img_id AND r.y = p.y AND r.x = p.x + 1
  LEFT JOIN px u ON u.img_id = p.img_id AND u.x = p.x AND u.y = p.y - 1 LEFT JOIN px b ON b.img_id = p.img_id AND b.x = p.x AND b.y = p.y + 1)
SELECT img_id, 2 * x AS x, 2 * y AS y, CASE WHEN u = l AND u <> r AND l <> b THEN u ELSE rgb END AS rgb FROM n
UNION ALL SELECT img_id, 2 * x + 1, 2 * y, CASE WHEN u = r AND u <> l AND r <> b THEN u ELSE rgb END FROM n
UNION ALL SELECT img_id, 2 * x, 2 * y + 1, CASE WHEN b = l AND b <> r AND l <> u THEN b ELSE rgb END FROM n
UNION ALL SELECT img_id, 2 * x + 1, 2 * y + 1, CASE WHEN b = r AND b <> l AND r <> u THEN b ELSE rgb END FROM n""",
)
_add(
    "sticker_rim",
    lambda s, d: layers.sticker_rim(_pixels(s, d).where("rgb < 11184810"), 1),
    f"""{_PX}, d AS (SELECT img_id, x, y FROM px WHERE rgb < 11184810), g AS (SELECT DISTINCT img_id, CAST(x + i.i AS INT) AS x, CAST(y + j.j AS INT) AS y FROM d, range(-1, 2) i(i), range(-1, 2) j(j))
SELECT img_id, x, y FROM g ANTI JOIN d USING (img_id, x, y)""",
)
_add(
    "pixel_edged",
    lambda s, d: inspect.pixel_edged(_pixels(s, d)),
    f"""{_PX}{_NEAR}{_ROW}, c AS (SELECT img_id, count(*) AS runs FROM d0 WHERE d <> 0 OR d IS NULL GROUP BY img_id),
l AS (SELECT img_id, count(*) AS lone FROM (SELECT img_id, x, y FROM near GROUP BY img_id, x, y, rgb HAVING count(*) FILTER (near = rgb) = 0) GROUP BY img_id),
s AS (SELECT img_id, count(*) AS e, count(*) FILTER (CAST(d AS BIGINT) * coalesce(p, 0) * 4 >= CAST(d AS BIGINT) * d OR CAST(d AS BIGINT) * coalesce(n, 0) * 4 >= CAST(d AS BIGINT) * d) AS q FROM d1 WHERE d <> 0 GROUP BY img_id)
SELECT img_id, runs, coalesce(lone, 0) AS lone, coalesce(q, 0) * 10 <= coalesce(e, 0) AS is_pixel_edged FROM c LEFT JOIN l USING (img_id) LEFT JOIN s USING (img_id)""",
)


def region_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, regions, colours, largest, sides): 4-connected regions, colours, the largest area, and pixel sides between colours."""
    px = _pixels(spark, sf_dir)
    own = regions.region_table(regions.label_runs(tiles.row_runs(px))).groupBy("img_id").agg(F.count("*").alias("regions"), F.countDistinct("rgb").alias("colours"), F.max("area").alias("largest"))
    sides = regions.edges(px).groupBy("img_id").agg(F.count("*").alias("sides"))
    return own.join(sides, "img_id", "left").select("img_id", "regions", "colours", "largest", F.coalesce("sides", F.lit(0)).alias("sides"))


_add(
    "region_statistics",
    region_statistics,
    f"""{_PX}{_REG}{_EDGES}, n AS (SELECT img_id, count(*) AS sides FROM e GROUP BY img_id)
SELECT reg.img_id, count(*) AS regions, count(DISTINCT rgb) AS colours, max(area) AS largest, any_value(coalesce(sides, 0)) AS sides FROM reg LEFT JOIN n USING (img_id) GROUP BY reg.img_id""",
)


_add(
    "ring_areas",
    lambda s, d: trace.rings(trace.chains(_labelled(s, d))).groupBy("img_id", "region_id").agg(F.sum("area").cast("long").alias("area")),
    f"{_PX}{_REG} SELECT img_id, region_id, area FROM reg",
)


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, wrong): pixels that a drawing gives back in another colour than the raster has."""
    px = _pixels(spark, sf_dir)
    shapes, sizes = vectorize.trace_pictures(px)
    files = drawings.drawings(shapes, sizes, "svg")
    back = pictures.image_pixels(pictures.decoded(files, "svg").withColumn("img_id", F.col("img_id").cast("string")))
    both = px.select(F.col("img_id").cast("string").alias("img_id"), "x", "y", "rgb").join(back.select("img_id", "x", "y", F.col("rgb").alias("again")).hint("merge"), ["img_id", "x", "y"], "left")
    return both.groupBy(F.col("img_id").cast("long").alias("img_id")).agg(F.count(F.when(~F.col("rgb").eqNullSafe(F.col("again")), 1)).alias("wrong"))


_add("svg_round_trip", _drawn, "SELECT CAST(vec_id AS BIGINT) AS img_id, CAST(0 AS BIGINT) AS wrong FROM embeddings")


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the shapes after a log that deletes lone pixels, restores those in the first row, and is undone where a raster's number is even."""
    table = regions.region_table(_runs(spark, sf_dir))
    small = table.where("area = 1")
    log = small.select("img_id", F.col("region_id").alias("seq"), F.lit("delete").alias("op"), "region_id", F.lit(None).cast("long").alias("other"))
    log = log.unionByName(small.where("y0 = 0").select("img_id", (F.col("region_id") + (1 << 30)).alias("seq"), F.lit("restore").alias("op"), "region_id", F.lit(None).cast("long").alias("other")))
    undone = log.where("img_id % 2 = 0").withColumns({"seq": F.col("seq") + (1 << 40), "op": F.lit("undo")})
    done = edit.effective_edits(log.unionByName(undone))
    return edit.without_deleted(table, done).select("img_id", "region_id", "area")


_add("edited_shapes", _edited, f"{_PX}{_REG} SELECT img_id, region_id, area FROM reg WHERE area > 1 OR y0 = 0 OR img_id % 2 = 0")
def _gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, values = materialize(_labelled(spark, sf_dir), "labelled"), _values(spark, sf_dir)
    chosen = colours.accepted_gradients(colours.gradient_fits(labelled, values), labelled, values)
    return chosen.select("img_id", "region_id", "n", F.col("flat_error").cast("decimal(18,3)").cast("double").alias("flat_error"), "is_gradient")


_add(
    "gradient_choice",
    _gradients,
    f"""{_PX}{_REG}, s AS (SELECT img_id, region_id, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(x * y)::BIGINT AS sxy, sum(y * y)::BIGINT AS syy,
  sum(v)::BIGINT AS sv, sum(v * v)::BIGINT AS sq, sum(x * v)::BIGINT AS sxv, sum(y * v)::BIGINT AS syv FROM lab JOIN v8 USING (img_id, x, y) GROUP BY img_id, region_id),
m AS (SELECT *, n * sxx - sx * sx AS a, n * sxy - sx * sy AS b, n * syy - sy * sy AS c, n * sxv - sx * sv AS d, n * syv - sy * sv AS e FROM s),
g AS (SELECT *, CAST(c * d - b * e AS DOUBLE) / (a * c - b * b) AS kx, CAST(a * e - b * d AS DOUBLE) / (a * c - b * b) AS ky FROM m WHERE a * c - b * b <> 0),
h AS (SELECT *, (sv - kx * sx - ky * sy) / n AS k0 FROM g),
e AS (SELECT h.img_id, h.region_id, any_value(n) AS n, any_value(sq - CAST(sv * sv AS DOUBLE) / n) AS flat, sum((v - k0 - kx * x - ky * y) * (v - k0 - kx * x - ky * y)) AS plane, max(k0 + kx * x + ky * y) - min(k0 + kx * x + ky * y) AS reach
  FROM h JOIN lab USING (img_id, region_id) JOIN v8 USING (img_id, x, y) GROUP BY h.img_id, h.region_id)
SELECT img_id, region_id, n, CAST(CAST(flat AS DECIMAL(18,3)) AS DOUBLE) AS flat_error, plane <= flat / 2 - 1e-6 AND reach > 2 + 1e-6 AS is_gradient FROM e""",
)


def _crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, x, y, upright, at): where each side between two regions of four levels has the colour halfway between theirs, by the 256 levels, in thousandths."""
    labelled, values = _labelled(spark, sf_dir), _values(spark, sf_dir)
    shades = regions.region_table(_runs(spark, sf_dir)).select("img_id", "region_id", "rgb")
    grey = values.select("img_id", "x", "y", (F.col("v") * 65793).cast("int").alias("rgb"))
    sides = trace.boundary_sides(labelled).where(F.col("left") != trace.OUTSIDE)
    upright = F.col("ax") == F.col("bx")
    at = F.when(upright, F.col("px") - F.least("ax", "bx")).otherwise(F.col("py") - F.least("ay", "by"))
    return corners.crossings(sides, grey, shades).select("img_id", F.least("ax", "bx").alias("x"), F.least("ay", "by").alias("y"), upright.alias("upright"), F.floor(at * 1000 + 0.3).cast("long").alias("at"))


_add(
    "edge_crossings",
    _crossings,
    f"""{_PX}, s AS (
  SELECT q.img_id, q.x, q.y, p.y = q.y AS upright, p.rgb % 256 AS a, q.rgb % 256 AS b, vp.v AS vp, vq.v AS vq FROM px p JOIN px q USING (img_id)
  JOIN v8 vp ON vp.img_id = p.img_id AND vp.x = p.x AND vp.y = p.y JOIN v8 vq ON vq.img_id = q.img_id AND vq.x = q.x AND vq.y = q.y
  WHERE ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) AND p.rgb <> q.rgb
), t AS (
  SELECT *, CAST(3 * (vp - a) * (b - a) AS DOUBLE) / (3 * (b - a) * (b - a)) AS tp, CAST(3 * (vq - a) * (b - a) AS DOUBLE) / (3 * (b - a) * (b - a)) AS tq FROM s
), u AS (SELECT *, CASE WHEN abs(tq - tp) > 0.05 THEN (0.5 - tp) / (tq - tp) END AS u FROM t)
SELECT img_id, x, y, upright, CAST(floor((CASE WHEN u BETWEEN -0.500001 AND 1.500001 THEN u ELSE 0.5 END - 0.5) * 1000 + 0.3) AS BIGINT) AS at FROM u""",
)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, region_id, rgb, area): shapes after a log that joins each lone pixel to its least neighbour, and is undone where a raster's number is even; areas are those of the new outlines."""
    runs = materialize(_runs(spark, sf_dir), "runs")
    table, labelled = regions.region_table(runs), regions.run_pixels(runs)
    near = regions.adjacency(labelled)
    near = near.select("img_id", F.col("region_a").alias("region_id"), F.col("region_b").alias("other")).unionByName(near.select("img_id", F.col("region_b").alias("region_id"), F.col("region_a").alias("other")))
    least = table.where("area = 1").select("img_id", "region_id").join(near.hint("merge"), ["img_id", "region_id"]).groupBy("img_id", "region_id").agg(F.min("other").alias("other"))
    log = least.select("img_id", F.col("region_id").alias("seq"), F.lit("join").alias("op"), "region_id", "other")
    undone = log.where("img_id % 2 = 0").withColumns({"seq": F.col("seq") + (1 << 40), "op": F.lit("undo")})
    joined = edit.joined_shapes(edit.effective_edits(log.unionByName(undone)))
    outline = trace.rejoined(edit.relabelled(trace.chains(labelled), joined), table.select("img_id").distinct().withColumn("tolerance", F.lit(0.0)))
    areas = trace.rings(outline).groupBy("img_id", "region_id").agg(F.sum("area").cast("long").alias("area"))
    return edit.with_joined(table, joined).select("img_id", "region_id", "rgb").join(areas.hint("merge"), ["img_id", "region_id"])


_add(
    "joined_shapes",
    _joined,
    f"""{_PX}{_REG}, e0 AS (SELECT r.img_id, r.region_id AS u, min(CASE WHEN a.region_a = r.region_id THEN a.region_b ELSE a.region_a END) AS v FROM reg r
  JOIN adj a ON a.img_id = r.img_id AND (a.region_a = r.region_id OR a.region_b = r.region_id) WHERE r.area = 1 AND r.img_id % 2 <> 0 GROUP BY r.img_id, r.region_id),
e2 AS (SELECT img_id, u, v FROM e0 UNION SELECT img_id, v, u FROM e0),
j AS (SELECT img_id, region_id AS p, region_id AS q FROM reg UNION SELECT j.img_id, j.p, e2.v FROM j JOIN e2 ON e2.img_id = j.img_id AND e2.u = j.q),
w AS (SELECT img_id, p, min(q) AS whole FROM j GROUP BY img_id, p),
o AS (SELECT reg.img_id, whole, rgb, area, row_number() OVER (PARTITION BY reg.img_id, whole ORDER BY area DESC, region_id) AS r FROM reg JOIN w ON w.img_id = reg.img_id AND w.p = reg.region_id)
SELECT img_id, whole AS region_id, max(rgb) FILTER (r = 1) AS rgb, CAST(sum(area) AS BIGINT) AS area FROM o GROUP BY img_id, whole""",
)
_add(
    "text_lines",
    lambda s, d: lettering.text_lines(regions.region_table(_runs(s, d)), 1, 3, 3),
    f"""{_PX}{_REG}, g AS (SELECT *, y1 - y0 + 1 AS h FROM reg WHERE y1 - y0 + 1 BETWEEN 1 AND 3 AND x1 - x0 + 1 <= 2.5 * 3),
n0 AS (SELECT a.img_id, a.region_id AS u, b.region_id AS v FROM g a JOIN g b ON a.img_id = b.img_id AND a.region_id <> b.region_id AND a.x0 <= b.x0
  AND b.x0 - a.x1 - 1 <= least(a.h, b.h) AND 2 * (least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) >= least(a.h, b.h) AND greatest(a.h, b.h) <= 2 * least(a.h, b.h)),
n2 AS (SELECT img_id, u, v FROM n0 UNION SELECT img_id, v, u FROM n0),
j AS (SELECT img_id, region_id AS p, region_id AS q FROM g UNION SELECT j.img_id, j.p, n2.v FROM j JOIN n2 ON n2.img_id = j.img_id AND n2.u = j.q),
w AS (SELECT img_id, p AS region_id, min(q) AS line_id FROM j GROUP BY img_id, p)
SELECT img_id, region_id, line_id FROM w QUALIFY count(*) OVER (PARTITION BY img_id, line_id) >= 3""",
)
_add(
    "unlike_curves",
    lambda s, d: trace.unlike_curves(trace.rings(trace.with_handles(trace.chains(_labelled(s, d), 0.8)))).select("img_id", "unlike"),
    f"{_PX}{_REG} SELECT img_id, CAST(0 AS BIGINT) AS unlike FROM reg GROUP BY img_id",
)


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items()}
