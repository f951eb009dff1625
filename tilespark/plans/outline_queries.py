"""Queries of region outlines and of the whole post-processing chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.operators import components as cc, inference as inf, rings
from tilespark.plans.mask_queries import BOX, FG2, KEYS, _comp
from tilespark.plans.registry import query
from tilespark.sources.fixtures import MOSAIC, PATCHES, mosaic, patches


def _rings(of: str, n: str = "") -> str:
    """The outer ring of every region of ``of(image_id, r, c, component)``, edge by edge from above its smallest pixel: ``pt(image_id, component, pos, y2, x2)``."""
    return f"""si{n}(s, dr, dc, ar, ac) AS (VALUES (0, -1, 0, 0, 1), (1, 0, 1, 1, 0), (2, 1, 0, 0, -1), (3, 0, -1, -1, 0)),
  ed{n} AS (SELECT o.*, s, dr, dc, ar, ac FROM {of} o, si{n} ANTI JOIN {of} t ON t.image_id = o.image_id AND t.component = o.component AND t.r = o.r + dr AND t.c = o.c + dc),
  nx{n} AS (SELECT e.image_id, e.component, e.r, e.c, e.s, CASE WHEN k.r IS NOT NULL THEN k.r WHEN f.r IS NOT NULL THEN f.r ELSE e.r END AS nr, CASE WHEN k.r IS NOT NULL THEN k.c WHEN f.r IS NOT NULL THEN f.c ELSE e.c END AS nc,
    (e.s + CASE WHEN k.r IS NOT NULL THEN 3 WHEN f.r IS NOT NULL THEN 0 ELSE 1 END) % 4 AS ns FROM ed{n} e
    LEFT JOIN {of} f ON f.image_id = e.image_id AND f.component = e.component AND f.r = e.r + ar AND f.c = e.c + ac
    LEFT JOIN {of} k ON k.image_id = e.image_id AND k.component = e.component AND k.r = e.r + ar + dr AND k.c = e.c + ac + dc),
  wa{n} AS (SELECT image_id, component, CAST(0 AS BIGINT) AS pos, r, c, s FROM ed{n} WHERE s = 0 AND r * 2147483648 + c = component
    UNION ALL SELECT w.image_id, w.component, w.pos + 1, nr, nc, ns FROM wa{n} w JOIN nx{n} USING (image_id, component, r, c, s) WHERE NOT (ns = 0 AND nr * 2147483648 + nc = w.component)),
  pe{n} AS (SELECT image_id, component, pos, CAST(2 * r + dr AS INTEGER) AS y2, CAST(2 * c + dc AS INTEGER) AS x2 FROM wa{n} JOIN si{n} USING (s)),
  pt{n} AS (SELECT * FROM pe{n} UNION ALL SELECT p.image_id, p.component, m.n, p.y2, p.x2 FROM pe{n} p JOIN (SELECT image_id, component, count(*) AS n FROM pe{n} GROUP BY 1, 2) m USING (image_id, component) WHERE p.pos = 0)"""


def _simplified(epsilon: float) -> str:
    """Points of ``pt`` that the simplification keeps: ``sp``. Runs are split at their farthest point, the first of equals."""
    return f"""rn AS (SELECT image_id, component, CAST(0 AS BIGINT) AS a, max(pos) AS b FROM pt GROUP BY 1, 2
    UNION ALL SELECT image_id, component, unnest([a, -m.back]) AS a, unnest([-m.back, b]) AS b FROM (
      SELECT image_id, component, a, b, ch, max({{'far': CASE WHEN ch = 0 THEN py * py + px * px ELSE abs(dy * px - dx * py) END, 'back': -pos}}) AS m FROM (
        SELECT rn.image_id, rn.component, a, b, p.pos, CAST(e.y2 - s.y2 AS BIGINT) AS dy, CAST(e.x2 - s.x2 AS BIGINT) AS dx, CAST(p.y2 - s.y2 AS BIGINT) AS py, CAST(p.x2 - s.x2 AS BIGINT) AS px, dy * dy + dx * dx AS ch
        FROM rn JOIN pt p ON p.image_id = rn.image_id AND p.component = rn.component AND p.pos > a AND p.pos < b JOIN pt s ON s.image_id = rn.image_id AND s.component = rn.component AND s.pos = a
        JOIN pt e ON e.image_id = rn.image_id AND e.component = rn.component AND e.pos = b) GROUP BY 1, 2, 3, 4, 5)
    WHERE CASE WHEN ch = 0 THEN m.far > {4 * epsilon * epsilon} ELSE CAST(m.far AS DOUBLE) * m.far > {4 * epsilon * epsilon} * ch END),
  sp AS (SELECT pt.* FROM pt SEMI JOIN (SELECT image_id, component, a AS pos FROM rn UNION SELECT image_id, component, b FROM rn) k USING (image_id, component, pos))"""


def _regions(spark, sf):
    return cc.label_components(mosaic(spark, sf).where("v >= 0.1"), True, tile=16)


@query("outline_points", f"WITH RECURSIVE {_comp(MOSAIC, FG2, 8)}, {_rings('co')} SELECT * FROM pt")
def outline_points(spark, sf):
    """Every point of the outer rings of all regions."""
    return rings.outline_rings(_regions(spark, sf), tile=16)


@query("outline_rings", f"WITH RECURSIVE {_comp(MOSAIC, FG2, 8)}, {_rings('co')}, {_simplified(1.0)} SELECT * FROM sp")
def outline_rings(spark, sf):
    """Outer rings simplified within one pixel."""
    return rings.simplify_rings(rings.outline_rings(_regions(spark, sf), tile=16), 1.0)


@query("outline_polygons", f"""WITH RECURSIVE {_comp(MOSAIC, FG2, 8)}, {_rings('co')}, {_simplified(0.75)}, g AS (SELECT image_id, component, count(*) AS n, sum(y2) AS y, sum(x2) AS x, min(y2) AS r0, max(y2) AS r1, min(x2) AS c0, max(x2) AS c1 FROM sp GROUP BY 1, 2)
  SELECT image_id, component, CASE WHEN n < 3 THEN 'dot' ELSE 'polygon' END AS type, CAST(CASE WHEN n < 3 THEN 1 ELSE n END AS INTEGER) AS points,
    round(CASE WHEN n < 3 THEN y / n ELSE r0 END, 6) AS r0, round(CASE WHEN n < 3 THEN y / n ELSE r1 END, 6) AS r1, round(CASE WHEN n < 3 THEN x / n ELSE c0 END, 6) AS c0, round(CASE WHEN n < 3 THEN x / n ELSE c1 END, 6) AS c1 FROM g""")
def outline_polygons(spark, sf):
    """Annotations of all regions with their type, number of points and extent, at half-pixel spacing."""
    o = rings.polygons(_regions(spark, sf).withColumn("label", F.lit(1)), 2.0, 0.75, single_points=True, tile=16)
    return o.select("image_id", "component", "type", F.size("coords").alias("points"), *[F.round(f(f"coords.{x}"), 6).alias(n) for x, f, n in (
        ("row", F.array_min, "r0"), ("row", F.array_max, "r1"), ("col", F.array_min, "c0"), ("col", F.array_max, "c1"))])


@query("infer_chain_fill", f"""WITH RECURSIVE {_comp(PATCHES, 'SELECT image_id, r, c FROM px WHERE v >= 0.08', 8)}, {BOX}, k AS (SELECT co.image_id, co.r, co.c FROM co JOIN bx USING (image_id, component) WHERE diagonal2 > 4),
  di AS (SELECT DISTINCT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c FROM k, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc) WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7),
  {_comp('z1 AS (SELECT 1)', 'SELECT image_id, r, c FROM px ANTI JOIN di USING (image_id, r, c)', 8, 'h')},
  hb AS (SELECT image_id, component, power(max(r) - min(r) + 1, 2) + power(max(c) - min(c) + 1, 2) AS d FROM coh GROUP BY 1, 2), fi AS (SELECT * FROM di UNION SELECT image_id, r, c FROM coh JOIN hb USING (image_id, component) WHERE d <= 5),
  {_comp('z2 AS (SELECT 1)', 'SELECT * FROM fi', 8, 'o')}, {_rings('coo')}, {_simplified(1.0)}
  SELECT 'threshold' AS step, image_id, r, c FROM fg UNION ALL SELECT 'filter', * FROM k UNION ALL SELECT 'dilate', * FROM di UNION ALL SELECT 'fill', * FROM fi UNION ALL SELECT 'outline', image_id, y2, x2 FROM sp""")
def infer_chain_fill(spark, sf):
    """Threshold, filter, dilation, hole filling and outline over every patch; the outline's points in half pixels."""
    steps = inf.chain(patches(spark, sf).select(*KEYS, "v"), (8, 8), 0.08, min_diagonal=2.0, dilation=1, hole_diagonal=5.0**0.5, outline=False)
    out = inf.outline_points(steps["fill"])[0].select(F.lit("outline").alias("step"), "image_id", F.col("y2").alias("r"), F.col("x2").alias("c"))
    for name in ("threshold", "filter", "dilate", "fill"):
        out = out.unionByName(steps[name].select(F.lit(name).alias("step"), *KEYS))
    return out
