"""Vector annotations: groups, coordinates, rasterization, outlines, simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilespark.operators.pointwise import with_tiles

#: Points of polygons that are met with rows at once.
_POINTS = 1 << 14
#: Points that each type of annotation needs: (least, exactly).
ARITY = {"dot": (1, 1), "measurement": (2, 2), "rectangle": (4, 4), "polygon": (3, None), "spline": (3, None), "points": (1, None)}


def validate(items: DataFrame) -> DataFrame:
    """``valid``: whether an item has as many points as its type asks for."""
    n = F.size("coords")
    hit = F.lit(False)
    for kind, (least, exact) in ARITY.items():
        hit = F.when(F.col("type") == kind, (n == exact) if exact else (n >= least)).otherwise(hit)
    return items.withColumn("valid", hit)


def shift(items: DataFrame, rows: float, cols: float) -> DataFrame:
    return items.withColumn("coords", F.transform("coords", lambda p: F.struct((p["row"] + rows).alias("row"), (p["col"] + cols).alias("col"))))


def scale(items: DataFrame, spacing: float) -> DataFrame:
    return items.withColumn("coords", F.transform("coords", lambda p: F.struct((p["row"] * spacing).alias("row"), (p["col"] * spacing).alias("col"))))


def group_counts(items: DataFrame) -> DataFrame:
    """Items by group, the group of none included."""
    return items.groupBy("grp").agg(F.count("*").alias("n"))


def descendants(groups: DataFrame, root: str | None, max_depth: int = 64) -> DataFrame:
    """``groups(name, parent)``: the group and all below it (all groups for a null root), by a recursive query; deeper trees are an error."""
    groups.createOrReplaceTempView("_annotation_groups")
    start = "parent is null" if root is None else "name = :root"
    found = groups.sparkSession.sql(f"""
        with recursive d(name, depth) as (
          select name, 0 from _annotation_groups where {start}
          union all
          select g.name, d.depth + 1 from _annotation_groups g join d on g.parent = d.name where d.depth < {max_depth})
        select name, max(depth) as depth from d group by name""", {} if root is None else {"root": root})
    return found.select(F.when(F.col("depth") < max_depth, F.col("name")).otherwise(F.raise_error(F.lit("the groups are nested too deeply or in a ring"))).cast("string").alias("name"))


def remove_group(items: DataFrame, groups: DataFrame, root: str | None) -> tuple[DataFrame, DataFrame]:
    """Drop a group, the groups below it and their items; null drops all groups and the ungrouped items as well."""
    gone = descendants(groups, root)
    kept = items.join(gone.withColumnRenamed("name", "grp"), "grp", "left_anti")
    return (kept.where("grp is not null") if root is None else kept), groups.join(gone, "name", "left_anti")


def regroup(items: DataFrame, groups: DataFrame, group: str | None, *, item=None, moved: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Put the items for which the condition ``item`` holds, or the group ``moved``, below ``group`` (null: below none).

    A new group is made below none. Groups that the move leaves without items and without groups of their own go, and so do those above
    them that hold nothing else.
    """
    if (item is None) == (moved is None):
        raise ValueError("either items or a group are moved")
    spark = groups.sparkSession
    if item is not None:
        left = items.where(item).select(F.col("grp").alias("name")).distinct()
        items = items.withColumn("grp", F.when(item, F.lit(group)).otherwise(F.col("grp")))
    else:
        left = groups.where(F.col("name") == moved).select(F.col("parent").alias("name"))
        groups = groups.withColumn("parent", F.when(F.col("name") == moved, F.lit(group)).otherwise(F.col("parent")))
    if group is not None:
        fresh = spark.createDataFrame([(group, None)], "name string, parent string").join(groups, "name", "left_anti").select("name", "parent")
        groups = groups.select("name", "parent").unionByName(fresh)
    held = items.select(F.col("grp").alias("name")).distinct()
    while True:  # a round for each level of the tree that empties
        open_ = left.where("name is not null").join(held, "name", "left_anti").join(groups.select(F.col("parent").alias("name")), "name", "left_anti")
        gone = groups.join(open_, "name", "left_semi").select("name", "parent")
        names = gone.collect()  # groups that one move empties
        if not names:
            return items, groups
        groups = groups.where(~F.col("name").isin([r["name"] for r in names]))
        left = spark.createDataFrame([(r["parent"],) for r in names], "name string")


def collect_empty_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that hold an item themselves or in a group below."""
    groups.createOrReplaceTempView("_annotation_groups")
    items.select("grp").distinct().createOrReplaceTempView("_annotation_used")
    used = groups.sparkSession.sql("""
        with recursive u(name, parent) as (
          select g.name, g.parent from _annotation_groups g join _annotation_used i on g.name = i.grp
          union all
          select g.name, g.parent from _annotation_groups g join u on g.name = u.parent)
        select distinct name from u""")
    return groups.join(used, "name", "left_semi")


def _covered(code: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: np.ndarray, height: int, width: int) -> np.ndarray:
    """Stretches that the polygons of each code cover, united: from and to (exclusive) as (code * height + row) * (width + 1) + column.

    ``rows, cols`` are the points of all polygons in turn, ``n`` how many each one has. Every edge is met with the rows that it crosses; between
    the first and second crossing of a polygon's row, the third and fourth, ... lie its cells.
    """
    of, end = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    after = np.arange(1, len(rows) + 1)
    after[end[n > 0] - 1] = (end - n)[n > 0]
    y, x, y2, x2 = rows, cols, rows[after], cols[after]
    top, low = (np.ceil(np.clip(f(y, y2), 0, height)) for f in (np.fmin, np.fmax))
    times = np.where(np.isfinite(y + x + y2 + x2), low - top, 0).astype(np.int64)
    edge = np.repeat(np.arange(len(y)), times)
    r = np.arange(len(edge)) - np.repeat(np.cumsum(times) - times, times) + top[edge].astype(np.int64)
    cut = x[edge] + (r - y[edge]) * (x2[edge] - x[edge]) / (y2[edge] - y[edge])
    places = np.sort((of[edge] * height + r) * (width + 1) + np.ceil(np.clip(cut, 0, width)).astype(np.int64))
    line = places // (width + 1)
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    nth = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))
    first = np.flatnonzero((nth[:-1] % 2 == 0) & (nth[1:] == nth[:-1] + 1))
    polygon = line[first] // height
    moved = (code[polygon] - polygon) * height * (width + 1)
    return _united(np.stack([places[first] + moved, places[first + 1] + moved], axis=1))


def _united(spans: np.ndarray) -> np.ndarray:
    """Stretches (from, to), those that meet made one."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0])]
    reach = np.maximum.accumulate(spans[:, 1])
    begin = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]], axis=1)


def rasterize(polygons: DataFrame, order: dict[str, int], labels: dict[str, int], height: int, width: int) -> DataFrame:
    """Pixels inside polygons (even-odd rule at pixel positions): ``r, c, label``; where groups overlap the later one in ``order`` counts.

    A row of a polygon is crossed at sorted columns; of the stretches between the first and second, third and fourth, ... a batch of polygons
    passes on their union by group and row.
    """
    if set(order) != set(labels):
        raise ValueError("order and labels must name the same groups")
    names = sorted(order)
    code = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]), F.col("grp"))
    kept = polygons.where(F.col("grp").isin(names) & (F.size("coords") >= 3)).select(
        code.alias("code"), *[F.col(f"coords.{name}").cast("array<double>").alias(name) for name in ("row", "col")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = batch.column("code").to_numpy(), batch.column("row").value_lengths().to_numpy()
            found, portions = [], np.cumsum(n) // _POINTS
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(portions)) + 1):
                if len(part):
                    some = batch.slice(part[0], len(part))
                    rows, cols = (some.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("row", "col"))
                    found.append(_covered(codes[part].astype(np.int64), rows, cols, n[part], height, width))
            spans = _united(np.concatenate(found)) if found else np.zeros((0, 2), np.int64)
            line = spans[:, 0] // (width + 1)
            columns = (line // height, line % height, spans[:, 0] % (width + 1), spans[:, 1] - line * (width + 1) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in columns], ["code", "r", "a", "b"])

    spans = kept.mapInArrow(run, "code int, r int, a int, b int")
    inside = spans.select("code", "r", F.explode(F.sequence("a", "b")).alias("c"))
    pick = lambda m: F.element_at(F.array(*[F.lit(m[name]) for name in names]), F.col("code") + 1)
    return inside.groupBy("r", "c").agg(F.max(F.struct(pick(order).alias("o"), pick(labels).alias("label"))).alias("m")).select("r", "c", F.col("m.label").alias("label"))


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Ramer-Douglas-Peucker by an explicit stack: drop points closer than epsilon to the chord of their run."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, chord = points[a + 1 : b] - points[a], points[b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * p[:, 1] - chord[1] * p[:, 0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        k = int(far.argmax())
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def trace(mask: np.ndarray) -> np.ndarray:
    """Outer contour of a filled region at level 0.5: midpoints between inside and outside cells, in order round the region."""
    return trace_cells(*np.nonzero(np.asarray(mask, bool)))


def trace_cells(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``trace`` of the region with the cells (r, c); of the cells that have all eight neighbours in the region any may be missing."""
    cells = set(zip(np.asarray(r).tolist(), np.asarray(c).tolist()))
    if not cells:
        return np.zeros((0, 2))
    start = min(cells)
    turns = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    # walk along the boundary with the region on the right: at each cell look for the first outside neighbour, clockwise
    cell, side, out = start, 0, []
    while True:
        d = turns[side]
        out.append((cell[0] + d[0] / 2, cell[1] + d[1] / 2))
        ahead = turns[(side + 1) % 4]
        front = (cell[0] + ahead[0], cell[1] + ahead[1])
        corner = (front[0] + d[0], front[1] + d[1])
        if front in cells and corner in cells:
            cell, side = corner, (side - 1) % 4
        elif front in cells:
            cell = front
        else:
            side = (side + 1) % 4
        if cell == start and side == 0:
            return np.array(out)


def _boundary(components: DataFrame, tile: int) -> DataFrame:
    """Pixels with something else among their eight neighbours, and those at tile borders; ``n, rows, cols`` sum up the region.

    Of the rows that a region keeps in a tile, the first carries the count and coordinate sums of all its pixels there, the others zeros.
    """
    names = ["image_id", "component", "label", "r", "c", "n", "rows", "cols"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["r"].to_numpy() % tile, frame["c"].to_numpy() % tile
        ids = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]
        grid = np.full((tile + 2, tile + 2), -1, np.int64)
        grid[r + 1, c + 1] = ids
        inner = np.ones(len(frame), bool)
        for dr in range(3):
            for dc in range(3):
                inner &= grid[r + dr, c + dc] == ids
        kept, of = frame[~inner].copy(), ids[~inner]
        first = np.zeros(len(kept), bool)
        first[np.unique(of, return_index=True)[1]] = True
        for name, weight in (("n", np.ones(len(frame))), ("rows", frame["r"]), ("cols", frame["c"])):
            kept[name] = np.where(first, np.bincount(ids, weights=weight)[of], 0.0)
        return kept[names]

    tiled = with_tiles(components.select("image_id", "component", "label", "r", "c"), tile)
    return tiled.groupBy("image_id", "tile_row", "tile_col").applyInPandas(run, "image_id long, component long, label int, r int, c int, n double, rows double, cols double")


def outline(components: DataFrame, spacing: float = 1.0, epsilon: float = 0.5, single_points: bool = False, tile: int = 512) -> DataFrame:
    """``components(image_id, r, c, component, label)`` -> one polygon a region: ``image_id, component, label, type, coords``.

    The outer ring is traced and simplified; rings of fewer than three points become dots at the region's mean, kept only with
    ``single_points``. Inner pixels are left out tile by tile first, so that a task holds the boundary pixels of one region and those
    at tile borders. No components give no rows.
    """
    schema = "image_id long, component long, label int, type string, coords array<struct<row:double,col:double>>"

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        ring = simplify(trace_cells(frame["r"].to_numpy(), frame["c"].to_numpy()), epsilon)
        kind = "polygon"
        if len(ring) < 3:
            ring, kind = np.array([[frame["rows"].sum(), frame["cols"].sum()]]) / frame["n"].sum(), "dot"
            if not single_points:
                return pd.DataFrame({"image_id": [], "component": [], "label": [], "type": [], "coords": []}).astype({"image_id": "int64", "component": "int64", "label": "int32"})
        points = [{"row": float(y * spacing), "col": float(x * spacing)} for y, x in ring]
        return pd.DataFrame({"image_id": [int(key[0])], "component": [int(key[1])], "label": [int(frame["label"].min())], "type": [kind], "coords": [points]})

    return _boundary(components, tile).groupBy("image_id", "component").applyInPandas(run, schema)
