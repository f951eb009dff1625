"""Region outlines without a task for a whole region: boundary edges, chains by tile, list ranking across tiles, simplification in rounds.

An edge is a side of a pixel beyond which its region ends. Its successor along the boundary, with the region on the right, follows from
the pixel ahead and the one beyond it, so a tile with one pixel of its surroundings chains its own edges. Chains that cross tile borders
are ranked by pointer doubling: each round doubles the reach of every open chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilespark.functions.storage import discard, materialize
from tilespark.operators.components import STRIDE

#: Sides of a pixel in clockwise order, as steps of row and column.
SIDES = ((-1, 0), (0, 1), (1, 0), (0, -1))
#: Pixels of tiles that are chained at once, about.
_PIXELS = 1 << 17
#: Points of the longest ring that is simplified in one task.
_RING = 1 << 10
_CHAIN = "image_id long, component long, head long, nxt long, n long, y2 array<int>, x2 array<int>"


def _edge(r, c, side):
    """The number of a side of a pixel; rows may go up to 2^30."""
    return (r << 33) | (c << 2) | side


def _chains(tiles: pa.RecordBatch, tile: int) -> pa.RecordBatch:
    """Chains of the edges of each tile's own pixels; the other pixels are those around it. A ring of a hole inside a tile is left out.

    Every tile has a frame of its own in one flat array, with room for the neighbours of its pixels, so all tiles are chained together.
    """
    images, ty, tx = (tiles.column(k).to_numpy() for k in ("image_id", "ty", "tx"))
    cells, size = tiles.column("p").flatten(), tiles.column("p").value_lengths().to_numpy()
    r, c, component = (cells.field(k).to_numpy().astype(np.int64) for k in ("r", "c", "component"))
    of, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    r0, c0, r1, c1 = (f.reduceat(x, start) for f, x in ((np.minimum, r), (np.minimum, c), (np.maximum, r), (np.maximum, c)))
    wide, area = c1 - c0 + 3, (r1 - r0 + 3) * (c1 - c0 + 3)
    place = (np.cumsum(area) - area)[of] + (r - r0[of] + 1) * wide[of] + c - c0[of] + 1
    grid = np.full(area.sum(), -1, np.int64)
    grid[place] = component
    own = (r // tile == ty[of]) & (c // tile == tx[of])
    r, c, component, place, of = (x[own] for x in (r, c, component, place, of))
    sides = []
    for side, (dy, dx) in enumerate(SIDES):
        k = np.flatnonzero(grid[place + dy * wide[of] + dx] != component)
        w, at, ek = wide[of[k]], place[k], component[k]
        ay, ax = SIDES[(side + 1) % 4]
        corner, front = grid[at + (ay + dy) * w + ax + dx] == ek, grid[at + ay * w + ax] == ek
        sy, sx = np.where(corner, ay + dy, np.where(front, ay, 0)), np.where(corner, ax + dx, np.where(front, ax, 0))
        turn = (side + np.where(corner, -1, np.where(front, 0, 1))) % 4
        sides.append((at * 4 + side, (at + sy * w + sx) * 4 + turn, _edge(r[k], c[k], side), _edge(r[k] + sy, c[k] + sx, turn), ek, of[k], 2 * r[k] + dy, 2 * c[k] + dx))
    here, there, number, following, comp, of, y2, x2 = (np.concatenate(v) for v in zip(*sides))
    order = np.argsort(here)
    here, there, number, following, comp, of, y2, x2 = (x[order] for x in (here, there, number, following, comp, of, y2, x2))
    n = len(here)
    first = _edge(comp // STRIDE, comp % STRIDE, 0)  # a region's ring begins above its smallest pixel
    at = np.minimum(np.searchsorted(here, there), max(0, n - 1))
    local = (here[at] == there) & (following != first)
    jump, left = np.where(local, at, np.arange(n)), local.astype(np.int64)
    for _ in range(int(np.bincount(of).max()).bit_length() + 1 if n else 0):
        left, jump = left + left[jump], jump[jump]
    done = np.flatnonzero(~local[jump])
    by = done[np.lexsort((-left[done], jump[done]))]
    tail = jump[by]
    cuts = np.flatnonzero(np.append(True, tail[1:] != tail[:-1])) if len(by) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(by))[: len(cuts)]
    head, last = by[cuts], by[ends - 1]
    bounds = pa.array(np.append(cuts, len(by)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x[by].astype(np.int32))) for x in (y2, x2)]
    numbers = [pa.array(x.astype(np.int64)) for x in (images[of[last]], comp[last], number[head], following[last], ends - cuts)]
    return pa.RecordBatch.from_arrays([*numbers, *lists], ["image_id", "component", "head", "nxt", "n", "y2", "x2"])


def _ranked(chains: DataFrame) -> DataFrame:
    """``chains(image_id, first, head, nxt, n)`` -> ``image_id, head, left`` for the chains of outer rings: edges from the head to the ring's end.

    A ring ends where the next edge is its first. Rings without a first edge surround holes: they are all that is left when a round
    ends no chain any more.
    """
    ends = F.when(F.col("nxt") == F.col("first"), F.lit(None).cast("long")).otherwise(F.col("nxt"))
    cur = materialize(chains.select("image_id", "head", ends.alias("to"), F.col("n").alias("left")), "chains")
    open_ = cur.where("to is not null").count()
    while open_:
        ahead = cur.select("image_id", F.col("head").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        waiting = cur.where("to is not null").join(ahead.hint("merge"), ["image_id", "to"]).select("image_id", "head", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"))
        nxt = materialize(cur.where("to is null").unionByName(waiting), "chains")
        discard(cur)
        cur, before = nxt, open_
        open_ = cur.where("to is not null").count()
        if open_ == before:
            break
    return cur.where("to is null").select("image_id", "head", "left")


def outline_rings(components: DataFrame, tile: int = 512) -> DataFrame:
    """``components(image_id, r, c, component)`` -> the outer ring of every region: ``image_id, component, pos, y2, x2``.

    ``component`` is the smallest pixel number (row * 2^31 + column) of the region, as ``label_components`` gives it. Points are the middles of
    boundary edges in clockwise order, in half pixels, from above the smallest pixel; the last point repeats the first. Pixels of a
    region that touch at a corner are joined there; rings of holes are left out. No components give no rows.
    """
    one = components.select("image_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "component")
    near = one
    for axis, name in (("r", "ty"), ("c", "tx")):
        near = near.withColumn(name, F.explode(F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / tile).cast("int") for d in (-1, 0, 1)]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            portions = np.cumsum(batch.column("p").value_lengths().to_numpy()) // _PIXELS
            for part in np.split(np.arange(len(portions)), np.flatnonzero(np.diff(portions)) + 1):
                if len(part):
                    yield _chains(batch.slice(part[0], len(part)), tile)

    tiles = near.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct("r", "c", "component")).alias("p"))
    chains = materialize(tiles.mapInArrow(run, _CHAIN), "chains")
    first = F.expr(f"shiftleft(component div {STRIDE}, 33) | shiftleft(component % {STRIDE}, 2)")
    slim = chains.select("image_id", "component", first.alias("first"), "head", "nxt", "n")
    whole = (F.col("head") == F.col("first")) & (F.col("nxt") == F.col("first"))
    ranks = _ranked(slim.where(~whole)).unionByName(slim.where(whole).select("image_id", "head", F.col("n").alias("left")))
    ranked = materialize(slim.join(ranks.hint("merge"), ["image_id", "head"]), "ranks")
    total = ranked.where("head = first").select("image_id", "component", F.col("left").alias("total"))
    placed = ranked.join(total.hint("merge"), ["image_id", "component"]).select("image_id", "head", (F.col("total") - F.col("left")).alias("before"), "total", (F.col("head") == F.col("first")).alias("starts"))
    points = chains.join(placed.hint("merge"), ["image_id", "head"]).select("image_id", "component", "before", "total", "starts", F.posexplode(F.arrays_zip("y2", "x2")).alias("i", "p"))
    end = F.when(F.col("starts") & (F.col("i") == 0), F.array(F.lit(0).cast("long"), F.col("total"))).otherwise(F.array(F.col("before") + F.col("i")))
    return points.select("image_id", "component", F.explode(end).alias("pos"), F.col("p.y2").alias("y2"), F.col("p.x2").alias("x2"))


def _far(y2: Column, x2: Column) -> tuple[Column, Column]:
    """How far a point lies from its run's chord (whole numbers that order the points of one run), and the square of the chord's length."""
    dy, dx = F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")
    py, px = (y2 - F.col("ya")).cast("long"), (x2 - F.col("xa")).cast("long")
    chord = (dy * dy + dx * dx).cast("long")
    return F.when(chord == 0, py * py + px * px).otherwise(F.abs(dy * px - dx * py)), chord


def _kept(y: np.ndarray, x: np.ndarray, n: np.ndarray, limit: float) -> np.ndarray:
    """Which points of whole rings, one after the other with ``n`` points each, are kept: all open runs of all rings are split at once."""
    keep = np.zeros(len(y), bool)
    b = np.cumsum(n) - 1
    a = b - n + 1
    keep[a] = keep[b] = True
    while True:
        open_ = b - a > 1
        a, b = a[open_], b[open_]
        if not len(a):
            return keep
        size = b - a - 1
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(a)), size)
        at = np.arange(size.sum()) + (a + 1 - start)[of]
        dy, dx, py, px = y[b] - y[a], x[b] - x[a], y[at] - y[a][of], x[at] - x[a][of]
        chord = dy * dy + dx * dx
        far = np.where(chord[of] == 0, py * py + px * px, np.abs(dy[of] * px - dx[of] * py))
        most = np.maximum.reduceat(far, start)
        hits = np.flatnonzero(far == most[of])
        k = at[hits[np.append(True, of[hits][1:] != of[hits][:-1])]]
        over = np.where(chord == 0, most > limit, most.astype(float) * most > limit * chord)
        a, k, b = a[over], k[over], b[over]
        keep[k] = True
        a, b = np.append(a, k), np.append(k, b)


def _simplified_whole(points: DataFrame, limit: float) -> DataFrame:
    """``simplify_rings`` of rings of at most ``_RING`` points: a ring comes as one row, and many are split together as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            portions = np.cumsum(batch.column("p").value_lengths().to_numpy()) // _PIXELS
            for part in np.split(np.arange(len(portions)), np.flatnonzero(np.diff(portions)) + 1):
                if not len(part):
                    continue
                some = batch.slice(part[0], len(part))
                n, cells = some.column("p").value_lengths().to_numpy().astype(np.int64), some.column("p").flatten()
                of, (pos, y, x) = np.repeat(np.arange(len(n)), n), (cells.field(name).to_numpy() for name in ("pos", "y2", "x2"))
                order = np.lexsort((pos, of))
                kept = order[_kept(y[order], x[order], n, limit)]
                ring = pa.array(of[kept])
                columns = [some.column("image_id").take(ring), some.column("component").take(ring), pa.array(pos[kept]), pa.array(y[kept].astype(np.int32)), pa.array(x[kept].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "component", "pos", "y2", "x2"])

    rings = points.groupBy("image_id", "component").agg(F.collect_list(F.struct("pos", "y2", "x2")).alias("p"))
    kinds = {name: points.schema[name].dataType.simpleString() for name in ("image_id", "component")}
    return rings.mapInArrow(run, f"image_id {kinds['image_id']}, component {kinds['component']}, pos long, y2 int, x2 int")


def simplify_rings(points: DataFrame, epsilon: float, in_task: int = _RING) -> DataFrame:
    """Ramer-Douglas-Peucker on all rings at once: ``points(image_id, component, pos, y2, x2)`` less those within ``epsilon`` pixels of their run's chord.

    Rings of at most ``in_task`` points are simplified in the task that they meet in. Longer ones take rounds: a round splits every open run at its
    farthest point (the first one, where several are as far); settled runs take no part in later rounds. Farthest points are partial maxima by run,
    so a ring of any length is spread over tasks. Runs whose two ends are the same point measure the distance to it.
    """
    key = ["image_id", "component"]
    stored = materialize(points.select(*key, F.col("pos").cast("long").alias("pos"), F.col("y2").cast("long").alias("y2"), F.col("x2").cast("long").alias("x2")), "points")
    limit = (2 * epsilon) ** 2
    long = materialize(stored.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > in_task).select(*key), "rings")
    if not long.take(1):
        return _simplified_whole(stored, limit)
    whole = _simplified_whole(stored.join(long.hint("merge"), key, "left_anti"), limit)
    stored = materialize(stored.join(long.hint("merge"), key, "left_semi"), "points")
    last = stored.groupBy(*key).agg(F.max("pos").alias("b"), F.max_by("y2", "pos").alias("yb"), F.max_by("x2", "pos").alias("xb"), F.min_by("y2", "pos").alias("ya"), F.min_by("x2", "pos").alias("xa"))
    runs = last.withColumn("a", F.lit(0).cast("long"))
    kept = stored.join(last.select(*key, "b").hint("merge"), key).where("pos = 0 or pos = b").select(*key, "pos", "y2", "x2")
    work = materialize(stored.join(runs.hint("merge"), key).where("pos > a and pos < b"), "runs")
    while work.take(1):
        far, chord = _far(F.col("y2"), F.col("x2"))
        best = work.groupBy(*key, "a").agg(F.max(F.struct(far.alias("far"), (-F.col("pos")).alias("back"), "y2", "x2", chord.alias("chord"))).alias("m"))
        over = F.when(F.col("m.chord") == 0, F.col("m.far") > limit).otherwise(F.col("m.far").cast("double") * F.col("m.far") > limit * F.col("m.chord"))
        split = materialize(best.where(over).select(*key, "a", (-F.col("m.back")).alias("k"), F.col("m.y2").alias("yk"), F.col("m.x2").alias("xk")), "splits")
        kept = kept.unionByName(split.select(*key, F.col("k").alias("pos"), F.col("yk").alias("y2"), F.col("xk").alias("x2")))
        low = F.col("pos") < F.col("k")
        halves = work.join(split.hint("merge"), [*key, "a"]).where("pos <> k").select(
            *key, "pos", "y2", "x2", F.when(low, F.col("k")).otherwise(F.col("b")).alias("b"), F.when(low, F.col("yk")).otherwise(F.col("yb")).alias("yb"),
            F.when(low, F.col("xk")).otherwise(F.col("xb")).alias("xb"), F.when(low, F.col("ya")).otherwise(F.col("yk")).alias("ya"),
            F.when(low, F.col("xa")).otherwise(F.col("xk")).alias("xa"), F.when(low, F.col("a")).otherwise(F.col("k")).alias("a"))
        nxt = materialize(halves, "runs")
        discard(work)
        work = nxt
    return whole.unionByName(kept.select(*key, "pos", F.col("y2").cast("int").alias("y2"), F.col("x2").cast("int").alias("x2")))


def as_polygons(points: DataFrame, components: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Simplified rings as one annotation a region: ``image_id, component, label, type, coords``; of fewer than three points a dot at their mean."""
    key = ["image_id", "component"]
    point = F.struct((F.col("y2") / 2.0 * spacing).alias("row"), (F.col("x2") / 2.0 * spacing).alias("col"))
    rings = points.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))), lambda s: s["p"]).alias("ring"))
    mean = lambda name: F.aggregate(F.col("ring"), F.lit(0.0), lambda s, q: s + q[name]) / F.size("ring")
    small = F.size("ring") < 3
    dot = F.array(F.struct(mean("row").alias("row"), mean("col").alias("col")))
    labels = components.groupBy(*key).agg(F.min("label").alias("label"))
    return rings.join(labels.hint("merge"), key).select(*key, "label", F.when(small, F.lit("dot")).otherwise(F.lit("polygon")).alias("type"), F.when(small, dot).otherwise(F.col("ring")).alias("coords"))


def polygons(components: DataFrame, spacing: float = 1.0, epsilon: float = 1.0, single_points: bool = False, tile: int = 512) -> DataFrame:
    """``components(image_id, r, c, component, label)`` -> one annotation a region: ``image_id, component, label, type, coords``.

    Rings that simplify to fewer than three points become dots at their mean, kept only with ``single_points``. A row holds a region's
    simplified points alone; coordinates are pixel positions times ``spacing``.
    """
    out = as_polygons(simplify_rings(outline_rings(components, tile), epsilon), components, spacing)
    return out if single_points else out.where("type = 'polygon'")
