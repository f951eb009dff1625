"""Queries of source rounds and of the replay buffer with errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.operators import sampling, telemetry
from tilespark.plans.registry import query
from tilespark.sources.fixtures import table

CATEGORIES, LABELS, POOL, SEED = [("c0", 0.5), ("c1", 0.3), ("c2", 0.2)], [("l0", 0.4), ("l1", 0.3), ("l2", 0.2), ("l3", 0.1)], 200, 7


def _values(pairs) -> str:
    return ", ".join(f"('{k}', {x}::DOUBLE)" for k, x in pairs)


@query("source_round", f"""WITH RECURSIVE s AS (SELECT doc_id AS id, 'c' || (doc_id % 3) AS category, unnest(list_distinct(['l' || (doc_id % 4), 'l' || ((doc_id // 7) % 4)])) AS label FROM documents),
  one AS (SELECT DISTINCT id, category FROM s), tot AS (SELECT least({POOL}, count(*)) AS n FROM one),
  ca AS (SELECT category, CAST(round_even(ratio * n, 0) AS BIGINT) AS part FROM (VALUES {_values(CATEGORIES)}) c(category, ratio), tot),
  la AS (SELECT category, label, CAST(round_even(ratio * part, 0) AS BIGINT) AS share, row_number() OVER (PARTITION BY category ORDER BY substr(md5('{SEED}|' || category || '|' || label), 1, 8), label) AS turn
    FROM ca, (VALUES {_values(LABELS)}) l(label, ratio)),
  li AS (SELECT category, label, list(id ORDER BY substr(md5('{SEED}|' || category || '|' || label || '|' || id), 1, 8), id) AS ids FROM s GROUP BY 1, 2),
  fo AS (SELECT category, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS now, '' AS step FROM ca
    UNION ALL SELECT category, turn, list_concat(taken, now), now, step FROM (
      SELECT f.category, la.turn, f.taken, list_slice(list_filter(li.ids, lambda x: NOT list_contains(f.taken, x)), 1, la.share) AS now, la.label AS step
      FROM fo f JOIN la ON la.category = f.category AND la.turn = f.turn + 1 JOIN li ON li.category = la.category AND li.label = la.label)),
  pick AS (SELECT unnest(now) AS id, category, step FROM fo),
  fill AS (SELECT id, category, 'fill' AS step FROM (SELECT o.id, o.category, part - (SELECT count(*) FROM pick p WHERE p.category = o.category) AS room, row_number() OVER (PARTITION BY o.category ORDER BY substr(md5('{SEED}|fill|' || o.category || '|' || o.id), 1, 8), o.id) AS k
    FROM one o JOIN ca USING (category) ANTI JOIN pick p ON p.id = o.id) WHERE k <= room),
  cho AS (SELECT * FROM pick UNION ALL SELECT * FROM fill),
  top AS (SELECT o.id, o.category, 'top-up' AS step, row_number() OVER (ORDER BY substr(md5('{SEED}|top-up|' || o.category || '|' || o.id), 1, 8), o.category, o.id) AS k FROM one o ANTI JOIN cho ON cho.id = o.id)
  SELECT * FROM cho UNION ALL SELECT id, category, step FROM top, tot WHERE k <= n - (SELECT count(*) FROM cho)""")
def source_round(spark, sf):
    """A round of 200 sources by category and label, filled up and topped up."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("category"), F.explode(F.array_distinct(F.array(
        F.concat(F.lit("l"), F.col("doc_id") % 4), F.concat(F.lit("l"), F.expr("(doc_id div 7) % 4"))))).alias("label"))
    return sampling.source_round(d, spark.createDataFrame(CATEGORIES, "category string, ratio double"), spark.createDataFrame(LABELS, "label string, ratio double"), POOL, SEED)


_BUFFER = "b AS (SELECT event_id AS slot, CAST(1 AS DOUBLE) AS error, value FROM events), u AS (SELECT event_id AS slot, CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS error FROM events WHERE event_type <> 'view')"


def _buffer(spark, sf):
    e = table(spark, sf, "events")
    start = e.select(F.col("event_id").alias("slot"), F.lit(1.0).alias("error"), "value")
    return telemetry.update_errors(start, e.where("event_type <> 'view'").select(F.col("event_id").alias("slot"), ((F.col("event_id") * 37 % 101).cast("double") / 100).alias("error")))


_UPDATED = _BUFFER + ", n AS (SELECT slot, coalesce(u.error, b.error) AS error, value FROM b LEFT JOIN u USING (slot))"
_ORDERED = _UPDATED + ", o AS (SELECT *, CAST(row_number() OVER (ORDER BY error >= 0.4, substr(md5('11|' || slot), 1, 8), slot) AS INTEGER) AS position FROM n)"


@query("buffer_update", f"WITH {_UPDATED} SELECT * FROM n")
def buffer_update(spark, sf):
    """A buffer with a slot an event after its errors were renewed."""
    return _buffer(spark, sf)


@query("buffer_write_order", f"WITH {_ORDERED} SELECT slot, error, position FROM o")
def buffer_write_order(spark, sf):
    """Slots in the order of overwriting: easy ones first, each kind shuffled."""
    return telemetry.write_order(_buffer(spark, sf), 0.4, 11).select("slot", "error", "position")


@query("buffer_push", f"""WITH {_ORDERED}, p AS (SELECT event_id AS seq, -value AS value FROM events WHERE event_type = 'click'), w AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS at FROM p)
  SELECT o.slot, CASE WHEN w.at IS NULL THEN o.error ELSE 1 END AS error, CASE WHEN w.at IS NULL THEN o.value ELSE w.value END AS value FROM o LEFT JOIN w ON o.position = w.at + 1""")
def buffer_push(spark, sf):
    """The clicks overwrite the easiest slots; new entries have error 1."""
    from tilespark.functions.ordering import numbered

    buffer = _buffer(spark, sf)
    clicks = numbered(table(spark, sf, "events").where("event_type = 'click'").select("event_id", (-F.col("value")).alias("value")), "n", "event_id")
    return telemetry.push(buffer, telemetry.write_order(buffer, 0.4, 11), clicks.select((F.col("n") - 1).alias("seq"), "value"))
