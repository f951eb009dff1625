"""Sharding by balanced label propagation.

Documents with equal texts are linked. A group of linked documents is a clique of like members, so its state is one row for each shard
that holds some of them. Every document starts in a shard drawn by hash. In each turn a join gives every group its counts by shard and the
room that shards have; the members in its smaller places move to its largest ones (one, or as many as the group needs at
the capacity), as far as each shard's quota allows, larger moves first. Links that stay cut are those of groups that no shard can hold.

Documents without a partner have no edges; they fill the shards up to even sizes: the large ones (a bounded number) one by one to the
emptiest shard, all others along one line of bytes that is cut where a shard is full. The law is ``bytes``: sizes near equal.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from tilespark.functions.storage import discard, materialize


def _loads(pieces: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for row in pieces.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load")).collect():  # a row a shard
        out[row["shard"]] = row["load"]
    return out


def _table(spark, rows: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _quotas(moves: DataFrame, room: list[int]) -> list[int]:
    """What each shard may take in: its room and what leaves it in the same turn, when all shards let in the same share of each demand."""
    ways = [(r["shard"], r["to"], r["demand"]) for r in moves.groupBy("shard", "to").agg(F.sum(F.col("n") * F.col("size")).alias("demand")).collect()]  # a row a pair of shards
    share, wanted = [1.0] * len(room), [0] * len(room)
    for _, to, demand in ways:
        wanted[to] += demand
    for _ in range(200):
        free = list(room)
        for shard, to, demand in ways:
            free[shard] += demand * share[to]
        now = [min(share[i], max(0.0, free[i]) / wanted[i]) if wanted[i] else 0.0 for i in range(len(room))]
        if max(a - b for a, b in zip(share, now)) < 1e-6:
            break
        share = now
    return [int(share[i] * wanted[i]) for i in range(len(room))]


def _accepted(moves: DataFrame, room: list[int], cell: int, largest: bool = True) -> DataFrame:
    """``moves(grp, size, shard, to, n)`` with ``go``: the members that the quota ``room`` of ``to`` lets in, larger (or smaller) moves first.

    A shard's quota is dealt to cells of about ``cell`` moves in the measure of their demand, so that no task orders all of a shard's moves.
    """
    spark = moves.sparkSession
    asked = moves.groupBy("to").agg(F.count("*").alias("rows")).collect()  # a row a shard
    cells = _table(spark, [(r["to"], max(1, -(-r["rows"] // cell))) for r in asked], "to int, cells long")
    dealt = moves.join(cells, "to").withColumn("cell", F.pmod(F.xxhash64("grp"), F.col("cells")))
    room_of = _table(spark, [(i, max(0, x)) for i, x in enumerate(room)], "to int, room long")
    demand = dealt.groupBy("to", "cell").agg(F.sum(F.col("n") * F.col("size")).alias("cell_demand"))
    whole = demand.groupBy("to").agg(F.sum("cell_demand").alias("demand"))
    quota = demand.join(whole, "to").join(room_of, "to").select(
        "to", "cell", F.floor(F.least(F.col("room") / F.col("demand"), F.lit(1.0)) * F.col("cell_demand")).cast("long").alias("quota"))
    weight = F.col("n") * F.col("size")
    order = Window.partitionBy("to", "cell").orderBy(weight.desc() if largest else weight.asc(), "grp", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    left = dealt.join(quota, ["to", "cell"]).withColumn("left", F.col("quota") - before)
    return left.withColumn("go", F.when(F.col("left") > 0, F.least("n", F.expr("left div size"))).otherwise(F.lit(0)).cast("long"))


def propagate(pieces: DataFrame, shards: int, capacity: int, turns: int = 12, cell: int = 100_000) -> DataFrame:
    """``pieces(grp, size, shard, n)``: how many members of a group are where -> the same after the moves; ``size`` is that of one member."""
    cur = materialize(pieces, "pieces")
    for turn in range(turns):
        loads = _loads(cur, shards)
        room = [capacity - x for x in loads]
        by_group = Window.partitionBy("grp")  # at most one row a shard in a group
        free = _table(cur.sparkSession, [(i, x) for i, x in enumerate(room)], "shard int, room long")
        ranked = cur.join(free, "shard").withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("n"), F.xxhash64("grp", "shard"))))
        need = F.ceil(F.sum(F.col("n") * F.col("size")).over(by_group) / F.lit(capacity))
        # a group that met full shards tries its next place in every second turn
        open_ = ((F.col("room") >= F.col("size")) | F.lit(turn % 2 == 0)).cast("int")
        goals = F.collect_list(F.when((F.col("open") == 1) & (F.col("place") <= F.col("need")), F.struct("rank", "shard"))).over(by_group)
        ranked = ranked.withColumn("need", F.greatest(need, F.lit(1))).withColumn("open", open_)
        ranked = ranked.withColumn("place", F.row_number().over(by_group.orderBy(F.desc("open"), "rank"))).withColumn("goals", goals)
        # a piece may move to a place of higher rank only, so that no two pieces change places for ever
        ahead = F.filter("goals", lambda g: g["rank"] < F.col("rank"))
        moves = ranked.withColumn("ahead", ahead).where("size(ahead) > 0").select(
            "grp", "size", "shard", "n", F.expr("ahead[cast(pmod(rank, size(ahead)) as int)].shard").alias("to"))
        moves = materialize(moves, "moves")
        moves = materialize(_accepted(moves, _quotas(moves, room), cell).where("go > 0").select("grp", "size", "shard", "to", "go"), "moves")
        if not moves.take(1):
            if turn % 2:
                break
            continue
        changed = cur.unionByName(moves.select("grp", "size", "shard", (-F.col("go")).alias("n"))).unionByName(
            moves.select("grp", "size", F.col("to").alias("shard"), F.col("go").alias("n")))
        nxt = materialize(changed.groupBy("grp", "size", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "pieces")
        discard(cur)
        cur = nxt
    return cur


def shed(pieces: DataFrame, shards: int, capacity: int, cell: int = 100_000) -> DataFrame:
    """Takes members of the smallest pieces out of the shards that are over the capacity; they are placed like documents without partners."""
    over = [max(0, x - capacity) for x in _loads(pieces, shards)]
    if not any(over):
        return pieces
    full = pieces.where(F.col("shard").isin([i for i, x in enumerate(over) if x])).select("grp", "size", "shard", F.col("shard").alias("to"), "n")
    gone = _accepted(full, over, cell, largest=False).select("grp", "shard", "go")
    return pieces.join(gone, ["grp", "shard"], "left").select("grp", "size", "shard", (F.col("n") - F.coalesce("go", F.lit(0))).alias("n")).where("n > 0")


def _level(loads: list[int], more: int) -> list[int]:
    """How much each shard gets when ``more`` is poured in and the lowest are filled to one level first."""
    order = sorted(range(len(loads)), key=loads.__getitem__)
    level, used = loads[order[0]], 1
    while used < len(order) and more > (loads[order[used]] - level) * used:
        more -= (loads[order[used]] - level) * used
        level, used = loads[order[used]], used + 1
    share, rest = divmod(more, used)
    got = [0] * len(loads)
    for at, i in enumerate(order[:used]):
        got[i] = level - loads[i] + share + (1 if at < rest else 0)
    return got


def _running(stored: DataFrame, value: str, name: str) -> DataFrame:
    """``stored`` with the sum of ``value`` over all earlier rows in the order of ``_row`` (a monotonically increasing id): sums by task, then inside tasks."""
    part = stored.withColumn("_task", F.shiftright("_row", 33))
    sums = part.groupBy("_task").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn(name, own).join(sums.select("_task", before.alias("_before")), "_task").withColumn(name, F.col(name) + F.col("_before")).drop("_task", "_before")


def assign(docs: DataFrame, shards: int = 40, turns: int = 12, fine: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` -> a row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``grp`` (the group's digest).

    ``size`` is the text's UTF-8 bytes plus 16; null and empty texts are equal. Rows that repeat a doc_id are documents of their own. Documents of over a
    ``fine``-th of a shard's mean go one by one through the driver, at most ``fine * shards`` of them.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("grp"))
    # equal texts stand together, dealt by ranges: a group of any size is spread over tasks
    tie = F.xxhash64("doc_id", "text_crc32")
    ordered = slim.withColumn("tie", tie).repartitionByRange("grp", "tie").sortWithinPartitions("grp", "tie").drop("tie")
    base = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()), "sized")
    total = base.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, -(-total // shards))
    placed = _running(base.withColumn("one", F.lit(1)), "one", "pos").drop("one")
    start = F.pmod(F.xxhash64("grp", "pos"), F.lit(shards)).cast("int")
    placed = materialize(placed.withColumn("start", start), "numbered")
    groups = placed.groupBy("grp").agg(F.count("*").alias("members"), F.min("pos").alias("first")).where("members > 1")
    groups = materialize(groups, "groups")
    linked = placed.select("grp", "size", "start").groupBy("grp", "size", "start").agg(F.count("*").alias("n")).join(groups.select("grp"), "grp", "left_semi")
    pieces = propagate(linked.select("grp", "size", F.col("start").alias("shard"), "n"), shards, capacity, turns)
    pieces = materialize(shed(pieces, shards, capacity), "pieces")
    # members of a group are dealt in their order: so many to its first shard, so many to the next
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("shard"))
    runs = pieces.withColumn("upto", upto).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("runs"))
    known = placed.join(groups.select("grp", "first").join(runs, "grp"), "grp", "left")
    at = F.get(F.filter("runs", lambda x: x["upto"] > F.col("pos") - F.col("first")), F.lit(0))["shard"]
    known = materialize(known.select("_row", "doc_id", "size", "text_crc32", "grp", at.alias("linked")), "linked")
    return _slots(_filled(known, shards, capacity, fine), shards)


def _filled(known: DataFrame, shards: int, capacity: int, fine: int) -> DataFrame:
    """Gives the rows without a shard in ``linked`` one, so that sizes come out even."""
    spark = known.sparkSession
    loads = [0] * shards
    for row in known.where("linked is not null").groupBy("linked").agg(F.sum("size").alias("s")).collect():  # a row a shard
        loads[row["linked"]] = row["s"]
    limit = capacity // fine
    loose = known.where("linked is null")
    large = sorted(loose.where(F.col("size") > limit).select("_row", "size").collect(), key=lambda r: (-r["size"], r["_row"]))  # at most fine * shards rows
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    chosen = []
    for row in large:
        load, i = heapq.heappop(heap)
        chosen.append((row["_row"], i))
        heapq.heappush(heap, (load + row["size"], i))
        loads[i] = load + row["size"]
    small = loose.where(F.col("size") <= limit)
    more = small.agg(F.sum("size")).first()[0] or 0
    bounds, line = [], 0
    for got in _level(loads, more):
        line += got
        bounds.append(line)
    cut = F.array(*[F.lit(b).cast("long") for b in bounds[:-1]])
    middle = F.col("line") + F.expr("size div 2")  # a document belongs where its middle lies
    on_line = _running(small, "size", "line").select("_row", "doc_id", "size", "text_crc32", "grp", F.size(F.filter(cut, lambda b: b <= middle)).alias("shard"))
    big = loose.where(F.col("size") > limit).join(_table(spark, chosen, "_row long, shard int"), "_row")
    cols = ["_row", "doc_id", "size", "text_crc32", "grp", "shard"]
    return known.where("linked is not null").withColumnRenamed("linked", "shard").select(cols).unionByName(big.select(cols)).unionByName(on_line.select(cols))


def _slots(placed: DataFrame, shards: int) -> DataFrame:
    """Numbers the documents of each shard without a gap; a shard's rows are spread over tasks."""
    dealt = placed.repartitionByRange("shard", "_row").sortWithinPartitions("shard", "_row")
    stored = materialize(dealt.withColumn("_task", F.spark_partition_id()), "sharded")
    counts = stored.groupBy("_task", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_task", "shard").orderBy("_row")) - 1
    slotted = stored.withColumn("slot", own).join(counts.select("_task", "shard", before.alias("before")), ["_task", "shard"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "grp")
