"""Tables of regions look small as files; joins with them are dealt out by key."""

from tilespark.operators import components as cc, inference as inf


def test_regions_are_not_broadcast(spark):
    mask = spark.createDataFrame([(0, r, c) for r in range(4) for c in range(4)], "image_id long, r int, c int")
    for out in (cc.filter_regions(mask, 2.0, tile=2), cc.label_components(mask, True, tile=2), cc.fill_holes(mask, mask, 2.0, tile=2)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan


def test_chain_leaves_out_the_outline(spark):
    scores = spark.createDataFrame([(0, r, c, 1.0) for r in range(3) for c in range(3)], "image_id long, r int, c int, v double")
    assert list(inf.chain(scores, (3, 3), 0.5, outline=False)) == ["prediction", "threshold"]
