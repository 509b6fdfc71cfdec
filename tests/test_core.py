import math

import pytest
from pyspark.sql import functions as F

from cellforge.functions import binning as B
from cellforge.operators import interaction, ownership, upward
from cellforge.plans.spec import TreeSpec
from cellforge.sources import generators, tables, view

CUBE = TreeSpec((-1.5,) * 3, (1.5,) * 3, leaf_tiles=4)


def test_ladder_and_validation():
    assert [t for _, t, _ in TreeSpec((0,) * 3, (1,) * 3, 32, 4).ladder()] == [32, 8, 2, 1]
    assert TreeSpec((0,) * 3, (1,) * 3, 1).num_layers == 1
    for bad in ({"reduction": 1}, {"root_tiles": 0}, {"leaf_tiles": 0}):
        with pytest.raises(ValueError):
            TreeSpec(**({"low": (0,) * 3, "high": (1,) * 3, "leaf_tiles": 4} | bad))
    with pytest.raises(ValueError):
        TreeSpec((0, 0, 0), (1, 0, 1), 4)
    with pytest.raises(IndexError):
        CUBE.layer(-1)


def test_nearest(spark):
    vals = [0.5, 2.5, 0.49999999999999994, 1.5, 0.0, 3.4999, -0.5, -2.5, -0.4]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "q double").select(B.nearest(F.col("q"))).collect()]
    assert got == [1, 3, 0, 2, 0, 3, -1, -3, 0]


def test_edges(spark):
    nan, rows = math.nan, [(-1.5, -1.5, -1.5), (1.5, 0.0, 0.0), (1.499999, 0.0, 0.0), (0.0, math.nan, 0.0), (None, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = {(r.i, r.j, r.k): r.n for r in upward.populate(df.where(B.in_box(CUBE)), CUBE, CUBE.layers[0], upward.mean_position(CUBE)).collect()}
    assert got == {(0, 0, 0): 1, (16, 8, 8): 1, (8, 8, 8): 2}
    assert [r[0] for r in df.select(ownership.owner(CUBE, CUBE.layers[0], (1, 1, 1))).collect()] == [0, -1, 0, -1, -1, 0, 0]
    assert upward.aggregate_up(df.limit(0).withColumn("v", F.lit(1)), CUBE).count() == 0


@pytest.mark.parametrize("ranks", [(1, 1, 1), (2, 1, 1), (2, 2, 1), (2, 2, 2), (4, 2, 2)])
def test_two_points_per_rank(spark, ranks):
    n = ranks[0] * ranks[1] * ranks[2]
    spec = TreeSpec((-1.5,) * 3, (1.5,) * 3, leaf_tiles=4 * n, reduction=max(2, n // 2))
    assert spec.num_layers >= 3
    cells = [c.collect() for c in upward.aggregate_layers(generators.pair_per_rank(spark, spec, ranks), spec, ranks=ranks)]
    assert sorted((r["rank"], r.v) for r in cells[0]) == sorted((r, r) for r in range(n) for _ in range(2))
    merged = [c for c in cells if sorted((r["rank"], r.v) for r in c) == [(r, 2 * r) for r in range(n)]]
    assert merged
    assert len({r["rank"] for r in cells[-1]}) == 1
    assert sum(r.v for r in cells[-1]) == n * (n - 1)


def test_mean_of_means(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0, 1)] * 3 + [(0.2, 0.2, 0.2, 1)], "x double, y double, z double, v int")
    top = upward.aggregate_layers(p, CUBE)[-1].collect()
    assert len(top) == 1 and abs(top[0].x - 0.1) < 1e-12 and top[0].v == 4


def test_closure():
    with pytest.raises(ValueError):
        upward.populate(None, CUBE, CUBE.layers[0], {"x": F.avg("x")})
    with pytest.raises(ValueError):
        upward.aggregate_with(None, CUBE, CUBE.layers[0], None, "x double, v long")


def test_every_leaf_pair_covered_once(spark):
    sf = "/root/testdata/sf0.001"
    spec, pts = tables.EMBEDDINGS, tables.embedding_points(spark, "/root/testdata/sf0.001").limit(120)
    up = upward.with_parent(upward.aggregate_up(pts, spec), spec).collect()
    par = {(r.layer, r.i, r.j, r.k): (r.pi, r.pj, r.pk) for r in up}
    ilist = {(r.layer, (r.i, r.j, r.k), (r.i_b, r.j_b, r.k_b)) for r in interaction.interaction_list(upward.aggregate_up(pts, spec), spec).collect()}
    leaf = [k[1:] for k in par if k[0] == 0]
    for a in leaf:
        for b in leaf:
            if a < b:
                near, hits, x, y = max(abs(p - q) for p, q in zip(a, b)) <= 1, 0, a, b
                for n in range(spec.num_layers):
                    hits += (n, x, y) in ilist
                    x, y = par[(n, *x)], par[(n, *y)]
                assert hits + near == 1


def test_partitions():
    assert ownership.uniform_partition(1, 2) == [0, 0, 1]
    assert ownership.average_partition(7, 3) == [0, 2, 4, 7]
    assert ownership.static_partition(9, 2) == [0, 1, 9]
    with pytest.raises(ValueError):
        ownership.static_partition(9, 3)
    p = ownership.random_partition(20, 4, 3)
    assert p == sorted(set(p)) and p[0] == 0 and p[-1] == 20


def test_view_errors():
    import numpy as np

    with pytest.raises(ValueError):
        view.decode(view.encode(np.zeros((2, 2, 3))), 2)
    with pytest.raises(ValueError):
        view.decode(b"", 3)
    assert view.parse_name(view.file_name(3, 4, 16, False, "z"))["rank"] == 3


def test_stream_matches_batch(spark, tmp_path):
    from cellforge.streaming import leaf

    pts = tables.lineitem_points(spark, "/root/testdata/sf0.001")
    pts.write.parquet(f"{tmp_path}/in")
    s = leaf.leaf_stream(spark.readStream.schema(pts.schema).parquet(f"{tmp_path}/in"), tables.LINEITEM)
    got, seen = {}, {}
    sink = leaf.ladder_sink(tables.LINEITEM, lambda e, n, c: seen.__setitem__(n, c.count()))
    q = s.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    want = [c.count() for c in upward.aggregate_layers(pts, tables.LINEITEM)]
    assert [seen[n] for n in sorted(seen)] == want


@pytest.mark.parametrize("cpt,reduction", [(4, 2), (2, 3), (8, 4)])
def test_sums_are_conserved_and_means_stay_in_their_cells(spark, cpt, reduction):
    pts = tables.embedding_points(spark, "/root/testdata/sf0.001")
    spec = TreeSpec(tables.EMBEDDINGS.low, tables.EMBEDDINGS.high, 16, reduction, cell_per_tile_dim=cpt)
    want = pts.where(B.in_box(spec)).agg(F.sum("v")).first()[0]
    rows = 1 << 60
    for layer, cells in zip(spec.layers, upward.aggregate_layers(pts, spec)):
        got = cells.collect()
        assert sum(r.v for r in got) == want and len(got) <= rows
        rows = len(got)
        for r in got:
            for c, idx, lo, h in zip("xyz", (r.i, r.j, r.k), spec.low, layer.cell_size):
                assert abs(r[c] - (lo + idx * h)) <= h / 2 + 1e-12 and 0 <= idx <= layer.cells_per_dim


def test_points_are_scanned_once(spark, capsys):
    df = upward.aggregate_up(tables.lineitem_points(spark, "/root/testdata/sf0.001"), tables.LINEITEM).select("layer", "i", "j", "k", "v", "n")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange") >= 4


def test_overlapping_boxes(spark):
    boxes = spark.createDataFrame([(3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 0.5, 0.5, 0.5, 2.0, 2.0, 2.0)], "rank int, x_lo double, y_lo double, z_lo double, x_hi double, y_hi double, z_hi double")
    pts = spark.createDataFrame([(0.1,) * 3, (0.6,) * 3, (1.0,) * 3, (5.0,) * 3, (None,) * 3], "x double, y double, z double")
    assert [r["rank"] for r in ownership.owner_by_boxes(pts, boxes).collect()] == [3, 1, 1, -1, -1]


def test_half_cells_follow_the_reciprocal(spark):
    spec, n = tables.LINEITEM, 0
    for layer in spec.layers:
        for lo, h in zip(spec.low, layer.cell_size):
            pts = [lo + (k + 0.5) * h for k in range(layer.cells_per_dim)]
            got = [r[0] for r in spark.createDataFrame([(p,) for p in pts], "p double").select(B.cell_index(F.col("p"), lo, h)).collect()]
            q = [(p - lo) * (1.0 / h) for p in pts]
            assert got == [math.floor(v) + (v - math.floor(v) >= 0.5) for v in q]
