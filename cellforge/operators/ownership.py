"""Rectilinear partitions of the tile grid, domain boxes, ownership and load balance."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import in_box, with_cells
from ..plans.spec import LayerSpec, TreeSpec

Partition = tuple[list[int], list[int], list[int]]


def uniform_partition(tiles: int, parts: int) -> list[int]:
    """Boundaries (i * tiles) // parts; with fewer tiles than parts some ranges are empty."""
    return [(i * tiles) // parts for i in range(parts + 1)]


def average_partition(tiles: int, parts: int) -> list[int]:
    """Equal floor-sized ranges, the remainder in the last."""
    return [i * (tiles // parts) for i in range(parts)] + [tiles]


def static_partition(tiles: int, parts: int) -> list[int]:
    """{0, 1, tiles}; defined for at most two parts."""
    if parts > 2 or (parts == 2 and tiles < 2):
        raise ValueError("a static partition has at most two parts and needs a tile for each")
    return [0, 1, tiles] if parts == 2 else [0, tiles]


def random_partition(tiles: int, parts: int, seed: int) -> list[int]:
    """Distinct sorted boundaries: the inner tiles whose md5 of "seed|tile" come first, so that any engine can draw them."""
    if parts > tiles:
        raise ValueError("more parts than tiles")
    order = sorted(range(1, tiles), key=lambda t: hashlib.md5(f"{seed}|{t}".encode()).hexdigest())
    return [0, *sorted(order[: parts - 1]), tiles]


def layer_partition(layer: LayerSpec, ranks: tuple[int, int, int], partition: Partition | None = None) -> Partition:
    p = partition or tuple(uniform_partition(layer.tiles_per_dim, n) for n in ranks)
    for b, n in zip(p, ranks):
        if len(b) != n + 1 or b[0] != 0 or sorted(b) != list(b):
            raise ValueError(f"{b} is not a partition into {n} ranges")
    return p


def axis_bounds(spec: TreeSpec, layer: LayerSpec, ranks, partition: Partition | None = None) -> list[list[tuple[float, float]]]:
    out = []
    for d, b in enumerate(layer_partition(layer, ranks, partition)):
        width = (spec.high[d] - spec.low[d]) / b[-1]
        out.append([(spec.low[d] + s * width, spec.low[d] + e * width) for s, e in zip(b, b[1:])])
    return out


def rank_of(cx: int, cy: int, cz: int, ranks: tuple[int, int, int]) -> int:
    return (cx * ranks[1] + cy) * ranks[2] + cz


def domains(spark: SparkSession, spec: TreeSpec, layer: LayerSpec, ranks, partition: Partition | None = None) -> DataFrame:
    """One half-open box for each rank: as many rows as ranks, whatever the data."""
    bx, by, bz = axis_bounds(spec, layer, ranks, partition)
    rows = [
        (rank_of(a, b, c, ranks), x[0], y[0], z[0], x[1], y[1], z[1])
        for a, x in enumerate(bx)
        for b, y in enumerate(by)
        for c, z in enumerate(bz)
    ]
    return spark.createDataFrame(rows, "rank int, x_lo double, y_lo double, z_lo double, x_hi double, y_hi double, z_hi double")


def owner(spec: TreeSpec, layer: LayerSpec, ranks, partition: Partition | None = None) -> Column:
    """The owning rank, -1 outside every box.

    The boxes are the product of three axis partitions, so the range join is three CASE lookups:
    no join, no shuffle, no broadcast.
    """
    coords = []
    for c, bounds in zip(spec.position_cols, axis_bounds(spec, layer, ranks, partition)):
        case = F.lit(None).cast("int")
        for n, (lo, hi) in reversed(list(enumerate(bounds))):
            case = F.when((F.col(c) >= F.lit(lo)) & (F.col(c) < F.lit(hi)), F.lit(n)).otherwise(case)
        coords.append(case)
    return F.coalesce((coords[0] * ranks[1] + coords[1]) * ranks[2] + coords[2], F.lit(-1)).cast("int")


def owner_by_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The same against arbitrary boxes (a row for each rank), which may overlap: the least rank that holds the point.

    The boxes' number is the number of ranks, a parameter; they become one array literal that each row
    is tested against, so nothing is joined or shuffled.
    """

    def inside(b: Column) -> Column:
        return reduce(Column.__and__, [(F.col(c) >= b[f"{c}_lo"]) & (F.col(c) < b[f"{c}_hi"]) for c in "xyz"])

    rows = [F.struct(*[F.lit(r[f]).cast(boxes.schema[f].dataType).alias(f) for f in boxes.columns]) for r in boxes.collect()]
    if not rows:
        return points.withColumn("rank", F.lit(-1))
    hits = F.transform(F.filter(F.array(*rows), inside), lambda b: b["rank"])
    return points.withColumn("rank", F.coalesce(F.array_min(hits), F.lit(-1)))


def migrate(points: DataFrame, spec: TreeSpec, layer: LayerSpec, ranks, partition: Partition | None = None) -> DataFrame:
    """Owned points with their rank. A later group-by shuffles anyway, so nothing is moved here."""
    return points.withColumn("rank", owner(spec, layer, ranks, partition)).where("rank >= 0")


def balanced_partition(points: DataFrame, spec: TreeSpec, layer: LayerSpec, ranks) -> DataFrame:
    """Workload quantiles: (axis, part, start_tile, end_tile), from tile histograms of all axes in one pass.

    A histogram has at most tiles_per_dim + 1 rows an axis, so the running sums are over that many.
    """
    cells = with_cells(points.where(in_box(spec)), spec, layer)
    tile = lambda c: F.least(F.floor(F.col(c) / layer.cell_per_tile_dim), F.lit(layer.tiles_per_dim - 1)).cast("int")
    axes = F.array(*[F.struct(F.lit(d).alias("axis"), tile(c).alias("tile")) for d, c in enumerate("ijk")])
    hist = cells.select(F.explode(axes).alias("s")).groupBy("s.axis", "s.tile").agg(F.count("*").alias("n"))
    cum = hist.withColumns({"cum": F.sum("n").over(Window.partitionBy("axis").orderBy("tile")), "total": F.sum("n").over(Window.partitionBy("axis"))})
    edges = cells.sparkSession.createDataFrame([(d, n, p) for d, n in enumerate(ranks) for p in range(n + 1)], "axis int, parts int, part int")
    reached = F.min(F.when(F.col("cum") * F.col("parts") >= F.col("total") * F.col("part"), F.col("tile") + 1))
    at = F.when(F.col("part") == 0, 0).when(F.col("part") == F.col("parts"), layer.tiles_per_dim).otherwise(F.coalesce(F.col("edge"), F.lit(layer.tiles_per_dim)))
    found = edges.join(cum, "axis", "left").groupBy("axis", "parts", "part").agg(reached.alias("edge")).withColumn("at", at.cast("int"))
    ahead = F.lead("at").over(Window.partitionBy("axis").orderBy("part"))
    return found.withColumn("end_tile", ahead).where("part < parts").select("axis", "part", F.col("at").alias("start_tile"), "end_tile")
