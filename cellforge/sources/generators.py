"""Seeded fixtures: particles, tile sequences and the two-points-per-rank test set."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ownership import axis_bounds, rank_of
from ..plans.spec import LayerSpec, TreeSpec


def random_particles(spark: SparkSession, n: int, spec: TreeSpec, layer: LayerSpec, tiles: tuple[tuple[int, int], ...] | None = None, seed: int = 0) -> DataFrame:
    """n uniform points, two cells (and a bit) inside the given tile window on every side.

    A coordinate is 52 bits of the md5 of "seed|axis|number", whatever the partitions: any engine draws
    the same points, a retried task too. With 156 bits a point they are distinct without a shuffle.
    """
    window = tiles or ((0, layer.tiles_per_dim),) * 3
    cpt, cols = layer.cell_per_tile_dim, []
    for d, (a, b) in enumerate(window):
        h = layer.cell_size[d]
        start, size = spec.low[d] + h * (2.01 + cpt * a), h * (cpt * (b - a) - 4.02)
        if size <= 0:
            raise ValueError("the tile window is too small for its margins")
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{d}|"), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10)
        cols.append((F.lit(start) + bits.cast("double") / F.lit(float(2**52)) * F.lit(size)).alias(spec.position_cols[d]))
    return spark.range(n).select(*cols)


def static_particle(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")


def random_tiles(spark: SparkSession, tiles: int, seed: int = 0) -> DataFrame:
    """A seeded permutation of 0..tiles-1 on every axis, zipped: ``tiles`` rows (ti, tj, tk, seq), by the md5 of "seed|axis|tile"."""
    axes = [sorted(range(tiles), key=lambda t, d=d: hashlib.md5(f"{seed}|{d}|{t}".encode()).hexdigest()) for d in range(3)]
    return spark.createDataFrame([(*t, n) for n, t in enumerate(zip(*axes))], "ti int, tj int, tk int, seq int")


def biased_tiles(spark: SparkSession, tiles: int, bias_fraction: float, seed: int | None = None) -> DataFrame:
    """Every tile once, those of the low-corner sub-cube (bias_fraction of each axis, one at least) first.

    ``seq`` is the place in the sequence; with a seed each of the two parts is shuffled, by the md5 of
    "seed|ti|tj|tk". Places are counted in buckets of that key, so that no task orders all tiles.
    """
    side = max(1, int(tiles * bias_fraction))
    t = spark.range(tiles**3).select(
        F.floor(F.col("id") / (tiles * tiles)).cast("int").alias("ti"),
        F.pmod(F.floor(F.col("id") / tiles), F.lit(tiles)).cast("int").alias("tj"),
        F.pmod(F.col("id"), F.lit(tiles)).cast("int").alias("tk"),
    )
    t = t.withColumn("in_corner", (F.col("ti") < side) & (F.col("tj") < side) & (F.col("tk") < side))
    if seed is None:  # closed-form rank, no global window
        pos = (F.col("ti") * tiles + F.col("tj")) * tiles + F.col("tk")
        within = (F.col("ti") * side + F.col("tj")) * side + F.col("tk")
        before = (
            F.least("ti", F.lit(side)) * side * side
            + F.when(F.col("ti") < side, F.least("tj", F.lit(side)) * side + F.when(F.col("tj") < side, F.least("tk", F.lit(side))).otherwise(0)).otherwise(0)
        )
        return t.withColumn("seq", F.when(F.col("in_corner"), within).otherwise(F.lit(side**3) + pos - before).cast("int"))
    t = t.withColumn("_k", F.md5(F.concat_ws("|", F.lit(str(seed)), "ti", "tj", "tk").cast("binary"))).withColumn("_b", F.concat(F.when(F.col("in_corner"), "0").otherwise("1"), F.substring("_k", 1, 2)))
    before = t.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 512 rows
    before = before.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "ti", "tj", "tk")) - 1
    return t.withColumn("_in", within).join(F.broadcast(before), "_b").select("ti", "tj", "tk", "in_corner", (F.col("_before") + F.col("_in")).cast("int").alias("seq"))


def pair_per_rank(spark: SparkSession, spec: TreeSpec, ranks: tuple[int, int, int], shift: float = 1.1) -> DataFrame:
    """For each rank its leaf-domain centre and a second point ``shift`` leaf cells further on every axis; v = rank."""
    leaf, rows = spec.layers[0], []
    bx, by, bz = axis_bounds(spec, leaf, ranks)
    for a, x in enumerate(bx):
        for b, y in enumerate(by):
            for c, z in enumerate(bz):
                r, centre = rank_of(a, b, c, ranks), [(lo + hi) / 2 for lo, hi in (x, y, z)]
                rows.append((*centre, r))
                rows.append((*[p + shift * h for p, h in zip(centre, leaf.cell_size)], r))
    return spark.createDataFrame(rows, "x double, y double, z double, v int")


def points_from_set(spark: SparkSession, points: set) -> DataFrame:
    """A table of distinct triples in order; ``seq`` is their place."""
    return spark.createDataFrame([(*p, n) for n, p in enumerate(sorted(points))], "x double, y double, z double, seq int")
