"""Cell binning and addressing as Column expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import LayerSpec, TreeSpec


def nearest(q: Column) -> Column:
    """Round to nearest, halves away from zero, for any finite q.

    ``floor(q + 0.5)`` is wrong just below a half, and ``F.round`` goes through BigDecimal.
    """
    a = F.abs(q)
    n = F.floor(a) + F.when(a - F.floor(a) >= 0.5, 1).otherwise(0)
    return F.when(q < 0, -n).otherwise(n).cast("int")


def cell_index(c: Column, low: float, size: float) -> Column:
    """The nearest node's index. The offset is multiplied by the reciprocal of the size, not divided by
    it: the two differ by an ulp, which decides points exactly between two nodes."""
    return nearest((c - F.lit(low)) * F.lit(1.0 / size))


def in_box(spec: TreeSpec) -> Column:
    """Half-open domain test on plain columns, so it reaches the Parquet scan. Null and NaN fail."""
    cond = F.lit(True)
    for c, lo, hi in zip(spec.position_cols, spec.low, spec.high):
        cond = cond & (F.col(c) >= F.lit(lo)) & (F.col(c) < F.lit(hi))
    return cond


def with_cells(df: DataFrame, spec: TreeSpec, layer: LayerSpec, names: tuple[str, str, str] = ("i", "j", "k")) -> DataFrame:
    return df.withColumns({n: cell_index(F.col(c), lo, s) for n, c, lo, s in zip(names, spec.position_cols, spec.low, layer.cell_size)})


def tile_and_local(df: DataFrame, cpt: int) -> DataFrame:
    """Adds the tile (ti,tj,tk) and the place inside it (li,lj,lk)."""
    return df.withColumns(
        {f"t{c}": F.floor(F.col(c) / cpt).cast("int") for c in "ijk"} | {f"l{c}": F.pmod(F.col(c), F.lit(cpt)).cast("int") for c in "ijk"}
    )


def packed_key(layer: LayerSpec) -> Column:
    """One long for (i,j,k): row-major over the inclusive index range 0..cells_per_dim."""
    n = layer.cells_per_dim + 1
    return (F.col("i").cast("long") * n + F.col("j")) * n + F.col("k")


def packed_address(layer: LayerSpec) -> Column:
    """(tile id << bits) | local id, both row-major; the tile side must be a power of two."""
    cpt, t = layer.cell_per_tile_dim, layer.tiles_per_dim + 1
    if cpt & (cpt - 1):
        raise ValueError("a packed address needs a power of two cells per tile side")
    bits = 3 * (cpt.bit_length() - 1)
    tile = (F.col("ti").cast("long") * t + F.col("tj")) * t + F.col("tk")
    local = (F.col("li") * cpt + F.col("lj")) * cpt + F.col("lk")
    return F.shiftleft(tile, bits).bitwiseOR(local.cast("long"))


def stencil_tiles(points: DataFrame, spec: TreeSpec, layer: LayerSpec) -> DataFrame:
    """Distinct tiles touched by the 3x3x3 stencil of nodes around each point in the domain."""
    base = with_cells(points.where(in_box(spec)), spec, layer).select("i", "j", "k").distinct()
    cpt = layer.cell_per_tile_dim

    def axis(c: str) -> Column:  # truncating division, so that node -1 falls in tile 0
        return F.array_distinct(F.transform(F.array(*[F.lit(o) for o in (-1, 0, 1)]), lambda o: ((F.col(c) + o) / cpt).cast("int")))

    return (
        base.select(F.explode(axis("i")).alias("ti"), "j", "k")
        .select("ti", F.explode(axis("j")).alias("tj"), "k")
        .select("ti", "tj", F.explode(axis("k")).alias("tk"))
        .distinct()
    )
