"""Cell-to-cell joins: near lists and interaction lists, as equi-joins on exploded neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import TreeSpec
from .upward import with_parent


def _around(cols: tuple[str, str, str]) -> Column:
    return F.array(
        *[F.struct(*[(F.col(c) + d).alias(f"q{n}") for n, (c, d) in enumerate(zip(cols, (a, b, e)))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for e in (-1, 0, 1)]
    )


def _distance(a: str, b: str) -> Column:
    return F.greatest(*[F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "ijk"])


def _pairs(cells: DataFrame, keys: tuple[str, str, str]) -> DataFrame:
    left = cells.withColumn("_q", F.explode(_around(keys))).select("*", "_q.*").alias("a")
    on = F.col("a.layer") == F.col("b.layer")
    for n, k in enumerate(keys):
        on &= F.col(f"a.q{n}") == F.col(f"b.{k}")
    return left.join(cells.alias("b"), on)


def _ids(a: str, suffix: str) -> list[Column]:
    return [F.col(f"{a}.{c}").alias(f"{c}{suffix}") for c in "ijk"]


def near_list(cells: DataFrame, layer: int = 0) -> DataFrame:
    """Ordered pairs of touching cells of a layer (Chebyshev distance at most 1), a cell with itself included."""
    one = cells.where(F.col("layer") == layer).select("layer", "i", "j", "k")
    return _pairs(one, ("i", "j", "k")).select(F.col("a.layer").alias("layer"), *_ids("a", ""), *_ids("b", "_b"))


def interaction_list(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """Ordered pairs of a layer whose cells do not touch but whose parents do.

    All root cells share one virtual parent, so the same equi-join covers the root, whose cell
    count is bounded by the specification.
    """
    c = with_parent(cells, spec).select("layer", "i", "j", "k", "pi", "pj", "pk")
    return _pairs(c, ("pi", "pj", "pk")).where(_distance("a", "b") > 1).select(F.col("a.layer").alias("layer"), *_ids("a", ""), *_ids("b", "_b"))
