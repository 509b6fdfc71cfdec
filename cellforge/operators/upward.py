"""Upward aggregation: leaf cells from points, every coarser layer from the cells below it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import in_box, with_cells
from ..plans.spec import LayerSpec, TreeSpec
from .ownership import owner


def mean_position(spec: TreeSpec) -> dict[str, Column]:
    return {c: F.avg(c) for c in spec.position_cols}


def default_aggs(spec: TreeSpec, sums: tuple[str, ...] = ("v",)) -> dict[str, Column]:
    return mean_position(spec) | {c: F.sum(c) for c in sums}


def populate(rows: DataFrame, spec: TreeSpec, layer: LayerSpec, aggs: dict[str, Column], ranks=None, partition=None, count: str | None = "n") -> DataFrame:
    """One layer: bin the rows to their nearest node and aggregate each occupied cell.

    ``n`` counts rows that enter a cell at this layer: points at the leaf, child cells above.
    """
    missing = set(spec.position_cols) - set(aggs)
    if missing:
        raise ValueError(f"the aggregate must return the position columns; it lacks {sorted(missing)}")
    keys = ["i", "j", "k"]
    if ranks:
        rows = rows.withColumn("rank", owner(spec, layer, ranks, partition)).where("rank >= 0")
        keys = ["rank", *keys]
    extra = [F.count("*").alias(count)] if count else []
    return with_cells(rows, spec, layer).groupBy(*keys).agg(*[e.alias(c) for c, e in aggs.items()], *extra)


def aggregate_layers(points: DataFrame, spec: TreeSpec, aggs: dict[str, Column] | None = None, ranks=None, materialise: bool = False, partitions: dict | None = None) -> list[DataFrame]:
    """A DataFrame for each layer, leaf first. Layer n+1 reads the aggregated rows of layer n.

    Every layer is one partial aggregate, one exchange and one final aggregate. A layer is both a
    result and the next one's input; its columns are all kept through both uses, so that Spark sees
    one exchange and reuses it: the points are scanned once however many layers are read together.
    ``materialise`` cuts the lineage with checkpoint() for tall trees (it needs a checkpoint folder
    all executors share). ``partitions`` has explicit tile boundaries for some layers (with ``ranks``).
    """
    aggs = aggs or default_aggs(spec)
    out, rows = [], points.where(in_box(spec))
    for layer in spec.layers:
        cells = populate(rows, spec, layer, aggs, ranks, (partitions or {}).get(layer.layer))
        # always true, as a cell has a row at least, but it holds the optimizer from pruning differently in each use
        cells = cells.where((F.col("n") > 0) | F.concat(*[F.col(c).cast("string") for c in aggs]).isNull())
        if materialise:
            cells = cells.checkpoint()
        out.append(cells)
        rows = cells.select(*aggs)
    return out


def aggregate_up(points: DataFrame, spec: TreeSpec, aggs: dict[str, Column] | None = None, ranks=None, materialise: bool = False, partitions: dict | None = None) -> DataFrame:
    """All layers in one relation keyed by (layer, [rank,] i, j, k)."""
    parts = aggregate_layers(points, spec, aggs, ranks, materialise, partitions)
    return reduce(DataFrame.unionByName, [p.withColumn("layer", F.lit(n)) for n, p in enumerate(parts)])


def aggregate_with(points: DataFrame, spec: TreeSpec, layer: LayerSpec, fn: Callable, schema: str) -> DataFrame:
    """User aggregate in pandas: ``fn(group) -> one-row frame`` with ``schema``, which must hold the position columns.

    A cell's rows meet in one task here; prefer :func:`populate`, which aggregates before the shuffle.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]
    if not set(spec.position_cols) <= set(names):
        raise ValueError("the result must hold the position columns, so that it can feed the next layer")

    def run(key, pdf):
        res = fn(pdf).iloc[:1].reset_index(drop=True)
        for n, v in zip(("k", "j", "i"), reversed(key)):
            res.insert(0, n, v)
        return res[["i", "j", "k", *names]]

    return with_cells(points.where(in_box(spec)), spec, layer).groupBy("i", "j", "k").applyInPandas(run, f"i int, j int, k int, {schema}")


def with_parent(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """Adds (pi,pj,pk): the cell of the next layer into which the aggregate is binned; 0,0,0 at the root."""
    cols = {}
    for n, c, lo, d in zip(("pi", "pj", "pk"), spec.position_cols, spec.low, range(3)):
        from ..functions.binning import cell_index

        case = F.lit(0)
        for layer in spec.layers[:-1]:
            case = F.when(F.col("layer") == layer.layer, cell_index(F.col(c), lo, spec.layers[layer.layer + 1].cell_size[d])).otherwise(case)
        cols[n] = case
    return cells.withColumns(cols)


def cell_lines(cells: DataFrame, spec: TreeSpec, payload: str = "v") -> DataFrame:
    """(rank, i, j, k, line) for a debug print of a layer's owned cells: "R<rank>: val: <payload>, x/y/z: <position>".

    Show it with ``.orderBy("rank", "i", "j", "k").show(n, False)``: ordered and bounded. A layer
    without cells has no lines.
    """
    rank = F.col("rank") if "rank" in cells.columns else F.lit(0)
    line = F.format_string("R%d: val: %d, x/y/z: %.3f, %.3f, %.3f", rank, payload, *spec.position_cols)
    return cells.select(rank.alias("rank"), "i", "j", "k", line.alias("line"))
