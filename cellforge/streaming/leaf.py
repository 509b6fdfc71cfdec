"""Leaf aggregation over a stream. Coarser layers average averages, which no per-batch state can
merge, so they are computed from the leaf table of each trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.binning import in_box
from ..operators.upward import aggregate_layers, default_aggs, populate
from ..plans.spec import TreeSpec


def leaf_stream(points: DataFrame, spec: TreeSpec, sums: tuple[str, ...] = ("v",)) -> DataFrame:
    """Streaming leaf cells; write with outputMode "complete" or "update". State is one row a cell."""
    return populate(points.where(in_box(spec)), spec, spec.layers[0], default_aggs(spec, sums))


def ladder_sink(spec: TreeSpec, write: Callable[[int, int, DataFrame], None], sums: tuple[str, ...] = ("v",)):
    """For ``foreachBatch`` on a complete-mode leaf stream: builds the layers above and hands each to ``write(epoch, layer, cells)``."""

    def run(leaf: DataFrame, epoch: int) -> None:
        write(epoch, 0, leaf)
        rows, aggs = leaf.select(*default_aggs(spec, sums)), default_aggs(spec, sums)
        for layer in spec.layers[1:]:
            cells = populate(rows, spec, layer, aggs)
            write(epoch, layer.layer, cells)
            rows = cells.select(*aggs)

    return run


__all__ = ["aggregate_layers", "ladder_sink", "leaf_stream"]
