"""Tree and layer specifications: pure arithmetic on the driver, no Spark job."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Tuning defaults of the workload partitioner (documentation only; AQE does the run-time work).
MAX_WORKLOAD_COEFF = 1.5
REBALANCE_EVERY = 200
MAX_BALANCE_ITERATIONS = 10
HALO_WIDTH = 2


@dataclass(frozen=True)
class LayerSpec:
    layer: int
    tiles_per_dim: int
    cell_per_tile_dim: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def cells_per_dim(self) -> int:
        return self.tiles_per_dim * self.cell_per_tile_dim

    @property
    def cell_size(self) -> tuple[float, float, float]:
        return tuple((h - l) / self.cells_per_dim for l, h in zip(self.low, self.high))


@dataclass(frozen=True)
class TreeSpec:
    """Domain box, leaf resolution and reduction; ``layers[0]`` is the leaf, ``layers[-1]`` the root.

    The ladder divides the tile count by ``reduction`` (rounding down, never below one) while it
    exceeds ``root_tiles``; the root may therefore be smaller than ``root_tiles``.
    """

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    leaf_tiles: int
    reduction: int = 2
    root_tiles: int = 1
    cell_per_tile_dim: int = 4
    position_cols: tuple[str, str, str] = ("x", "y", "z")
    layers: tuple[LayerSpec, ...] = field(init=False)

    def __post_init__(self) -> None:
        if len(self.low) != 3 or len(self.high) != 3:
            raise ValueError("the domain needs three low and three high coordinates")
        if not all(math.isfinite(v) for v in (*self.low, *self.high)) or not all(h > l for l, h in zip(self.low, self.high)):
            raise ValueError("high must exceed low on every axis")
        if self.reduction < 2:
            raise ValueError("reduction must be at least 2")
        if self.root_tiles < 1 or self.leaf_tiles < 1 or self.cell_per_tile_dim < 1:
            raise ValueError("tile and cell counts must be positive")
        object.__setattr__(self, "low", tuple(map(float, self.low)))
        object.__setattr__(self, "high", tuple(map(float, self.high)))
        ladder = [self.leaf_tiles]
        while ladder[-1] > self.root_tiles:
            ladder.append(max(1, ladder[-1] // self.reduction))
        object.__setattr__(
            self,
            "layers",
            tuple(LayerSpec(n, t, self.cell_per_tile_dim, self.low, self.high) for n, t in enumerate(ladder)),
        )

    @property
    def num_layers(self) -> int:
        return len(self.layers)

    def layer(self, n: int) -> LayerSpec:
        if not 0 <= n < len(self.layers):
            raise IndexError(f"layer {n} of {len(self.layers)}")
        return self.layers[n]

    def ladder(self) -> list[tuple[int, int, int]]:
        """(layer, tiles_per_dim, cells_per_dim) of every layer."""
        return [(l.layer, l.tiles_per_dim, l.cells_per_dim) for l in self.layers]
