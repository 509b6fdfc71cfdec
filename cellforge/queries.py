"""The registry: one query for each operator, with the SQL that an independent engine runs beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binning as B
from .operators import interaction, ownership, upward
from . import scratch
from .plans.spec import HALO_WIDTH, MAX_BALANCE_ITERATIONS, MAX_WORKLOAD_COEFF, REBALANCE_EVERY, TreeSpec
from .sources import generators, tables, view

E, L = tables.EMBEDDINGS, tables.LINEITEM
RANKS = (2, 2, 1)
#: Inputs of single queries: a tile window, boundaries of two layers, a specification of two cells a tile, a set.
WINDOW = ((2, 9), (0, 16), (5, 11))
BOUNDS = {0: ([0, 3, 16], [0, 11, 16], [0, 16]), 1: ([0, 5, 8], [0, 2, 8], [0, 8])}
TWO = TreeSpec((0.0, 0.0, 0.0), (51.0, 0.11, 0.09), leaf_tiles=9, reduction=3, cell_per_tile_dim=2)
SET = ((0.5, 2.0, -1.0), (0.5, -3.0, 4.0), (-7.25, 0.0, 0.0), (0.5, 2.0, -1.5))


def _r(c: str, out: str | None = None, digits: int = 6):
    return F.round(F.col(c), digits).alias(out or c)


# --- queries -------------------------------------------------------------------------------------
def leaf_cells(spark, sf):
    c = upward.populate(tables.lineitem_points(spark, sf).where(B.in_box(L)), L, L.layers[0], upward.default_aggs(L))
    return c.select("i", "j", "k", "v", "n")


def upward_all_layers(spark, sf):
    c = upward.aggregate_up(tables.lineitem_points(spark, sf), L)
    return c.select("layer", "i", "j", "k", "v", "n")


def upward_embeddings(spark, sf):
    c = upward.aggregate_up(tables.embedding_points(spark, sf), E)
    return c.select("layer", "i", "j", "k", _r("x"), _r("y"), _r("z"), "v", "n")


def upward_events(spark, sf):
    c = upward.aggregate_up(tables.event_points(spark, sf), tables.EVENTS)
    return c.select("layer", "i", "j", "k", "v", "n")


def layer_n(spark, sf):
    return upward.aggregate_layers(tables.embedding_points(spark, sf), E)[2].select("i", "j", "k", _r("x"), _r("y"), _r("z"), "v", "n")


def root_cells(spark, sf):
    return upward.aggregate_layers(tables.lineitem_points(spark, sf), L)[-1].select("i", "j", "k", "v", "n")


def root_total(spark, sf):
    return root_cells(spark, sf).agg(F.sum("v").alias("v"), F.count("*").alias("cells"))


def mean_position(spark, sf):
    p = tables.embedding_points(spark, sf).where(B.in_box(E))
    return upward.populate(p, E, E.layers[0], upward.mean_position(E), count=None).select("i", "j", "k", _r("x"), _r("y"), _r("z"))


def sum_payload(spark, sf):
    return leaf_cells(spark, sf).select("i", "j", "k", "v")


def cell_counts(spark, sf):
    return upward.aggregate_up(tables.lineitem_points(spark, sf), L).groupBy("layer").agg(F.count("*").alias("cells"))


def distinct_cells(spark, sf):
    p = tables.lineitem_points(spark, sf).where(B.in_box(L))
    return B.with_cells(p, L, L.layers[0]).select("i", "j", "k").distinct()


SMALL = TreeSpec((0.0, 0.0, 0.0), (25.0, 0.08, 0.05), leaf_tiles=4)


def box_filter(spark, sf):
    return tables.lineitem_points(spark, sf).where(B.in_box(SMALL)).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


def out_of_domain(spark, sf):
    p = tables.lineitem_points(spark, sf)
    return p.withColumn("rank", ownership.owner(SMALL, SMALL.layers[0], RANKS)).where("rank < 0").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def cell_index(spark, sf):
    p = B.with_cells(tables.lineitem_points(spark, sf).where(B.in_box(L)), L, L.layers[0])
    return p.groupBy("x", "y", "z", "i", "j", "k").agg(F.count("*").alias("n"))


def tile_local_ids(spark, sf):
    return B.tile_and_local(distinct_cells(spark, sf), L.cell_per_tile_dim)


def packed_key(spark, sf):
    t = tile_local_ids(spark, sf)
    return t.select("i", "j", "k", B.packed_key(L.layers[0]).alias("key"), B.packed_address(L.layers[0]).alias("address"))


def stencil_tiles(spark, sf):
    return B.stencil_tiles(tables.embedding_points(spark, sf), E, E.layers[0])


def layer_ladder(spark, sf):
    return spark.createDataFrame(E.ladder(), "layer int, tiles_per_dim int, cells_per_dim int")


def rank_domains(spark, sf):
    return ownership.domains(spark, L, L.layers[0], RANKS)


def assign_rank(spark, sf):
    return tables.embedding_points(spark, sf).select(_r("x"), _r("y"), _r("z"), ownership.owner(E, E.layers[0], RANKS).alias("rank"))


def assign_rank_join(spark, sf):
    p = tables.embedding_points(spark, sf)
    return ownership.owner_by_boxes(p, ownership.domains(spark, E, E.layers[0], RANKS)).select(_r("x"), _r("y"), _r("z"), "rank")


def migrate_counts(spark, sf):
    return ownership.migrate(tables.lineitem_points(spark, sf), L, L.layers[0], RANKS).groupBy("rank").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def upward_rank_local(spark, sf):
    return upward.aggregate_up(tables.lineitem_points(spark, sf), L, ranks=RANKS).select("layer", "rank", "i", "j", "k", "v", "n")


def parent_map(spark, sf):
    return upward.with_parent(upward.aggregate_up(tables.embedding_points(spark, sf), E), E).select("layer", "i", "j", "k", "pi", "pj", "pk")


def interaction_list(spark, sf):
    return interaction.interaction_list(upward.aggregate_up(tables.embedding_points(spark, sf), E), E)


def near_list(spark, sf):
    return interaction.near_list(upward.aggregate_up(tables.embedding_points(spark, sf), E))


def _boundaries(spark, f, name):
    rows = [(t, p, n, b) for t in (1, 4, 16, 50) for p in (1, 2, 3, 8) for n, b in enumerate(f(t, p))]
    return spark.createDataFrame(rows, f"tiles int, parts int, n int, {name} int")


def average_partition(spark, sf):
    return _boundaries(spark, ownership.average_partition, "boundary")


def uniform_partition(spark, sf):
    return _boundaries(spark, ownership.uniform_partition, "boundary")


def balanced_partition(spark, sf):
    return ownership.balanced_partition(tables.lineitem_points(spark, sf), L, L.layers[0], (4, 2, 1))


def udaf_pandas(spark, sf):
    def mean(pdf):
        return pdf[["x", "y", "z"]].mean().to_frame().T

    c = upward.aggregate_with(tables.embedding_points(spark, sf), E, E.layers[0], mean, "x double, y double, z double")
    return c.select("i", "j", "k", _r("x"), _r("y"), _r("z"))


def biased_tiles(spark, sf):
    return generators.biased_tiles(spark, 12, 0.4)


def biased_tiles_seeded(spark, sf):
    return generators.biased_tiles(spark, 12, 0.3, seed=5)


def random_particles(spark, sf):
    return generators.random_particles(spark, 1000, E, E.layers[0], WINDOW, seed=7)


def random_particle_tiles(spark, sf):
    return B.stencil_tiles(generators.random_particles(spark, 1000, E, E.layers[0], WINDOW, seed=7), E, E.layers[0])


def static_particle(spark, sf):
    return generators.static_particle(spark)


def static_particle_tiles(spark, sf):
    return B.stencil_tiles(generators.static_particle(spark), E, E.layers[0])


def random_tiles(spark, sf):
    return generators.random_tiles(spark, 40, seed=3)


def sorted_set(spark, sf):
    return generators.points_from_set(spark, set(SET))


def random_partition(spark, sf):
    rows = [(s, n, b) for s in (1, 2, 3) for n, b in enumerate(ownership.random_partition(50, 8, s))]
    return spark.createDataFrame(rows, "seed int, n int, boundary int")


def static_partition(spark, sf):
    rows = [(t, p, n, b) for t in (2, 16, 50) for p in (1, 2) for n, b in enumerate(ownership.static_partition(t, p))]
    return spark.createDataFrame(rows, "tiles int, parts int, n int, boundary int")


def partition_defaults(spark, sf):
    return spark.createDataFrame([(float(MAX_WORKLOAD_COEFF), REBALANCE_EVERY, MAX_BALANCE_ITERATIONS, HALO_WIDTH)], "max_workload_coeff double, rebalance_every int, max_iterations int, halo_width int")


def upward_explicit_partition(spark, sf):
    """Own tile boundaries for the two finest layers, the uniform ones above."""
    return upward.aggregate_up(tables.lineitem_points(spark, sf), L, ranks=RANKS, partitions=BOUNDS).select("layer", "rank", "i", "j", "k", "v", "n")


def upward_two_cells_per_tile(spark, sf):
    return upward.aggregate_up(tables.lineitem_points(spark, sf), TWO).select("layer", "i", "j", "k", "v", "n")


def root_ranks(spark, sf):
    root = upward.aggregate_layers(tables.lineitem_points(spark, sf), L, ranks=RANKS)[-1]
    return root.agg(F.countDistinct("rank").alias("ranks"), F.sum("v").alias("v"))


def layer_by_number(spark, sf):
    """layer(n) of the specification, its accessors with it."""
    rows = [(n, L.layer(n).tiles_per_dim, L.layer(n).cells_per_dim, *L.layer(n).cell_size) for n in range(L.num_layers)]
    return spark.createDataFrame(rows, "layer int, tiles_per_dim int, cells_per_dim int, size_x double, size_y double, size_z double")


def owned_cell_lines(spark, sf):
    cells = upward.aggregate_layers(tables.embedding_points(spark, sf), E, ranks=RANKS)[2]
    return upward.cell_lines(cells, E)


def view_lines(spark, sf):
    z, _ = _surface(spark)
    return view.view_lines(z, ("x", "y", "z"), {0: (-2, -2), 1: (6, -2)})


def view_line_at(spark, sf):
    z, _ = _surface(spark)
    return view.view_lines(z, ("x", "y", "z"), {0: (-2, -2), 1: (6, -2)}, at=(7, 3))


def pair_per_rank(spark, sf):
    spec = TreeSpec((-1.5,) * 3, (1.5,) * 3, leaf_tiles=16, reduction=2)
    return upward.aggregate_up(generators.pair_per_rank(spark, spec, RANKS), spec, ranks=RANKS).select("layer", "rank", "i", "j", "k", _r("x"), _r("y"), _r("z"), "v", "n")


def _surface(spark):
    """Positions and vorticity of two ranks' 12 by 12 surfaces, ghosts included."""
    nodes = spark.range(2 * 12 * 12).select(
        F.floor(F.col("id") / 144).cast("int").alias("rank"), F.pmod(F.floor(F.col("id") / 12), F.lit(12)).cast("int").alias("i"), F.pmod("id", F.lit(12)).cast("int").alias("j")
    )
    z = nodes.select("rank", "i", "j", (F.col("i") / 4).alias("x"), (F.col("j") / 4).alias("y"), F.col("rank").cast("double").alias("z"))
    return z, nodes.select("rank", "i", "j", (F.col("i") * 2.0).alias("w0"), (F.col("j") * 0.5).alias("w1"))


def _written(spark):
    folder = scratch.fresh_path(spark, "view")
    z, w = _surface(spark)
    view.write_view(z, folder, 16, False, 2, ("x", "y", "z"))
    view.write_view(w, folder, 16, False, 2, ("w0", "w1"))
    return folder


def view_roundtrip(spark, sf):
    """Writes a surface for each rank, reads positions and vorticity back and flattens the owned window."""
    folder = _written(spark)
    back = view.surface_particles(view.read_positions(spark, f"{folder}/z_*"), view.read_vorticity(spark, f"{folder}/w_*"), 8, 8)
    return back.select("rank", "pid", "i", "j", "x", "y", "z", "w0", "w1")


def view_positions(spark, sf):
    return view.read_positions(spark, f"{_written(spark)}/z_*")


def view_vorticity(spark, sf):
    return view.read_vorticity(spark, f"{_written(spark)}/w_*")


def view_names(spark, sf):
    return view.view_files(spark, _written(spark))


_ALL = [
    leaf_cells, upward_all_layers, upward_embeddings, upward_events, layer_n, root_cells, root_total, mean_position, sum_payload, cell_counts,
    distinct_cells, box_filter, out_of_domain, cell_index, tile_local_ids, packed_key, stencil_tiles, layer_ladder, rank_domains, assign_rank,
    assign_rank_join, migrate_counts, upward_rank_local, parent_map, interaction_list, near_list, average_partition, uniform_partition,
    balanced_partition, udaf_pandas, biased_tiles, biased_tiles_seeded, random_particles, random_particle_tiles, static_particle, static_particle_tiles,
    random_tiles, sorted_set, random_partition, static_partition, partition_defaults, upward_explicit_partition, upward_two_cells_per_tile, root_ranks,
    layer_by_number, owned_cell_lines, pair_per_rank, view_roundtrip, view_positions, view_vorticity, view_names, view_lines, view_line_at,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# --- oracle SQL ----------------------------------------------------------------------------------
_EMB = "SELECT embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z, label v FROM embeddings"
_LIN = "SELECT l_quantity::DOUBLE x, l_discount::DOUBLE y, l_tax::DOUBLE z, l_linenumber v FROM lineitem"
_EVT = "SELECT (epoch_us(ts) - 1704067200000000)::DOUBLE x, user_id::DOUBLE y, value::DOUBLE z, 1 v FROM events"


def _box(s: TreeSpec) -> str:
    return " AND ".join(f"{c} >= {lo!r} AND {c} < {hi!r}" for c, lo, hi in zip("xyz", s.low, s.high))


def _bin(s: TreeSpec, n: int, names: str = "ijk") -> str:
    out = []
    for c, lo, size, name in zip("xyz", s.low, s.layers[n].cell_size, names):
        q = f"(({c} - ({lo!r}::DOUBLE)) * {1.0 / size!r}::DOUBLE)"
        out.append(f"CAST(floor({q}) + CASE WHEN {q} - floor({q}) >= 0.5 THEN 1 ELSE 0 END AS INT) {name}")
    return ", ".join(out)


def _rank(s: TreeSpec, n: int, ranks=RANKS, partition=None) -> str:
    axes = []
    for c, bounds in zip("xyz", ownership.axis_bounds(s, s.layers[n], ranks, partition)):
        axes.append("CASE " + " ".join(f"WHEN {c} >= {lo!r}::DOUBLE AND {c} < {hi!r}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(bounds)) + " END")
    return f"coalesce((({axes[0]}) * {ranks[1]} + ({axes[1]})) * {ranks[2]} + ({axes[2]}), -1)::INT"


def _ladder(src: str, s: TreeSpec, ranks=None, top: int | None = None, partitions=None) -> str:
    key = "rank, i, j, k" if ranks else "i, j, k"
    ctes = [f"m AS (SELECT * FROM ({src}) WHERE {_box(s)})"]
    for n in range(s.num_layers if top is None else top + 1):
        prev = f"L{n - 1}" if n else "m"
        r = f", {_rank(s, n, ranks, (partitions or {}).get(n))} AS rank" if ranks else ""
        keep = " WHERE rank >= 0" if ranks else ""
        ctes.append(
            f"L{n} AS MATERIALIZED (SELECT {key}, avg(x) x, avg(y) y, avg(z) z, sum(v)::BIGINT v, count(*) n FROM (SELECT {_bin(s, n)}{r}, x, y, z, v FROM {prev}){keep} GROUP BY {key})"
        )
    return "WITH " + ", ".join(ctes)


def _all(s: TreeSpec, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT {l.layer} AS layer, {cols} FROM L{l.layer}" for l in s.layers)


_XYZ = "round(x, 6) x, round(y, 6) y, round(z, 6) z"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def _parents(s: TreeSpec) -> str:
    last = s.num_layers - 1
    parts = []
    for l in s.layers:
        p = "0 pi, 0 pj, 0 pk" if l.layer == last else _bin(s, l.layer + 1, ("pi", "pj", "pk"))
        parts.append(f"SELECT {l.layer} AS layer, i, j, k, {p} FROM L{l.layer}")
    return " UNION ALL ".join(parts)


def _partition_sql(expr: str) -> str:
    return (
        "SELECT t.tiles::INT tiles, p.parts::INT parts, n.n::INT n, "
        + expr
        + "::INT boundary FROM (VALUES (1),(4),(16),(50)) t(tiles), (VALUES (1),(2),(3),(8)) p(parts), range(0, 9) n(n) WHERE n.n <= p.parts"
    )


def oracle_sql() -> dict[str, str]:
    emb, lin, evt = _ladder(_EMB, E), _ladder(_LIN, L), _ladder(_EVT, tables.EVENTS)
    leaf = _ladder(_LIN, L, top=0)
    cells = f"SELECT DISTINCT {_bin(L, 0)} FROM ({_LIN}) WHERE {_box(L)}"
    cpt, n1, t1 = L.cell_per_tile_dim, L.layers[0].cells_per_dim + 1, L.layers[0].tiles_per_dim + 1
    tl = ", ".join([f"({c} // {cpt})::INT t{c}" for c in "ijk"] + [f"({c} % {cpt})::INT l{c}" for c in "ijk"])
    root = E.num_layers - 1
    cheb = "greatest(abs(a.{0}i-b.{0}i), abs(a.{0}j-b.{0}j), abs(a.{0}k-b.{0}k))"
    dom_rows = []
    bx, by, bz = ownership.axis_bounds(L, L.layers[0], RANKS)
    for a, x in enumerate(bx):
        for b, y in enumerate(by):
            for c, z in enumerate(bz):
                dom_rows.append((ownership.rank_of(a, b, c, RANKS), x[0], y[0], z[0], x[1], y[1], z[1]))
    spec16 = TreeSpec((-1.5,) * 3, (1.5,) * 3, leaf_tiles=16, reduction=2)
    h = 3.0 / 64
    pairs = []
    for r in range(4):
        x, y = (-0.75, 0.75)[r // 2], (-0.75, 0.75)[r % 2]
        pairs += [(x, y, 0.0, r), (x + 1.1 * h, y + 1.1 * h, 0.0 + 1.1 * h, r)]
    pair_src = f"SELECT * FROM (VALUES {_values(pairs)}) t(x, y, z, v)"
    q = lambda c, lo, s: f"(({c} - ({lo!r}::DOUBLE)) * {1.0 / s!r}::DOUBLE)"
    st = E.layers[0]
    coord = []
    for d, (a, b) in enumerate(WINDOW):
        h = st.cell_size[d]
        start, size = E.low[d] + h * (2.01 + 4 * a), h * (4 * (b - a) - 4.02)
        coord.append(f"{start!r}::DOUBLE + ('0x' || substr(md5('7|{d}|' || id), 1, 13))::BIGINT::DOUBLE / {float(2**52)!r}::DOUBLE * {size!r}::DOUBLE AS {'xyz'[d]}")
    particles = f"SELECT {', '.join(coord)} FROM range(1000) t(id)"
    surface = "SELECT r::INT rank, i::INT i, j::INT j, i / 4.0::DOUBLE x, j / 4.0::DOUBLE y, r::DOUBLE z, i * 2.0::DOUBLE w0, j * 0.5::DOUBLE w1 FROM range(2) a(r), range(12) b(i), range(12) c(j)"
    lines = f"SELECT rank, i, j, printf('R%d %d %d %d %d %.12f %.12f %.12f', rank, gi, gj, i, j, x, y, z) line, gi, gj FROM (SELECT *, (i - 2 + 8 * rank)::INT gi, j - 2 gj FROM ({surface}))"
    axis = lambda c, d: f"CAST(trunc((floor({q(c, E.low[d], st.cell_size[d])}) + CASE WHEN {q(c, E.low[d], st.cell_size[d])} - floor({q(c, E.low[d], st.cell_size[d])}) >= 0.5 THEN 1 ELSE 0 END + {'abc'[d]}.o) / 4) AS INT)"
    offs = "(VALUES (-1),(0),(1))"
    stencil = lambda src: f"SELECT DISTINCT {axis('x', 0)} ti, {axis('y', 1)} tj, {axis('z', 2)} tk FROM ({src}) p, {offs} a(o), {offs} b(o), {offs} c(o) WHERE {_box(E)}"
    quant = []
    for d, (c, n) in enumerate(zip("ijk", (4, 2, 1))):
        t = f"least({c} // {cpt}, {L.layers[0].tiles_per_dim - 1})"
        hist = f"SELECT tile, sum(n) OVER (ORDER BY tile) cum, sum(n) OVER () total FROM (SELECT {t} tile, count(*) n FROM (SELECT {_bin(L, 0)} FROM ({_LIN}) WHERE {_box(L)}) GROUP BY 1)"
        edge = lambda p, hist=hist, n=n: "0" if p == 0 else str(L.layers[0].tiles_per_dim) if p == n else f"(SELECT coalesce(min(tile) + 1, {L.layers[0].tiles_per_dim}) FROM ({hist}) WHERE cum * {n} >= total * {p})"
        quant += [f"SELECT {d}::INT AS axis, {p}::INT AS part, ({edge(p)})::INT start_tile, ({edge(p + 1)})::INT end_tile" for p in range(n)]
    return {
        "leaf_cells": f"{leaf} SELECT i, j, k, v, n FROM L0",
        "upward_all_layers": f"{lin} {_all(L, 'i, j, k, v, n')}",
        "upward_embeddings": f"{emb} {_all(E, f'i, j, k, {_XYZ}, v, n')}",
        "upward_events": f"{evt} {_all(tables.EVENTS, 'i, j, k, v, n')}",
        "layer_n": f"{emb} SELECT i, j, k, {_XYZ}, v, n FROM L2",
        "root_cells": f"{lin} SELECT i, j, k, v, n FROM L{L.num_layers - 1}",
        "root_total": f"{lin} SELECT sum(v)::BIGINT v, count(*) cells FROM L{L.num_layers - 1}",
        "mean_position": f"{emb} SELECT i, j, k, {_XYZ} FROM L0",
        "udaf_pandas": f"{emb} SELECT i, j, k, {_XYZ} FROM L0",
        "sum_payload": f"{leaf} SELECT i, j, k, v FROM L0",
        "cell_counts": f"{lin} SELECT layer, count(*) cells FROM ({_all(L, 'i')}) GROUP BY layer",
        "distinct_cells": cells,
        "box_filter": f"SELECT x, y, z, count(*) n FROM ({_LIN}) WHERE {_box(SMALL)} GROUP BY ALL",
        "out_of_domain": f"SELECT count(*) n, sum(v)::BIGINT v FROM ({_LIN}) WHERE {_rank(SMALL, 0)} < 0",
        "cell_index": f"SELECT x, y, z, {_bin(L, 0)}, count(*) n FROM ({_LIN}) WHERE {_box(L)} GROUP BY ALL",
        "tile_local_ids": f"SELECT *, {tl} FROM ({cells})",
        "packed_key": f"SELECT i, j, k, (i::BIGINT * {n1} + j) * {n1} + k AS key, (((ti::BIGINT * {t1} + tj) * {t1} + tk) << 6) | ((li * {cpt} + lj) * {cpt} + lk)::BIGINT AS address FROM (SELECT *, {tl} FROM ({cells}))",
        "stencil_tiles": stencil(_EMB),
        "layer_ladder": "WITH RECURSIVE t(layer, tiles) AS (SELECT 0, 16 UNION ALL SELECT layer + 1, greatest(1, tiles // 2) FROM t WHERE tiles > 1) SELECT layer::INT layer, tiles::INT tiles_per_dim, (tiles * 4)::INT cells_per_dim FROM t",
        "rank_domains": f"SELECT * FROM (VALUES {_values(dom_rows)}) t(rank, x_lo, y_lo, z_lo, x_hi, y_hi, z_hi)",
        "assign_rank": f"SELECT {_XYZ}, {_rank(E, 0)} AS rank FROM ({_EMB})",
        "assign_rank_join": f"SELECT {_XYZ}, {_rank(E, 0)} AS rank FROM ({_EMB})",
        "migrate_counts": f"SELECT rank, count(*) n, sum(v)::BIGINT v FROM (SELECT {_rank(L, 0)} AS rank, v FROM ({_LIN})) WHERE rank >= 0 GROUP BY rank",
        "upward_rank_local": f"{_ladder(_LIN, L, RANKS)} {_all(L, 'rank, i, j, k, v, n')}",
        "parent_map": f"{emb} {_parents(E)}",
        "interaction_list": f"{emb}, c AS MATERIALIZED ({_parents(E)}), o AS (SELECT u.o oi, v.o oj, w.o ok FROM {offs} u(o), {offs} v(o), {offs} w(o)), e AS MATERIALIZED (SELECT c.*, pi + oi qi, pj + oj qj, pk + ok qk FROM c, o) SELECT a.layer, a.i, a.j, a.k, b.i i_b, b.j j_b, b.k k_b FROM e a JOIN c b ON a.layer = b.layer AND a.qi = b.pi AND a.qj = b.pj AND a.qk = b.pk WHERE {cheb.format('')} > 1",
        "near_list": f"{emb}, o AS (SELECT u.o oi, v.o oj, w.o ok FROM {offs} u(o), {offs} v(o), {offs} w(o)), e AS MATERIALIZED (SELECT i, j, k, i + oi qi, j + oj qj, k + ok qk FROM L0, o) SELECT 0 AS layer, a.i, a.j, a.k, b.i i_b, b.j j_b, b.k k_b FROM e a JOIN L0 b ON a.qi = b.i AND a.qj = b.j AND a.qk = b.k",
        "average_partition": _partition_sql("CASE WHEN n.n = p.parts THEN t.tiles ELSE n.n * (t.tiles // p.parts) END"),
        "uniform_partition": _partition_sql("(n.n * t.tiles) // p.parts"),
        "balanced_partition": " UNION ALL ".join(quant),
        "biased_tiles": "SELECT ti::INT ti, tj::INT tj, tk::INT tk, ti < 4 AND tj < 4 AND tk < 4 AS in_corner, (row_number() OVER (ORDER BY NOT (ti < 4 AND tj < 4 AND tk < 4), ti, tj, tk) - 1)::INT AS seq FROM range(12) a(ti), range(12) b(tj), range(12) c(tk)",
        "biased_tiles_seeded": "SELECT ti::INT ti, tj::INT tj, tk::INT tk, ti < 3 AND tj < 3 AND tk < 3 AS in_corner, (row_number() OVER (ORDER BY NOT (ti < 3 AND tj < 3 AND tk < 3), md5('5|' || ti || '|' || tj || '|' || tk)) - 1)::INT AS seq FROM range(12) a(ti), range(12) b(tj), range(12) c(tk)",
        "random_particles": particles,
        "random_particle_tiles": stencil(particles),
        "static_particle": "SELECT 0.0::DOUBLE x, 0.0::DOUBLE y, 0.0::DOUBLE z",
        "static_particle_tiles": stencil("SELECT 0.0::DOUBLE x, 0.0::DOUBLE y, 0.0::DOUBLE z"),
        "random_tiles": "WITH p AS (SELECT d, t, (row_number() OVER (PARTITION BY d ORDER BY md5('3|' || d || '|' || t)) - 1)::INT seq FROM range(3) a(d), range(40) b(t)) SELECT i.t::INT ti, j.t::INT tj, k.t::INT tk, seq FROM (SELECT * FROM p WHERE d = 0) i JOIN (SELECT * FROM p WHERE d = 1) j USING (seq) JOIN (SELECT * FROM p WHERE d = 2) k USING (seq)",
        "sorted_set": f"SELECT x, y, z, (row_number() OVER (ORDER BY x, y, z) - 1)::INT seq FROM (VALUES {_values(SET)}) t(x, y, z)",
        "random_partition": "WITH inner_ AS (SELECT s, t FROM (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || t)) r FROM range(1, 4) a(s), range(1, 50) b(t)) WHERE r < 8), e AS (SELECT * FROM inner_ UNION ALL SELECT s, 0 FROM range(1, 4) a(s) UNION ALL SELECT s, 50 FROM range(1, 4) a(s)) SELECT s::INT seed, (row_number() OVER (PARTITION BY s ORDER BY t) - 1)::INT n, t::INT boundary FROM e",
        "static_partition": "SELECT t.tiles::INT tiles, p.parts::INT parts, n.n::INT n, (CASE WHEN n.n = p.parts THEN t.tiles ELSE n.n END)::INT boundary FROM (VALUES (2),(16),(50)) t(tiles), (VALUES (1),(2)) p(parts), range(0, 3) n(n) WHERE n.n <= p.parts",
        "partition_defaults": "SELECT 1.5::DOUBLE max_workload_coeff, 200::INT rebalance_every, 10::INT max_iterations, 2::INT halo_width",
        "upward_explicit_partition": f"{_ladder(_LIN, L, RANKS, partitions=BOUNDS)} {_all(L, 'rank, i, j, k, v, n')}",
        "upward_two_cells_per_tile": f"{_ladder(_LIN, TWO)} {_all(TWO, 'i, j, k, v, n')}",
        "root_ranks": f"{_ladder(_LIN, L, RANKS)} SELECT count(DISTINCT rank) ranks, sum(v)::BIGINT v FROM L{L.num_layers - 1}",
        "layer_by_number": "WITH RECURSIVE t(layer, tiles) AS (SELECT 0, 16 UNION ALL SELECT layer + 1, tiles // 2 FROM t WHERE tiles > 1) SELECT layer::INT layer, tiles::INT tiles_per_dim, (tiles * 4)::INT cells_per_dim, 51.0::DOUBLE / (tiles * 4) size_x, 0.11::DOUBLE / (tiles * 4) size_y, 0.09::DOUBLE / (tiles * 4) size_z FROM t",
        "owned_cell_lines": f"{_ladder(_EMB, E, RANKS)} SELECT rank, i, j, k, printf('R%d: val: %d, x/y/z: %.3f, %.3f, %.3f', rank, v, x, y, z) line FROM L2",
        "view_roundtrip": f"SELECT rank, ((i - 2) * 8 + j - 2)::INT pid, i, j, x, y, z, w0, w1 FROM ({surface}) WHERE i BETWEEN 2 AND 9 AND j BETWEEN 2 AND 9",
        "view_positions": f"SELECT rank, i, j, x, y, z FROM ({surface})",
        "view_vorticity": f"SELECT rank, i, j, w0, w1 FROM ({surface})",
        "view_names": "SELECT x || '_16_f_r' || r || '.2.view' AS name, x, 16::INT mesh_size, false periodic, r::INT rank, 2::INT comm_size FROM (VALUES ('z'), ('w')) a(x), range(2) b(r)",
        "view_lines": f"SELECT rank, i, j, line FROM ({lines})",
        "view_line_at": f"SELECT rank, i, j, line FROM ({lines}) WHERE gi = 7 AND gj = 3",
        "pair_per_rank": f"{_ladder(pair_src, spec16, RANKS)} {_all(spec16, f'rank, i, j, k, {_XYZ}, v, n')}",
    }
