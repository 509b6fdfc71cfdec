"""Connected components, and exact similarity components from signatures, without listing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, repeats
from . import textnum as tn
from .shingles import Shingles

#: Sets that one task compares with each other, or with as many others.
BLOCK = 1024


def connected(edges: DataFrame, name: str = "star") -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the least node reachable.

    Alternating large and small stars: a logarithmic number of rounds for any shape. A hub with most
    of the edges is pre-aggregated and its minimum broadcast (see hot_join); while all edges
    are few (counted), all minima are. Every round is written, so the lineage stays short, by as
    many tasks as its edges need.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = common.keep(e, name)
    last = None
    parts = common.shuffle_parts(e.sparkSession)
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        total = state[0]
        if state == last or not total:
            break
        last = state
        few, tasks = total < common.SMALL_ROWS, max(1, total // 20_000)

        def slim(df: DataFrame) -> DataFrame:
            return df.coalesce(tasks) if tasks < parts else df

        def star(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
            return rows.join(F.broadcast(slim(least)), key) if few else common.hot_join(rows, least, [key], "n", 2 * total)

        # large star: a node's larger neighbours go to its least
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        big = common.keep(slim(star(both, least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()), name)
        # small star: a node and its smaller neighbours go to the least of them
        small = big.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = star(big, small, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, common.keep(slim(out.unionByName(small.select("a", F.col("m").alias("b"))).distinct()), name)
        common.discard(before, big)
    leaves = e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    return leaves.unionByName(leaves.select(F.col("comp").alias("node"), "comp").distinct())


def _links(ids: np.ndarray, sets: list[np.ndarray], exact: Callable[[int], frozenset], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs with 100 * |A and B| >= percent * |A or B|.

    Intersections of hashed sets come from a product of incidence matrices over the elements that
    several sets share, a slice of columns at a time; a link counts once the sets themselves,
    ``exact(n)``, agree. With ``left`` only pairs across that place are compared.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not sizes.any():
        return []
    row = np.repeat(np.arange(n), sizes)
    vocab, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = (times > 1)[col]
    row, col = row[keep], number[col[keep]]
    width = int((times > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a, b = (slice(0, n), slice(0, n)) if left is None else (slice(0, left), slice(left, n))
    both = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
    step = 4096
    for c in range(0, width, step):
        i, j = np.searchsorted(col, (c, c + step))
        m = np.zeros((n, min(step, width - c)), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        both += m[a] @ m[b].T
    union = sizes[a, None] + sizes[None, b] - both
    x, y = np.nonzero((100 * both.astype(np.float64) >= percent * union) & (union > 0))
    y = y + b.start
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for p, q in zip(x.tolist(), y.tolist()):
        if p != q:
            f, g = find(p), find(q)
            if f != g and _similar(exact(p), exact(q), percent):
                root[f] = g
                out.append((int(ids[p]), int(ids[q])))
    return out


def _similar(a: frozenset, b: frozenset, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(kind: Shingles, percent: int):
    """Group function: rows (sid, z, side) -> spanning links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        pdf = pdf.sort_values(["side", "sid"], kind="stable")
        raw = [unzip.decompress(z) for z in pdf["z"]]
        offs = np.append(0, np.cumsum([len(r) for r in raw]))
        data, sets = np.frombuffer(b"".join(raw), np.uint8), []
        for i, j in tn.chunks(offs):
            sets += kind.sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        side = pdf["side"].to_numpy()
        left = int((side == 0).sum()) if (side == 1).any() else None
        links = _links(pdf["sid"].to_numpy(), sets, lru_cache(4096)(lambda n: kind.exact(raw[n])), percent, left)
        return pd.DataFrame({"a": np.array([l[0] for l in links], np.int64), "b": np.array([l[1] for l in links], np.int64)})

    return run


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sid, n, z): one compressed text of each set in ``nodes`` (sid, n, key). Few documents leave their place."""
    bucket = F.pmod(F.xxhash64("_key"), F.lit(1 << 20)).cast("int").alias("_bucket")
    want = nodes.select(F.col("key").alias("_key"), "sid", "n")
    some = F.broadcast(want.select(bucket).distinct())  # at most 2^20 rows
    d = docs.select("_key", "text", bucket).join(some, "_bucket", "left_semi").select("_key", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(3)
        for batch in batches:
            data, offs = tn.buffer(batch.column(1))
            raw = data.tobytes()
            z = [zip_.compress(raw[offs[i] : offs[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["_key", "z"])

    return d.mapInArrow(pack, "_key long, z binary").join(want, "_key").select("sid", "n", "z")


def _among(sig: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``sig`` whose signature is among ``shared``, and a few others: most signatures have one
    set only, and a broadcast bitmap (of at most 32 MB, beyond whose use it filters less) spares them a
    second shuffle."""
    words, bits = repeats.bitmap(shared.select(F.col("sig").alias("h")), shared.count())
    held = sig.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(repeats.hits(held.value, bits, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return sig.select("sig", "sid").mapInArrow(run, "sig long, sid long")


def _elements(texts: DataFrame, kind: Shingles) -> DataFrame:
    """(sid, n, e): a row for each element of each set of ``texts`` (sid, n, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [unzip.decompress(z) for z in batch.column(2).to_pylist()]
            offs = np.append(0, np.cumsum([len(r) for r in raw]))
            data, (sid, n) = np.frombuffer(b"".join(raw), np.uint8), (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            for i, j in tn.chunks(offs):
                sets = kind.sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                sizes = [len(s) for s in sets]
                cols = [np.repeat(sid[i:j], sizes), np.repeat(n[i:j], sizes), np.concatenate(sets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sid", "n", "e"])

    return texts.select("sid", "n", "z").mapInArrow(run, "sid long, n long, e long")


def _refine(texts: DataFrame, kind: Shingles, percent: int) -> DataFrame:
    """(sid, cluster): finer clusters of the sets in ``texts`` (sid, n, z) that still hold every link.

    Signatures chain sets that are alike in places into clusters far larger than any group that links.
    A set whose elements that another set has too are fewer than ``percent`` of its own links with
    nothing and drops out. Of those left, two that link share one of their n - ceil(n * percent / 100) + 1
    rarest elements, in one order of all elements; sets that share such an element are a cluster. A hash
    that two elements have in common only makes an element look less rare.
    """
    once = _elements(texts, kind).groupBy("e").agg(F.count("*").alias("df"), F.min("sid").alias("sid"), F.min("n").alias("n")).where("df = 1")
    lone = once.groupBy("sid").agg(F.count("*").alias("u"), F.min("n").alias("n")).where((F.col("n") - F.col("u")) * 100 < F.col("n") * percent).select("sid")
    some = common.keep(_elements(texts.join(lone, "sid", "left_anti"), kind), "elements")
    df = common.keep(some.groupBy("e").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    shared = common.hot_join(some, df, ["e"], "df", max(1, some.count()))
    by_set = Window.partitionBy("sid")
    prefix = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1 - (F.col("n") - F.count("*").over(by_set))  # without those it has alone, the rarest
    rare = shared.withColumn("_p", prefix).withColumn("_r", F.row_number().over(by_set.orderBy("df", "e"))).where("_r <= _p")
    rare = common.keep(rare.select("sid", "e"), "rare")
    common.discard(some, df)
    least = rare.groupBy("e").agg(F.min("sid").alias("m"), F.count("*").alias("w")).where("w > 1")
    stars = common.hot_join(rare, least, ["e"], "w", max(1, rare.count())).where("sid <> m").select(F.col("sid").alias("a"), F.col("m").alias("b"))
    return connected(stars, "refined").withColumnRenamed("node", "sid").withColumnRenamed("comp", "cluster")


def similar(docs: DataFrame, nodes: DataFrame, signatures: DataFrame | list[DataFrame], kind: Shingles, percent: int, block: int = BLOCK) -> DataFrame:
    """(sid, comp) of every set that is linked to another: 100 * |A and B| >= percent * |A or B|.

    ``nodes`` has each different set once (sid, n elements, key of a document that has it);
    ``signatures`` (sig, sid) give equal signatures to any two sets that link (repeats are welcome). They may come in parts, each with all
    rows of its signatures: a part is written and deleted before the next, so that disk holds one.

    Signatures of one set only drop out by a pre-aggregated minimum and maximum. What is left joins
    each set to its signature's least, and the components of these stars are clusters: sets that
    link are in one cluster. A cluster of at most ``block`` sets is compared by one task. Larger ones
    are made finer (see :func:`_refine`); what is still larger is sorted by size and cut into blocks: first every block with itself and the cluster's first
    sets, then, of what these links have not joined to the cluster's main component, every block with all blocks
    whose sizes allow the similarity. Tasks return spanning links, never pairs.
    """
    given, stars = signatures if isinstance(signatures, list) else [signatures], None
    for part in given:
        sig = common.keep(part, "signatures")
        total = max(1, sig.count())
        shared = sig.groupBy("sig").agg(F.min("sid").alias("m"), F.max("sid").alias("top"), F.count("*").alias("n")).where("m <> top").drop("top")
        shared = common.keep(shared, "shared")
        some = common.keep(_among(sig, shared), "some")
        common.discard(sig)
        found = common.hot_join(some, shared, ["sig"], "n", total).where("sid <> m").select(F.col("sid").alias("a"), F.col("m").alias("b")).distinct()
        if len(given) > 1:
            found = common.keep(found, "stars")
            common.discard(some, shared)
            common.sweep(docs.sparkSession)
        stars = found if stars is None else stars.unionByName(found)
    cluster = common.keep(connected(stars.distinct(), "cluster"), "cluster").withColumnRenamed("node", "sid").withColumnRenamed("comp", "cluster")
    member = cluster.join(nodes, "sid")
    texts = common.keep(_texts(docs, member.select("sid", "n", "key")), "texts")
    member = common.keep(member.select("sid", "n", "cluster"), "member")
    sizes = member.groupBy("cluster").agg(F.count("*").alias("size"))
    chained = common.keep(sizes.where(F.col("size") > block), "chained")
    if chained.limit(1).count():
        chain = common.hot_join(member, chained, ["cluster"], "size", member.count()).select("sid")
        finer = _refine(texts.join(chain, "sid"), kind, percent)
        whole = member.join(sizes.where(F.col("size") <= block).select("cluster"), "cluster").select("sid", "n", "cluster")
        member = common.keep(whole.unionByName(finer.join(nodes.select("sid", "n"), "sid").select("sid", "n", "cluster")), "members")
        sizes = member.groupBy("cluster").agg(F.count("*").alias("size"))
        common.sweep(docs.sparkSession)
    compare = _compare(kind, percent)
    rows, parts = member.count(), common.shuffle_parts(docs.sparkSession)

    def dealt(rows_: DataFrame, *keys: str) -> DataFrame:
        """Into tasks of like work at any size: comparing is long for the bytes it takes, which is all that Spark would go by."""
        return rows_.repartition(max(parts, rows // block), *keys).groupBy(*keys).applyInPandas(compare, "a long, b long")

    kept = texts.select("sid", "z")

    small = member.join(sizes.where(F.col("size") <= block), "cluster").select("sid", "cluster")
    # clusters are many and mostly tiny: several share a group, which compares a cluster's sets only
    links = dealt(kept.join(small, "sid").withColumn("side", F.lit(0)), "cluster")

    large = common.keep(sizes.where(F.col("size") > block), "large")
    if large.limit(1).count():
        big = common.keep(common.hot_join(member, large, ["cluster"], "size", max(1, rows)), "big")
        diagonal = _blocks(big, block)
        first = big.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set(F.when(F.xxhash64("sid") % F.greatest(F.lit(1), F.col("size") / 64).cast("long") == 0, F.col("sid")))), 1, 4).alias("lead"))
        lead = first.select("cluster", F.explode("lead").alias("sid"))
        with_lead = diagonal.select("cluster", "blk").distinct().join(lead, "cluster").join(diagonal.select("cluster", "blk", "sid").withColumn("own", F.lit(1)), ["cluster", "blk", "sid"], "left").where("own is null").select("cluster", "blk", "sid")
        both = diagonal.select("cluster", "blk", "sid").unionByName(with_lead)
        near = common.keep(dealt(kept.join(both, "sid").withColumn("side", F.lit(0)), "cluster", "blk"), "near")
        links = links.unionByName(near)
        label = connected(near, "label").withColumnRenamed("node", "sid")
        big = common.keep(big.join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "labelled")
        # the most frequent label of each cluster is its main component, which needs no comparison within
        main = big.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
        big = big.join(main, "cluster").withColumn("is_main", F.col("comp") == F.col("main"))
        cut = common.keep(_blocks(big.drop("comp", "main"), block, "is_main"), "cut")
        span = cut.groupBy("cluster", "is_main", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        x = span.where("not is_main").select("cluster", F.col("blk").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
        y = span.select("cluster", F.col("is_main").alias("ymain"), F.col("blk").alias("y"), "lo", "hi")
        fits = (F.col("hi") * 100 >= F.col("xlo") * percent) & (F.col("xhi") * 100 >= F.col("lo") * percent)
        tasks = x.join(y, "cluster").where(fits & (F.col("ymain") | (F.col("x") <= F.col("y"))))  # block numbers, not rows: (size / block)^2 at most
        tasks = tasks.withColumnRenamed("cluster", "c").withColumn("same", ~F.col("ymain") & (F.col("x") == F.col("y")))
        names = ["c", "x", "ymain", "y", "sid"]
        left = cut.where("not is_main").join(tasks, (F.col("cluster") == F.col("c")) & (F.col("blk") == F.col("x"))).select(*names, F.lit(0).alias("side"))
        on = (F.col("cluster") == F.col("c")) & (F.col("blk") == F.col("y")) & (F.col("is_main") == F.col("ymain"))
        right = cut.join(tasks.where("not same"), on).select(*names, F.lit(1).alias("side"))
        far = dealt(kept.join(left.unionByName(right), "sid"), "c", "x", "ymain", "y")
        links = links.unionByName(far)
    return connected(links, "links").withColumnRenamed("node", "sid")


def _blocks(big: DataFrame, block: int, *by: str) -> DataFrame:
    """Adds ``blk``: sets of like size together, about ``block`` in each.

    Bounds are size quantiles of the cluster, then a hash splits what one size holds too much of, so
    no window over a whole cluster is needed.
    """
    keys = ["cluster", *by]
    cuts = big.groupBy(*keys).agg(F.percentile_approx("n", F.lit([x / 256 for x in range(1, 256)]), F.lit(2560)).alias("q"), F.count("*").alias("m"))
    d = big.join(cuts, keys)
    parts = F.ceil(F.col("m") / block)
    q = F.size(F.filter(F.array_distinct("q"), lambda c: c < F.col("n")))
    # with up to 256 parts the quantiles are grouped; beyond, every quantile is split by a hash
    coarse = F.floor(q * F.least(parts, F.lit(256)) / 256)
    sub = F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1), F.ceil(parts / 256)))
    d = d.withColumn("_c", coarse * 1_000_000 + sub)
    n = d.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    d = d.join(n, [*keys, "_c"])
    return d.withColumn("blk", F.xxhash64("_c", F.pmod(F.xxhash64("sid", F.lit(7)), F.ceil(F.col("_n") / block)))).drop("_c", "_n", "q", "m")
