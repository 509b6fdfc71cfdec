"""N-gram Jaccard join by PartEnum signatures.

Sets of one size band that are similar enough differ in at most k elements. The feature domain is
partitioned by hash into n1 parts, each of them into N2 smaller ones. With 2 * n1 > k some part holds
at most one of the differences, so that two of its three smaller parts are free of any; a set has a
signature for each two of three smaller parts of each part, and similar sets share one. A set is
indexed in its own band and, if it can be the smaller partner there, in the next.

Where that makes more than PARTS parts, PARTS of them are indexed: signatures stay a few hundred however
large the sets. The k differences fall on the parts by hash, two on each on average at the most, so
that one part has at most one with a probability of 0.406; that none of 60 parts has, and a similar pair
is missed, has a probability below 1e-13, whatever the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components
from . import textnum as tn
from .shingles import Shingles

SHINGLE = 3
PERCENT = 90
#: Smaller parts of a part, and how many of them a signature covers.
N2, COVER = 3, 2
#: Parts that are indexed at most.
PARTS = 60
#: Parts with an empty signature that a set may have without indexing those: another part is then certain to agree.
SPARE = 1
#: Ratio of a band's bounds, about: a whole power of 100 / percent.
BAND_RATIO = (100 / 90) ** 3


def bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size bands."""
    lo, out = 1, []
    ratio = (100 / percent) ** max(1, round(math.log(BAND_RATIO) / math.log(100 / percent)))
    while lo <= most:
        out.append(lo)
        lo = max(lo + 1, math.floor(lo * ratio) + 1)
    return np.array(out, np.int64)


def distance(hi: int, percent: int = PERCENT) -> int:
    """The most elements in which two sets of at most ``hi`` elements differ if they are similar."""
    return (2 * hi * (100 - percent)) // (100 + percent)


def layout(lo: int, hi: int, percent: int = PERCENT) -> tuple[int, int]:
    """(parts, spare parts) of a band.

    Signatures of empty smaller parts say nothing and would put all sets of the band into one cluster.
    Spare parts make up for those that are left out: as many as the band's least sets may have. Where
    not all parts are indexed, empty signatures are left out without any.
    """
    least = distance(hi, percent) // COVER + 1
    if least > PARTS:
        return least, least
    more = 0
    for _ in range(10):
        parts = least + SPARE + more
        e = parts * N2 * math.exp(-lo * percent / 100 * COVER / N2 / parts)
        more = min(least, math.ceil(e + 2 * math.sqrt(e))) if e >= 0.2 else 0
    return least + SPARE + more, SPARE + more


def passes(percent: int = PERCENT) -> int:
    """Into how many parts the signatures are dealt, one after the other: a set has about twice as many at 80 as at 90 percent."""
    return -(-distance(100, percent) // 10)


_BANDS: dict[int, np.ndarray] = {}


def signatures_of(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of one set of different 64-bit element hashes, in ascending order."""
    n = len(elements)
    b = _BANDS.setdefault(percent, bands(percent))
    own = int(np.searchsorted(b, n, side="right")) - 1
    out = []
    for i in (own, own + 1):
        lo, hi = int(b[i]), int(b[i + 1]) - 1
        if i > own and n * 100 < lo * percent:
            continue
        parts, spare = layout(lo, hi, percent)
        place = (((elements >> np.uint64(32)) * np.uint64(N2 * parts)) >> np.uint64(32)).astype(np.int64)  # ascending, as the elements are
        used = PARTS if parts == spare else parts
        bounds = np.searchsorted(place, np.arange(N2 * used + 1))
        some = elements[: bounds[-1]]
        with np.errstate(over="ignore"):
            total = np.append(np.uint64(0), np.cumsum(tn.mix(some + np.uint64(i))))
            part = (total[bounds[1:]] - total[bounds[:-1]]).reshape(used, N2)
            size = np.diff(bounds).reshape(used, N2)
            first = np.arange(used, dtype=np.uint64) * np.uint64(8) + np.uint64(i << 40)
            sig = np.stack([tn.mix(tn.mix(part[:, x] + first + np.uint64(x)) + part[:, y] + np.uint64(y)) for x in range(N2) for y in range(x + 1, N2)], 1)
        empty = np.stack([size[:, x] + size[:, y] == 0 for x in range(N2) for y in range(x + 1, N2)], 1)
        out.append(sig[~empty] if empty.any(1).sum() <= spare else sig.ravel())
    return np.concatenate(out)


def node_table(keyed: DataFrame, kind: Shingles, bad: np.ndarray) -> DataFrame:
    """(_key, n, sid, tag): each document's set size and the id of its word sequence, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(1))
            n, ids = [], []
            for i, j in tn.chunks(offs):
                b, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                raw = b.tobytes()
                n += [len(s) for s in kind.sets(b, o)]
                ids += [kind.ids(raw[o[r] : o[r + 1]], bad) for r in range(j - i)]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "n", "sid", "tag"])

    return keyed.select("_key", "text").mapInArrow(run, "_key long, n long, sid long, tag long")


def nodes_of(keyed: DataFrame, kind: Shingles) -> tuple[DataFrame, np.ndarray]:
    """The stored node table, and the ids that had several tags on the way: no id stands for two word sequences."""
    bad = np.zeros(0, np.int64)
    while True:
        nodes = common.keep(node_table(keyed, kind, bad), "nodes")
        clash = nodes.where("sid is not null").groupBy("sid").agg(F.min("tag").alias("a"), F.max("tag").alias("z")).where("a <> z")
        more = np.array([r["sid"] for r in clash.select("sid").limit(100_000).collect()], np.int64)  # about documents^2 / 2^65
        if not len(more):
            return nodes.drop("tag"), bad
        common.discard(nodes)
        bad = np.union1d(bad, more)


def signature_table(keyed: DataFrame, kind: Shingles, bad: np.ndarray, percent: int = PERCENT, part: int = 0, parts: int = 1) -> DataFrame:
    """(sig, sid) of one of ``parts`` parts of the signatures; sets that a batch repeats are written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(0))
            seen = set()
            for i, j in tn.chunks(offs):
                b, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                raw, sig, sid = b.tobytes(), [], []
                for r, s in enumerate(kind.sets(b, o)):
                    if len(s) and (x := kind.ids(raw[o[r] : o[r + 1]], bad)[0]) not in seen:
                        seen.add(x)
                        own = signatures_of(s, percent)
                        sig.append(own[own % np.uint64(parts) == part] if parts > 1 else own)
                        sid.append(np.full(len(sig[-1]), x, np.int64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(sid))], names=["sig", "sid"])

    return keyed.select("text").mapInArrow(run, "sig long, sid long")


def join_components(docs: DataFrame, percent: int = PERCENT, block: int = components.BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """The documents with ``n_shingles`` and ``component_id``, the least doc_id reachable by links.

    Two documents link if 100 * |A and B| >= percent * |A or B| for their sets of different shingles
    of ``shingle`` words (ASCII letters lower-cased; with fewer words the whole sequence is the one shingle). A
    document without words has no set and links with nothing: its component is itself. Rows that
    repeat a doc_id, or have none, are documents of their own; a component of null ids only is null.
    Extra columns pass through, unless the operator makes one of that name. Links are decided on the
    sets themselves, never on hashes of their elements; copies are known by 128-bit digests.
    """
    plain, _ = common.stash(docs)
    keyed = common.with_key(plain, "keyed")
    kind = Shingles(shingle, lower=True)
    nodes, bad = nodes_of(keyed, kind)
    sets = nodes.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min("_key").alias("key"))
    parts = passes(percent)
    signatures = [signature_table(keyed, kind, bad, percent, p, parts) for p in range(parts)]
    linked = components.similar(keyed, sets, signatures, kind, percent, block)
    found = attach(keyed.select("_key", "doc_id"), nodes, linked)
    out = keyed.drop("doc_id").join(found.drop("text"), "_key")
    made = ["n_shingles", "component_id", "is_first"]
    return out.select(*common.unstash(docs, made), *made)


def attach(ids: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(_key, doc_id, n_shingles, component_id, is_first) from the sets' components; narrow rows only."""
    count = max(1, nodes.count())
    sets = nodes.where("sid is not null").groupBy("sid").agg(F.min("_key").alias("key"), F.count("*").alias("copies"))
    sets = common.keep(sets.join(linked, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "sets")
    least = sets.groupBy("comp").agg(F.min("key").alias("least"), F.count("*").alias("w"))
    home = common.keep(common.hot_join(sets, least, ["comp"], "w", count).select("sid", "copies", "least"), "home")
    full = common.hot_join(nodes.where("sid is not null"), home, ["sid"], "copies", count).select("_key", "n", "least")
    found = full.unionByName(nodes.where("sid is null").select("_key", "n", F.col("_key").alias("least")))
    out = ids.select("_key", "doc_id").join(found, "_key")
    out = out.withColumn("is_first", F.col("_key") == F.col("least"))
    names = out.where("is_first").select("least", F.col("doc_id").alias("component_id"))
    if not out.where(~F.col("_key").eqNullSafe(F.col("doc_id").cast("long"))).limit(1).count():
        out = out.withColumn("component_id", F.col("least").cast(out.schema["doc_id"].dataType))  # keys are the ids
    else:
        out = out.join(names, "least")
    return out.select("_key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "is_first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
