"""Best-fit packing of token pieces into sequences, by a configuration linear program.

A configuration says how many pieces of each length share a sequence. The covering program over
the length histogram is solved by multiplicative weights: each round prices configurations by a
knapsack dynamic program, takes fractions of the best one for every length that still has demand,
and raises the weights of lengths whose demand falls slowly. Weights divided by the best
configuration's value are feasible for the dual program, so every round also gives a lower bound.
The fractional solution is rounded down to whole sequences; what that leaves over is packed best-fit
decreasing, on the histogram too. The driver only ever holds histograms of at most ``capacity``
lengths and the chosen configurations; pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
#: Pricing rounds at most, the part of the demand (in volume) at which they end, and how sharply demand that is left raises a weight.
ROUNDS = 60
LEFT = 1e-3
SHARPNESS = 0.5
#: Premium on long pieces: among configurations that fill a sequence, those of few long pieces come
#: first, and short pieces stay to fill the gaps of what is rounded.
PREMIUM = 0.3
#: Configurations are priced as optimal down to this share of the best value.
NEAR = 0.995
#: Characters below this are split alike by both tokenizer libraries, whatever their Unicode tables.
FIRST_SLOW = "\u0500"


def vocabulary_paths() -> tuple[str, str]:
    """(tokenizers file, the same vocabulary as ranks) of the public tokenizer that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict = {}


def encoder(json_path: str, ranks_path: str | None):
    """text -> ids of the tokenizers file. With ``ranks_path`` texts of the common scripts take a faster
    library that reads the same vocabulary as ranks and gives the same ids (tested for every character
    below FIRST_SLOW); all others, and texts that hold a special token's string, take the file itself."""
    if (json_path, ranks_path) in _encoders:
        return _encoders[json_path, ranks_path]
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    slow = lambda t: exact.encode(t, add_special_tokens=False).ids
    encode = slow
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(t: str):
            plain = (t.isascii() or max(t) < FIRST_SLOW) and not any(x in t for x in special)
            return fast.encode_ordinary(t) if plain else slow(t)

    _encoders[json_path, ranks_path] = encode
    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document; its ids end with ``end_id``.

    A document of at most ``capacity`` ids is one piece; a longer one is cut into full pieces, the
    first of which takes the remainder. A null text is empty and so the one id ``end_id``.
    """
    import zlib

    json_path, ranks_path = paths or vocabulary_paths()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            owner, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(np.asarray(encode(text or ""), np.uint32), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b].tobytes()
                    owner.append(row)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids_out.append(ids[a:b].astype(np.int32))
            cols = {
                id_col: batch.column(0).take(pa.array(owner, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                cols["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(greatest value, last piece or -1) of every capacity: an unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            got = best[c - lengths[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[c]:
                best[c], pick[c] = got[j], j
    return best, pick


def filled(lengths: list[int], pick: list[int], first: int, capacity: int) -> dict[int, int]:
    """The best configuration that holds piece ``first``, as copies of each piece."""
    copies, c = {first: 1}, capacity - lengths[first]
    while c > 0:
        j = pick[c]
        if j < 0:
            c -= 1
        else:
            copies[j] = copies.get(j, 0) + 1
            c -= lengths[j]
    return copies


def program(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """(fractional sequences of each configuration, lower bound on their sum): no length is covered beyond its demand."""
    left, out = need.astype(float), {}
    ls = lengths.tolist()
    bound = max(float((need * lengths).sum()) / capacity, float(need[lengths > capacity // 2].sum()))
    volume = float((need * lengths).sum())
    for _ in range(rounds):
        live = np.flatnonzero(left > 1e-9)
        if float((left * lengths).sum()) <= LEFT * volume or not len(live):
            break
        behind = left[live] / need[live]
        weight = lengths[live] * (1 + PREMIUM * lengths[live] / capacity) * np.exp(SHARPNESS * (behind - behind.mean()))
        best, pick = knapsack(lengths[live], weight, capacity)
        if len(live) == len(lengths):
            bound = max(bound, float((need * weight).sum() / best[-1]))
        own, picks = lengths[live].tolist(), pick.tolist()
        value = weight + best[capacity - lengths[live]]  # of the best configuration with each length
        good = np.flatnonzero(value >= NEAR * best[-1])
        if not len(good):
            good = np.array([int(value.argmax())])
        chosen = [filled(own, picks, int(j), capacity) for j in good]
        want = [left[live[j]] / c[j] for j, c in zip(good.tolist(), chosen)]
        use = np.zeros(len(live))
        for x, c in zip(want, chosen):
            for j, k in c.items():
                use[j] += x * k
        room = np.minimum(1.0, left[live] / np.maximum(use, 1e-12))
        for x, c in zip(want, chosen):
            t = x * min(room[j] for j in c)
            key = tuple(sorted(((ls[live[j]], k) for j, k in c.items()), reverse=True))
            out[key] = out.get(key, 0.0) + t
            for j, k in c.items():
                left[live[j]] -= t * k
        left = np.maximum(left, 0.0)
    return out, bound


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram, whole groups of like sequences at a time."""
    open_: dict[int, dict[tuple, int]] = {}
    for l in sorted(counts, reverse=True):
        n = counts[l]
        while n:
            fit = min((f for f, g in open_.items() if f >= l and g), default=None)
            if fit is None:
                each = capacity // l
                whole, n = divmod(n, each)
                for many, copies in ((whole, each), (1 if n else 0, n)):
                    if many:
                        g = open_.setdefault(capacity - copies * l, {})
                        g[((l, copies),)] = g.get(((l, copies),), 0) + many
                n = 0
                break
            pattern, have = next(iter(open_[fit].items()))
            each = fit // l
            use, copies = (min(have, n // each), each) if n >= each else (1, n)
            open_[fit].pop(pattern)
            if have > use:
                open_[fit][pattern] = have - use
            g = open_.setdefault(fit - copies * l, {})
            p = (*pattern, (l, copies))
            g[p] = g.get(p, 0) + use
            n -= use * copies
            if not open_[fit]:
                del open_[fit]
    return [(p, n) for g in open_.values() for p, n in g.items()]


def configure(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((length, copies), ...) with the number of sequences that use each.

    The fractional solution's configurations are rounded down; configurations that hold the same longest
    piece pass what rounding cuts off on to the next of them, as far as the demand still allows."""
    out: list = []
    if counts.get(capacity):
        out.append((((capacity, 1),), counts[capacity]))
    lengths = np.array(sorted(l for l, n in counts.items() if n and l < capacity), np.int64)
    if not len(lengths):
        return out
    need = np.array([counts[int(l)] for l in lengths], np.int64)
    solution, _ = program(lengths, need, capacity, rounds)
    left = {int(l): int(n) for l, n in zip(lengths, need)}
    carry: dict[int, float] = {}
    for pattern, x in sorted(solution.items(), reverse=True):
        x += carry.get(pattern[0][0], 0.0)
        times = min(int(x + 1e-9), *(left[l] // k for l, k in pattern))
        carry[pattern[0][0]] = x - times
        if times:
            for l, k in pattern:
                left[l] -= times * k
            out.append((pattern, times))
    return out + best_fit({l: n for l, n in left.items() if n}, capacity)


def slots(configs: list) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by rank: rows sorted by (length, first rank)."""
    rows, base, seen = [], 0, {}
    for pattern, times in configs:
        at = 0
        for l, copies in pattern:
            first = seen.get(l, 0)
            rows.append((l, first, base, times, at))
            seen[l] = first + copies * times
            at += l * copies
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 48) + a[:, 1], "first": a[:, 1], "base": a[:, 2], "times": a[:, 3], "at": a[:, 4]}


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, rounds: int = ROUNDS, in_order: bool = False) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces (it is read more than once).

    The rank of a piece among those of its length is split by a hash of its id, so that the full
    pieces, the most frequent length by far, are numbered by many tasks. An empty table packs into
    nothing; repeated rows are pieces of their own. With ``in_order`` ids are places from 0 on, and
    ranks follow them: ranges of places take the part of the hash.
    """
    spark = cut.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    place = spark.sparkContext.broadcast(slots(configure(hist, capacity, rounds)))
    buckets = min(4096, max(1, sum(hist.values()) // 20_000))
    bucket = F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets))
    if in_order:
        bucket = F.floor(F.col(id_col) * buckets / ((cut.agg(F.max(id_col)).first()[0] or 0) + 1))
    d = cut.withColumn("_b", bucket)
    before = d.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_b").orderBy(id_col, "piece", "ids_crc32")
    d = d.withColumn("_in", F.row_number().over(own) - 1).join(before, ["length", "_b"])
    d = d.select(*cut.columns, (F.col("_before") + F.col("_in")).cast("long").alias("_rank"))
    n = len(cut.columns)

    def run_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = place.value
        for batch in batches:
            l = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            j = np.searchsorted(s["key"], (l << 48) + rank, side="right") - 1
            r = rank - s["first"][j]
            seq = s["base"][j] + r % s["times"][j]
            off = s["at"][j] + r // s["times"][j] * l
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:n], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return d.mapInArrow(run_place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(common.keep(pieces(docs), "pieces"))


def stored_order(docs: DataFrame) -> DataFrame:
    """Adds ``position``: rows of a stored table in the order of its files and of the rows in them, from 0 on.

    Spark names the files of a range-sorted table in its order. Places are counted a file at a time,
    so only one row a file meets in one task.
    """
    from pyspark.errors import AnalysisException

    try:
        d = docs.withColumns({"_f": F.col("_metadata.file_path"), "_r": F.col("_metadata.row_index")})
        d.schema
    except AnalysisException:  # not a stored table: the order of its partitions
        n = F.monotonically_increasing_id()
        d = docs.withColumns({"_f": F.shiftright(n, 33).cast("string"), "_r": n.bitwiseAND(F.lit((1 << 33) - 1))})
    files = d.groupBy("_f").agg(F.count("*").alias("_n"))  # one row a file
    before = Window.orderBy(F.length("_f"), "_f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return common.small_join(d, files, "_f", "inner").withColumn("position", F.col("_before") + F.col("_r")).drop("_f", "_r", "_before")


def pack_in_order(docs: DataFrame) -> DataFrame:
    """:func:`pack_documents` along a stored order: adds ``position``, a document's place in it.

    Of equal length earlier pieces take earlier sequences; sequences are then numbered by their first
    position. Rows that repeat a document are copies of their own.
    """
    placed = stored_order(docs.drop("position"))
    cut = common.keep(pieces(placed, id_col="position").join(placed.select("position", "doc_id"), "position"), "pieces")
    packed = common.keep(pack(cut, id_col="position", in_order=True), "packed")
    first = packed.groupBy("sequence_id").agg(F.min("position").alias("_first"))
    parts = common.shuffle_parts(docs.sparkSession)
    ordered = common.keep(first.repartitionByRange(parts, "_first", "sequence_id").sortWithinPartitions("_first", "sequence_id"), "sequences")
    numbered = stored_order(ordered).select("sequence_id", F.col("position").alias("_number"))
    out = packed.join(numbered, "sequence_id")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_number").alias("sequence_id"), "offset", "position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
