"""Finding every repeated window of a corpus, exactly, without pairing documents.

1. Anchors. Each window of ``window`` units (bytes or words) is assigned an anchor gram by content
   (see textnum.anchors); neighbouring windows share one. An anchor with its run of windows is an
   occurrence: (h, ctx, key, lo, span), where h is the gram's hash, ctx a digest of all the run's
   units, and [lo, lo + span] the starts of its windows. Equal windows have equal h, so windows whose
   h occurs once are unique and drop out before anything else is computed or moved.
2. Claims. Occurrences of equal (h, ctx) propose that their runs are equal; all but the first claim the
   first as their witness. Claims of one document on the same diagonal of one witness are merged
   into maximal ones. Equal hashes remove nothing: the units of a claim meet those of its witness
   in a reference shard, and only what the shard's index finds there counts.
3. Contested anchors, of several ctx: the first occurrence of each ctx goes to the shard of its anchor,
   which finds the windows that also occur in another. An anchor of more than ``hot`` different ctx
   is dealt out by its windows instead: windows of equal hash become claims like those above.

Both kinds of shards are decided by the operator's ``Index`` (suffix arrays or suffix automata). A
shard has a bounded number of units: a witness in demand is replicated to as many shards as its
claims fill, a long one is cut into blocks.

A refused claim shows that two different runs have equal digests; then everything is done again under
another salt.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textnum as tn

#: Representatives in a contested shard, and the number of an anchor's contexts beyond which it is dealt out by windows.
SHARD = 2048
HOT = 2048
#: Bits of the filter of repeated anchors that is broadcast: 2^28 bits are 32 MB; beyond their use it only filters less.
MAX_FILTER_BITS = 28
#: Buckets of keys that are broadcast to spare untouched documents a shuffle; any that share a bucket just come along.
KEY_BUCKETS = 1 << 20


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    kind: str  # "byte" or "word"
    window: int
    gram: int

    @property
    def shard(self) -> int:
        """Units of a witness shard, about."""
        return 1 << 20 if self.kind == "byte" else 1 << 17

    @property
    def block(self) -> int:
        """Units of a claim, and of the part of a witness that is indexed apart."""
        return self.shard // 4

    def read(self, b: np.ndarray, offsets: np.ndarray, salt: int):
        """(hash of each unit, row offsets in units, byte starts, byte ends); bytes are their own places."""
        if self.kind == "byte":
            return None, offsets, None, None
        s, e, rows = tn.word_spans(b, offsets)
        return tn.strong_words(b, s, e, salt), rows, s, e

    def anchors(self, b: np.ndarray, values, rows: np.ndarray):
        prefix = tn.Prefix(tn.byte_values(b) if values is None else values)
        return tn.anchors(prefix, rows, self.window, self.gram)


Index = Callable[[list, list, bool], tuple[list, list]]


def bitmap(repeated: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(64-bit words, bits): a set bit for the leading bits of every repeated hash."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, n))), 16, MAX_FILTER_BITS))
    place = F.shiftrightunsigned("h", 64 - bits)
    got = repeated.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("b"))
    got = got.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2^bits / 64 rows
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return words, bits


def hits(words: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def repeated_hashes(docs: DataFrame, units: Units, salt: int) -> DataFrame:
    """(h): anchors that occur more than once; counted map-side first, so a frequent one moves once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(0))
            for i, j in tn.chunks(offs):
                b = data[offs[i] : offs[j]]
                values, rows, _, _ = units.read(b, offs[i : j + 1] - offs[i], salt)
                h, n = np.unique(units.anchors(b, values, rows)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n byte")
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def occurrences(docs: DataFrame, units: Units, salt: int, shared, bits: int) -> DataFrame:
    """(h, ctx, key, lo, span) of the documents' anchors (``_key``, ``text``) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = tn.buffer(batch.column(1))
            for i, j in tn.chunks(offs):
                b = data[offs[i] : offs[j]]
                values, rows, _, _ = units.read(b, offs[i : j + 1] - offs[i], salt)
                row, lo, hi, h = units.anchors(b, values, rows)
                at = np.flatnonzero(hits(words, bits, h))
                row, lo, hi, h = row[at], lo[at], hi[at], h[at]
                raw, wide = (b.tobytes(), 1) if values is None else (values.tobytes(), 8)
                ctx = [tn.digest(raw[x * wide : y * wide], salt) for x, y in zip(lo.tolist(), (hi + units.window).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(keys[i + row]), pa.array((lo - rows[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                    names=["h", "ctx", "key", "lo", "span"],
                )

    return docs.select("_key", "text").mapInArrow(run, "h long, ctx long, key long, lo int, span int")


def _bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket")


def touched(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose bucket holds one of the keys, all others): the latter never move."""
    some = F.broadcast(keys.select(_bucket("key")).distinct())  # at most KEY_BUCKETS rows
    d = docs.withColumn("_bucket", _bucket("_key"))
    return d.join(some, "_bucket", "left_semi").drop("_bucket"), d.join(some, "_bucket", "left_anti").drop("_bucket")


def _runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_key, text, runs) of the documents that have wanted runs (key, and any columns)."""
    cols = [c for c in wanted.columns if c != "key"]
    per = wanted.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct(*cols)).alias("runs"))
    return touched(docs.select("_key", "text"), wanted)[0].join(per, "_key")


def _flat(batch: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray]:
    runs = batch.column(2)
    flat, at = runs.flatten(), np.append(0, np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False)))
    return [flat.field(k) for k in range(flat.type.num_fields)], at


def carried(docs: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """The wanted runs (key, lo, size, g, kind, h) with ``body``: their units' bytes, whatever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(1))
            (lo, size, g, kind, h), at = _flat(batch)
            lo, size = lo.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tn.chunks(offs):
                b = data[offs[i] : offs[j]]
                o = offs[i : j + 1] - offs[i]
                if units.kind == "byte":
                    rows, s, e = o, None, None
                else:
                    s, e, rows = tn.word_spans(b, o)
                doc = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                start = rows[doc] + lo[at[i] : at[j]]
                end = np.minimum(start + size[at[i] : at[j]], rows[doc + 1])
                raw = b.tobytes()
                a, z = (start, end) if s is None else (s[start], e[end - 1])
                body = [raw[x:y] for x, y in zip(a.tolist(), z.tolist())]
                take = pa.array(i + doc)
                r = slice(at[i], at[j])
                for x in range(0, len(body), 4096):
                    k = slice(x, x + 4096)
                    cols = [batch.column(0).take(take[k]), pa.array(lo[r][k].astype(np.int32)), g[r][k], kind[r][k], h[r][k], pa.array(body[k], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "lo", "g", "kind", "h", "body"])

    return _runs(docs, wanted.select("key", "lo", "size", "g", "kind", "h")).mapInArrow(run, "key long, lo int, g long, kind byte, h long, body binary")


def windows_of(docs: DataFrame, wanted: DataFrame, units: Units, salt: int) -> DataFrame:
    """(h, w, key, start): every window of the wanted runs (key, lo, span, h) with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = tn.buffer(batch.column(1))
            (lo, span, h), at = _flat(batch)
            lo, span, h = (x.to_numpy(zero_copy_only=False) for x in (lo, span, h))
            for i, j in tn.chunks(offs):
                b = data[offs[i] : offs[j]]
                values, rows, _, _ = units.read(b, offs[i : j + 1] - offs[i], salt)
                strong = tn.Strong(tn.TABLE61[b] if values is None else values >> np.uint64(3), salt)
                doc, r = np.repeat(np.arange(j - i), np.diff(at[i : j + 1])), slice(at[i], at[j])
                start, wide = rows[doc] + lo[r], span[r].astype(np.int64) + 1
                k = np.repeat(np.arange(len(start)), wide)
                off = np.arange(len(k)) - np.repeat(np.cumsum(wide) - wide, wide)
                w = strong.span(start[k] + off, start[k] + off + units.window)
                yield pa.RecordBatch.from_arrays([pa.array(h[r][k]), pa.array(w.view(np.int64)), pa.array(keys[i + doc][k]), pa.array((lo[r][k] + off).astype(np.int32))], names=["h", "w", "key", "start"])

    return _runs(docs, wanted.select("key", "lo", "span", "h")).mapInArrow(run, "h long, w long, key long, start int")


def _claim(rows: DataFrame, keep_first: bool, start: str, size) -> DataFrame:
    """(key, s, e, wkey, ws): occurrences with their class's ``first`` and ``last`` claim a witness."""
    own = (F.col("key") == F.col("first.key")) & (F.col(start) == F.col(f"first.{start}"))
    if keep_first:
        witness = lambda f: F.col(f"first.{f}")
        rows = rows.where(~own)
    else:
        witness = lambda f: F.when(own, F.col(f"last.{f}")).otherwise(F.col(f"first.{f}"))
    return rows.select("key", F.col(start).alias("s"), (F.col(start) + size).cast("int").alias("e"), witness("key").alias("wkey"), witness(start).alias("ws"))


def merged_claims(claims: DataFrame, units: Units) -> DataFrame:
    """Claims of a document that touch on one diagonal of one witness become one; long ones are cut into overlapping blocks."""

    window, block = units.window, units.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(keys)), n)
            s, e, wkey, ws = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            diag = s - ws
            order = np.lexsort((s, diag, wkey, doc))
            doc, s, e, wkey, diag = (x[order] for x in (doc, s, e, wkey, diag))
            other = np.append(True, (doc[1:] != doc[:-1]) | (wkey[1:] != wkey[:-1]) | (diag[1:] != diag[:-1]))
            base = np.cumsum(other) << 40
            reach = np.maximum.accumulate(base + e)  # how far the claims before reach, within the same diagonal
            new = np.append(True, base[1:] + s[1:] > reach[:-1])
            first = np.flatnonzero(new)
            end = np.maximum.reduceat(e, first) if len(first) else e[:0]
            doc, s, wkey, diag = (x[first] for x in (doc, s, wkey, diag))
            step = block - window + 1
            pieces = np.maximum(1, -(-(end - s - window + 1) // step))
            k = np.repeat(np.arange(len(s)), pieces)
            at = s[k] + step * (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            to = np.minimum(end[k], at + block)
            cols = [keys[doc][k], at.astype(np.int32), to.astype(np.int32), wkey[k], (at - diag[k]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "s", "e", "wkey", "ws"])

    per = claims.groupBy("key").agg(F.collect_list(F.struct("s", "e", "wkey", "ws")).alias("c"))
    return per.mapInArrow(run, "key long, s int, e int, wkey long, ws int")


def repeated_spans(docs: DataFrame, units: Units, index: Index, keep_first: bool, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(key, s, e): spans of units covered by repeated windows; spans may overlap.

    ``docs`` has ``_key`` (unique, ordering) and ``text``. With ``keep_first`` a window counts if an
    equal one starts earlier, by (key, start); else if an equal one starts anywhere else.
    ``index(references, streamed, contested)`` gets runs (key, lo, bytes, anchor) of a shard. Contested:
    references only, for each of which it returns the spans of windows that occur in another of its
    anchor under the same rule. Else it returns for each streamed run the spans that occur among the
    references.
    """
    for salt in range(4):
        out = _attempt(docs, units, index, keep_first, hot, shard, salt)
        if out is not None:
            return out
    raise RuntimeError("different runs had equal digests under four salts")


def _attempt(docs: DataFrame, units: Units, index: Index, keep_first: bool, hot: int, shard: int, salt: int) -> DataFrame | None:
    spark, w = docs.sparkSession, units.window
    repeated = common.keep(repeated_hashes(docs, units, salt), "repeated")
    words, bits = bitmap(repeated, repeated.count())
    common.discard(repeated)
    shared = spark.sparkContext.broadcast(words)
    occ = common.keep(occurrences(docs, units, salt, shared, bits), "anchors")
    shared.destroy()
    total = max(1, occ.count())
    ends = lambda *c: [F.count("*").alias("n"), F.min(F.struct(*c)).alias("first"), F.max(F.struct(*c)).alias("last")]
    by_h = common.keep(occ.groupBy("h").agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1"), *ends("key", "lo")).where("n > 1"), "by-anchor")
    agreed = by_h.where("c0 = c1").select("h", "n", "first", "last")
    claims = common.keep(_claim(common.hot_join(occ.select("h", "key", "lo", "span"), agreed, ["h"], "n", total), keep_first, "lo", F.col("span") + w), "agreed")
    disputed = common.keep(common.hot_join(occ, by_h.where("c0 <> c1").select("h", "n"), ["h"], "n", total).drop("n"), "disputed")
    common.discard(occ, by_h)
    used = [claims, disputed]
    classes = common.keep(disputed.groupBy("h", "ctx").agg(*ends("key", "lo", "span")), "classes")
    used.append(classes)
    again = common.hot_join(disputed, classes.where("n > 1"), ["h", "ctx"], "n", max(1, disputed.count()))
    claims = claims.unionByName(_claim(again, keep_first, "lo", F.col("span") + w))

    # contested anchors, light and heavy
    heavy = common.keep(classes.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > hot), "heavy")  # at most (classes / hot) rows
    used.append(heavy)
    reps = light = classes.select("h", "first.key", "first.lo", "first.span")
    if heavy.limit(1).count():
        light = common.small_join(reps, heavy.select("h"), "h", "left_anti")
        wins = common.keep(windows_of(docs, common.small_join(reps, heavy.select("h"), "h", "left_semi"), units, salt), "windows")
        seen = common.keep(wins.groupBy("h", "w").agg(*ends("key", "start")).where("n > 1"), "seen")
        used += [wins, seen]
        hit = common.hot_join(wins, seen, ["h", "w"], "n", max(1, wins.count()))
        claims = claims.unionByName(_claim(hit, keep_first, "start", F.lit(w)))
    parts = max(1, -(-classes.count() // shard))
    shards = light.select("key", "lo", (F.col("span") + w).alias("size"), F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(parts)).alias("g"), F.lit(0).cast("byte").alias("kind"), "h")

    claims = common.keep(merged_claims(claims, units), "claims")
    common.discard(*used[:2], *used[4:])
    wanted = common.keep(shards.unionByName(_witnessed(claims, units)), "wanted")
    common.discard(*used[2:4])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "h", "key", "lo"], kind="stable")
        out = []
        contested = pdf["kind"].iloc[0] == 0
        side = [list(zip(p["key"].tolist(), p["lo"].tolist(), p["body"].tolist(), p["h"].tolist())) for p in ((pdf, pdf[:0]) if contested else (pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 2]))]
        found, refused = index(*side, contested)
        for key, s, e in found:
            out.append((key, s, e, True))
        out += [(run[0], run[1], run[1], False) for run in refused]
        return pd.DataFrame(out, columns=["key", "s", "e", "ok"]).astype({"key": "int64", "s": "int32", "e": "int32", "ok": "bool"})

    body = carried(docs, wanted, units)
    found = common.keep(body.groupBy(F.col("kind") > 0, "g").applyInPandas(decide, "key long, s int, e int, ok boolean"), "spans")
    common.discard(claims, wanted)
    if found.where("not ok").limit(1).count():
        common.discard(found)
        return None
    return found.drop("ok")


def _witnessed(claims: DataFrame, units: Units) -> DataFrame:
    """(key, lo, size, g, kind, h) of claims (kind 2) and of their witnesses (kind 1).

    A witness's blocks are indexed apart. A block in demand gets a copy of its claimed range for each
    units.shard of claims, over which these are spread by their key. Copies and their claims are dealt
    into shards of about units.shard.
    """
    c = claims.withColumns({"b": F.floor(F.col("ws") / units.block), "size": F.col("e") - F.col("s")})
    demand = c.groupBy("wkey", "b").agg(F.min("ws").alias("lo"), F.max(F.col("ws") + F.col("size")).alias("hi"), F.sum("size").alias("units"), F.count("*").alias("n"))
    demand = common.keep(demand.withColumn("copies", F.ceil(F.col("units") / units.shard)), "demand")
    size = demand.agg(F.sum(F.col("units") + F.col("copies") * (F.col("hi") - F.col("lo")))).first()[0] or 0
    shard = lambda salt: F.pmod(F.xxhash64("wkey", "b", salt), F.lit(max(1, -(-size // units.shard))))
    refs = demand.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    refs = refs.select(F.col("wkey").alias("key"), "lo", (F.col("hi") - F.col("lo")).alias("size"), shard("salt").alias("g"), F.lit(1).cast("byte").alias("kind"), F.lit(0).cast("long").alias("h"))
    many = demand.where("copies > 1").select("wkey", "b", "copies", "n")  # at most (all claimed units / units.shard) rows
    spread = common.hot_left_join(c, many, ["wkey", "b"], "n", max(1, claims.count())).withColumn("salt", F.pmod(F.xxhash64("key", "s"), F.coalesce("copies", F.lit(1).cast("long"))))
    return refs.unionByName(spread.select("key", F.col("s").alias("lo"), "size", shard("salt").alias("g"), F.lit(2).cast("byte").alias("kind"), F.lit(0).cast("long").alias("h")))


def merged(spans: DataFrame) -> DataFrame:
    """(key, spans): the spans of each document. Their number is bounded by the document's length."""
    return spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def joined(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by windows at these ascending starts."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, np.diff(starts) > window))
    last = np.append(new[1:], len(starts)) - 1
    return list(zip(starts[new].tolist(), (starts[last] + window).tolist()))


def cut(docs: DataFrame, spans: DataFrame, units: Units, columns: list[str], text_kind: str) -> DataFrame:
    """The documents' ``columns`` with n_units, n_removed, n_spans and ``kept``: the units outside all spans.

    Words are joined by one space; bytes follow each other. ``text_kind`` is string or binary.
    """
    per = merged(spans).withColumnRenamed("key", "_key")
    d, rest = touched(docs.select("_key", "text", *[c for c in columns if c != "text"]), spans)
    none = F.array().cast("array<struct<s:int,e:int>>")
    is_word = units.kind == "word"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(1))
            runs = batch.column(batch.schema.get_field_index("spans")).fill_null([])
            flat, at = runs.flatten(), np.append(0, np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False)))
            s, e = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            n_units, n_removed, n_spans, kept = [], [], [], []
            for i, j in tn.chunks(offs):
                b = data[offs[i] : offs[j]]
                o = offs[i : j + 1] - offs[i]
                rows = tn.word_spans(b, o)[2] if is_word else o
                doc = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                gone = tn.covered(int(rows[-1]), rows[doc] + s[at[i] : at[j]], rows[doc] + e[at[i] : at[j]])
                raw = b.tobytes()
                for r in range(j - i):
                    a, z = int(rows[r]), int(rows[r + 1])
                    g = gone[a:z]
                    removed = int(g.sum())
                    n_units.append(z - a)
                    n_removed.append(removed)
                    n_spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0)
                    if is_word:  # bytes.split() splits at the same six separators
                        parts = raw[o[r] : o[r + 1]].split()
                        kept.append(b" ".join(itertools.compress(parts, (~g).tolist()) if removed else parts))
                    else:
                        kept.append(b[a:z][~g].tobytes() if removed else raw[a:z])
            out = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            arr = pa.array(kept, pa.binary())
            out += [pa.array(x, pa.int64()) for x in (n_units, n_removed, n_spans)] + [arr.cast(pa.string()) if text_kind == "string" else arr]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_units", "n_removed", "n_spans", "kept"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["n_units long, n_removed long, n_spans long", f"kept {text_kind}"])
    hit = d.join(per, "_key", "left").mapInArrow(run, schema)
    return hit.unionByName(rest.withColumn("spans", none).mapInArrow(run, schema))
