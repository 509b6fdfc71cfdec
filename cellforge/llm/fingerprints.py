"""Document fingerprints by MinHash, and the near-duplicate join over their bands.

A document's set is its different 5-word shingles (with fewer words, the whole sequence as one).
Each of PERMUTATIONS universal hash permutations x -> a * x + b of the 32-bit shingle hashes keeps
its least value, of which the fingerprint holds 16 bits as four hex digits. The share of equal
places estimates the sets' Jaccard similarity; a document without words has a fingerprint of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textnum as tn
from .shingles import Shingles, shingle_hashes

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
SIMILARITY = 0.8
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def signatures(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, PERMUTATIONS) of 16 bits; 0xFFFF in all places for a text without words."""
    h, rows = shingle_hashes(b, offsets, SHINGLE)
    out = np.full((len(rows) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    has = np.flatnonzero(np.diff(rows))
    if len(has):
        x = (h >> np.uint64(32)).astype(np.uint32)
        first = rows[has]
        for k in range(PERMUTATIONS):
            out[has, k] = np.minimum.reduceat(x * _A[k] + _B[k], first).astype(np.uint16)
    return out


def batch_signatures(column: pa.Array) -> np.ndarray:
    data, offs = tn.buffer(column)
    parts = [signatures(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in tn.chunks(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def texts_of(sig: np.ndarray) -> list[str]:
    """Four hex digits for each place."""
    return [r.tobytes().hex() for r in sig.astype(">u2")]


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``fingerprint``; one pass, no shuffle. A null text is an empty one."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts_of(batch_signatures(batch.column(at))))], names=[*batch.schema.names, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, fingerprint string")


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """Runs ``fn(ids, texts, i, j) -> batch`` over documents in ascending id: texts[i] are theirs, texts[j] the next ones'.

    After the last document comes the first; rows of equal id follow each other by their texts'
    hashes, a null id comes first. The keys are cut into as many ranges as there are shuffle
    partitions; the first document of a range also goes to the end of the range before it, so a text
    moves once and no task sees more than its range.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = common.with_key(docs.select("doc_id", "text"), "keyed")
    parts = common.shuffle_parts(spark)
    cuts = keyed.agg(F.percentile_approx("_key", F.array(*[F.lit(n / parts) for n in range(1, parts)]), F.lit(100 * parts)).alias("q")).first()["q"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("_key"))).cast("int")
    firsts = {int(r["b"]): int(r["k"]) for r in keyed.groupBy(bucket.alias("b")).agg(F.min("_key").alias("k")).collect()}  # one row a range
    order = sorted(firsts)
    before = {firsts[b]: order[n - 1] for n, b in enumerate(order)}  # the last range ends with the very first document
    tail = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    places = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("t")))
    at = F.try_element_at(tail, F.col("_key")) if before else F.lit(None).cast("int")
    dealt = keyed.withColumn("_at", at).withColumn("_p", F.explode(F.when(F.col("_at").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("_at").cast("int").alias("b"), F.lit(1).alias("t")))))))
    dealt = dealt.select(F.col("_p.b").alias("_b"), F.col("_p.t").alias("_t"), "_key", "doc_id", "text").repartition(parts, "_b").sortWithinPartitions("_b", "_t", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = batch.select(["_b", "_t", "doc_id", "text"])
            t = pa.Table.from_batches([held, batch]) if held is not None else pa.Table.from_batches([batch])
            t = t.combine_chunks()
            if t.num_rows > 1:
                b, tail_row = t.column("_b").to_numpy(), t.column("_t").to_numpy()
                use = np.flatnonzero((tail_row[:-1] == 0) & (b[:-1] == b[1:]))
                for x in range(0, len(use), 512):
                    i = use[x : x + 512]
                    rows = np.union1d(i, i + 1)
                    texts = _flat(t.column("text").take(pa.array(rows)))
                    yield fn(_flat(t.column("doc_id").take(pa.array(i))), texts, np.searchsorted(rows, i), np.searchsorted(rows, i + 1))
            held = t.slice(t.num_rows - 1).to_batches()[0] if t.num_rows else held

    return dealt.mapInArrow(run, f"doc_id {kind}, {schema}")


def _flat(c) -> pa.Array:
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _compare(ids: pa.Array, texts: pa.Array, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Fingerprints of texts, of their edited forms, and how alike they are."""
    plain = [t or "" for t in texts.to_pylist()]
    edited, n_chars = [], []
    for a, b in zip(i.tolist(), j.tolist()):
        t = plain[a]
        k = len(t) // 2
        edited.append(t[: len(t) - k] + plain[b][:k])
        n_chars.append(len(t))
    sig, new = batch_signatures(texts), batch_signatures(pa.array(edited, pa.string()))
    own, nxt = sig[i], sig[j]
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    cols = [ids, pa.array(n_chars, pa.int64()), pa.array(digest), pa.array(texts_of(own)), pa.array(texts_of(new)), pa.array((own == new).mean(1)), pa.array((own == nxt).mean(1))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


KIND = Shingles(SHINGLE, lower=False)


def band_table(keyed: DataFrame, bad: np.ndarray) -> DataFrame:
    """(sig, sid): a signature for each band of a document's fingerprint."""
    wide = PERMUTATIONS // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(0))
            for x, y in tn.chunks(offs):
                b, o = data[offs[x] : offs[y]], offs[x : y + 1] - offs[x]
                raw = b.tobytes()
                ids = [KIND.ids(raw[o[r] : o[r + 1]], bad)[0] for r in range(y - x)]
                has = [r for r, k in enumerate(ids) if k is not None]
                if not has:
                    continue
                sid = np.array([ids[r] for r in has], np.int64)
                bands = signatures(b, o)[has].astype(np.uint64).reshape(len(has), BANDS, wide)
                with np.errstate(over="ignore"):
                    key = (bands << (np.arange(wide, dtype=np.uint64) * np.uint64(16))).sum(2) + tn.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(tn.mix(key).ravel().view(np.int64)), pa.array(np.repeat(sid, BANDS))], names=["sig", "sid"])

    return keyed.select("text").mapInArrow(run, "sig long, sid long")


def near_duplicates(docs: DataFrame, percent: int = int(100 * SIMILARITY)) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of verified links of at least ``percent`` Jaccard.

    Candidates share a band of their fingerprints; links are decided on the shingle sets. A pair at
    0.8 shares one of 32 bands of 4 with a chance of over 0.9999999. Documents without words link
    with nothing.
    """
    from . import components, partenum

    keyed = common.with_key(docs.select("doc_id", "text"), "keyed")
    nodes, bad = partenum.nodes_of(keyed, KIND)
    sets = nodes.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min("_key").alias("key"))
    linked = components.similar(keyed, sets, band_table(keyed, bad), KIND, percent)
    return partenum.attach(keyed, nodes, linked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs, _compare, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
