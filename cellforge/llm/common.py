"""What the operators share: reading tables, scratch tables, guarded joins, row keys."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows a side may have to be broadcast; counted before it is.
SMALL_ROWS = 100_000
#: Rows in an Arrow batch handed to Python: texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share, removed when the session's JVM ends."""
    return scratch.fresh_path(spark, name)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*kept: DataFrame) -> None:
    """Deletes tables written by :func:`keep` that nothing will read again."""
    for df in kept:
        path = getattr(df, "_scratch", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Frees the shuffle files of finished work: Spark deletes them when the driver's JVM has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def small_join(big: DataFrame, small: DataFrame, on, how: str = "left", limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcasts ``small`` if it has at most ``limit`` rows (counted), else a shuffle join that AQE can split."""
    return big.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, hot_keys: int = 10_000) -> DataFrame:
    """Inner join of many rows with one row a key, where a few keys may hold most of ``big``.

    ``weight`` counts a key's rows in ``big``, ``total`` all of them. Keys with at least
    total / hot_keys rows number at most ``hot_keys``, whatever the data: those are broadcast and
    their rows never move. The rest is a shuffle join without a heavy key.
    """
    least = max(2, total // hot_keys)
    hot, cold = small.where(F.col(weight) >= least), small.where(F.col(weight) < least)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def hot_left_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, hot_keys: int = 10_000) -> DataFrame:
    """The left form of :func:`hot_join`. If all of ``small`` (counted) is small, it is broadcast whole."""
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return big.join(F.broadcast(small), keys, "left")
    least = max(2, total // hot_keys)
    hot, cold = small.where(F.col(weight) >= least).withColumn("_hot", F.lit(True)), small.where(F.col(weight) < least)
    first = big.join(F.broadcast(hot), keys, "left")
    rest = first.where("_hot is null").select(*big.columns).join(cold, keys, "left")
    return first.where("_hot is not null").drop("_hot").unionByName(rest)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, natively."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words: as many as pieces between runs of space, without the empty ones at both ends."""
    p = F.split(text, SPACE)
    return F.size(p) - F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)


def crc_fold(modulus: int, c: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(modulus))


def with_key(docs: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``_key``: a long, unique to each row, that orders rows by id.

    Ids that are unique and not null serve as they are. Else the rows are written range-sorted by
    (id with nulls first, hash of the text) and numbered in that order, so that repeated rows are
    separate documents with a defined order.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    bad = ids.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k is null").limit(1).count()
    if not bad:
        return docs.withColumn("_key", F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64("text")]
    parts = shuffle_parts(docs.sparkSession)
    return keep(docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_key", F.monotonically_increasing_id()), name)


def stash(docs: DataFrame, named: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """The ``named`` columns and _c0, _c1, ...: all others under neutral names, so that none can clash."""
    plain = docs.toDF(*[f"_c{n}" for n in range(len(docs.columns))])
    at = {c: n for n, c in reversed(list(enumerate(docs.columns)))}
    rest = [f"_c{n}" for n in range(len(docs.columns)) if n not in [at[c] for c in named]]
    return plain.select(*[F.col(f"_c{at[c]}").alias(c) for c in named], *rest), rest


def unstash(docs: DataFrame, produced: list[str], named: tuple[str, ...] = ("doc_id", "text")) -> list[Column]:
    """The columns of :func:`stash` under their own names; a name the operator produces gives way to the operator's."""
    at = {c: n for n, c in reversed(list(enumerate(docs.columns)))}
    names = {at[c]: c for c in named}
    return [F.col(names.get(n, f"_c{n}")).alias(c) for n, c in enumerate(docs.columns) if c not in produced]
