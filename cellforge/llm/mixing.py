"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule w(t) = share * (1 + ramp * (2t - 1)) over training time t in
[0, 1]. Its integral is the source's target; a document copy's place in the source's cumulative
demand is inverted to its training position, and copies are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1.0, 2.0, 3.0)
#: Schedule slopes that go with the weights: light sources early, heavy ones late.
RAMPS = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
SEED = "mix"
#: Hex digits of the order key that split a source's running sum: 4,096 buckets a source.
BUCKET_HEX = 3


def _cycle(values: tuple[float, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, ramp), one row a source.

    Sources sorted by cap / weight: a source is capped exactly if its ratio is at most the level
    that is left for it and all after it. That is the fixed point of sharing the excess anew. The
    windows run over one row a source, after the sizes were summed map-side.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.select("source", "source_size", _cycle(weights, rank).alias("w"), _cycle(ramps, rank).alias("ramp")).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left_w = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    src = src.withColumn("capped", F.col("cap") / F.col("w") <= (F.col("total") - before) / left_w)
    every = Window.partitionBy()
    free_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("w") * (F.col("total") - used) / free_w))
    return src.select("source", "source_size", target.alias("target"), "ramp")


def _position(u: Column, ramp: Column) -> Column:
    """t with t + ramp * (t^2 - t) = u: the inverse of the schedule's normalised integral."""
    return 2 * u / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u))


MADE = ["size", "source_size", "target", "passes", "taken", "offset", "ramp", "position"]


def plan(docs: DataFrame, size: Column, weights=WEIGHTS, ramps=RAMPS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds to the documents: size, source_size, target, passes, taken, offset, ramp and position.

    A source's documents form a stream in the order of md5(seed, id). The mix takes the stream
    whole as often as it fits the target, then its beginning up to the document whose middle
    passes what is left; so the taken words miss the target by half a document at most.
    ``position`` is the first copy's, null for documents the mix leaves out.

    Running sums are split: documents meet in one task by (source, first digits of the key), and
    the sums of these buckets are added up apart, so a source with a third of all rows is spread
    over thousands of groups. Nulls: no text has size 0; a null source is a source of its own,
    the last; a null id is ordered as the text "null". Repeated rows are documents of their own. Extra columns
    pass through, unless the operator makes one of that name.
    """
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    named = ("doc_id", "source", "_size")
    sized = docs.withColumn("_size", size.cast("long"))
    plain, _ = common.stash(sized, named)
    d = plain.withColumnRenamed("_size", "size").withColumn("_k", key).withColumn("_b", F.substring("_k", 1, BUCKET_HEX)).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sums = common.keep(d.groupBy("_s", "source", "_b").agg(F.sum("size").alias("size")), "sizes")  # 4,096 rows a source at most
    src = targets(sums.select("source", "size"), weights, ramps, max_epochs).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    buckets = sums.select("_s", "_b", F.col("size").alias("_n"))
    run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_s", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before")).join(src, "_s")
    own = Window.partitionBy("_s", "_b").orderBy("_k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(own), F.lit(0))).join(buckets, ["_s", "_b"])
    d = d.withColumn("offset", F.col("_before") + F.col("_in"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    d = d.withColumn("_w", whole.cast("long"))
    rest = F.col("target") - F.col("_w") * F.col("source_size")
    d = d.withColumn("passes", F.when(F.col("size") > 0, F.col("_w") + F.when(F.col("offset") + F.col("size") / 2 <= rest, 1).otherwise(0)).otherwise(0).cast("int"))
    u = F.least(F.lit(1.0), (F.col("offset") + F.col("size") / 2) / F.col("target"))
    d = d.withColumns({"taken": F.col("passes") * F.col("size"), "position": F.when(F.col("passes") > 0, _position(u, F.col("ramp")))})
    return d.select(*common.unstash(sized, ["_size", *MADE], named), *MADE)


def curriculum(planned: DataFrame) -> DataFrame:
    """A row for each copy the mix takes, with its epoch and training position, range-sorted by position.

    A column called epoch gives way to the operator's.
    """
    c = planned.drop("epoch").where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    u = F.least(F.lit(1.0), (F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("size") / 2) / F.col("target"))
    c = c.withColumn("position", _position(u, F.col("ramp")))
    parts = common.shuffle_parts(planned.sparkSession)
    return c.repartitionByRange(parts, "position").sortWithinPartitions("position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(common.text_or_empty()).alias("_words"))
    p = plan(common.keep(docs, "words"), F.col("_words"))  # the texts are read once
    out = p.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", F.round("position", 9).alias("position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]  # documents that the mix leaves out have no position and come last
    return out.repartitionByRange(common.shuffle_parts(spark), *order).sortWithinPartitions(*order)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s0),
s2 AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (w - 2) / 2 AS ramp, (sum(source_size) OVER ())::DOUBLE AS total FROM s1),
s3 AS (SELECT *, cap / w <= (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM s2),
s4 AS (SELECT source, source_size, ramp, CASE WHEN capped THEN cap ELSE least(cap, w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
                / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM s3),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM d),
j AS (SELECT o.*, source_size, target, ramp, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
      FROM o JOIN s4 ON o.source IS NOT DISTINCT FROM s4.source),
p AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN offs + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END AS passes FROM j),
t AS (SELECT *, least(1.0::DOUBLE, (offs + size / 2) / target) AS u FROM p)
"""
ORACLE_SQL = (
    ORACLE
    + """SELECT doc_id, size, source_size, round(target, 4) AS target, (passes * size)::BIGINT AS taken,
  CASE WHEN passes > 0 THEN round(2 * u / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)), 9) END AS position FROM t"""
)
