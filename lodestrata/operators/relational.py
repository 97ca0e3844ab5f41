"""Joins, aggregates, windows and set operations that the corpus pipelines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What a slot is thought to read at once.
SPLIT_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Without that setting only a local master may go on, with a folder of its own: a cluster's
    executors could not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lodestrata-checkpoints-")
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function for loops that writes rows to a table in the shared folder and reads them back.

    A checkpoint keeps what Spark knows of the rows' order and of equal columns; over many rounds of
    joins that multiplies until planning takes longer than running. A table begins anew. The
    tables are deleted at the end, so what is returned is to be cut before.
    """
    top, number = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", count()

    def settle(df: DataFrame) -> DataFrame:
        path = f"{top}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield settle
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan dealt to all slots; an input that fills them stays where it is.

    A table of a few row groups is read by as many tasks, however many slots there are. The size
    is the plan's own estimate, so nothing runs.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(slots) if size < slots * SPLIT_BYTES else df


def ranked(df: DataFrame, keys: list, order: list, name: str = "rank") -> DataFrame:
    """Row number within keys by a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top_per_key(df: DataFrame, keys: list, order: list, k: int, name: str = "rank") -> DataFrame:
    return ranked(df, keys, order, name).where(F.col(name) <= k)


def latest(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The newest row of each key."""
    return top_per_key(df, keys, order, 1, "_newest").drop("_newest")


def per_document_cap(df: DataFrame, query: str, doc: str, rank: str, cap: int, protected: Column | None = None) -> DataFrame:
    """At most ``cap`` rows per document in rank order; protected rows stay and count."""
    n = F.row_number().over(Window.partitionBy(query, doc).orderBy(rank))
    keep = n <= cap if protected is None else (n <= cap) | protected
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Target rows without the changed keys, and the changes (the newest of each key)."""
    if newest:
        changes = latest(changes, keys, [F.desc(newest)])
    return target.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def lateral_latest(parent: DataFrame, child: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Each parent with its child of the greatest order and the number of its children (0 if none)."""
    last = child.groupBy(key).agg(F.count("*").alias("n_children"), F.max_by(F.struct(*fields), F.col(order)).alias("last"))
    return parent.join(last, key, "left").select(parent["*"], F.coalesce("n_children", F.lit(0)).alias("n_children"), *[F.col("last")[f].alias(f"last_{f}") for f in fields])


def parity(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: status is equal, differs, missing or unexpected."""
    e, a = expected.select(*keys, F.col(value).alias("expected")), actual.select(*keys, F.col(value).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("actual"), "equal").otherwise("differs")
    return e.join(a, keys, "full_outer").withColumn("status", status)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, fields: list[str]) -> DataFrame:
    """Each left row with the fields of the right row of its key that is latest at or before its time.

    One shuffle: both sides are stacked and the last right row is carried along a window, so the
    number of pairs within a key never matters.
    """
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*fields).alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    lft = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lft).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col("_m")[f].alias(f) for f in fields])


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points within [start, end) of each range, by an equi-join on buckets of ``width``."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(r, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def islands(df: DataFrame, keys: list, order: str, change: Column, name: str = "island") -> DataFrame:
    """Number of changes so far along the order: rows without a change between them share an island."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(change, F.lit(True)), 1).otherwise(0)).over(w).cast("long"))


def cliff_cut(df: DataFrame, query: str, score: str, tie: str, min_score: float, margin: float, cliff: float) -> DataFrame:
    """Rows above max(min_score, top - margin), up to the largest gap of ``cliff`` or more (the earliest of equals)."""
    w = Window.partitionBy(query)
    o = w.orderBy(F.desc(score), tie)
    x = df.withColumn("_top", F.max(score).over(w)).where(F.col(score) >= F.greatest(F.lit(min_score), F.col("_top") - margin))
    x = x.withColumn("_i", F.row_number().over(o)).withColumn("_gap", F.round(F.col(score) - F.lead(score).over(o), 6))
    cut = F.max(F.when(F.col("_gap") >= cliff, F.struct("_gap", (-F.col("_i")).alias("i")))).over(w)
    return x.withColumn("_cut", -cut["i"]).where("_cut is null or _i <= _cut").drop("_top", "_i", "_gap", "_cut")


def suffix_within_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """The longest suffix of each key's rows whose costs fit the budget; the last row stays in any case."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    x = df.withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return x.where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def gini(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """2 sum(i x_i) / (n sum x) - (n + 1) / n over sorted values; 0 where the sum is 0.

    Equal values are counted first, so the ordered window runs over distinct values only.
    """
    c = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, F.lit(0)).orderBy("_v"))
    ranks = (upto - F.col("_c")) * F.col("_c") + F.col("_c") * (F.col("_c") + 1) / 2
    agg = c.withColumn("_r", ranks).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_v")).alias("_a"), F.sum(F.col("_v") * F.col("_c")).alias("_s"), F.sum("_c").alias("_n"))
    g = F.when(F.col("_s") > 0, 2 * F.col("_a") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")).otherwise(0.0)
    return agg.select(*keys, F.round(g, 6).alias("gini"))


def dip_boundaries(df: DataFrame, key: str, order: str, score: str, least: int = 3) -> DataFrame:
    """Rows that begin a new segment: score below mean - deviation of the key, at least ``least`` rows after the last one.

    Which dips count depends on the one before, so each key's dips (few by their definition) are walked in order.
    """
    w = Window.partitionBy(key)
    x = df.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_t", F.avg(score).over(w) - F.stddev_pop(score).over(w))
    dips = x.where(F.col(score) < F.col("_t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(order).alias("o")))).alias("d"))
    start = F.struct(F.lit(1).alias("last"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("kept"))
    step = lambda a, d: F.when(d["_i"] - a["last"] >= least, F.struct(d["_i"].alias("last"), F.concat(a["kept"], F.array(d["o"])).alias("kept"))).otherwise(a)
    return dips.select(key, F.explode(F.aggregate("d", start, step)["kept"]).alias(order))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """1, 2, ... over all rows by a total order; no task holds them all.

    Rows are dealt out in ranges of the order and sorted there. A row's number is its number in
    its range and the counts of the ranges before, which alone reach the driver.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, before, starts = F.shiftright("_at", 33), 0, []
    for p, n in sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect())):
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_p long, _before long")
    x = placed.withColumn("_p", part.cast("long")).join(F.broadcast(starts), "_p")  # a row a range
    return x.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
