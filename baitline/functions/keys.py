"""Ways to work per key when one key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import scratch_path


#: Rows that a task of the as-of join sorts.
PER_TASK = 100_000


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key.

    Two ranks: the first within (key, salt), which Spark also applies before
    the shuffle, the second over the at most ``salts * n`` rows left per key.
    No task ever sorts a whole hot key.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def _hashable(df: DataFrame, name: str) -> bool:
    return "map" not in df.schema[name].dataType.simpleString()


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key.  Spark keeps one candidate per key and task before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def mark_smallest(
    df: DataFrame, group: str, quota: Callable[[DataFrame], DataFrame], identity: list[str], seed: int, out: str
) -> DataFrame:
    """Add ``out``: true for exactly so many rows of each group, by a hash of ``identity``.

    ``quota`` turns the groups' sizes (group, n) into (group, quota).
    ``identity`` is unique within a group.

    The table is read twice.  First rows are counted by group and four-digit
    hash prefix, and the counts stored; sizes and running totals over at most
    65,536 prefixes per group show in which prefix the quota ends.  Then rows
    are marked by comparison with that prefix, and those of the prefix itself by
    their rank in it.  Ranks are taken within (group, prefix), which is even
    however few groups there are; no group is sorted as a whole.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *identity))
    prefixed = df.withColumn("_place", F.struct(key.alias("hash"), *identity)).withColumn("_prefix", F.substring("_place.hash", 1, 4))
    path = scratch_path(df.sparkSession, "prefixes")
    prefixed.groupBy(group, "_prefix").agg(F.count("*").alias("_n")).write.parquet(path)
    per_prefix = df.sparkSession.read.parquet(path)
    sizes = quota(per_prefix.groupBy(group).agg(F.sum("_n").alias("n")))
    in_order = Window.partitionBy(group).orderBy("_prefix")
    ends = (
        per_prefix.withColumn("_upto", F.sum("_n").over(in_order)).join(sizes, group)
        .withColumn("_need", F.col("quota") - (F.col("_upto") - F.col("_n")))
        .filter("_need > 0").groupBy(group).agg(F.max(F.struct("_prefix", "_need")).alias("_end"))  # one row per group
    )
    rank = F.row_number().over(Window.partitionBy(group, "_prefix").orderBy("_place"))
    ranked = prefixed.withColumn("_rank", rank).join(ends, group, "left")
    taken = (F.col("_prefix") < F.col("_end._prefix")) | ((F.col("_prefix") == F.col("_end._prefix")) & (F.col("_rank") <= F.col("_end._need")))
    return ranked.select(*df.columns, F.coalesce(taken, F.lit(False)).alias(out))


def latest_before(
    left: DataFrame,
    owner: str,
    time: str,
    observations: dict[str, tuple[list[str], DataFrame]],
    slice_by: str = "HOUR",
    per_slice: int = 500_000,
) -> DataFrame:
    """As-of join: per kind, the last observation at or before each row's time.

    ``observations`` maps an output column to (levels, table): the columns that,
    with ``owner``, an observation belongs to, and a table of (owner, levels...,
    observed_at, value struct).  An owner holds all rows of its levels, so one
    exchange by (owner, segment) serves every kind; each kind is then a window
    within it.  A null owner or level has no observations.

    A segmented scan: rows and observations of an owner are cut into segments of
    time, each segment starts with the last values of the segments before it (a
    running ``last`` over one row per segment), and no pair of rows is ever
    built.  Segments are calendar slices; a slice that holds over ``per_slice``
    rows of an owner is cut further, at quantiles of its rows' times, so a busy
    owner is spread however its rows lie.  The result depends on neither.  Of
    observations with equal times the greatest value counts.

    ``left`` is read once and stored; counts and segments come from its keys.
    """
    path = scratch_path(left.sparkSession, "asof-rows")
    left.write.parquet(path)
    left = left.sparkSession.read.schema(left.schema).parquet(path)

    def cut(c: str) -> Column:
        return F.date_trunc(slice_by, F.col(c)).cast("timestamp_ntz")

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    keyed = left.filter(F.col(owner).isNotNull()).select(F.col(owner).alias("_key"), cut(time).alias("_slice"), F.col(time).alias("_time"))
    cuts = _busy_cuts(keyed.withColumn("_micros", micros("_time")), per_slice)

    def segmented(df: DataFrame) -> DataFrame:
        """Add ``_sub``, the place of the row's segment within its slice."""
        if cuts is None:
            return df.withColumn("_sub", F.lit(0))
        after = F.size(F.filter("_cuts", lambda c: c < micros("_time")))
        return df.join(cuts, ["_key", "_slice"], "left").withColumn("_sub", F.when(F.col("_cuts").isNull(), 0).otherwise(after)).drop("_cuts")

    levels = list(dict.fromkeys(c for cols, _ in observations.values() for c in cols))
    held = {c: f"_level_{c}" for c in levels}
    asked = left.filter(F.col(owner).isNotNull()).select(
        F.col(owner).alias("_key"), F.col(time).alias("_time"), cut(time).alias("_slice"), *[F.col(c).alias(held[c]) for c in levels]
    )
    finest = segmented(asked).drop("_time").distinct()
    segment = ["_slice", "_sub"]
    merged: DataFrame | None = None
    for out, (cols, table) in observations.items():
        own = [held[c] for c in cols]
        present = F.col("owner").isNotNull()
        for c in cols:
            present = present & F.col(c).isNotNull()
        seen = segmented(table.filter(present).select(
            F.col("owner").alias("_key"), F.col("observed_at").alias("_time"), cut("observed_at").alias("_slice"),
            F.lit(1).alias("_kind"), *[F.col(c).alias(held[c]) for c in cols], F.col("value").alias(out),
        ))
        newest = seen.groupBy("_key", *segment, *own).agg(F.max(F.struct("_time", F.col(out).alias("value"))).alias(out))
        slices = finest.select("_key", *segment, *own).distinct().withColumn("_asked", F.lit(True))
        earlier = Window.partitionBy("_key", *own).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            slices.join(newest, ["_key", *segment, *own], "full_outer")
            .select("_key", *segment, *own, "_asked", F.last(f"{out}.value", ignorenulls=True).over(earlier).alias(out))
            .filter(F.col("_asked") & F.col(out).isNotNull())
            .select("_key", F.col("_slice").alias("_time"), *segment, F.lit(0).alias("_kind"), *own, out)
        )
        part = seen.unionByName(carried)
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    # rows without an owner meet no observation; spread them
    alone = F.concat(F.lit("\u0001"), F.xxhash64(*[F.col(c) for c in left.columns if _hashable(left, c)]).cast("string"))
    rows = segmented(left.select(
        F.coalesce(F.col(owner), alone).alias("_key"), F.col(time).alias("_time"), cut(time).alias("_slice"),
        F.lit(2).alias("_kind"), *[F.col(c).alias(held[c]) for c in levels], F.struct(*left.columns).alias("_row"),
    ))
    merged = merged.unionByName(rows, allowMissingColumns=True)
    # So many that a task sorts as many rows however large the table is; a segment, which is whole, has at most per_slice.
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(-(-left.count() // PER_TASK), min(width, left.sparkSession.sparkContext.defaultParallelism))
    filled = merged.repartition(pieces, "_key", *segment)
    for out, (cols, _) in observations.items():
        # what is carried into a segment comes before all that lies in it
        running = (
            Window.partitionBy("_key", *segment, *[held[c] for c in cols]).orderBy(F.col("_kind") > 0, "_time", "_kind", out)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        known = F.lit(True)
        for c in cols:
            known = known & F.col(held[c]).isNotNull()
        filled = filled.withColumn(f"_last_{out}", F.when(known, F.last(out, ignorenulls=True).over(running)))
    return filled.filter(F.col("_kind") == 2).select("_row.*", *[F.col(f"_last_{out}").alias(out) for out in observations])


def _busy_cuts(keyed: DataFrame, per_slice: int) -> DataFrame | None:
    """Times (``_cuts``) at which the slices of over ``per_slice`` rows are cut; None where there is no such slice."""
    busy = keyed.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_slice)
    most = busy.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    pieces = -(-most // per_slice)
    fractions = F.expr("array(" + ", ".join(f"{i / pieces!r}D" for i in range(1, pieces)) + ")")
    times = keyed.join(busy, ["_key", "_slice"], "left_semi").groupBy("_key", "_slice")
    return times.agg(F.array_distinct(F.percentile_approx("_micros", fractions, F.lit(max(10_000, 20 * pieces)))).alias("_cuts"))
