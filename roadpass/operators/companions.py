"""Cars that travel together: same monitor, at most five minutes apart."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roadpass.functions import timekeys as K
from roadpass.operators.filters import readable_plates
from roadpass.session import release, scratch_dir, shuffles_removed, stored

GAP_SECONDS = 300
DAY_SECONDS = 86_400
# Entries of up to so many cars form all their pairs, which are linear in the number of entries.
CROWD = 1000
# Pairs of entries' cars that a pass sends through the shuffle, and that a task counts.
PASS_PAIRS, TASK_PAIRS = 64_000_000, 500_000


def companions_of(passes: DataFrame, suspects: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Passes of other cars near each pass of a suspect car.

    Only the suspects' passes are tripled over neighbouring time slots; the full pass
    table is joined once, on (monitor, slot), and a pair meets in exactly one slot. The
    output follows the suspects' passes, so the list should be a short one.
    """
    base = passes.select("monitor_id", "car", "action_time", "pass_id", K.clock(F.col("ts")).alias("clock"))
    slot = F.floor(F.col("clock") / gap)
    near = F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot")
    left = base.join(suspects.select("car").distinct(), "car", "left_semi").select(
        "monitor_id",
        near,
        "car",
        "action_time",
        "pass_id",
        "clock",
    )
    right = base.select(
        "monitor_id",
        slot.alias("slot"),
        F.col("car").alias("companion"),
        F.col("action_time").alias("companion_time"),
        F.col("pass_id").alias("companion_pass_id"),
        F.col("clock").alias("companion_clock"),
    )
    close = F.abs(F.col("clock") - F.col("companion_clock")) <= gap
    return (
        left.join(right, ["monitor_id", "slot"])
        .where(close & (F.col("car") != F.col("companion")))
        .select(
            "car",
            "companion",
            "monitor_id",
            "action_time",
            "companion_time",
            "pass_id",
            "companion_pass_id",
        )
    )


def meetings(passes: DataFrame, suspects: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """(car, companion, meetings, monitors, first_time, last_time) of each suspect car.

    ``meetings`` counts the pairs of passes, ``monitors`` the different monitors.
    """
    return (
        companions_of(passes, suspects, gap)
        .groupBy("car", "companion", "monitor_id")
        .agg(F.count("*").alias("n"), F.min("action_time").alias("a"), F.max("action_time").alias("b"))
        .groupBy("car", "companion")
        .agg(
            F.sum("n").alias("meetings"),
            F.count("*").alias("monitors"),
            F.min("a").alias("first_time"),
            F.max("b").alias("last_time"),
        )
    )


def network_companions(
    passes: DataFrame, least: int = 3, monitors: int = 2, slot_seconds: int = GAP_SECONDS, crowd: int = CROWD
) -> DataFrame:
    """(car, companion, shared, monitors, first_start, last_start): all pairs of cars that have
    at least ``least`` entries (monitor, time slot) in common, at ``monitors`` or more monitors.

    A set-similarity join with prefix filtering. A car's entries are ordered from rare to
    frequent. Two cars with ``least`` common entries have one among the entries that are
    left when each car's ``least - 1`` most frequent ones are taken away, so only
    those meet: the slots of a jam, where thousands of cars pass, form no pairs with the
    cars that have rarer entries. Only entries of more than ``crowd`` cars are taken away, so a
    pair that has none of them is counted where it meets; the others are verified on their
    whole sets, the smaller set looked up in the larger one. Unread plates are left out.
    """
    if least < 1:
        raise ValueError("least must be positive")
    entry = ["monitor_id", "slot"]
    timed = readable_plates(passes).where(F.col("ts").isNotNull() & F.col("monitor_id").isNotNull())
    slot = F.floor(K.clock(F.col("ts")) / slot_seconds).alias("slot")
    with shuffles_removed(passes.sparkSession):
        sets = stored(timed.select("car", "monitor_id", slot).distinct(), "car-entries")
    pairs = candidate_pairs(sets, least, crowd)
    found, asked = pairs.where("more = 0").drop("more"), pairs.where("more > 0").select("a", "b")
    if asked.isEmpty():
        release(passes.sparkSession, sets.scratch_path)
    else:
        # Only sizes of cars that are candidates are needed, and the smaller set is the one read.
        size = sets.groupBy("car").agg(F.count("*").alias("size"))
        sized = asked.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
        small, large = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a"))
        both = sized.select("a", "b", small.alias("car"), large.alias("other"))
        looked = both.join(sets, "car").join(sets.withColumnRenamed("car", "other"), ["other", *entry])
        found = found.unionByName(_summed(looked))
    start = {name: K.clock_text(F.col(name) * slot_seconds).alias(f"{name}_start") for name in ("first", "last")}
    return found.where((F.col("shared") >= least) & (F.col("monitors") >= monitors)).select(
        F.col("a").alias("car"), F.col("b").alias("companion"), "shared", "monitors", start["first"], start["last"]
    )


def _summed(common: DataFrame) -> DataFrame:
    """(a, b, shared, monitors, first, last) of rows (a, b, monitor_id, slot)."""
    return (
        common.groupBy("a", "b", "monitor_id")
        .agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("shared"), F.count("*").alias("monitors"), F.min("first").alias("first"), F.max("last").alias("last"))
    )


def candidate_pairs(sets: DataFrame, least: int, crowd: int = 1) -> DataFrame:
    """(a, b, shared, monitors, first, last, more), a < b: cars of ``sets`` (car, monitor_id, slot)
    that can share ``least`` entries.

    They share an entry which is not held back by either; a car holds back those of its
    ``least - 1`` most frequent entries that more than ``crowd`` cars have. The figures cover the
    shared entries that neither holds back; ``more`` is how many both together hold back.

    Pairs are never shuffled. A car is sent the numbers of the later cars of each of its
    entries, and all rows of a car lie in one task, which counts them. The cars are worked
    off in as many passes as it takes to send ``PASS_PAIRS`` numbers in each.
    """
    spark, entry = sets.sparkSession, ["monitor_id", "slot"]
    with shuffles_removed(spark):
        names = stored(_numbered(sets.select("car").distinct()), "car-numbers")
        lists = stored(_lists(sets.join(names, "car").select(*entry, (F.col("id") * least).alias("code"))), "entry-cars")
        if least > 1 and lists.where(F.size("codes") > crowd).limit(1).count():
            lists = stored(_held_back(lists, least, crowd), "open-entry-cars")
        n = F.size("codes").cast("long")
        pairs = lists.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()[0]
        rounds = max(1, math.ceil(pairs / PASS_PAIRS))
        tasks = max(1, math.ceil(pairs / rounds / TASK_PAIRS))
        path = scratch_dir(spark, "companion-candidates")
        more = F.pmod("a", F.lit(least)) + F.pmod("b", F.lit(least))
        for k in range(rounds):
            met = _summed(_meeting(lists, F.pmod(F.floor(F.col("a") / least), F.lit(rounds)) == k, tasks))
            kept = met.withColumn("more", more).where(F.col("shared") + F.col("more") >= least)
            kept.write.mode("append").parquet(path)
        release(spark, lists.scratch_path)
    found = spark.read.schema(kept.schema).parquet(path)
    named = found.withColumn("a", F.floor(F.col("a") / least)).withColumn("b", F.floor(F.col("b") / least))
    for end in ("a", "b"):
        named = named.join(names.select(F.col("id").cast("long").alias(end), F.col("car").alias(f"{end}_car")), end)
    return named.select(F.col("a_car").alias("a"), F.col("b_car").alias("b"), "shared", "monitors", "first", "last", "more")


def _numbered(cars: DataFrame) -> DataFrame:
    """(car, id): numbers without gaps, in the order of the cars."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = cars.repartitionByRange("car").sortWithinPartitions("car")
    placed = stored(ranged.select("car", F.spark_partition_id().alias("part"), row.alias("row")), "car-places")
    # A row for each partition.
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("start"))
    return placed.join(F.broadcast(starts), "part").select("car", (F.col("start") + F.col("row")).cast("int").alias("id"))


def _lists(entries: DataFrame) -> DataFrame:
    """The sorted codes of the cars of every entry that several cars have."""
    codes = F.sort_array(F.collect_list("code")).alias("codes")
    return entries.groupBy("monitor_id", "slot").agg(codes).where(F.size("codes") > 1)


def _held_back(lists: DataFrame, least: int, crowd: int) -> DataFrame:
    """``lists`` without the entries that a car holds back; its codes tell how many these are."""
    entry = ["monitor_id", "slot"]
    single = lists.select(*entry, F.size("codes").alias("cars"), F.explode("codes").alias("code"))
    order = Window.partitionBy("code").orderBy(F.desc("cars"), F.desc("slot"), F.desc("monitor_id"))
    held = single.where(F.col("cars") > crowd).withColumn("i", F.row_number().over(order)).where(F.col("i") < least)
    held = stored(held.select("code", *entry), "held-entries")
    more = held.groupBy("code").agg(F.count("*").cast("int").alias("more"))
    kept = single.join(held, ["code", *entry], "left_anti").join(more, "code", "left")
    return _lists(kept.select(*entry, (F.col("code") + F.coalesce("more", F.lit(0))).alias("code")))


def _meeting(lists: DataFrame, some: Column, tasks: int) -> DataFrame:
    """(a, b, monitor_id, slot) of the pairs of an entry's cars, for ``some`` cars a, all of a car in one task."""
    size = F.size("codes")
    rows = lists.select("monitor_id", "slot", "codes", F.posexplode("codes").alias("i", "a")).where(some & (F.col("i") < size - 1))
    later = F.slice("codes", F.col("i") + 2, size - F.col("i") - 1).alias("later")
    sent = rows.select("a", "monitor_id", "slot", later).repartition(tasks, "a")
    return sent.select("a", F.explode("later").alias("b"), "monitor_id", "slot")


def _within(n: str, window: WindowSpec, gap: int) -> Column:
    """Sum over the rows at most ``gap`` seconds away, as a difference of running sums: a
    sliding frame would add up all its rows again for every row."""
    start = Window.unboundedPreceding
    upto = F.sum(n).over(window.rangeBetween(start, gap))
    before = F.sum(n).over(window.rangeBetween(start, -gap - 1))
    return upto - F.coalesce(before, F.lit(0))


def _by_day(rows: DataFrame, gap: int) -> DataFrame:
    """Rows with their ``day``, and again for a neighbouring day that starts or ended at
    most ``gap`` seconds away."""
    days = [F.floor((F.col("clock") + shift) / DAY_SECONDS) for shift in (-gap, 0, gap)]
    # A pass without a time meets nobody but is kept, with a day of NULL.
    return rows.withColumn("day", F.explode(F.array_distinct(F.array(*days))))


def _own_day() -> Column:
    return F.col("day").eqNullSafe(F.floor(F.col("clock") / DAY_SECONDS))


def encounters(passes: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """(car, encounters): how many passes of other cars were near the car's own passes.

    Covers the whole network without producing pairs. Passes are first counted per
    second; the range frames then run over those counts day by day, each day with
    ``gap`` seconds lent from its neighbours, so a frame never holds more than a day's
    seconds of one monitor.
    """
    if gap >= DAY_SECONDS:
        raise ValueError("gap must be shorter than a day")
    base = passes.select("monitor_id", "car", K.clock(F.col("ts")).alias("clock"))
    own = base.groupBy("monitor_id", "car", "clock").agg(F.count("*").alias("n"))
    everyone = own.groupBy("monitor_id", "clock").agg(F.sum("n").alias("all_n"))
    near = _within("all_n", Window.partitionBy("monitor_id", "day").orderBy("clock"), gap)
    near_own = _within("n", Window.partitionBy("monitor_id", "car", "day").orderBy("clock"), gap)
    around = _by_day(everyone, gap).select("monitor_id", "clock", "day", near.alias("near")).where(_own_day())
    mine = (
        _by_day(own, gap)
        .select("monitor_id", "car", "clock", "n", "day", near_own.alias("near_own"))
        .where(_own_day())
    )
    met = F.col("n") * (F.col("near") - F.col("near_own"))
    same = ["monitor_id", "clock"]
    return mine.drop("day").join(around.drop("day"), same).groupBy("car").agg(F.sum(met).alias("encounters"))
