"""States of entities over spans of days that combine, stored for blocks of 1, 2, 4, ... days.

A state holds what the summaries and the volatility tables need of an entity in a span:
its first and last day with their attacks, totals and extremes, and the greatest
changes between its present days. Two spans that follow one another combine by adding
the change at the seam, so any range of days is the combination of O(log n) stored
blocks, and after days are replaced only the blocks above them are combined again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.scale import reliable_checkpoint, tasks_for

# Days of a stored partition, as a power of two; longer blocks have a partition each.
ERA = 6

EPOCH = dt.date(1970, 1, 1)

#: Columns of a state. ``calendar_*`` count absent days between present ones as days with 0.
STATE = {
    "first_day": "date",
    "first_attacks": "bigint",
    "last_day": "date",
    "last_attacks": "bigint",
    "total_attacks": "bigint",
    "active_days": "bigint",
    "max_daily": "bigint",
    "rise": "bigint",
    "rise_pct": "double",
    "calendar_rise": "bigint",
    "calendar_pct": "double",
    "peak": "struct<size:double,early:int,date:date,attacks:bigint,previous:bigint>",
    "moves": "bigint",
    "sum_size": "double",
    "sum_square": "double",
}


def day_states(days: DataFrame, entity: str, *others: str) -> DataFrame:
    """States of single days, from ``entity, date, attacks`` with a row for each; ``others`` are kept."""
    none, number = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    attacks = F.col("attacks")
    return days.select(
        entity,
        F.col("date").alias("first_day"),
        attacks.alias("first_attacks"),
        F.col("date").alias("last_day"),
        attacks.alias("last_attacks"),
        attacks.alias("total_attacks"),
        F.lit(1).cast("bigint").alias("active_days"),
        attacks.alias("max_daily"),
        none.alias("rise"),
        number.alias("rise_pct"),
        none.alias("calendar_rise"),
        number.alias("calendar_pct"),
        F.lit(None).cast(STATE["peak"]).alias("peak"),
        F.lit(0).cast("bigint").alias("moves"),
        F.lit(0.0).alias("sum_size"),
        F.lit(0.0).alias("sum_square"),
        *others,
    )


def _seam(a: Column, day: Column, p: Column, before: Column) -> dict[str, Column]:
    """The change from the last day of the span before (``p`` attacks) to the first day of this one (``a``)."""
    zero, known = F.lit(0).cast("bigint"), before.isNotNull()
    gap = F.datediff(day, before)
    idle = F.when(gap >= 3, X.change_pct_from_one(zero, zero))
    move = X.change_pct_or_zero(a, p)
    size = F.when(known, F.abs(move))
    return {
        "seam_rise": a - p,
        "seam_pct": F.when(known, X.change_pct_from_one(a, p)),
        "seam_calendar_rise": F.when(gap == 1, a - p).when(gap > 1, F.greatest(a, zero - p)),
        "seam_calendar_pct": F.when(gap == 1, X.change_pct_from_one(a, p)).when(
            gap > 1, F.greatest(X.change_pct_from_one(a, zero), X.change_pct_from_one(zero, p), idle)
        ),
        "seam_peak": F.when(
            known,
            F.struct(
                size.alias("size"),
                (-F.unix_date(day)).alias("early"),
                day.alias("date"),
                a.alias("attacks"),
                p.alias("previous"),
            ),
        ),
        "seam_size": size,
    }


def combined(states: DataFrame, *keys: str) -> DataFrame:
    """One state for each key; the spans of a key must not overlap.

    A window holds the spans of one key, which ``cover`` and the levels keep few.
    """
    order = Window.partitionBy(*keys).orderBy("first_day")
    placed = states.withColumns(
        {"before_day": F.lag("last_day").over(order), "before_attacks": F.lag("last_attacks").over(order)}
    ).withColumns(_seam(*map(F.col, ("first_attacks", "first_day", "before_attacks", "before_day"))))

    def greatest(own: str, seam: str) -> Column:
        return F.max(F.greatest(own, seam)).alias(own)

    return placed.groupBy(*keys).agg(
        F.min("first_day").alias("first_day"),
        F.min_by("first_attacks", "first_day").alias("first_attacks"),
        F.max("last_day").alias("last_day"),
        F.max_by("last_attacks", "last_day").alias("last_attacks"),
        F.sum("total_attacks").alias("total_attacks"),
        F.sum("active_days").alias("active_days"),
        F.max("max_daily").alias("max_daily"),
        greatest("rise", "seam_rise"),
        greatest("rise_pct", "seam_pct"),
        greatest("calendar_rise", "seam_calendar_rise"),
        greatest("calendar_pct", "seam_calendar_pct"),
        greatest("peak", "seam_peak"),
        (F.sum("moves") + F.count("seam_size")).alias("moves"),
        (F.sum("sum_size") + F.coalesce(F.sum("seam_size"), F.lit(0.0))).alias("sum_size"),
        (F.sum("sum_square") + F.coalesce(F.sum(F.col("seam_size") * F.col("seam_size")), F.lit(0.0))).alias("sum_square"),
    )


def paired(states: DataFrame, *keys: str) -> DataFrame:
    """As ``combined`` for keys of one or two spans: without an aggregation, and in the order of the keys."""
    order = Window.partitionBy(*keys).orderBy("first_day")
    placed = states.withColumns(
        {"later": F.lead(F.struct(*STATE)).over(order), "has_earlier": F.lag("first_day").over(order).isNotNull()}
    ).filter(~F.col("has_earlier"))
    later = F.col("later")
    seam = _seam(later["first_attacks"], later["first_day"], F.col("last_attacks"), F.when(later.isNotNull(), F.col("last_day")))
    placed = placed.withColumns(seam)

    def greatest(own: str, seam: str) -> Column:
        return F.greatest(own, later[own], seam).alias(own)

    def added(name: str, seam: Column, none: Column) -> Column:
        return (F.col(name) + F.coalesce(later[name], none) + F.coalesce(seam, none)).alias(name)

    zero, nothing = F.lit(0).cast("bigint"), F.lit(0.0)
    size = F.col("seam_size")
    return placed.select(
        *keys,
        "first_day",
        "first_attacks",
        F.coalesce(later["last_day"], "last_day").alias("last_day"),
        F.coalesce(later["last_attacks"], "last_attacks").alias("last_attacks"),
        added("total_attacks", zero, zero),
        added("active_days", zero, zero),
        F.greatest("max_daily", later["max_daily"]).alias("max_daily"),
        greatest("rise", "seam_rise"),
        greatest("rise_pct", "seam_pct"),
        greatest("calendar_rise", "seam_calendar_rise"),
        greatest("calendar_pct", "seam_calendar_pct"),
        greatest("peak", "seam_peak"),
        added("moves", F.when(size.isNotNull(), F.lit(1).cast("bigint")), zero),
        added("sum_size", size, nothing),
        added("sum_square", size * size, nothing),
    )


def number_of(day: dt.date) -> int:
    return (day - EPOCH).days


def cover(start: dt.date, end: dt.date, levels: int) -> list[tuple[int, int]]:
    """(level, block) of the fewest stored blocks that make up a closed range."""
    out, at, stop = [], number_of(start), number_of(end) + 1
    while at < stop:
        level = 0
        while level < levels and at % (2 << level) == 0 and at + (2 << level) <= stop:
            level += 1
        out.append((level, at >> level))
        at += 1 << level
    return out


def _era(level: int) -> Column:
    return F.shiftright(F.shiftleft("block", level), ERA).cast("int")


@dataclass(frozen=True)
class DayBlocks:
    """Stored states of one kind of entity: ``path/level=k/era=e`` holds blocks of 2^k days.

    Levels 0 to ``ERA`` share partitions of 2^``ERA`` days; each longer block is a
    partition. Within one, rows are sorted by block and entity, so a range reads the row
    groups of its blocks.
    """

    path: str
    entity: str
    levels: int

    def build(self, days: DataFrame) -> DayBlocks:
        """From ``entity, date, attacks`` (one row each); rows without an entity or date are left out.

        A level is shuffled and sorted once: the two halves of a block meet where the block
        is written, in tasks of a part of the entities and of few partitions.
        """
        spark, known = days.sparkSession, self._known(days)
        number = F.unix_date("date").cast("long")
        placed = known.select(self.entity, "date", "attacks", number.alias("block")).withColumn("era", _era(0))
        self._store(day_states(self._sorted(placed.hint("rebalance", F.col("era"))), self.entity, "block", "era"), 0)
        for level in range(1, self.levels + 1):
            below = self.level(spark, level - 1)
            held = below.agg(F.count("*").alias("rows"), F.count_distinct("era").alias("eras")).first()
            tasks = tasks_for(held["rows"])
            part = F.pmod(F.xxhash64(self.entity), F.lit(-(-tasks // max(1, held["eras"]))))
            halves = self._halves(below, level).withColumn("part", part).repartition(tasks, "era", "part")
            self._store(paired(halves, "era", "block", self.entity, "part").drop("part"), level)
        return self

    def refresh(self, days: DataFrame, dates: Iterable[dt.date]) -> DayBlocks:
        """Replace the given dates by what ``days`` has of them (none: the date is emptied).

        The partitions that hold the dates are written anew, level by level from the one
        below; all others stay as they are.
        """
        spark, dates = days.sparkSession, sorted(set(dates))
        touched = {number_of(d) for d in dates}
        fresh = day_states(self._known(days).filter(F.col("date").isin(dates)), self.entity)
        fresh = fresh.withColumn("block", F.unix_date("first_day").cast("long"))
        eras = {n >> ERA for n in touched}
        kept = self.level(spark, 0).filter(F.col("era").isin(sorted(eras)) & ~F.col("first_day").isin(dates)).drop("era")
        self._replace(reliable_checkpoint(kept.unionByName(fresh.select(kept.columns))), 0, eras)
        for level in range(1, self.levels + 1):
            blocks = {n >> level for n in touched}
            eras = {(b << level) >> ERA for b in blocks}
            below = {((2 * b + half) << (level - 1)) >> ERA for b in blocks for half in (0, 1)} | (eras if level <= ERA else set())
            source = self.level(spark, level - 1).filter(F.col("era").isin(sorted(below)))
            above = paired(self._halves(source, level), "era", "block", self.entity).drop("era")
            if level > ERA:
                above = above.filter(F.col("block").isin(sorted(blocks)))
            self._replace(above, level, eras)
        return self

    def level(self, spark: SparkSession, level: int) -> DataFrame:
        columns = {self.entity: "string", **STATE, "block": "bigint", "era": "int"}
        schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
        return spark.read.schema(schema).parquet(f"{self.path}/level={level}")

    def _known(self, days: DataFrame) -> DataFrame:
        return days.filter(F.col(self.entity).isNotNull() & F.col("date").isNotNull())

    def _halves(self, states: DataFrame, level: int) -> DataFrame:
        """States of the level below with the block and partition that they belong to."""
        return states.withColumn("block", F.shiftright("block", 1)).withColumn("era", _era(level))

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("era", "block", self.entity)

    def _store(self, states: DataFrame, level: int) -> None:
        """Write states that are sorted by partition, block and entity."""
        states.write.mode("overwrite").partitionBy("era").parquet(f"{self.path}/level={level}")

    def _replace(self, states: DataFrame, level: int, eras: set[int]) -> None:
        """Write the partitions of some eras, also those that are empty now."""
        for era in sorted(eras):
            own = states.filter(_era(level) == era)
            own.sortWithinPartitions("block", self.entity).write.mode("overwrite").parquet(f"{self.path}/level={level}/era={era}")

    def states(self, spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
        """The states of the blocks that make up a range."""
        out = None
        by_level: dict[int, list[int]] = {}
        for level, block in cover(start, end, self.levels):
            by_level.setdefault(level, []).append(block)
        for level, blocks in sorted(by_level.items()):
            eras = sorted({(b << level) >> ERA for b in blocks})
            own = self.level(spark, level).filter(F.col("era").isin(eras) & F.col("block").isin(blocks))
            own = own.select(self.entity, *STATE)
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.level(spark, 0).filter(F.lit(False)).select(self.entity, *STATE)

    def over(self, spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
        """The state of every entity over a range of days."""
        return combined(self.states(spark, start, end), self.entity)
