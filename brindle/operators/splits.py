"""Chronological splits, entity checks and training-only encodings."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import share, usable
from brindle.operators.features import CATEGORICAL, NUMERICAL, quoted
from brindle.operators.quantiles import order_statistics

PARTS = ("train", "validation", "test", "fit", "early_stop")


class SplitError(ValueError):
    pass


@dataclass
class Bounds:
    """Inclusive ends; a gap after each keeps late labels out of the next part."""

    train_end: object
    validation_end: object
    early_end: object
    gap: timedelta

    def masks(self, t: Column) -> dict[str, Column]:
        gap = F.make_dt_interval(secs=F.lit(self.gap.total_seconds()).cast("decimal(18,6)"))
        a, b, e = (F.lit(x).cast("timestamp_ntz") for x in (self.train_end, self.validation_end, self.early_end))
        train = t <= a
        return {"train": train, "validation": (t > a + gap) & (t <= b), "test": t > b + gap, "fit": t <= e, "early_stop": (t > e + gap) & train}


#: Times are counted from here in microseconds, which doubles hold exactly for 285 years.
EPOCH = datetime(2000, 1, 1)


def _nth_times(times: DataFrame, places: list[int]) -> list:
    """Distinct times at 1-based places, from histograms over them: no task ranks them."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("t"))
    found = order_statistics(times.select(F.lit("t").alias("feature"), micros.cast("double").alias("v")), {"t": [p - 1 for p in places]})
    return [EPOCH + timedelta(microseconds=int(found["t", p - 1])) for p in places]


def find_bounds(df: DataFrame, time: str, train: float = 0.6, validation: float = 0.2, early: float = 0.15, gap: timedelta = timedelta(0), train_end=None, validation_end=None) -> Bounds:
    """Cuts at fractions of the distinct times, so equal times stay together; explicit ends go before fractions."""
    t = quoted(time).cast("timestamp_ntz")
    times = df.select(t.alias("t")).where("t is not null").distinct()
    n = times.count()
    if n < 5:
        raise SplitError(f"{n} distinct times are too few; five are needed")
    if train_end is None:
        # the distinct times of training are the first ones of all
        k = int(n * train)
        train_end, validation_end, early_end = _nth_times(times, [k, int(n * (train + validation)), max(1, int(k * (1 - early)))])
    else:
        early_end = None
        train_end, validation_end = times.sparkSession.range(1).select(F.lit(str(train_end)).cast("timestamp").cast("timestamp_ntz"), F.lit(str(validation_end)).cast("timestamp").cast("timestamp_ntz")).first()
    if not train_end < validation_end:
        raise SplitError("train_end must be before validation_end")
    if early_end is None:
        k = times.where(F.col("t") <= F.lit(train_end)).count()
    cut = int(k * (1 - early))
    if not 0 < cut < k:
        raise SplitError("training has too few times for an early-stopping part")
    if early_end is None:
        (early_end,) = _nth_times(times, [cut])
    return Bounds(train_end, validation_end, early_end, gap)


def parts_of(df: DataFrame, time: str, bounds: Bounds) -> dict[str, DataFrame]:
    return {n: df.where(m) for n, m in bounds.masks(quoted(time).cast("timestamp_ntz")).items()}


def split_summary(df: DataFrame, time: str, y: Column, bounds: Bounds) -> DataFrame:
    """(split, rows, actual_clicks, positive_rate, start, end) in one pass; fit and early_stop lie inside train."""
    t = quoted(time).cast("timestamp_ntz")
    of = F.explode(F.filter(F.array(*[F.when(m, n) for n, m in bounds.masks(t).items()]), lambda x: x.isNotNull()))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select(of.alias("split"), y.cast("long").alias("y"), t.alias("t")).groupBy("split").agg(F.count("*").alias("rows"), F.sum("y").alias("actual_clicks"), F.avg("y").alias("positive_rate"), text(F.min("t")).alias("start"), text(F.max("t")).alias("end"))


def gap_rows(df: DataFrame, time: str, bounds: Bounds) -> DataFrame:
    """One row: rows that the gaps leave out, outside and inside of train."""
    m = bounds.masks(quoted(time).cast("timestamp_ntz"))
    return df.agg(F.count_if(~(m["train"] | m["validation"] | m["test"])).alias("excluded_gap_rows"), F.count_if(m["train"] & ~(m["fit"] | m["early_stop"])).alias("inner_gap_rows"))


def check_parts(summary: list[dict]) -> None:
    have = {r["split"]: r for r in summary}
    for name in PARTS:
        if name not in have:
            raise SplitError(f"{name} has no rows; change the ends or the gap")
        r = have[name]
        if name != "test" and not 0 < r["actual_clicks"] < r["rows"]:
            raise SplitError(f"{name} needs both classes; take a longer time")


def crossing_entities(df: DataFrame, time: str, entity: str, bounds: Bounds) -> DataFrame:
    """(entity, level, parts): entities that are in several parts, of the whole (outer) or of train (inner); null ones always."""
    t, e = quoted(time).cast("timestamp_ntz"), quoted(entity)
    m = bounds.masks(t)
    first = lambda names: F.coalesce(*[F.when(m[n], n) for n in names])
    rows = df.select(e.alias("entity"), F.explode(F.array(F.struct(F.lit("outer").alias("level"), first(PARTS[:3]).alias("part")), F.struct(F.lit("inner").alias("level"), first(PARTS[3:]).alias("part")))).alias("r")).select("entity", "r.*").where("part is not null")
    return rows.groupBy("entity", "level").agg(F.count_distinct("part").alias("parts")).where("parts > 1 or entity is null")


@dataclass
class Encoder:
    """Sorted levels of each categorical feature as seen in training; others and null are missing."""

    features: dict[str, str]
    levels: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, features: dict[str, str]) -> Encoder:
        names = [n for n, k in features.items() if k == CATEGORICAL]
        levels: dict[str, list[str]] = {n: [] for n in names}
        if names:
            # levels of all features are made distinct side by side; a model holds them all, so they come to the driver
            rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), quoted(n).cast("string").alias("level")) for i, n in enumerate(names)])).alias("r")
            for r in df.select(rows).select("r.*").where("level is not null").distinct().toLocalIterator():
                levels[names[r["i"]]].append(r["level"])
        return Encoder(features, {n: sorted(x, key=lambda v: v.encode()) for n, x in levels.items()})

    def columns(self) -> list[Column]:
        """f0, f1...: numbers in single precision, null where not finite; places of levels from 0, null where unknown."""
        out = []
        for i, (n, k) in enumerate(self.features.items()):
            if k == NUMERICAL:
                c = usable(quoted(n).cast("float"))
            elif self.levels[n]:
                c = F.try_element_at(F.create_map(*[F.lit(x) for j, v in enumerate(self.levels[n]) for x in (v, float(j))]), quoted(n).cast("string"))
            else:
                c = F.lit(None).cast("double")
            out.append(c.cast("double").alias(f"f{i}"))
        return out

    def unseen(self, df: DataFrame) -> dict[str, int]:
        names = list(self.levels)
        if not names:
            return {}
        got = df.agg(*[F.count_if(quoted(n).isNotNull() & ~(quoted(n).cast("string").isin(self.levels[n]) if self.levels[n] else F.lit(False))).alias(f"u{i}") for i, n in enumerate(names)]).first()
        return dict(zip(names, got, strict=True))

    def to_dict(self) -> dict:
        return {"features": self.features, "levels": self.levels}


def class_share(df: DataFrame, y: Column) -> float:
    return df.agg(share(y.cast("int") == 1)).first()[0]
