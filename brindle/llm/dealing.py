"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.session import fresh

#: A key with more than FEW rows is dealt to several tasks; at most HOT keys, those with the most rows, are.  Any
#: other key has then no more than a HOT-th of all rows.
FEW, HOT = 1000, 1000

Hot = list[tuple]


def hot_keys(counts: DataFrame) -> Hot:
    """counts (key, k) -> (key, to how many tasks its rows are dealt) of at most HOT keys."""
    return [(r[0], -(-r[1] // FEW)) for r in counts.where(F.col(counts.columns[1]) > FEW).orderBy(F.desc(counts.columns[1])).limit(HOT).collect()]


def hot_of(rows: DataFrame, columns: list[str]) -> list[Hot]:
    """The hot keys of each of rows' columns, which are longs, counted in one pass."""
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("e")
    counts = rows.select(every).groupBy("e").agg(F.count("*").alias("k"))
    got = hot_keys(counts)
    return [[(e["v"], n) for e, n in got if e["c"] == i] for i in range(len(columns))]


def fetched(rows: DataFrame, table: DataFrame, keys: list[str], hot: Hot, how: str = "inner") -> DataFrame:
    """rows joined with table on keys, each of which table has few rows of, while rows may have any number.

    The rows of a hot key (of the first column of keys) are dealt by a salt, and the table's rows of that key are
    repeated for each.  ``how`` is inner or left.
    """
    key = keys[0]
    if not hot:
        return rows.join(table, keys, how)
    salt, copies = fresh(rows, "__salt"), fresh(rows, "__copies")
    kind = rows.schema[key].dataType.simpleString()
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} {kind}, {copies} int"))  # at most HOT rows
    dealt = rows.join(few, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(copies)).cast("int"), F.lit(0))).drop(copies)
    again = table.join(few, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))).drop(copies)
    return dealt.join(again, [*keys, salt], how).drop(salt)
