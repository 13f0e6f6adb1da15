"""Exact quantiles with linear interpolation, for any number of values.

Order statistics come from histograms: values are counted in ``CELLS`` equal cells between the
least and the greatest, the cells that hold a wanted rank are refined between their own least and
greatest values, and so on until a cell holds one value.  Each pass is one scan with map-side
counts, and at most ``CELLS`` rows per open cell come back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 2048

#: Of a feature: how many values, the least and the greatest; and of its cells: (number, values, least, greatest).
Ends = dict[str, tuple[int, float, float]]
Cells = dict[tuple[str, int], list]


def ends_of(values: DataFrame) -> Ends:
    rows = values.groupBy("feature").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # a row per feature
    return {r["feature"]: (r["n"], r["low"], r["high"]) for r in rows}


def first_cells(values: DataFrame, ends: Ends) -> Cells:
    """The cells of the first pass, of features with more than one value."""
    _, counts = _pass(values, [(f, k, low, high) for k, (f, (_, low, high)) in enumerate(sorted(ends.items())) if low < high], ["feature"])
    return counts


def exact_quantiles(values: DataFrame, probabilities: list[float], ends: Ends | None = None, cells: Cells | None = None) -> dict[str, list[float | None]]:
    """values (feature string, v double without nulls) -> for each feature its quantiles."""
    ends = ends_of(values) if ends is None else ends
    ranks = {f: sorted({k for p in probabilities for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) for f, (n, *_) in ends.items()}
    found = order_statistics(values, ranks, ends, cells)
    out: dict[str, list[float | None]] = {}
    for f, (n, *_) in ends.items():
        at = [p * (n - 1) for p in probabilities]
        out[f] = [found[f, math.floor(x)] + (found[f, math.ceil(x)] - found[f, math.floor(x)]) * (x - math.floor(x)) for x in at]
    return out


def _part() -> Column:
    """The part of its cell that a value is in; halves where the cell is wider than a double can say."""
    v, low, high = (F.col(c) for c in ("v", "low", "high"))
    wide = high - low == float("inf")
    share = F.when(wide, (v / 2 - low / 2) / (high / 2 - low / 2)).otherwise((v - low) / F.when(~wide, high - low).otherwise(1.0))
    return F.least(F.lit(CELLS - 1), F.floor(share * CELLS))


def _pass(inside: DataFrame, cells: list[tuple], keys: list[str]) -> tuple[DataFrame, Cells]:
    """One scan: values dealt to the parts of open cells (feature, number, low, high), and what the parts hold."""
    table = inside.sparkSession.createDataFrame(cells, "feature string, cell long, low double, high double")
    inside = inside.join(F.broadcast(table), keys)  # one row for each wanted rank at most
    inside = inside.select("feature", "v", (F.col("cell") * CELLS + _part()).alias("cell"))
    counts: Cells = {}
    for r in inside.groupBy("feature", "cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        counts.setdefault((r["feature"], r["cell"] // CELLS), []).append((r["cell"], r["n"], r["low"], r["high"]))
    for x in counts.values():
        x.sort()
    return inside, counts


def order_statistics(values: DataFrame, ranks: dict[str, list[int]], ends: Ends | None = None, cells: Cells | None = None) -> dict[tuple[str, int], float]:
    """(feature, rank from 0) -> value; ``cells`` are those of first_cells(), if they are known."""
    ends = ends_of(values) if ends is None else ends
    spark = values.sparkSession
    found: dict[tuple[str, int], float] = {}
    # an open cell: (feature, number, low, high, values before it, ranks in it)
    open_ = []
    for k, (f, (_, low, high)) in enumerate(sorted(ends.items())):
        if low == high:
            found.update({(f, r): low for r in ranks[f]})
        else:
            open_.append((f, k, low, high, 0, ranks[f]))
    inside, keys = values, ["feature"]
    while open_:
        if cells is None:
            inside, counts = _pass(inside, [c[:4] for c in open_], keys)
        else:  # the first pass is known already
            table = spark.createDataFrame([c[:4] for c in open_], "feature string, cell long, low double, high double")
            inside = inside.join(F.broadcast(table), keys).select("feature", "v", (F.col("cell") * CELLS + _part()).alias("cell"))
            counts, cells = cells, None
        opened = []
        for f, number, _, _, before, wanted in open_:
            for cell, n, low, high in counts[f, number]:
                here = [k for k in wanted if before <= k < before + n]
                if here and low == high:
                    found.update({(f, k): low for k in here})
                elif here:
                    opened.append((f, cell, low, high, before, here))
                before += n
        # small numbers again, as they are multiplied by CELLS in each pass
        renamed = {(f, c): i for i, (f, c, *_) in enumerate(opened)}
        if opened:
            names = spark.createDataFrame([(f, c, i) for (f, c), i in renamed.items()], "feature string, cell long, new long")
            inside = inside.join(F.broadcast(names), ["feature", "cell"]).select("feature", "v", F.col("new").alias("cell"))
        open_ = [(f, renamed[f, c], low, high, before, here) for f, c, low, high, before, here in opened]
        keys = ["feature", "cell"]
    return found
