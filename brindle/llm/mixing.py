"""Mixing sources to target weights by hash-threshold histograms; no sort of documents.

A document's size is its number of words.  Sources, by code point with null last, weigh
``weights`` in turn and share the size of all documents; a target stops at ``cap`` times its
source's size and the excess goes to the others by weight (water filling, from running sums
over the sources by their caps per weight).

A source whose target is b whole times its size and a rest takes each document b times, and
those below a hash threshold once more.  The threshold comes from histograms: sizes are
summed by (source, hash bucket), the bucket where the running sum crosses the rest is found,
and only the documents in that bucket are summed again at the next digits of the hash.  The
last step is one hash value.  If rows share it (they repeat a doc_id, or theirs is null), the same
histograms go on over a second hash, of the rows' places in the scan, so that a source misses its
target by no more than a row however many rows are alike; the last row is taken if that comes
nearer.  Documents are never sorted, a hot source's rows are summed before they are shuffled, and
the result depends on doc_id, or on the same scan's places, so reruns agree.
Sources may be many: their order and running sums come in two levels then, parts first.

Nulls: a null text has size 0, a null source is a source (the last), rows with a null doc_id
share one hash.  Empty texts are taken, or not, like others and add 0; of a very long text only
the number of words is kept.  An empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.session import cut, drop, fresh, hold, plain

#: The digits of a hash: LEVELS times LEVEL_BITS bits.
LEVELS, LEVEL_BITS = 4, 15
#: Thresholds are broadcast only if there are at most so many sources with so many characters of names.
FEW, NAMES = 10_000, 4_000_000
SALTS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def place_hash() -> Column:
    """60 bits that tell the rows of a scan apart."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)


def _running(by: DataFrame, order: list[str], columns: list[str], few: bool) -> DataFrame:
    """by with to_<column>, the sum of the column over the rows before; no task sees more than a part of many rows."""
    sums = lambda w: {f"to_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns}
    if few:
        return by.withColumns(sums(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    part = fresh(by, "__part")
    dealt = cut(by.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    parts = dealt.groupBy(part).agg(*[F.sum(c).alias(c) for c in columns])  # a row for each task
    parts = parts.select(part, *[x.alias(f"before_{c}") for c, x in zip(columns, sums(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).values(), strict=True)])
    inside = dealt.withColumns(sums(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    both = inside.join(F.broadcast(parts), part)
    return both.withColumns({f"to_{c}": F.col(f"to_{c}") + F.col(f"before_{c}") for c in columns}).drop(part, *[f"before_{c}" for c in columns])


def _targets(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(key, source_size, target, base, rest) by source, from (key, size); a written table."""
    by = cut(sized.groupBy("key").agg(F.sum("size").alias("source_size")))
    # one row per source from here on; '' is null and comes last
    few = by.count() <= FEW
    by = _running(by.withColumns({"last": F.col("key") == "", "one": F.lit(1).cast("long")}), ["last", "key"], ["one"], few)
    by = by.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("to_one") % len(weights)).cast("int")).cast("double"))
    by = cut(by.withColumn("room", cap * F.col("source_size") / F.col("weight")).select("key", "source_size", "weight", "room"))
    total, every = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    levels = _running(by, ["room", "key"], ["source_size", "weight"], few)
    # the water level if just the sources below this one are full
    level = (total - cap * F.col("to_source_size")) / (every - F.col("to_weight"))
    level = levels.withColumn("level", level).agg(F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "key", "level")))["level"]).first()[0]
    by = by.withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.lit(level).cast("double")))
    base = F.least(F.lit(cap), F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    by = by.withColumn("base", base.cast("long"))
    return cut(by.select("key", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("rest")))


def _crossings(rows: DataFrame, at: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """From rows (key, hash, size) and at (key, rest, before): (key, hash, before, after, n, rest), the hash value at which
    the running sum of sizes crosses the rest, and the sums before and after it; no row for a key that does not reach it.
    Adds the tables it writes."""
    rests = at.select("key", "rest")
    at = at.withColumn("prefix", F.lit(0).cast("long"))
    part = rows.select("key", "hash", "size").withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        part = part.withColumn("bucket", F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level)))
        # what a bucket holds is summed before the shuffle; in the first step all buckets count
        sums = part.groupBy("key", "prefix", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sums = sums.join(at.select("key", "prefix", "rest", "before"), ["key", "prefix"])
        run = Window.partitionBy("key").orderBy("bucket")
        sums = sums.withColumn("after", F.col("before") + F.sum("size").over(run))
        crossing = sums.where("after > rest").groupBy("key").agg(F.min(F.struct("bucket", "after", "size", "n")).alias("c"))
        at_next = crossing.select("key", F.col("c.bucket").alias("prefix"), (F.col("c.after") - F.col("c.size")).alias("before"), F.col("c.after").alias("after"), F.col("c.n").alias("n"))
        at = cut(at_next.join(rests, "key"))
        tables.append(at)
        if level + 1 < LEVELS:
            part = part.drop("prefix").withColumnRenamed("bucket", "prefix").join(at.select("key", "prefix"), ["key", "prefix"], "left_semi")
    return at.withColumnRenamed("prefix", "hash")


def _thresholds(sized: DataFrame, targets: DataFrame, tables: list[DataFrame]) -> tuple[DataFrame, bool]:
    """(key, source_size, target, base, below, tie_below), and whether ties matter: documents are taken once more if their hash is
    below ``below``, or is that and their tie is below ``tie_below``; from (key, hash, tie, size)."""
    at = _crossings(sized, targets.select("key", "rest", F.lit(0).cast("long").alias("before")), tables)
    nearer = (F.col("after") - F.col("rest") < F.col("rest") - F.col("before")).cast("long")
    ties = not at.where("n > 1").isEmpty()
    if ties:
        alike = sized.join(at.select("key", "hash"), ["key", "hash"], "left_semi").select("key", F.col("tie").alias("hash"), "size")
        last = _crossings(alike, at.select("key", "rest", "before"), tables)
        last = last.select("key", (F.col("hash") + nearer).alias("tie_below"))
        below = at.select("key", F.col("hash").alias("below")).join(last, "key")
    else:
        below = at.select("key", (F.col("hash") + nearer).alias("below"), F.lit(0).cast("long").alias("tie_below"))
    every = F.when(F.col("rest") > 0, F.lit(2**62)).otherwise(0)
    return targets.join(below, "key", "left").select("key", "source_size", "target", "base", F.coalesce("below", every).alias("below"), F.coalesce("tie_below", F.lit(0)).alias("tie_below")), ties


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, into: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same columns, and ``into`` struct<size, source_size, target, copies>.

    ``copies`` is how often the mix takes the document, 0 to ``cap``.
    """
    held = fresh(docs, "__held")
    parts = {"size": words(F.col("text")), "key": _key(F.col("source")), "hash": doc_hash(F.col("doc_id")), "tie": place_hash()}
    row = lambda *names: docs.withColumn(held, F.struct(*[parts[n].alias(n) for n in names]))
    sized = hold(row(*parts).select(f"{held}.*"))
    targets = _targets(sized, weights, cap)
    tables = [targets]
    by, ties = _thresholds(sized, targets, tables)
    by = cut(by.select("key", F.struct("source_size", "target", "base", "below", "tie_below").alias("plan")))
    sized.unpersist()
    for table in tables:
        drop(table)
    # a row's place in the scan is part of the plan only where it decides
    return _apply(row(*parts) if ties else row("size", "key", "hash"), by, cap, held, into, ties)


def _apply(row: DataFrame, by: DataFrame, cap: int, held: str, into: str, ties: bool) -> DataFrame:
    """Joins the plan of a source on; a hot source is dealt by salt if there are too many sources to broadcast."""
    n, chars = by.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    key, plan, salt = fresh(row, "__key"), fresh(row, "__plan"), fresh(row, "__salt")
    by = by.select(F.col("key").alias(key), F.col("plan").alias(plan))
    if n <= FEW and chars <= NAMES:
        both = row.join(F.broadcast(by), F.col(f"{held}.key") == F.col(key))
    else:
        by = by.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = row.join(by, (F.col(f"{held}.key") == F.col(key)) & (F.pmod(F.col(f"{held}.hash"), F.lit(SALTS)) == F.col(salt)))
    more = F.col(f"{held}.hash") < F.col(f"{plan}.below")
    if ties:
        more |= (F.col(f"{held}.hash") == F.col(f"{plan}.below")) & (F.col(f"{held}.tie") < F.col(f"{plan}.tie_below"))
    copies = F.least(F.lit(cap), F.col(f"{plan}.base") + more.cast("long"))
    told = F.struct(F.col(f"{held}.size").alias("size"), F.col(f"{plan}.source_size").alias("source_size"), F.col(f"{plan}.target").alias("target"), copies.alias("copies"))
    return both.select(*plain([c for c in row.columns if c not in (held, into)]), told.alias(into))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each document."""
    out = mix_sources(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / w AS room FROM s
), l AS (
  SELECT arg_min(lv, room) AS level FROM (
    SELECT a.room, ((SELECT sum(source_size) FROM r) - 3 * coalesce(sum(b.source_size) FILTER (WHERE b.room < a.room), 0))
      / nullif((SELECT sum(w) FROM r) - coalesce(sum(b.w) FILTER (WHERE b.room < a.room), 0), 0) AS lv
    FROM r a, r b GROUP BY a.source, a.room
  ) WHERE lv <= room
), t AS (
  SELECT source, source_size, least(3.0 * source_size, w * level) AS target FROM r, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS base FROM t
), c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.base, e.target - e.base * e.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (base + CASE WHEN after <= rest OR (before <= rest AND after - rest < rest - before) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
