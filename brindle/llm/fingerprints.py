"""One-permutation MinHash fingerprints of a fixed size.

The distinct five-word shingles of a text (A-Z lower-cased) are hashed once to 64 bits.  The
upper bits name one of ``BINS`` bins, each bin keeps its least hash, and an empty bin takes
that of a full one by optimal densification: a sequence of bins drawn from a hash of the
bin's number and the attempt, the same for all texts, is followed to the first full bin.
``BITS`` low-order bits per bin are stored, packed, as hex.  Two texts agree by chance in one
of ``2 ** BITS`` bins, so the share m of equal bins gives the similarity
``(m - c) / (1 - c)`` with ``c = 2 ** -BITS``, not under 0.

A text without words (null, empty, white space) has the empty fingerprint, like only to
itself.  Texts with fewer than five words have their words as the one shingle.  A very long text
takes 8 bytes for each shingle, and some 30 for each word while they are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bytes_view import CHUNK, mix, shingle_sets
from brindle.llm.session import bounded_batches, returning

BINS, BITS = 512, 4
ATTEMPTS = 96
#: Ranges of ids per partition of the shuffle, so that a hash of their numbers deals them evenly.
RANGES = 4

_i, _t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, ATTEMPTS + 1, dtype=np.uint64))
PROBES = (mix(_i * np.uint64(0x9E3779B97F4A7C15) + _t * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
NUMBER = np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def bins_of(h: np.ndarray) -> np.ndarray:
    """The low-order bits of each bin, as uint8, from the sorted hashes of a set that is not empty."""
    number = (h >> SHIFT).astype(np.int64)
    first = np.concatenate([[True], number[1:] != number[:-1]])
    full = np.zeros(BINS, bool)
    value = np.zeros(BINS, np.uint64)
    full[number[first]] = True
    value[number[first]] = h[first]
    empty = np.flatnonzero(~full)
    for t in range(ATTEMPTS):
        if not len(empty):
            break
        donor = PROBES[t][empty]
        ok = full[donor]
        value[empty[ok]] = value[donor[ok]]
        empty = empty[~ok]
    if len(empty):  # a very small set: its least hash
        value[empty] = h[0]
    # the bin's number enters, or bins that share a donor would agree by chance together
    return (mix(value + NUMBER) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(bins: np.ndarray) -> str:
    """The bins' bits, low-order first, as hex."""
    bits = (bins[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def fingerprints(texts: pa.Array) -> list[np.ndarray | None]:
    return [bins_of(h) if len(h) else None for _, h in shingle_sets(texts)]


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance))


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, pa.Array]]:
    for batch in batches:
        bucket, halo, ids = (batch.column(k).to_pylist() for k in range(3))
        texts = batch.column(3).fill_null("")
        sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy())
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK, "right")))
            part = texts.slice(i, j - i)
            yield bucket[i:j], halo[i:j], ids[i:j], part.to_pylist(), part
            i = j


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (range, halo, id); the row after a row is the next document, a halo row is only that."""
    held = None
    for bucket, halo, ids, texts, column in _parts(batches):
        prints = fingerprints(column)
        rows = list(zip(bucket, halo, ids, texts, prints, strict=True))
        if held is not None:
            rows.insert(0, held)
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        if not pairs:
            continue
        new = [_edited(a[3], b[3]) for a, b in pairs]
        changed = fingerprints(pa.array(new, pa.large_string()))
        hexed = lambda p: "" if p is None else packed(p)
        out = [(a[2], len(a[3]), hashlib.sha256(t.encode()).hexdigest(), hexed(a[4]), hexed(e), likeness(a[4], e), likeness(a[4], b[4])) for (a, b), t, e in zip(pairs, new, changed, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=FIELDS)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text string, ...) -> SCHEMA: each text's fingerprint, that of its edited text, and their likeness.

    The next document, by ascending doc_id, comes without a global sort: ids are cut into
    ranges at quantiles, the first document of a range is sent to the range before it too, and
    each text is shuffled once.  Rows with a null doc_id come first; rows that share a doc_id
    follow each other by text.  A lone document is its own next one; extra columns are ignored.
    """
    spark = bounded_batches(docs).sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(order.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most RANGES * n numbers
    steps = [i / (RANGES * n) for i in range(1, RANGES * n)]
    splits = sorted({int(x) for x in keyed.select("k").approxQuantile("k", steps, 0.2 / (RANGES * n))})
    bucket = F.lit(0)
    if splits:
        bucket = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col("k")))
    keyed = keyed.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["k"]) for r in keyed.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    to = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    halo = F.lit(None).cast("int")
    if to:
        places = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
        halo = F.when(F.col("k").isin(list(to)), places[F.col("k")])
    spread = F.explode(F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("halo")), F.when(halo.isNotNull(), F.struct(halo.alias("b"), F.lit(True).alias("halo"))))))
    rows = keyed.withColumn("to", spread).select("to.b", "to.halo", "doc_id", "text", "k")
    rows = rows.repartition(n, "b").sortWithinPartitions("b", "halo", "k", "text").select("b", "halo", "doc_id", "text")
    return rows.mapInArrow(returning(_compare), SCHEMA)
