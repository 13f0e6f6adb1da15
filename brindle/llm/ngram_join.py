"""Exact self-join of word-shingle sets by Jaccard similarity, skipping by relations between sets.

``100 * |x & y| >= 80 * |x | y|`` links two documents.  The plan, none of whose steps
collects more than two small tables of a stated size:

1.  One scan gives each set's size, a 128-bit digest, its ``SKETCH`` smallest hashes and a
    parity bitmap.  Equal sets become one class, so copies of any number cost one row each.
2.  Star round: within a shared small hash every class is compared with the one that stands
    nearest to the middle of its group (and with the nearest of its own size step), that is,
    whose own small hashes the most classes have.  A large group of near copies is
    linked here with a number of comparisons linear in the group.  A member that is linked
    to its centre keeps what the two sets differ by.
    Before two sets are fetched, their parity bitmaps (each hash flips one of at least ``n``
    bits) bound how much they share from above.
3.  Exact round: the prefix filter, in the order of how many documents hold a hash.  Blocks
    of about ``BLOCK`` hashes deal them, packed, to buckets by their value, each hash of a block
    once; a bucket sums and answers to each block which of its hashes two or more documents
    hold.  Hashes that one document holds come first in the order and cannot meet another, so
    a set with enough of them needs no list, and two linked sets share a hash in the rest of
    their prefixes.
    *Index-level skipping*: a list whose entries are one component already is passed over.  The
    others are sorted by size and position and cut into blocks of ``ENTRIES``; each block knows its
    least size, the most that its entries have left behind their positions, and its components.
    An entry passes over blocks that cannot reach the share, and looks into the others only.
    *Answer-level skipping*: where v is linked to its star's centre c, the answer of another set u
    to v is derived from u's answer to c, which is computed once for all members.  With m = c - v
    and p = v - c, which were kept, ``|u & v| = |u & c| - |u & m| + |u & p|``: bounds from the sizes
    of m and p decide most pairs without any set, and for the rest only u is looked up in m and p.
4.  Components of the links.

Word hashes are multilinear (``bytes_view``), shingles have 64 bits of them; within a document or a
pair, a collision has a probability of about size ** 2 / 2 ** 63 over the keys.  Sets for comparisons
are recomputed from the texts of those documents only.

Keys may be hot: joins by a hash, a centre or a class deal the rows of keys that many rows have to
several tasks (``dealing``).  Lists of more than ``PART`` entries are cut into parts by size step and
hash, and pairs of parts that can link meet in a task each, so no task holds more than two parts.
Buckets and tasks of the exact round follow the number of hashes, ``TASK`` bytes each, up to 65,536
buckets.  All tables on the way are dropped once the result, a written table, is there.

A very long text is a set of 8 bytes for each shingle, and about 30 bytes for each word while it is
made.  Nulls: a null or empty text, or one without words, has an empty set, links with nothing and
is its own component.  Rows with a null doc_id take no part; their component is null.  Rows
that share a doc_id are one document, so its texts are linked through it.  A text's
repeated rows, ties of size and extra columns change nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bytes_view import digest, mix, shingle_sets
from brindle.llm.components import components
from brindle.llm.dealing import fetched, hot_keys, hot_of
from brindle.llm.session import bounded_batches, cut, drop, fresh, hold, plain, returning

SKETCH = 16
BLOCK = 1 << 19
#: The ids of documents whose sets are wanted are broadcast up to so many; beyond, as a bitmap of BITS bits.
IDS = 1_000_000
BITS = 1 << 24
PIECE = 32_768
#: Entries of a block of a list, and of a part of a long list.
ENTRIES, PART = 64, 1 << 10
#: Bytes of hashes, or of sets, that a task should get.
TASK = 64 << 20

SCANNED = "doc_id long, n long, hi long, lo long, sketch array<long>, parity binary"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _parity(h: np.ndarray) -> bytes:
    """A bitmap of at least len(h) bits, a power of two; each hash flips one bit."""
    size = max(64, 1 << (len(h) - 1).bit_length())
    flips = np.bincount((h >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _alike(share: int):
    """Keeps pairs that their bitmaps leave open: differing bits are at most what differs between the sets."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny = (c.to_numpy() for c in batch.columns[:4])
            keep = np.zeros(len(x), bool)
            for i in range(len(x)):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint8) for c in batch.columns[4:])
                if len(a) < len(b):
                    a, b = b, a
                if len(a) > len(b):
                    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)))
                apart = int(np.bitwise_count(a ^ b).sum())
                most = (int(nx[i]) + int(ny[i]) - apart) // 2
                keep[i] = 100 * most >= share * (int(nx[i]) + int(ny[i]) - most)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (x, y, nx, ny)], names=["x", "y", "nx", "ny"])

    return alike


def _scan(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.list_(pa.int64())), ("parity", pa.binary())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for r, h in shingle_sets(batch.column(1), width=width):
                rows.append((ids[r], len(h), *digest(h), _signed(np.sort(mix(h))[:SKETCH]), _parity(h)) if len(h) else (ids[r], 0, 0, 0, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return scan


class Block:
    """Sets of some documents, as one sorted array of (hash, document) keys.

    A hash is cut to ``bits`` bits here; hashes that meet only make an order coarser.
    """

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, doc_id: int, h: np.ndarray) -> None:
        self.keys.append((h >> self.shift << np.uint64(16)) | np.uint64(len(self.docs)))
        self.docs.append((doc_id, *digest(h), len(h)))
        self.size += len(h)

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.docs) == 1 << 16


def _dealt(buckets: int, width: int):
    """Rows of blocks: for each bucket of hashes those that one document of the block holds (with it) and those
    that several hold (with how many), and to the block itself (bucket -1) the latter with each document."""
    bits = 32 + buckets.bit_length() - 1

    def rows_of(block: Block, number: int) -> Iterator[tuple]:
        keys = np.sort(np.concatenate(block.keys))
        token, doc = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        times = np.diff(np.append(first, len(token)))
        one = first[times == 1]
        several = times > 1
        shared, k = token[first[several]], times[several].astype(np.uint32)
        many = np.repeat(several, times)
        ids = np.array(block.docs, np.int64)
        yield (-1, number, token[many].tobytes(), doc[many].tobytes(), ids.tobytes())
        edges = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
        cut_one, cut_many = np.searchsorted(token[one], edges), np.searchsorted(shared, edges)
        low_one, doc_one, low_many = token[one].astype(np.uint32), doc[one], shared.astype(np.uint32)
        for b in range(buckets):
            i, j, x, y = cut_one[b], cut_one[b + 1], cut_many[b], cut_many[b + 1]
            if j > i or y > x:
                yield (b, number, np.concatenate([low_one[i:j], low_many[x:y]]).tobytes(), doc_one[i:j].tobytes(), k[x:y].tobytes())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = Block(bits)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for r, h in shingle_sets(batch.column(1), width=width):
                if ids[r] is not None and len(h):
                    block.add(ids[r], h)
                if block.full():
                    yield _dealt_batch(rows_of(block, number))
                    number, block = number + 1, Block(bits)
        if block.size:
            yield _dealt_batch(rows_of(block, number))

    return dealt


DEALT = "bucket int, block long, tokens binary, docs binary, more binary"


def _dealt_batch(rows: Iterator[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "tokens", "docs", "more"])


def _by_key(batches: Iterator[pa.RecordBatch], key: Callable[[tuple], object]) -> Iterator[list[tuple]]:
    """The rows of each key; rows come in the key's order."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and key(rows[-1]) != key(row):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of a bucket, back to each block: its hashes that two or more documents hold, and how many do.

    A block's own rows go through as they are."""
    for rows in _by_key(batches, lambda r: r[:2] if r[0] < 0 else r[0]):
        if rows[0][0] < 0:
            yield _dealt_batch(iter(rows))
            continue
        tokens = [np.frombuffer(r[2], np.uint32) for r in rows]
        value, count = np.unique(np.concatenate(tokens), return_counts=True)
        for t, r in zip(tokens, rows, strict=True):
            k = np.frombuffer(r[4], np.uint32)
            if len(k):
                np.add.at(count, np.searchsorted(value, t[len(t) - len(k) :]), k.astype(np.int64) - 1)
        value, count = value[count > 1], count[count > 1]
        if not len(value):
            continue
        out = []
        for t, r in zip(tokens, rows, strict=True):
            docs = np.frombuffer(r[3], np.uint16)
            at = np.minimum(np.searchsorted(value, t), len(value) - 1)
            hit = value[at] == t
            if hit.any():
                one = hit[: len(docs)]
                found = np.concatenate([np.flatnonzero(one), len(docs) + np.flatnonzero(hit[len(docs) :])])
                pairs = np.stack([t[found], np.minimum(count[at[found]], 2**32 - 1).astype(np.uint32)])
                out.append((r[0], r[1], pairs.tobytes(), docs[one].tobytes(), None))
        if out:
            yield _dealt_batch(iter(out))


def _prefixes(share: int):
    """For the rows of a block: the prefixes of its documents most of whose hashes others hold too.

    Hashes are ordered by how many documents hold them, and those of one document only come
    first: a set with so many of these that they fill its prefix links with nothing.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, lambda r: r[1]):
            token, held, doc = [], [], []
            shared, times = [], []
            own = next(r for r in rows if r[0] < 0)
            ids = np.frombuffer(own[4], np.int64).reshape(-1, 4)
            for r in rows:
                if r[0] >= 0:
                    pairs, docs = np.frombuffer(r[2], np.uint32).reshape(2, -1), np.frombuffer(r[3], np.uint16)
                    high = np.uint64(r[0]) << np.uint64(32)
                    full = pairs[0].astype(np.uint64) | high
                    token.append(full[: len(docs)])
                    held.append(pairs[1][: len(docs)])
                    doc.append(docs)
                    shared.append(full[len(docs) :])
                    times.append(pairs[1][len(docs) :])
            many, of = np.frombuffer(own[2], np.uint64), np.frombuffer(own[3], np.uint16)
            if len(many):
                key, k = np.concatenate(shared), np.concatenate(times)
                order = np.argsort(key)
                token.append(many)
                held.append(k[order][np.searchsorted(key[order], many)])
                doc.append(of)
            if not token:
                continue
            token, held, doc = np.concatenate(token), np.concatenate(held), np.concatenate(doc).astype(np.int64)
            known = np.bincount(doc, minlength=len(ids))
            n = ids[:, 3]
            need = -(-share * n // 100)
            open_ = known >= need
            keep = open_[doc]
            token, held, doc = token[keep], held[keep], doc[keep]
            order = np.lexsort((token, held, doc))
            token, doc = token[order], doc[order]
            begin = np.searchsorted(doc, np.arange(len(ids) + 1))
            out = []
            for d in np.flatnonzero(open_):
                alone = n[d] - known[d]
                take = n[d] - need[d] + 1 - alone
                out.append((*ids[d, :3].tolist(), int(alone), token[begin[d] : begin[d] + take].view(np.int64)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "hi", "lo", "alone", "prefix"])

    return prefixes


def _sets(bitmap: np.ndarray | None, width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            if bitmap is not None:
                at = _bit(ids.fill_null(0).to_numpy().astype(np.int64))
                known &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            values = ids.to_pylist()
            rows, size = [], 0
            for r, h in shingle_sets(batch.column(1), known, width):
                if len(h):
                    rows.append((values[r], h.tobytes()))
                    size += len(h)
                if size > BLOCK:
                    yield _set_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _set_batch(rows)

    return sets


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, items = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["doc_id", "items"])


def _bit(ids: np.ndarray) -> np.ndarray:
    """A position in the bitmap; the same as _bit_of()."""
    return ids % BITS


def _bit_of(column: str) -> F.Column:
    return F.pmod(F.col(column), F.lit(BITS))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's hashes b has; both are sorted."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a


def _overlaps(share: int):
    """From rows (x, y, side, items) in the order of (x, y, side): what each x and y share, and what linked ones differ by."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        pair = None
        for batch in batches:
            x, y, side = (batch.column(i).to_numpy() for i in range(3))
            items = batch.column(3)
            rows = []
            for i in range(batch.num_rows):
                if pair != (x[i], y[i]):
                    pair, left = (x[i], y[i]), []
                own = np.frombuffer(items[i].as_buffer(), np.uint64)
                if side[i] == 0:
                    left.append(own.copy())
                    continue
                for a in left:
                    here = _shared(own, a)
                    k = int(here.sum())
                    near = 100 * k >= share * (len(a) + len(own) - k)
                    minus, plus = (a[~_shared(a, own)], own[~here]) if near else (a[:0], a[:0])
                    rows.append((int(x[i]), int(y[i]), k, len(a), len(own), near, minus.tobytes(), plus.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=COMPARED_NAMES)

    return overlaps


COMPARED = "x long, y long, overlap long, nx long, ny long, linked boolean, minus binary, plus binary"
COMPARED_NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (u, v, uc, nu, nv, minus, plus, items of u): what u and v share, by what v's centre and v differ by."""
    for batch in batches:
        u, v, uc, nu, nv = (c.to_numpy() for c in batch.columns[:5])
        got = uc.copy()
        for i in range(batch.num_rows):
            minus, plus, own = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in batch.columns[5:])
            got[i] += int(_shared(plus, own).sum()) - int(_shared(minus, own).sum())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (u, v, got, nu, nv)], names=["x", "y", "overlap", "nx", "ny"])


def _linked(overlap: str, a: str, b: str, share: int) -> F.Column:
    return F.expr(f"100 * {overlap} >= {share} * ({a} + {b} - {overlap})")


def list_pairs(size: np.ndarray, place: np.ndarray, node: np.ndarray, comp: np.ndarray, side: np.ndarray, share: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(node, nodes that its set may be linked with, entries looked at) of each entry of a list in order of size and place.

    Two entries may link if their components differ, their sides do (or are 0), and what either has from its place
    on is as much as they must share.
    """
    m = len(size)
    rest = size - place  # what an entry has from its place on
    heads = np.arange(0, m, ENTRIES)
    least, most = size[heads], np.maximum.reduceat(rest, heads)
    low, high = np.minimum.reduceat(comp, heads), np.maximum.reduceat(comp, heads)
    last = np.searchsorted(size, size * 100 // share, "right")  # sizes beyond cannot reach the share
    for i in range(m - 1):
        if last[i] <= i + 1:
            continue
        a, b = (i + 1) // ENTRIES, (last[i] - 1) // ENTRIES + 1
        open_ = (np.minimum(rest[i], most[a:b]) >= -(-share * (size[i] + least[a:b]) // (100 + share))) & ((low[a:b] != comp[i]) | (high[a:b] != comp[i]))
        if not open_.any():
            continue
        j = ((a + np.flatnonzero(open_))[:, None] * ENTRIES + np.arange(ENTRIES)).ravel()
        j = j[(j > i) & (j < last[i])]
        need = -(-share * (size[i] + size[j]) // (100 + share))
        ok = (comp[j] != comp[i]) & (np.minimum(rest[i], rest[j]) >= need) & ((side[j] != side[i]) | (side[j] == 0))
        yield int(node[i]), node[j[ok]], len(j)


def _open_pairs(share: int):
    """From rows (list, size and place, class, component, side) in order: pairs of different components."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Whole lists, many at a time; a long list waits in compact arrays until its end."""
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))
            if end:
                parts = [*rest, [c[:end] for c in now]]
                yield [np.concatenate(c) for c in zip(*parts, strict=True)]
                rest = []
            elif rest and rest[-1][0][-1] != now[0][0]:
                yield [np.concatenate(c) for c in zip(*rest, strict=True)]
                rest = []
            rest.append([c[end:] for c in now])
        if rest:
            yield [np.concatenate(c) for c in zip(*rest, strict=True)]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, node, comp, side in blocks(batches):
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            found: set[tuple[int, int]] = set()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for x, others, _ in list_pairs(at[a:b] >> 32, at[a:b] & 0xFFFFFFFF, node[a:b], comp[a:b], side[a:b], share):
                    found.update((x, y) for y in others.tolist() if y != x)
                    if len(found) >= 1 << 16:
                        yield _pair_batch(found)
            if found:
                yield _pair_batch(found)

    return pairs


def _dealt_lists(entries: DataFrame, share: int) -> DataFrame:
    """entries (token, at, n, node, comp) -> (list, at, node, comp, side) of lists with more than one component.

    An entry of a list of more than PART entries goes to the parts of its own size step, and of the steps beside it, that
    its part is to meet.
    """
    counts = cut(entries.groupBy("token").agg(F.count("*").alias("k"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("token", "k"))
    hot = hot_keys(counts)
    some = fetched(entries, counts, ["token"], hot)
    step = F.floor(F.log("n") / F.log(F.lit(100 / share))).cast("int")
    short = some.where(F.col("k") <= PART).select(F.col("token").alias("list"), "at", "node", "comp", F.lit(0).alias("side"))
    long = some.where(F.col("k") > PART).withColumn("step", step)
    if counts.where(F.col("k") > PART).isEmpty():
        return short
    # how many parts each step of a long list has, as a map: steps of a list are as few as logarithms of sizes
    parts = long.groupBy("token", "step").agg(F.ceil(F.count("*") / PART).cast("int").alias("p"))
    parts = parts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("step", "p"))).alias("parts"))
    long = fetched(long, parts, ["token"], hot)
    of = lambda s: F.coalesce(F.try_element_at("parts", s), F.lit(0))
    own = F.pmod(F.xxhash64("node"), of(F.col("step"))).cast("int")
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def meets(s, p, t, q, side):
        return F.struct(s.alias("s"), p.alias("p"), t.alias("t"), q.alias("q"), side.cast("int").alias("side"))

    st, mine = F.col("step"), F.col("own")
    same = F.transform(every(of(st)), lambda r: meets(st, F.least(r, mine), st, F.greatest(r, mine), F.when(r == mine, 0).when(mine < r, 1).otherwise(2)))
    up = F.transform(every(of(st + 1)), lambda r: meets(st, mine, st + 1, r, F.lit(1)))
    down = F.transform(every(of(st - 1)), lambda r: meets(st - 1, r, st, mine, F.lit(2)))
    long = long.withColumn("own", own).withColumn("g", F.explode(F.concat(same, up, down)))
    # lists that share a hash by chance only give more candidates
    return short.union(long.select(F.xxhash64("token", "g.s", "g.p", "g.t", "g.q").alias("list"), "at", "node", "comp", F.col("g.side").alias("side")))


def _pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    x, y = np.array(sorted((min(p), max(p)) for p in found), np.int64).reshape(-1, 2).T
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])


class Join:
    """The steps of a join, over texts (doc_id, text), which drop what they wrote when the join is done."""

    def __init__(self, texts: DataFrame, share: int, width: int):
        self.texts, self.share, self.width = texts, share, width
        self.spark = texts.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[DataFrame] = []

    def kept(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.tables.append(out)
        return out

    def tasks(self, size: int | None) -> int:
        return max(self.parts, -(-int(size or 0) // TASK))

    def alike(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """pairs (x, y) that may be linked -> (x, y, nx, ny)."""
        pairs = self.kept(pairs)
        side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
        hot_x, hot_y = hot_of(pairs, ["x", "y"])
        both = fetched(fetched(pairs, side("x"), ["x"], hot_x), side("y"), ["y"], hot_y).select("x", "y", "nx", "ny", "px", "py")
        return self.kept(both.mapInArrow(returning(_alike(self.share)), "x long, y long, nx long, ny long").distinct())

    def sets(self, ids: DataFrame) -> DataFrame:
        """(doc_id, items binary), the sorted hashes of the documents of ids (doc_id), a written table."""
        width = self.width
        if ids.count() <= IDS:
            wanted = self.texts.join(F.broadcast(ids), "doc_id", "left_semi")
            return wanted.mapInArrow(returning(lambda it: _sets(None, width)(it)), "doc_id long, items binary")
        bits = ids.select(_bit_of("doc_id").alias("b")).groupBy(F.floor(F.col("b") / PIECE).alias("piece")).agg(F.expr(f"bitmap_construct_agg(b % {PIECE})").alias("bits"))
        bitmap = np.zeros(BITS // 8, np.uint8)
        for piece, part in bits.collect():  # at most BITS / PIECE rows of 4 KB
            bitmap[piece * PIECE // 8 :][: len(part)] = np.frombuffer(part, np.uint8)
        held = self.spark.sparkContext.broadcast(bitmap)
        return self.texts.mapInArrow(returning(lambda it: _sets(held.value, width)(it)), "doc_id long, items binary")

    def compared(self, pairs: DataFrame, size: int | None) -> DataFrame:
        """pairs (x, y), whose sets have ``size`` bytes, -> COMPARED; texts that share a doc_id give a row each.  One scan serves both sides."""
        sides = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("doc_id"), F.lit(0).alias("side")), F.struct(F.col("y").alias("doc_id"), F.lit(1).alias("side")))).alias("s"), "x", "y").select("s.*", "x", "y")
        ids = self.kept(sides.groupBy("doc_id").agg(F.count("*").alias("k")))
        rows = fetched(sides, self.sets(ids.select("doc_id")), ["doc_id"], hot_keys(ids)).select("x", "y", "side", "items")
        rows = rows.repartition(self.tasks(size), "x", "y").sortWithinPartitions("x", "y", "side")
        return self.kept(rows.mapInArrow(returning(_overlaps(self.share)), COMPARED))

    def entries(self, total: int) -> DataFrame:
        """(doc_id, hi, lo, alone, prefix): the hashes of each set's prefix that others hold too, ``alone`` others going before them."""
        size = 8 * total
        tasks = self.tasks(size)
        buckets = min(1 << 16, max(256, 1 << (4 * tasks - 1).bit_length()))
        dealt = self.texts.mapInArrow(returning(_dealt(buckets, self.width)), DEALT)
        dealt = dealt.repartition(tasks, F.col("bucket") < 0, F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket").cast("long"))).sortWithinPartitions("bucket", "block")
        answered = dealt.mapInArrow(returning(_answered), DEALT).repartition(tasks, "block").sortWithinPartitions("block")
        return answered.mapInArrow(returning(_prefixes(self.share)), "doc_id long, hi long, lo long, alone long, prefix array<long>")

    def answers(self, pairs: DataFrame, found: DataFrame, told: dict | None) -> list[DataFrame]:
        """Links among pairs (x, y, nx, ny) of different components, derived from what centres shared with their members (found)."""
        linked = lambda k, a, b: f"100 * ({k}) >= {self.share} * ({a} + {b} - ({k}))"
        # the centre that a set is most alike
        best = found.groupBy("y").agg(F.max(F.struct("overlap", "x", "nx")).alias("c"))
        centre = self.kept(best.select("y", F.col("c.x").alias("c"), F.col("c.overlap").alias("vc"), F.col("c.nx").alias("nc")))
        hot_x, hot_y = hot_of(pairs, ["x", "y"])
        rows = fetched(pairs, centre, ["y"], hot_y, "left")
        rows = fetched(rows, centre.selectExpr("y x", "c xc", "vc xvc", "nc xnc"), ["x"], hot_x, "left")
        # v is the one that has a centre, c; u the other
        rows = self.kept(rows.selectExpr("if(c is null and xc is not null, y, x) u", "if(c is null and xc is not null, x, y) v", "if(c is null and xc is not null, ny, nx) nu", "if(c is null and xc is not null, nx, ny) nv", "coalesce(c, xc) c", "coalesce(vc, xvc) vc", "coalesce(nc, xnc) nc"))
        links = []
        whole = rows.where("c is null or c = u").selectExpr("u x", "v y", "nu nx", "nv ny")
        asked = rows.where("c <> u").selectExpr("c x", "u y", "nc nx", "nu ny")
        asked = self.kept(asked.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny")))
        known = None
        if not asked.isEmpty():
            known = self.compared(asked, asked.agg(F.sum(8 * (F.col("nx") + F.col("ny")))).first()[0])
            links.append(known.where("linked").selectExpr("x a", "y b"))
            # texts that share a doc_id may give several answers; pairs with those are compared whole
            told_once = known.groupBy("x", "y").agg(F.count("*").alias("times"), F.max("overlap").alias("uc"), F.max("linked").alias("same"))
            rows = rows.where("c <> u").withColumn("pair", F.xxhash64("c", "u"))
            rows = fetched(rows, told_once.selectExpr("xxhash64(x, y) pair", "x c", "y u", "times", "uc", "same"), ["pair", "c", "u"], hot_of(rows, ["pair"])[0]).drop("pair")
            how = F.expr(f"case when times > 1 then 'whole' when same then 'same' when {linked('uc + vc - nc', 'nu', 'nv')} then 'linked' when not ({linked('least(uc, vc) + least(nu - uc, nv - vc)', 'nu', 'nv')}) then 'apart' else 'differ' end")
            rows = self.kept(rows.withColumn("how", how))
            links.append(rows.where("how = 'linked'").selectExpr("u a", "v b"))
            whole = whole.union(rows.where("how = 'whole'").selectExpr("u x", "v y", "nu nx", "nv ny"))
            differ = rows.where("how = 'differ'").select("u", "v", "c", "uc", "nu", "nv")
            if not differ.isEmpty():
                differ = self.kept(differ)
                hot_u, hot_v = hot_of(differ, ["u", "v"])
                kept = fetched(differ, found.selectExpr("y v", "x c", "minus", "plus"), ["v", "c"], hot_v)
                ids = self.kept(differ.selectExpr("u doc_id").distinct())
                sets = self.sets(ids).selectExpr("doc_id u", "items")
                size = differ.agg(F.sum(8 * (F.col("nu") + F.col("nv")))).first()[0]
                both = fetched(kept, sets, ["u"], hot_u)
                both = both.select("u", "v", "uc", "nu", "nv", "minus", "plus", "items").repartition(self.tasks(size), "u", "v")
                derived = self.kept(both.mapInArrow(returning(_derived), "x long, y long, overlap long, nx long, ny long"))
                links.append(derived.where(_linked("overlap", "nx", "ny", self.share)).selectExpr("x a", "y b"))
        whole = self.kept(whole.distinct())
        if not whole.isEmpty():
            size = whole.agg(F.sum(8 * (F.col("nx") + F.col("ny")))).first()[0]
            links.append(self.compared(whole, size).where("linked").selectExpr("x a", "y b"))
        if told is not None:
            told["whole"] = whole.count()
            told.update({r["how"]: r["count"] for r in rows.groupBy("how").count().collect()} if known is not None else {})
        return links


def jaccard_groups(docs: DataFrame, share: int = 80, width: int = 5, told: dict | None = None) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles long, component_id long), one row per row.

    ``share`` is the similarity in percent, ``width`` the words in a shingle.  The module's
    docstring has the method, and what nulls, empty texts and repeated rows give.  ``told``, if given,
    gets the number of pairs by how the last round answered them.
    """
    spark = bounded_batches(docs).sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    join = Join(texts, share, width)
    scanned = hold(texts.mapInArrow(returning(_scan(width)), SCANNED))

    # 1. classes of equal sets; the smallest doc_id stands for a class
    taking = "n > 0 and doc_id is not null"
    full = scanned.where(taking)
    classes = join.kept(full.groupBy("hi", "lo").agg(F.count("*").alias("k"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")))
    total = classes.agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
    row = full.select("doc_id", "n", "hi", "lo")
    large = hot_keys(classes.select("hi", "k"))
    # texts that share a doc_id
    member = fetched(row, classes.select("hi", "lo", "rep"), ["hi", "lo"], large).select("doc_id", "rep")
    ends = join.kept(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a"))
    links = []
    if not ends.isEmpty():
        member = join.kept(member)
        links.append(join.kept(fetched(member, ends, ["doc_id"], hot_of(member, ["doc_id"])[0]).select("a", F.col("rep").alias("b")).where("a <> b").distinct()))

    # 2. stars
    small = classes.select(F.explode("sketch").alias("token"), "rep", "n", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / share))).alias("step"))
    counts = join.kept(small.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    hot = hot_keys(counts)
    small = join.kept(fetched(small, counts, ["token"], hot))
    # a set most of whose hashes many others have stands nearest to the middle of its group
    middle = small.groupBy("rep").agg(F.round(F.sum(F.log("k")), 3).alias("score"))
    small = join.kept(small.join(middle, "rep").select("token", "step", F.struct((-F.col("score")).alias("s"), "rep", "n").alias("d")))
    star = None
    for keys in (["token"], ["token", "step"]):
        best = small.groupBy(*keys).agg(F.min("d").alias("c"))
        more = fetched(small, best, keys, hot).select("c", "d")
        star = more if star is None else star.union(more)
    star = star.where(f"d.rep <> c.rep and 100 * least(c.n, d.n) >= {share} * greatest(c.n, d.n)").select("c", F.col("d.rep").alias("rep"))
    star = join.alike(star.select(F.col("c.rep").alias("x"), F.col("rep").alias("y")).distinct(), classes)
    size = star.agg(F.sum(8 * (F.col("nx") + F.col("ny")))).first()[0]
    found = join.compared(star, size).where("linked")
    links.append(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    every = lambda: functools.reduce(DataFrame.union, links)
    first = components(every())
    join.tables.append(first)

    # 3. what the stars leave open
    nodes = classes.select("hi", "lo", F.col("rep").alias("doc_id"), "n").join(first.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    nodes = nodes.select("hi", "lo", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    lists = join.entries(total).join(nodes, ["hi", "lo", "doc_id"]).select(F.posexplode("prefix").alias("place", "token"), "alone", "n", "doc_id", "comp")
    lists = join.kept(lists.select("token", F.expr("shiftleft(n, 32) + alone + place").alias("at"), "n", F.col("doc_id").alias("node"), "comp"))
    lists = _dealt_lists(lists, share).repartition(join.tasks(None), "list").sortWithinPartitions("list", "at", "node")
    pairs = join.alike(lists.mapInArrow(returning(_open_pairs(share)), "x long, y long").distinct(), classes)
    if not pairs.isEmpty():
        links += join.answers(pairs, found, told)
        first = components(every())
        join.tables.append(first)

    # 4. each row's component, through its class
    top = classes.join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    linked = fetched(row, top, ["hi", "lo"], large).select("doc_id", "n", "component")
    # rows with an empty set are their own component, those with a null doc_id have none
    alone = scanned.where(f"not ({taking})").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = cut(linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))
    for table in join.tables:
        drop(table)
    scanned.unpersist()
    return out


def keep_representatives(docs: DataFrame, share: int = 80, width: int = 5) -> DataFrame:
    """docs with one row of each group of linked documents: that of the smallest doc_id, a repeated row once.

    Documents with an empty set, and rows with a null doc_id, link with nothing and stay.
    """
    groups = jaccard_groups(docs, share, width)  # a written table
    key = fresh(docs, "__id")
    # rows of a doc_id share a group, so the ids that go decide
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
    again = groups.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    if again.isEmpty():
        return kept
    # of rows that share a doc_id, one with a set stays: the first by text
    twice = kept.join(again, kept["doc_id"] == again[key], "left_semi")
    once = kept.join(again, kept["doc_id"] == again[key], "left_anti")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct((~F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]"))).alias("e"), F.col("text").alias("t"), F.struct(*plain(rest)).alias("r") if rest else F.lit(0).alias("r"))
    first = twice.where("text is not null").groupBy("doc_id").agg(F.min(row).alias("row"))
    first = first.select("doc_id", F.col("row.t").alias("text"), *([F.col(f"row.r.{c}") for c in plain(rest)] if rest else []))
    return once.unionByName(first)


#: The same groups: shingles as texts, all pairs that share one, and what links reach.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), d AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w
), c AS (
  SELECT min(doc_id) AS rep, len(s) AS n, s FROM d WHERE len(s) > 0 GROUP BY s
), x AS (
  SELECT rep, n, unnest(s) AS g FROM c
), p AS (
  SELECT a.rep AS a, b.rep AS b, a.n + b.n AS total, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), e AS (
  SELECT a, b FROM p WHERE 100 * k >= 80 * (total - k) UNION SELECT b, a FROM p WHERE 100 * k >= 80 * (total - k)
), r AS (
  SELECT rep AS id, rep AS other FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other
), t AS (
  SELECT id, min(other) AS top FROM r GROUP BY id
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(t.top, d.doc_id) AS component_id FROM d LEFT JOIN c ON c.s = d.s LEFT JOIN t ON t.id = c.rep
"""
