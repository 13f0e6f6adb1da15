"""Order-preserving packing of tokenised documents into sequences.

Documents stay in the order of the scan; each is its token ids and one end id.  The stream of
a task is cut into windows of at most ``length`` ids by dynamic programming over candidate
cuts: ends of documents (free), ends of sentences (``SENTENCE``) and, where a sentence is too
long or the stream ends, any place (``HARD``).  A window pays ``EACH``, so that short ones are
not chosen freely, and its padding, ``length`` less its ids, or none if its length is a power
of two.  With f the least cost up to a cut,

    f(j) = penalty(j) + EACH + min(length - c_j + min over c_j - c_i <= length of (f(i) + c_i),
                                   min over k of f(cut at c_j - 2 ** k))

and the inner minimum over a sliding window comes from a monotone queue, so the work is linear
in the cuts.  Blocks of about ``BLOCK`` ids are solved at a time: their windows are kept up to
the cheapest cut in the last ``length`` ids and the rest goes in front of the next block, so
memory is bounded by a block and the longest document.

Units, words cut between letters and signs, are tokenised once each.  That gives the ids of the
text only if the tokenizer says so: its normalizer must do no more than NFC, lower case and white
space, and its pre-tokenizer must keep runs of letters apart from runs of signs and drop white
space (``SEPARATES``).  Other tokenizers get whole texts.  A unit is looked up by a hash, and its
bytes are compared before its ids are used.

A very long text is one run of ids, about 4 bytes for a token and some 20 for a word of it, besides
the text itself.  Nulls: a null or empty text is its end id alone.  Null and repeated doc_ids are packed as rows
of their own.  Extra columns are ignored, an empty table gives no rows.  Sequence numbers hold
the task's partition in their upper bits; a task that is run again gives the same rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bytes_view import LOWER, SPACE, chunks, spans, word_hashes
from brindle.llm.session import bounded_batches, returning

LENGTH, END_ID = 4096, 2
SENTENCE, HARD, EACH = 6, 24, 12
BLOCK = 1 << 18
#: Units, and bytes of them, that are kept with their ids; beyond, all are forgotten and tokenised again.
UNITS, UNIT_BYTES = 1 << 17, 1 << 23

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])

_loaded: dict[str, UnitIds | TextIds] = {}

#: Normalizers and pre-tokenizers under which the ids of a text are those of its units.
HARMLESS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
SEPARATES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Bytes of ASCII signs, but for the apostrophe (contractions) and digits.
SIGN = np.zeros(256, bool)
SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Units that normalisation leaves alone: lower-case ASCII and Latin-1 letters.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like spans(), but words also end between a letter and a sign, where no token goes across."""
    starts, ends, at = spans(raw, off)
    if not len(raw):
        return starts, ends, at
    letter = ASCII_LETTER[raw]
    # Latin-1 letters, by their second byte
    wide = np.zeros(len(raw), bool)
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    sign = SIGN[raw]
    inside = np.flatnonzero((letter[:-1] | wide[:-1]) & sign[1:] | sign[:-1] & letter[1:]) + 1
    if len(inside):
        inside = inside[~np.isin(inside, off)]
        starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
    return starts, ends, np.searchsorted(starts, off)


def _loads(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def separable(path: str) -> bool:
    """Whether a tokenizer's file says that its ids of a text are those of the text's units."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    normal, cutter, model = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}, told.get("model") or {}
    steps, cutters = normal.get("normalizers", []), cutter.get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": SEPARATES}, "behavior": "Removed", "invert": True}
    return (
        normal.get("type") == "Sequence"
        and {"type": "Lowercase"} in steps
        and all(x in HARMLESS for x in steps)
        and cutter.get("type") == "Sequence"
        and len(cutters) == 2
        and cutters[0] == split
        and cutters[1].get("type") == "ByteLevel"
        and not cutters[1].get("use_regex", True)
        and not cutters[1].get("add_prefix_space", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(x.get("special") for x in told.get("added_tokens", []))  # whose strings are ordinary text here
    )


class TextIds:
    """Token ids of whole texts, for tokenizers of any kind."""

    def __init__(self, path: str, end_id: int = END_ID):
        self.tokenizer, self.end_id = _loads(path), end_id

    def forget(self) -> None:
        """Nothing is kept."""

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, raw, off in chunks(column):
            ids, ends, stops, place = [], [], [], 0
            for r in range(j - i):
                text = raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
                got = self.tokenizer.encode(text, add_special_tokens=False)
                stops += [place + k for k, (_, e) in enumerate(got.offsets, 1) if e and text[e - 1 : e] in ".!?" and (text[e : e + 1] or " ").isspace()]
                ids.append(np.array([*got.ids, self.end_id], np.uint32))
                place += len(got.ids) + 1
                ends.append(place)
            yield i, np.concatenate(ids), np.array(ends, np.int64), np.array(stops, np.int64)


class UnitIds:
    """Token ids of units, remembered with their bytes in an open hash table."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = _loads(path)
        # the same model without normalisation, for plain units between bars
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bar = self._encode(["|"])[0]
        if len(self.bar) != 1:
            raise ValueError(f"{path}: a bar is {len(self.bar)} tokens")
        self.end_id = end_id
        self.forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.keys = np.zeros(8 * UNITS, np.uint64)
        self.places = np.zeros(8 * UNITS, np.int32)
        self.ids = np.full(1 << 16, self.end_id, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.begin[1] = 1
        # an entry's bytes; entry 0 is the end of a document, whose bytes no unit has
        self.bytes = np.zeros(1 << 18, np.uint8)
        self.byte_at = np.zeros(1 << 16, np.int64)
        self.n = 1

    def _add(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(sizes), self.n
        for name, base, more in (("ids", self.begin[n], len(ids)), ("bytes", self.byte_at[n], len(data)), ("begin", n + 1, k), ("byte_at", n + 1, k)):
            held = getattr(self, name)
            if base + more > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), base + more - len(held)), held.dtype)]))
        self.ids[self.begin[n] : self.begin[n] + len(ids)] = ids
        self.bytes[self.byte_at[n] : self.byte_at[n] + len(data)] = data
        self.begin[n + 1 : n + 1 + k] = self.begin[n] + np.cumsum(sizes)
        self.byte_at[n + 1 : n + 1 + k] = self.byte_at[n] + np.cumsum(lengths)
        self.n += k

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of new units, in their order, as entries."""
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = [k for k, t in enumerate(texts) if PLAIN.fullmatch(t)]
        lists: list = [None] * len(texts)
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            ids = np.array(self.plain.encode_batch_fast([" | ".join([texts[k] for k in part]) + " |"], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(ids == self.bar[0])
            for k, a, b in zip(part, [0, *(stops[:-1] + 1).tolist()], stops.tolist(), strict=True):
                lists[k] = ids[a:b]
        other = [k for k, x in enumerate(lists) if x is None]
        for k, ids in zip(other, self._encode([texts[k] for k in other]), strict=True):
            lists[k] = np.array(ids, np.uint32)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self._add(np.concatenate(lists), sizes, raw[_flat(starts, ends - starts)], ends - starts)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], (slot[on] + 1) & int(mask)
        return out

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.places[slot[mine]] = places[mine]
            keys, places, slot = keys[~mine], places[~mine], (slot[~mine] + 1) & mask

    def entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each unit."""
        raw = LOWER[raw]
        keys = word_hashes(raw, starts, ends) | np.uint64(1)
        if self.n > 2 * UNITS or self.byte_at[self.n] > UNIT_BYTES:
            self.forget()
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.n + len(new) >= len(self.keys) // 2:  # one very long text
                old = self.keys, self.places
                self.keys = np.zeros(1 << (4 * (self.n + len(new))).bit_length(), np.uint64)
                self.places = np.zeros(len(self.keys), np.int32)
                full = old[0] != 0
                self._put(old[0][full], old[1][full])
            values, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            self._put(values, np.arange(self.n, self.n + len(values), dtype=np.int32))
            found[new] = self.n + inverse
            self._learn(raw, starts[new[first]], ends[new[first]])
        # units that only share a hash with what was found get entries of their own, which no key leads to
        other = self._differ(found, raw, starts, ends)
        if len(other):
            found[other] = self.n + np.arange(len(other))
            self._learn(raw, starts[other], ends[other])
        return found

    def _differ(self, found: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The units whose bytes are not those of their entries."""
        size = ends - starts
        apart = size != self.byte_at[found + 1] - self.byte_at[found]
        same = np.flatnonzero(~apart)
        if len(same):
            mine, held = _flat(starts[same], size[same]), _flat(self.byte_at[found[same]], size[same])
            apart[same] = np.logical_or.reduceat(raw[mine] != self.bytes[held], np.cumsum(size[same]) - size[same])
        return np.flatnonzero(apart)

    def flat(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of entries, and where each ends."""
        n = self.begin[entries + 1] - self.begin[entries]
        return self.ids[_flat(self.begin[entries], n)], np.cumsum(n)

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, raw, off in chunks(column):
            starts, ends, at = units(raw, off)
            entries = self.entries(raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
            last = raw[ends - 1] if len(ends) else raw[:0]
            after = raw[np.minimum(ends, len(raw) - 1)] if len(ends) else raw[:0]
            stop = ((last == 46) | (last == 33) | (last == 63) | (after == 10)) & SPACE[after]
            where = at[1:]
            ids, till = self.flat(np.insert(entries, where, 0))
            rows = till[where + np.arange(j - i)]
            yield i, ids, rows, till[np.flatnonzero(np.insert(stop, where, False))]


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def ids_by(path: str) -> UnitIds | TextIds:
    if path not in _loaded:
        _loaded[path] = UnitIds(path) if separable(path) else TextIds(path)
    return _loaded[path]


def token_runs(column: pa.Array, ids_of: UnitIds | TextIds) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, ids of a run of rows with end ids, where each row ends, where sentences end)."""
    return ids_of.runs(column)


def best_cuts(cuts: list[int], penalty: list[int], length: int, final: bool) -> list[int]:
    """Indices of the chosen cuts, the first one included; cuts rise from 0 by at most ``length``."""
    n = len(cuts)
    cost, back = [0] * n, [0] * n
    at = {0: 0}
    powers = [p for p in (1 << k for k in range(length.bit_length())) if p < length]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        c = cuts[j]
        while c - cuts[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = cost[i] + cuts[i] + length - c
        for p in powers:
            k = at.get(c - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalty[j] + EACH
        cost[j], back[j] = best, i
        at[c] = j
        worth = best + c
        while queue and cost[queue[-1]] + cuts[queue[-1]] >= worth:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not final:
        first = next(k for k in range(n) if cuts[-1] - cuts[k] < length)
        j = min(range(max(first, 1), n), key=lambda k: (cost[k], -k))
    out = [j]
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


class Packer:
    """Takes runs of documents, gives rows of pieces."""

    def __init__(self, length: int, prefix: int):
        self.length, self.next = length, prefix
        self.ids, self.docs, self.stops = np.zeros(0, np.uint32), [], np.zeros(0, np.int64)  # docs: (end in ids, id, length)

    def add(self, ids: np.ndarray, names: list, ends: np.ndarray, stops: np.ndarray) -> None:
        base = len(self.ids)
        sizes = np.diff(ends, prepend=0)
        self.docs += zip((ends + base).tolist(), names, sizes.tolist(), strict=True)
        self.stops = np.concatenate([self.stops, stops + base])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, final: bool) -> list[tuple]:
        size = len(self.ids)
        if not size:
            return []
        price = np.full(size + 1, -1, np.int64)
        price[self.stops] = SENTENCE
        price[[e for e, *_ in self.docs]] = 0
        price[0] = 0
        if final and price[size] < 0:
            price[size] = HARD
        if final:  # the rest of the stream in powers of two
            for whole in (size // self.length * self.length, max(0, size // self.length - 1) * self.length):
                place = whole
                for k in range(self.length.bit_length() - 1, -1, -1):
                    while size - place >= 1 << k:
                        if price[place] < 0:
                            price[place] = HARD
                        place += 1 << k
        cuts = np.flatnonzero(price >= 0)
        gaps = np.flatnonzero(np.diff(cuts) > self.length // 2)
        for g in gaps:  # inside of very long sentences
            price[np.arange(cuts[g] + self.length // 4, cuts[g + 1], self.length // 4)] = HARD
        if not final and size - cuts[-1] > self.length // 2:
            price[np.arange(cuts[-1] + self.length // 4, size + 1, self.length // 4)] = HARD
        cuts = np.flatnonzero(price >= 0)
        chosen = best_cuts(cuts.tolist(), price[cuts].tolist(), self.length, final)
        rows = []
        windows = [int(cuts[k]) for k in chosen]
        d, begin = 0, 0
        starts = [e - n for e, _, n in self.docs]
        for a, b in zip(windows, windows[1:], strict=False):
            place = a
            while place < b:
                while self.docs[d][0] <= place:
                    d += 1
                end, name, n = self.docs[d]
                till = min(end, b)
                piece = self.ids[place:till]
                rows.append((name, place - starts[d], till - place, zlib.crc32(piece.astype("<u4").tobytes()), n, self.next, place - a))
                place = till
            self.next += 1
            begin = b
        self.ids = self.ids[begin:]
        self.docs = [(e - begin, name, n) for e, name, n in self.docs if e > begin]
        self.stops = self.stops[self.stops > begin] - begin
        return rows


def _pack(path: str, length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_by(path)
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=FIELDS)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids, ends, stops in token_runs(batch.column(1), ids_of):
                packer.add(ids, names[i : i + len(ends)], ends, stops)
                if len(packer.ids) >= BLOCK and (rows := packer.take(False)):
                    yield batch_of(rows)
        if rows := packer.take(True):
            yield batch_of(rows)
        ids_of.forget()  # the worker may wait for long, or serve other stages

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """docs (doc_id long, text string, ...) -> one row per piece of a document in a sequence: SCHEMA."""
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(returning(_pack(tokenizer, length)), SCHEMA)
