"""Language identification with labelled spans.

A model has, for each learned language, log-probabilities of hashed letter trigrams (of
bytes, with word ends) and the scripts that the language uses.  In a text, the script of a
word, from ranges of code points, narrows the candidates: only languages that use it are
scored for the word, and no other can be its label (all are candidates for a script that no
learned language uses).  A word's score for a candidate is the sum over its trigrams; a word without a letter
scores 0 for all.  Viterbi over the words, with a penalty for each switch, labels
spans.  The prediction is the language that covers the most letters, the score its share.
Letters are code points that Unicode calls letters or marks; ``\u00d7`` and ``\u00f7`` are none.

Learning takes documents with a lang, those whose crc32(doc_id) mod 5 is not 0 only, about
``PER_LANGUAGE`` of each language, drawn by a hash of doc_id, whole texts.  Every lang that
occurs there is learned, however rare.  The model holds the trigrams that a language has, so
rare languages are small in it; beyond ``WIDE`` languages texts are scored in smaller groups,
and a long one in runs of words.  Predicting sees nothing but the text.  A very long text is
taken whole: some 40 bytes for each of its bytes, and 5 for each word and language.

Nulls: a null text, or one without any letter, is ``und`` with score 0, as is every text if
there is nothing to learn from.  A null doc_id counts as held out.  Rows with a null lang are
predicted, not learned from.  Repeated rows count each, ties go to the language that sorts
first, extra columns pass through, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.bytes_view import LOWER, chunks, spans
from brindle.llm.session import bounded_batches, returning

PER_LANGUAGE = 4_000
BUCKETS = 1 << 16
SWITCH = 12.0
#: The score of a language that is no candidate: no path that a switch could avoid goes through it.
FORBIDDEN = -1e6
GROUP, PIECE = 1 << 20, 1 << 18
WIDE = 64
FOLDS = 5

#: Scripts by ranges of code points; the later one wins in a word of several.
SCRIPTS = [
    ("latin", 0x00C0, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


def _script_table() -> np.ndarray:
    """The script's number by the first two bytes of a character; 0 is none."""
    table = np.zeros(1 << 16, np.uint8)
    for number, (_, low, high) in enumerate(SCRIPTS, 1):
        for cp in range(low, high + 1):
            a, b = chr(cp).encode("utf-8", "surrogatepass")[:2]
            table[a << 8 | b] = number
    return table


SCRIPT = _script_table()
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter (2), a mark (1) or neither (0)."""
    kinds = np.zeros(0x110000, np.uint8)
    for cp in range(0x80, 0x40000):  # no planes beyond have letters
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            kinds[cp] = 2 if kind == "L" else 1
    return kinds


def letters_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it is part of a letter or mark, and whether a letter begins with it."""
    part, first = ASCII_LETTER[raw], ASCII_LETTER[raw].copy()
    lead = np.flatnonzero(raw >= 0xC2)
    if not len(lead):
        return part, first
    wide = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
    size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = lead[size == n]
        cp = wide[at] & mask
        for k in range(1, n):
            cp = cp << 6 | wide[at + k] & 0x3F
        kind = letter_table()[np.minimum(cp, 0x10FFFF)]
        first[at] = kind == 2
        for k in range(n):
            here = at[kind > 0] + k
            part[here[here < len(raw)]] = True
    return part, first


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words' first bytes and the first word of each row; per byte the trigram's bucket and whether it counts; script and letters per word."""
    low = LOWER[raw]
    starts, ends, at = spans(raw, off)
    letter, first = letters_of(raw)
    inside = np.where(letter, low, 32).astype(np.uint32)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < len(raw)]] = 32
    after[off[1:][off[1:] > 0] - 1] = 32
    bucket = ((before << 16 | inside << 8 | after) * np.uint32(2654435761)) >> np.uint32(16)
    wide = raw >= 0xC2
    script = letter.astype(np.uint8) & (raw < 128)
    place = np.flatnonzero(wide[:-1] & letter[:-1]) if len(raw) else np.zeros(0, int)
    script[place] = SCRIPT[raw[place].astype(np.uint16).astype(np.int64) << 8 | raw[place + 1]]
    if not len(starts):
        return starts, at, bucket, letter, np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return starts, at, bucket, letter, np.maximum.reduceat(script, starts), np.add.reduceat(first.astype(np.int64), starts)


class Model:
    """languages, allowed bool [scripts + 1, languages], and of each language its buckets, their weights and that of all others.

    ``counts`` has for each language an array of BUCKETS counts, or its buckets and their counts.
    """

    def __init__(self, languages: list[str], counts: Sequence, scripts: np.ndarray):
        self.languages = languages
        self.known: list[tuple[np.ndarray, np.ndarray, np.float32]] = []
        for c in counts:
            place, n = c if isinstance(c, tuple) else (np.flatnonzero(c), c[np.flatnonzero(c)])
            total = n.sum() + 0.1 * BUCKETS
            self.known.append((place.astype(np.uint16), np.log((n + 0.1) / total).astype(np.float32), np.float32(np.log(0.1 / total))))
        used = scripts >= 0.01 * np.maximum(1, scripts[:, 1:].sum(1, keepdims=True))
        self.allowed = used.T.copy()
        self.allowed[0] = True
        self.allowed[~self.allowed.any(1)] = True  # no learned language uses the script

    def group(self, most: int) -> int:
        """Bytes of text to score at a time, so that a score of each word and language has room."""
        return max(1 << 12, most * WIDE // max(WIDE, len(self.languages)))

    def word_scores(self, bucket: np.ndarray, letter: np.ndarray, starts: np.ndarray, script: np.ndarray) -> np.ndarray:
        """[words, languages]: sums over trigrams for the candidates of each word's script, FORBIDDEN for the others."""
        ends = np.append(starts[1:], len(bucket))
        # words of scripts with the same candidates are scored together
        sets = {s: self.allowed[s].tobytes() for s in np.unique(script).tolist()}
        parts = []
        for key in dict.fromkeys(sets.values()):
            own = [s for s, x in sets.items() if x == key]
            words = np.flatnonzero(np.isin(script, own))
            if len(words) == len(starts):  # all have the same candidates
                parts.append((self.allowed[own[0]], words, bucket, ~letter, starts))
                continue
            size = ends[words] - starts[words]
            begin = np.cumsum(size) - size
            place = np.repeat(starts[words] - begin, size) + np.arange(int(size.sum()))
            parts.append((self.allowed[own[0]], words, bucket[place], ~letter[place], begin))
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        weights = np.empty(BUCKETS, np.float32)
        for k, (place, known, other) in enumerate(self.known):
            weights.fill(other)
            weights[place] = known
            for allowed, words, at, mute, begin in parts:
                if allowed[k]:
                    column = weights[at]
                    column[mute] = 0
                    out[words, k] = np.add.reduceat(column, begin)
                else:
                    out[words, k] = FORBIDDEN
        return out


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; rows are runs of words from at[r] to at[r + 1], all advanced together."""
    counts = np.diff(at)
    order = np.argsort(-counts, kind="stable")
    begin, size = at[:-1][order], counts[order]
    label = np.zeros(len(scores), np.int32)
    if not len(scores):
        return label
    stays = np.ones(scores.shape, bool)
    top = np.zeros(len(scores), np.int32)
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(longest), "left")  # rows with more than t words
    best = scores[begin[: live[0]]].copy()
    last = np.zeros(len(order), np.int32)
    for t in range(1, longest + 1):
        n = int(live[t]) if t < longest else 0
        if n < len(best):
            last[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        if not n:
            break
        word = begin[:n] + t
        high = best.max(1)
        top[word] = best.argmax(1)
        jump = (high - switch)[:, None]
        stay = best >= jump
        stays[word] = stay
        best = np.where(stay, best, jump) + scores[word]
    state = last
    for t in range(longest - 1, -1, -1):
        n = int(live[t])
        word = begin[:n] + t
        label[word] = state[:n]
        if t:
            keep = stays[word, state[:n]]
            state[:n] = np.where(keep, state[:n], top[word])
    return label


def viterbi_of_one(runs: Iterator[np.ndarray], n: int, switch: float = SWITCH) -> np.ndarray:
    """viterbi() of one row of n words, whose scores come in runs; keeps a bit of each word and language."""
    stays, top, best, t = [], np.zeros(n, np.int32), None, 0
    for scores in runs:
        kept = np.ones(scores.shape, bool)
        for i, own in enumerate(scores):
            if best is None:
                best = own.copy()
            else:
                top[t] = best.argmax()
                jump = best[top[t]] - np.float32(switch)
                kept[i] = best >= jump
                best = np.where(kept[i], best, jump) + own
            t += 1
        stays.append(np.packbits(kept, axis=1))
    label = np.zeros(n, np.int32)
    state = int(best.argmax()) if n else 0
    for kept in reversed(stays):
        for bits in kept[::-1]:
            t -= 1
            label[t] = state
            if t and not bits[state >> 3] >> (7 - (state & 7)) & 1:
                state = int(top[t])
    return label


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of an empty text for null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def draw(labelled: DataFrame, label: str, each: int) -> tuple[DataFrame, list]:
    """About ``each`` rows of each label, by a hash of doc_id; and the labels in order."""
    sizes = labelled.groupBy(label).count().collect()  # a row for each label
    chance = F.lit(1.0)
    if large := [r for r in sizes if r["count"] > each]:
        shares = F.create_map(*[F.lit(x) for r in large for x in (r[label], each / r["count"])])
        chance = F.coalesce(F.try_element_at(shares, F.col(label)), chance)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 30)) < chance * (1 << 30)
    return labelled.where(drawn), sorted(r[label] for r in sizes)


def train(docs: DataFrame) -> Model | None:
    """A model from docs (doc_id, text, lang): sums over tasks, of the trigrams that each language has."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    sample, languages = draw(known, "lang", PER_LANGUAGE)
    if not languages:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        scripts = np.zeros((len(languages), len(SCRIPTS) + 1), np.int64)
        number = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(1).to_pylist()])
            for i, j, raw, off in chunks(batch.column(0)):
                starts, at, bucket, letter, script, letters = _features(raw, off)
                of_byte = np.repeat(langs[i:j], np.diff(off))[letter]
                seen, n = np.unique(of_byte * BUCKETS + bucket[letter], return_counts=True)
                cut = np.flatnonzero(np.diff(seen // BUCKETS, prepend=-1, append=-1))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    k = int(seen[a] // BUCKETS)
                    if k not in counts:
                        counts[k] = np.zeros(BUCKETS, np.int64)
                    counts[k][seen[a:b] % BUCKETS] += n[a:b]
                np.add.at(scripts, (np.repeat(langs[i:j], np.diff(at)), script), letters)
        for k, c in counts.items():
            place = np.flatnonzero(c)
            row = [k], [place.astype(np.uint16).tobytes()], [c[place].tobytes()], [scripts[k].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["k", "buckets", "counts", "scripts"])

    # a sample of stated size, dealt to a few tasks: each returns at most one row for a language;
    # of many languages each goes to one task, with few others
    texts = bounded_batches(sample).select("text", "lang")
    few = texts.repartition(max(1, min(8, 32 // len(languages)))) if len(languages) <= 32 else texts.repartition(-(-len(languages) // 16), "lang")
    empty = np.zeros(0, np.uint16), np.zeros(0, np.int64)
    counts = [empty] * len(languages)
    scripts = np.zeros((len(languages), len(SCRIPTS) + 1))
    for r in few.mapInArrow(returning(counted), "k int, buckets binary, counts binary, scripts binary").toLocalIterator():
        place, n = np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.int64)
        if len(counts[r["k"]][0]):
            whole = np.zeros(BUCKETS, np.int64)
            for at, more in (counts[r["k"]], (place, n)):
                whole[at] += more
            place = np.flatnonzero(whole).astype(np.uint16)
            n = whole[place]
        counts[r["k"]] = place, n
        scripts[r["k"]] += np.frombuffer(r["scripts"], np.int64)
    return Model(languages, counts, scripts)


def label_texts(column: pa.Array, model: Model | None) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; spans are runs of words of one language."""
    out: list[tuple[str, float, list[dict]]] = []
    group, most = (model.group(GROUP), model.group(PIECE)) if model else (GROUP, PIECE)
    width = len(model.languages) if model else 1
    for i, j, raw, off in chunks(column, group):
        if model and width > WIDE and len(raw) > group:  # one row
            starts, at, bucket, letter, script, letters = _features(raw, off)
            counts, label = np.diff(at), viterbi_of_one(_runs(model, bucket, letter, starts, script, most), len(starts))
        else:
            parts = []
            for a, b, piece, po in _sub(raw, off, most):
                starts, at, bucket, letter, script, letters = _features(piece, po)
                scores = model.word_scores(bucket, letter, starts, script) if model else np.zeros((len(starts), 1), np.float32)
                parts.append((scores, np.diff(at), letters, script))
            scores, counts, letters, script = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.concatenate([[0], np.cumsum(counts)])
            label = viterbi(scores, at)
        row = np.repeat(np.arange(j - i), counts)
        covered = np.bincount(row * width + label, weights=letters, minlength=(j - i) * width).reshape(-1, width)
        best, total = covered.argmax(1), covered.sum(1)
        for r in range(j - i):
            words = label[at[r] : at[r + 1]]
            if not model or not total[r]:
                out.append(("und", 0.0, []))
                continue
            cut = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1, [len(words)]])
            runs = [{"lang": model.languages[words[a]], "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out.append((model.languages[best[r]], float(covered[r, best[r]] / total[r]), runs))
    return out


def _runs(model: Model, bucket: np.ndarray, letter: np.ndarray, starts: np.ndarray, script: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Scores of a text's words, in runs of about ``most`` bytes."""
    ends = np.append(starts[1:], len(bucket))
    i, n = 0, len(starts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right"))))
        a, b = starts[i], ends[j - 1]
        yield model.word_scores(bucket[a:b], letter[a:b], starts[i:j] - a, script[i:j])
        i = j


def _sub(raw: np.ndarray, off: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows in pieces of about ``most`` bytes, as features take many bytes for a byte."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())])))])


def identify(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """docs (text, ...) -> all its columns and ``prefix`` + lang_pred, score, spans; without a model all are ``und``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + f.name, f.dataType) for f in ADDED.fields]])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))]
        for batch in batches:
            got = label_texts(batch.column(place), held.value)
            if got:
                new = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return bounded_batches(docs).mapInArrow(returning(labelled), schema)


def language_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans)."""
    d = docs.select("doc_id", "text", "lang")
    out = identify(d.select("doc_id", "text"), train(d))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
