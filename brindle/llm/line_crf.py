"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are shares and sizes of the line (symbols, upper case,
digits, sentence marks, lengths, words that repeat windows of the text, whether the line is a
copy, common words) and of the text's length, each put into one of ``BINS`` bins at quantiles
of the training lines; the line's own bins and those of the lines before and after it have
weights, and so has each pair of neighbouring labels.  Forward-backward gives each line's
marginal; the mean of the marginals, weighted by the lines' lengths, is the document's
aggregate, and a logistic curve fitted on the training documents turns it into a score.

Learning takes about ``DOCUMENTS`` labelled documents, drawn by a hash of doc_id among those
whose crc32(doc_id) mod 4 is not 2, whole texts; a line's label is its document's.  Labels,
language, source and doc_id are no inputs of a score.

A null or empty text is one empty line and is scored like others.  Without labels of both
kinds every score is the share of label 1, or 0.5.  A null doc_id is not held out, but has no
label to learn from; repeated rows get equal scores; extra columns are ignored.  A very long
text is taken whole: some 30 bytes for each of its words and 300 for each line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bytes_view import LOWER, chunks, mix, shingle_hashes, spans, word_hashes
from brindle.llm.language_id import fold
from brindle.llm.session import bounded_batches, returning

DOCUMENTS = 6_000
FOLDS, HELD_OUT = 4, 2
BINS = 8
STEPS, RATE, RIDGE = 150, 0.15, 2e-4
THRESHOLD = 0.7

#: Common words of a few languages.
COMMON = "the of and to a in is that for it was on with as be at by this from or an der die das und in den von zu mit ist im nicht ein eine auf für auch de la le les et des en un une du que est pour dans qui par sur pas el los las y del se por con para una su al lo como más".split()

NAMES = ["chars", "words", "mean_word", "symbols", "upper", "digits", "marks", "non_ascii", "ends_marked", "symbol_words", "short_words", "common", "same_as_before", "windows_again", "copied_line", "text_words", "text_lines", "text_windows_again"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


SYMBOL = _table("#*$%&|<>=+/\\[]{}@^~_`")
MARK = _table(".,;:!?'\"()-")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _table("0123456789")
HIGH = np.arange(256) >= 128


def _common_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(COMMON).encode(), np.uint8)
    starts, ends, _ = spans(raw, np.array([0, len(raw)]))
    return np.unique(word_hashes(raw, starts, ends))


COMMON_HASHES = _common_hashes()


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [lines, len(NAMES)], first line of each row, bytes of each line); each row has a line."""
    rows = len(off) - 1
    breaks = np.flatnonzero(raw == 10)
    owner = np.searchsorted(off, breaks, "right") - 1
    start = np.concatenate([off[:-1], breaks + 1])
    end = np.concatenate([off[1:], breaks])
    row = np.concatenate([np.arange(rows), owner])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    at = np.searchsorted(row, np.arange(rows + 1))
    # a line ends at the next line's break, or at its row's end
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[at[1:] - 1] = off[1:]
    size = (end - start).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[end] - total[start]

    low = LOWER[raw]
    w_start, w_end, w_at = spans(raw, off)
    line_of = np.searchsorted(start, w_start, "right") - 1
    # an empty line that starts where the next row does must not take its words
    line_of = np.minimum(line_of, len(start) - 1)
    hashes = word_hashes(low, w_start, w_end) if len(w_start) else np.zeros(0, np.uint64)
    per = lambda x: np.bincount(line_of, weights=x, minlength=len(start))
    words = per(np.ones(len(w_start)))
    of_row = np.repeat(np.arange(rows), np.diff(w_at))
    previous = np.zeros(len(hashes), bool)
    previous[1:] = (hashes[1:] == hashes[:-1]) & (of_row[1:] == of_row[:-1])
    common = np.isin(hashes, COMMON_HASHES)
    symbol_end = SYMBOL[raw[w_end - 1]] | (raw[w_end - 1] == 33) if len(w_end) else np.zeros(0, bool)
    short = (w_end - w_start) <= 3
    window, begin = shingle_hashes(hashes, w_at, 3)
    window_row = np.repeat(np.arange(rows), np.diff(begin))
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
    twice = _again(window + salt[window_row]) if len(window) else np.zeros(0, bool)
    # the word that a window begins with
    first_word = np.arange(len(window)) - begin[window_row] + w_at[window_row]
    repeated = np.bincount(line_of[first_word], weights=twice, minlength=len(start)) if len(window) else np.zeros(len(start))
    line_hash = np.zeros(len(start), np.uint64)
    np.add.at(line_hash, line_of, mix(hashes + mix((np.arange(len(hashes)) - np.concatenate([[0], np.cumsum(words)])[line_of].astype(np.int64)).astype(np.uint64))))
    copied = np.zeros(len(start), bool)
    full = words > 0
    copied[full] = _again(line_hash[full] + salt[row[full]])
    text_words = np.diff(w_at).astype(float)
    text_twice = np.bincount(window_row, weights=twice, minlength=rows) / np.maximum(1, np.diff(begin)) if len(window) else np.zeros(rows)
    chars, n = np.maximum(size, 1), np.maximum(words, 1)
    columns = [
        np.log1p(size), np.log1p(words), size / n, share(SYMBOL[raw]) / chars, share(UPPER[raw]) / chars, share(DIGIT[raw]) / chars, share(MARK[raw]) / chars, share(HIGH[raw]) / chars,
        np.where(end > start, MARK[raw[np.maximum(end - 1, 0)]], 0.0) if len(raw) else np.zeros(len(start)),
        per(symbol_end) / n, per(short) / n, per(common) / n, per(previous) / n, repeated / n, copied,
        np.log1p(text_words)[row], np.log1p(np.diff(at).astype(float))[row], text_twice[row],
    ]
    return np.stack(columns, 1), at, size


class Chain:
    """Rows of lines, all advanced together, the longest first."""

    def __init__(self, at: np.ndarray):
        counts = np.diff(at)
        order = np.argsort(-counts, kind="stable")
        self.begin, self.count = at[:-1][order], counts[order]
        self.live = np.searchsorted(-self.count, -np.arange(int(counts.max()) if len(counts) else 0), "left")

    def pass_on(self, u: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good at each line from the lines up to it, and from those after it."""
        a, b = u.copy(), np.zeros_like(u)
        for t in range(1, len(self.live)):
            w = self.begin[: self.live[t]] + t
            x = a[w - 1]
            a[w] = u[w] + np.logaddexp(x + pair[1, 1], pair[0, 1]) - np.logaddexp(x + pair[1, 0], pair[0, 0])
        for t in range(len(self.live) - 1, 0, -1):
            w = self.begin[: self.live[t]] + t
            x = u[w] + b[w]
            b[w - 1] = np.logaddexp(x + pair[1, 1], pair[1, 0]) - np.logaddexp(x + pair[0, 1], pair[0, 0])
        return a, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, pair: np.ndarray, curve: tuple[float, float], constant: float | None = None):
        self.edges, self.weights, self.pair, self.curve, self.constant = edges, weights, pair, curve, constant

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], "right") for f in range(x.shape[1])], 1)

    def evidence(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-odds of good from a line's own bins and its neighbours'."""
        own, before, after = (self.weights[k][np.arange(bins.shape[1]), bins].sum(1) for k in range(3))
        u = own.copy()
        inner = np.ones(len(u), bool)
        inner[at[:-1]] = False
        follow = np.flatnonzero(inner)
        u[follow] += before[follow - 1]
        u[follow - 1] += after[follow]
        return u

    def marginals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        u = self.evidence(self.bins(x), at)
        a, b = Chain(at).pass_on(u, self.pair)
        return _sigmoid(a + b)

    def scores(self, x: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        good = aggregate(self.marginals(x, at), at, size)
        return _sigmoid(self.curve[0] * np.log(good / (1 - good)) + self.curve[1])


def aggregate(marginals: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean marginal of each row, weighted by the lines' lengths (and one each)."""
    weight = size + 1
    total = np.add.reduceat(weight * marginals, at[:-1]) / np.add.reduceat(weight, at[:-1])
    return np.clip(total, 1e-6, 1 - 1e-6)


def fit(x: np.ndarray, at: np.ndarray, size: np.ndarray, label: np.ndarray) -> Model:
    """By gradient ascent (Adam) on the mean log-likelihood of the rows' labels, held for each of their lines."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    model = Model(edges, np.zeros((3, x.shape[1], BINS)), np.zeros((2, 2)), (1.0, 0.0))
    bins, chain = model.bins(x), Chain(at)
    y = np.repeat(label, np.diff(at)).astype(float)
    inner = np.ones(len(y), bool)
    inner[at[:-1]] = False
    follow = np.flatnonzero(inner)
    flat = bins + np.arange(x.shape[1]) * BINS
    # a row counts once, however many lines it has
    share = 1 / np.repeat(np.diff(at), np.diff(at)) / len(label)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.pair)]
    for step in range(1, STEPS + 1):
        u = model.evidence(bins, at)
        a, b = chain.pass_on(u, model.pair)
        miss = (y - _sigmoid(a + b)) * share
        grad = np.empty_like(model.weights)
        for k, (of, to) in enumerate(((np.arange(len(y)), np.arange(len(y))), (follow, follow - 1), (follow - 1, follow))):
            # own, before, after: the bins of line ``to`` bear on line ``of``
            g = np.bincount(flat[to].reshape(-1), weights=np.repeat(miss[of], x.shape[1]), minlength=x.shape[1] * BINS)
            grad[k] = g.reshape(x.shape[1], BINS)
        pair = np.zeros((2, 2))
        if len(follow):
            ends = u[follow] + b[follow]
            joint = np.stack([model.pair[i, j] + i * a[follow - 1] + j * ends for i in range(2) for j in range(2)])
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            seen = np.stack([(y[follow - 1] == i) & (y[follow] == j) for i in range(2) for j in range(2)])
            pair = ((seen - joint) * share[follow]).sum(1).reshape(2, 2)
        for p, g, (m, v) in zip((model.weights, model.pair), (grad - RIDGE * model.weights, pair - 20 * RIDGE * model.pair), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    good = aggregate(_sigmoid(sum(chain.pass_on(model.evidence(bins, at), model.pair))), at, size)
    model.curve = _curve(np.log(good / (1 - good)), label)
    return model


def _curve(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one number, by Newton steps with a weak ridge."""
    a, b = 0.1, 0.0
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((label == 0).sum() + 2))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((target - p) * z).sum() - 1e-3 * a, (target - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, ``column`` 0 or 1)."""
    own = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    own = own.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    n = own.count()
    drawn = own.where(F.pmod(F.xxhash64("doc_id", F.lit("lines")), F.lit(1 << 30)) < min(1.0, DOCUMENTS / max(n, 1)) * (1 << 30))
    # about DOCUMENTS rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch.column(0)):
                x, at, size = line_features(raw, off)
                rows = [(x[a:b].astype(np.float32).tobytes(), size[a:b].astype(np.float32).tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                xs, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())], names=["y", "x", "size"])

    rows = bounded_batches(sample).mapInArrow(returning(features), "y int, x binary, size binary").toArrow()
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((0, 0)), np.zeros((3, 0, 0)), np.zeros((2, 2)), (1.0, 0.0), float(y.mean()) if len(y) else 0.5)
    order = sorted(range(len(y)), key=lambda i: (rows.column("x")[i].as_py(), y[i]))  # the order of tasks must not matter
    xs = [np.frombuffer(rows.column("x")[i].as_py(), np.float32).reshape(-1, len(NAMES)) for i in order]
    sizes = [np.frombuffer(rows.column("size")[i].as_py(), np.float32) for i in order]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    return fit(np.concatenate(xs).astype(float), at, np.concatenate(sizes).astype(float), y[order])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score double, n_lines long, n_bad_lines long)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for i, j, raw, off in chunks(batch.column(1)):
                x, at, size = line_features(raw, off)
                x = x.astype(np.float32).astype(float)
                bad = np.zeros(j - i, np.int64) if m.constant is not None else np.add.reduceat((m.marginals(x, at) < 0.5).astype(np.int64), at[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(m.scores(x, at, size)), pa.array(np.diff(at)), pa.array(bad)], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(returning(scored), "doc_id long, score double, n_lines long, n_bad_lines long")


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, n_bad_lines)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score_quality(docs, train(docs, labels))
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
