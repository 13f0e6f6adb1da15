"""Secret scans: base patterns, and the guess cost of values in credential context.

Base kinds, leftmost and non-overlapping each: ``assign`` (a credential name, a separator and
a value of 6 or more characters), ``access`` (``AKIA`` and 16 or more), ``hex`` (24 or more).

The method adds ``guess``: a value that follows a credential word (those of ``CONTEXT``, a
superset of the base names) is segmented into dictionary words, dates, repeats, keyboard walks
and brute-force spans so that the cost is least, by dynamic programming over its characters and
the number of segments k:

    best(j, k) = min over i < j of best(i, k - 1) + cost(i, j);  cost = min over k of best(n, k) + log2(k!)

Costs are bits, the factorial is for the order of the segments.  A repeat is a block of up to
``BLOCK`` characters, which costs what its own best segmentation does, and the logarithm of how
often it stands.  Values of at least ``BITS`` bits are reported; those that are cheap to guess,
such as ``password`` or ``qwerty2020``, are placeholders or prose.  Costs only grow, so what has
reached ``BITS`` is left out: the program is exact below, and its time about linear in a value
of any length.

The dictionary is ``WORDS``, then the ``LEARNED`` most frequent words of the corpus: ASCII
letters between spaces and marks, counted over all documents by aggregates that combine before
the shuffle.  Values after credential words teach it nothing, however often they are copied.

Texts are scanned whole: a byte-level filter that never loses a match picks the texts to scan
with patterns; a very long one is held as bytes and as one string.  A null or empty text has no spans and the digest of an empty list; repeated
rows and null ids give rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.bytes_view import LOWER, chunks
from brindle.llm.session import bounded_batches, returning

KINDS = ("assign", "access", "hex", "guess")
BITS = 30.0
BLOCK = 64
LEARNED, LONGEST_WORD, PARTS = 5000, 16, 32

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential.
NAMES = "password passwd passphrase passcode pwd secret token api_key apikey api-key access_key auth_key private_key client_secret credential credentials login_key"
CONTEXT = re.compile(rf"""(?<![A-Za-z])(?:{"|".join(sorted(NAMES.split(), key=len, reverse=True))})["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([!-~]{{6,}})""", re.IGNORECASE | re.ASCII)
TRIM = "\"'`,;.!?)]}>#*$%&|"

#: Frequent password words and plain words, most frequent first.
WORDS = """password admin user test welcome login dragon monkey master shadow sunshine princess football baseball letmein iloveyou
secret hello freedom whatever starwars superman batman summer winter spring autumn monday friday january october december changeme default
guest root example sample dummy token value string none null true false your here insert placeholder redacted hidden mypass pass word key
the and that this with from have not are was for you all new one two three time people year day home work life hand part child eye woman
place week case point company number group problem fact love money house water green blue black white red orange yellow silver gold""".split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
LEET = str.maketrans("013457@$!", "oleastasi")
#: Rows of a keyboard, walked in either direction.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
STEPS = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)[0-9]{2}", re.ASCII)
MOST_WORD = max(map(len, RANK))


def _alphabet(c: str) -> float:
    """Bits of one character by brute force."""
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _factorial(k: int) -> float:
    return math.lgamma(k + 1) / math.log(2)


#: The divisors of a block's size: a block that repeats a smaller one is no cheaper than that one.
DIVISORS = {n: [d for d in range(1, n // 2 + 1) if n % d == 0] for n in range(2, BLOCK + 1)}


class Starts:
    """Where a run may begin, by number of segments before; a run costs the logarithm of its length."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, float]]] = {}

    def add(self, i: int, lowest: dict[int, tuple]) -> None:
        for k, entry in lowest.items():
            self.of.setdefault(k, []).append((i, entry[0]))

    def least(self, j: int) -> Iterator[tuple[int, float, int]]:
        """(segments, cost + log2(j - i), i) of the cheapest starts; drops starts that an earlier one beats, as that one then does at any later j."""
        for k, starts in self.of.items():
            least, at, kept = math.inf, 0, []
            for i, cost in starts:
                total = cost + math.log2(j - i)
                if total < least:
                    while kept and kept[-1][1] >= cost:
                        kept.pop()
                    kept.append((i, cost))
                    least, at = total, i
            starts[:] = kept
            yield k, least, at


def segment(value: str, ranks: dict[str, int] = RANK, most: float = BITS, memo: dict[str, float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """(bits, segments as (kind, text)) of the cheapest segmentation; infinite and none if it is not below ``most``."""
    n, memo = len(value), {} if memo is None else memo
    low = value.lower()
    plain = low.translate(LEET)
    hexed = n >= 16 and set(low) <= set("0123456789abcdef")
    longest = max(map(len, ranks), default=0) if len(ranks) != len(RANK) else MOST_WORD
    # by number of segments: (bits, start, whether brute force came before it, kind); the last segment is brute force or not
    other: list[dict[int, tuple]] = [{0: (0.0, 0, False, "")}]
    brute: list[dict[int, tuple]] = [{}]
    lowest: list[dict[int, tuple]] = [{0: (0.0, False)}]
    dates: dict[int, list[int]] = {}
    if m := DATE.match(value):
        dates[m.end()] = [0]
    walk = same = last = 0
    walks, sames = Starts(), Starts()
    # since which end the value repeats itself at a distance
    since, blocks = list(range(BLOCK + 1)), {}
    sizes = range(2, BLOCK + 1)
    for j in range(1, n + 1):
        c = value[j - 1]
        new: dict[int, tuple] = {}

        def put(k: int, bits: float, i: int, kind: str) -> None:
            if bits + _factorial(k) < most and bits < new.get(k, (math.inf,))[0]:
                new[k] = (bits, i, lowest[i][k - 1][1], kind)

        def relax(i: int, bits: float, kind: str) -> None:
            for k, entry in lowest[i].items():
                put(k + 1, entry[0] + bits, i, kind)

        for i in range(max(0, j - longest), j - 2):
            if lowest[i]:
                part, leet = low[i:j], plain[i:j]
                rank, bits = ranks.get(part), 0.0
                if rank is None and (rank := ranks.get(leet)) is not None:
                    bits = 1.0 + sum(a != b for a, b in zip(part, leet, strict=True))
                if rank is not None:
                    upper = sum(x.isupper() for x in value[i:j])
                    case = 0.0 if not upper else 1.0 if upper == j - i or value[i].isupper() and upper == 1 else math.log2(math.comb(j - i, upper)) + 1
                    relax(i, math.log2(rank) + 1 + bits + case, "word")
        for i in dates.pop(j, ()):
            relax(i, math.log2(365.0 * 100 if j - i > 4 else 100.0) + (2.0 if not value[i:j].isdigit() else 0.0), "date")
        if j > 1:
            walk = walk + 1 if low[j - 2 : j] in STEPS else 0
            same = same + 1 if c == value[j - 2] else 0
        for run, starts, bits, kind in ((walk, walks, math.log2(47.0) + 1, "walk"), (same, sames, _alphabet(c), "repeat")):
            if run < 2:
                starts.of.clear()
                continue
            starts.add(j - 3, lowest[j - 3])
            for k, total, i in starts.least(j):
                put(k + 1, bits + total, i, kind)
        for size in sizes if same < 2 * BLOCK else ():  # in a long run of one character no other block counts
            if size >= j:
                break
            if c != value[j - 1 - size]:
                since[size] = j
                blocks.pop(size, None)
            elif j - since[size] >= size and not any(j - since[d] >= 2 * size - d if d > 1 else same >= 2 * size - 1 for d in DIVISORS[size]):
                starts = blocks.setdefault(size, {}).setdefault(j % size, Starts())
                starts.add(j - 2 * size, lowest[j - 2 * size])
                if starts.of:
                    block = value[j - size : j]
                    if block not in memo:
                        memo[block] = segment(block, ranks, most, memo)[0]
                    for k, total, i in starts.least(j):
                        put(k + 1, memo[block] - math.log2(size) + total, i, "repeat")
        single, forced = 4.0 if hexed else _alphabet(c), {}
        for k, entry in brute[j - 1].items():
            if entry[0] + single + _factorial(k) < most:
                forced[k] = (entry[0] + single, entry[1], entry[2], "brute")
        for k, entry in other[j - 1].items():
            bits = entry[0] + single
            if bits + _factorial(k + 1) < most and bits < forced.get(k + 1, (math.inf,))[0]:
                forced[k + 1] = (bits, j - 1, False, "brute")
        best = {k: (x[0], False) for k, x in new.items()}
        for k, x in forced.items():
            if x[0] < best.get(k, (math.inf,))[0]:
                best[k] = (x[0], True)
        other.append(new)
        brute.append(forced)
        lowest.append(best)
        if best:
            last = j
            if m := DATE.match(value, j):
                dates.setdefault(m.end(), []).append(j)
        elif last < j - 2 * BLOCK - longest and not walks.of and not sames.of and not any(s.of for x in blocks.values() for s in x.values()):
            return math.inf, []
    if not lowest[n]:
        return math.inf, []
    bits, k = min((x[0] + _factorial(k), k) for k, x in lowest[n].items())
    parts, j, forced = [], n, lowest[n][k][1]
    while j:
        _, i, before, kind = (brute if forced else other)[j][k]
        parts.append((kind, value[i:j]))
        j, k, forced = i, k - 1, before
    return bits, parts[::-1]


def guess_bits(value: str, ranks: dict[str, int] = RANK) -> float:
    """The bits of a value where they are under BITS, else infinite."""
    return segment(value, ranks)[0]


def learned_words(docs: DataFrame, most: int = LEARNED) -> list[str]:
    """The most frequent words of the corpus, ties in their order; at most ``most`` of at most LONGEST_WORD letters each."""
    text = F.when(F.rlike("text", F.lit("(?i)" + "|".join(n.decode() for n in NEEDLES))), F.regexp_replace("text", "(?i)" + CONTEXT.pattern, " ")).otherwise(F.col("text"))
    words = F.regexp_extract_all(text, F.lit(f"(?:^|[\\s(\"])([A-Za-z]{{3,{LONGEST_WORD}}})(?=[\\s.,;:!?)\"]|$)"), F.lit(1))
    counts = docs.select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    # parts are ranked first, so that what reaches the driver does not grow with the tasks
    part = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(PARTS))).orderBy(F.desc("n"), "w"))
    some = counts.withColumn("k", part).where(F.col("k") <= most).select("w", "n")
    return [r["w"] for r in some.orderBy(F.desc("n"), "w").limit(most).collect()]


def dictionary(learned: list[str]) -> dict[str, int]:
    """Ranks of words: the fixed ones first."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*RANK, *learned]))}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def guess_spans(text: str, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(TRIM)
        if len(value) >= 6 and guess_bits(value, ranks) >= BITS:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


NEEDLES = [x.encode() for x in ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth_key", "private_key", "credential", "login_key", "akia")]
IS_HEX = np.zeros(256, bool)
IS_HEX[[*range(48, 58), *range(97, 103)]] = True


def _positions(data: bytes, needle: bytes) -> Iterator[int]:
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


def candidates(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rows that may hold a span: those with a needle, or 24 hex digits on end (rows may run into each other)."""
    places = [p for needle in NEEDLES for p in _positions(LOWER[raw].tobytes(), needle)] if len(raw) else []
    hit = IS_HEX[raw]
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= 24
    rows = set(np.searchsorted(off, places, "right") - 1)
    for a, b in zip(start[long], end[long], strict=True):
        rows.update(range(int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b - 1, "right"))))
    return np.array(sorted(rows), np.int64)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())])


def _scan(ranks: dict[str, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((4, n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            for i, _, raw, off in chunks(batch.column(1)):
                for r in candidates(raw, off).tolist():
                    if r >= len(off) - 1 or off[r] == off[r + 1]:
                        continue
                    text = raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
                    base, more = base_spans(text), guess_spans(text, ranks)
                    for kind, *_ in base + more:
                        counts[KINDS.index(kind), i + r] += 1
                    digests[i + r] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i + r] = _joined(base + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts[:3]), pa.array(digests), pa.array(spans), pa.array(counts[3])], schema=FIELDS)

    return scan


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text string, ...) -> SCHEMA; spans are in code points, ends exclusive."""
    docs = bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(returning(_scan(dictionary(learned_words(docs)))), SCHEMA)
