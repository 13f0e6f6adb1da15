"""Quality rules and distribution divergence, with DataFrame functions only.

Base rules come from the words ``[^\\x20\\x09-\\x0D]+`` of the whole text.  The divergence
method then compares two histograms of a document with references, one per language:

* characters by class (upper case, lower case, digit, space, sentence marks, symbols, other);
* common words by share of all words, and the rest as one bin.

References are sums over all documents of a language (column ``lang``) that pass the base
rules, so they follow the corpus.  Those of the languages of ``COMMON_WORDS`` share the bins of
all its words.  Each other language has bins of its own: its ``OWN_WORDS`` most frequent words
of letters only in these documents, by a count that is aggregated before it is dealt out.
Listed languages are literals of the plan; all others, however many, are one broadcast row of
about a KB for each.  Where a text without any of a reference's words is within
``WORD_MOST`` of it (words without spaces, or hardly any common ones), the reference cannot judge
words: it judges by characters alone, and only documents of its own lang or of none.
The distance is the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).
A document is dropped if, against the nearest reference, its character distance exceeds
``CHAR_MOST`` or its common-word distance exceeds ``WORD_MOST``.  Characters are not judged in
texts of under ``MIN_CHARS`` characters, nor words in those of under ``MIN_WORDS`` words, as
short histograms are far from any reference by chance; without a reference all pass.

Nulls: a null text has no words, all counts 0 and fails the base rules, as an empty one does.
A null lang or doc_id changes nothing but that the row adds to no reference.  Repeated rows
count each.  Extra columns are ignored.  An empty table gives no rows.  A very long text is an
array of its words in the JVM, some 100 bytes for each.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.session import hold

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Common words of four languages: fixed values, any of which may be replaced.
COMMON_WORDS = {
    "de": "auch auf das den der des die ein eine es für im in ist mit nicht sich und von zu".split(),
    "en": "a and are as be by for from in is it not of on that the this to was with".split(),
    "es": "como con de del el en es la las los no para por que se su un una y lo".split(),
    "fr": "au dans de des du elle en est et il la le les pas pour que qui sur un une".split(),
}
#: Patterns of the character classes, which have no character in common, the most frequent ones first; what none of
#: them takes is the last bin.
CLASSES = {"lower": "\\p{Ll}", "space": "\\s", "upper": "\\p{Lu}", "digit": "\\p{Nd}", "mark": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>=+/\\\\\\[\\]{}@^~_`]"}

OWN_WORDS = 24
MIN_CHARS, MIN_WORDS = 200, 100
CHAR_MOST, WORD_MOST = 0.25, 0.31


def window_hashes(hashes: str, width: int = 3) -> Column:
    """64-bit hashes of the windows of ``width`` words, array<long>, from a column of the words' hashes; null for under two windows."""
    last = F.size(hashes) - width
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


def repeated_windows(hashes: str) -> Column:
    """The windows with their places, sorted, so that equal neighbours mark places; null where all differ, which a set tells sooner."""
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _marked(sorted_windows: str) -> Column:
    """The places of windows that occur again, in order."""
    s = F.col(sorted_windows)
    same = lambda x, j: (F.get(s, j)["h"] == x["h"])
    again = F.filter(s, lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | F.coalesce(F.when(j > 0, same(x, j - 1)), F.lit(False)))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def _covered(places: str, width: int = 3) -> Column:
    """How many words windows at sorted places cover: each adds what lies after the one before it."""
    p = F.col(places)
    add = F.transform(p, lambda x, j: F.when(j == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(p, j - 1))))
    return F.aggregate(add, F.lit(0).cast("long"), lambda a, x: a + x)


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> those, words array, and the contract's counts."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("text", text).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    # a column for each step, as an expression inside a lambda would be computed again for each word
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("hashes", window_hashes("hashes"))
    d = d.withColumn("windows", repeated_windows("hashes")).withColumn("places", _marked("windows")).drop("windows", "hashes")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    d = d.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "lines": lines,
            "n_repeat_words": F.coalesce(_covered("places"), F.lit(0)).cast("long"),
        }
    ).drop("places")
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    return d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _known() -> list[str]:
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def own_words(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Of each language that COMMON_WORDS lacks, the most frequent words and their counts, over documents that pass the base rules."""
    others = docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    out: dict[str, dict[str, int]] = {r["lang"]: {} for r in others.select("lang").distinct().collect()}
    if out:
        # no filter on what was computed and no explode(), which brings one: pushed down, it would compute that for each word
        words = base_counts(others).select("lang", F.explode_outer(F.when(~F.col("base_failed"), F.col("words"))).alias("word"))
        counts = words.where(F.rlike("word", F.lit("^[\\p{L}\\p{M}]+$"))).groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
        first = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
        for r in first.where(F.col("place") <= OWN_WORDS).orderBy("lang", "place").collect():  # OWN_WORDS rows a language
            out[r["lang"]][r["word"]] = r["n"]
    return out


def _apart(word: Column) -> Column:
    return F.concat(F.lit(" "), word, F.lit(" "))


def _places(known: list[str]) -> tuple[int, dict[int, str]]:
    """(size of a table, letter by place) in which the words' CRCs, modulo the size, are all different; letters are in the words' order."""
    for size in itertools.count(len(known)):
        places = {zlib.crc32(w.encode()) % size: chr(0x21 + i) for i, w in enumerate(known)}
        if len(places) == len(known):
            return size, places


def _removed(text: str, parts: list[str], remove: Callable) -> Column:
    """How many characters of a text each part takes, array<int>; parts have none in common, so each is looked for in what the ones before left."""
    start = F.struct(F.col(text).alias("rest"), F.array().cast("array<int>").alias("sizes"))
    step = lambda s, part: F.struct(remove(s["rest"], part, F.lit("")).alias("rest"), F.array_append(s["sizes"], F.length(s["rest"])).alias("sizes"))
    sizes = F.aggregate(F.array(*map(F.lit, parts)), start, step, lambda s: F.array_append(s["sizes"], F.length(s["rest"])))
    return F.zip_with(F.slice(sizes, 1, len(parts)), F.slice(sizes, 2, len(parts)), lambda a, b: a - b)


def histograms(d: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """Adds counts, array<int>: characters by class and the rest, then words by common word and the rest; and hits, the words that are in ``more``, each between spaces of its own."""
    known = _known()
    size, places = _places(known)
    # each common word that occurs is one letter of a text; a word's place in the table follows from its CRC
    letters = F.array(*[F.lit(places.get(i, "")) for i in range(size)])
    hits = F.filter(F.transform("words", F.lower), lambda w: w.isin(known))
    coded = F.array_join(F.transform(hits, lambda w: F.get(letters, F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int"))), "")
    d = d.withColumn("coded", F.when(~F.col("base_failed"), coded))
    d = d.withColumns({"by_class": F.when(~F.col("base_failed"), _removed("text", [f"{c}+" for c in CLASSES.values()], F.regexp_replace)), "by_letter": _removed("coded", sorted(places.values()), F.replace)})
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    rest = F.array(F.length("text") - total("by_class"))
    others = F.array((F.col("n_words") - F.length("coded")).cast("int"))
    d = d.withColumn("counts", F.when(~F.col("base_failed"), F.concat("by_class", rest, "by_letter", others))).drop("coded", "by_class", "by_letter")
    if more:
        found = F.filter(F.transform("words", F.lower), lambda w: w.isin(list(more)))
        d = d.withColumn("hits", F.when(~F.col("base_failed"), F.array_join(F.transform(found, _apart), "")))
    return d


def references(counted: DataFrame, own: dict[str, dict[str, int]] | None = None) -> tuple[list, list]:
    """(language, character shares, common-word shares) over all documents that pass the base rules; and of other languages
    also, before the last, their words, whose counts ``own`` has."""
    own = own or {}
    split, width = len(CLASSES) + 1, len(CLASSES) + len(_known()) + 2
    known = counted.where("lang is not null and not base_failed")
    sums = known.groupBy("lang").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("counts", F.lit(i)).cast("long")) for i in range(width)]).alias("sums"))
    rows = sums.orderBy(F.desc("n"), "lang").collect()  # a row for each language
    listed, others = [], []
    for r in rows:
        x = np.array(r["sums"], float)
        chars, words = x[:split] / x[:split].sum(), x[split:]
        if r["lang"] in COMMON_WORDS:
            listed.append((r["lang"], chars, words / words.sum()))
        else:
            n = np.array([*own.get(r["lang"], {}).values()], float)
            others.append((r["lang"], chars, [*own.get(r["lang"], {})], np.append(n, words.sum() - n.sum()) / words.sum()))
    return listed, others


def judges_words(shares: np.ndarray) -> bool:
    """Whether a text with none of the words, all in the last bin, is beyond WORD_MOST."""
    p = np.zeros(len(shares))
    p[-1] = 1.0
    part = lambda x, y: (x[x > 0] * np.log2(2 * x[x > 0] / (x + y)[x > 0])).sum()
    return float(np.sqrt(max(0.0, (part(p, shares) + part(shares, p)) / 2))) > WORD_MOST


def _distance(counts: Column, total: Column, ref: Column) -> Column:
    def term(n: Column, q: Column) -> Column:
        p = n / total
        return F.when(n > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)

    twice = F.aggregate(F.zip_with(counts, ref, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, the base counts, base_failed, kept, char_distance, word_distance, language.

    The distances are those to the nearest reference, to six digits, null where the method does not judge.
    """
    docs = docs.select("doc_id", "text", "lang")
    own = own_words(docs)
    more = sorted({w for words in own.values() for w in words})
    counted = histograms(base_counts(docs), more).withColumn("n_chars", F.length("text"))
    counted = hold(counted.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars", "counts", *["hits"] * bool(more)))
    listed, others = references(counted, own)
    split = len(CLASSES) + 1
    judged = (~F.col("base_failed")) & (F.col("n_chars") >= MIN_CHARS)
    chars, words = F.slice("counts", 1, split), F.slice("counts", split + 1, len(_known()) + 1)

    def near(char: Column, word: Column | None, language: Column) -> Column:
        word = F.lit(None).cast("double") if word is None else word
        return F.struct(char.alias("char_distance"), word.alias("word_distance"), language.alias("language"))

    of_it = lambda language: F.coalesce(F.col("lang") == language, F.lit(True))
    found = []
    for lang, c, w in listed:
        char = _distance(chars, F.col("n_chars"), F.lit(c))
        found.append(near(char, _distance(words, F.col("n_words"), F.lit(w)), F.lit(lang)) if judges_words(w) else F.when(of_it(F.lit(lang)), near(char, None, F.lit(lang))))
    choices = F.array(*found) if found else None
    if others:
        row = [([(lang, c.tolist(), ws, w.tolist(), judges_words(w)) for lang, c, ws, w in others],)]
        table = docs.sparkSession.createDataFrame(row, "refs array<struct<language: string, chars: array<double>, words: array<string>, shares: array<double>, judges: boolean>>")
        counted = counted.crossJoin(F.broadcast(table))

        def other(x: Column) -> Column:
            n = F.transform(x["words"], lambda w: ((F.length("hits") - F.length(F.replace(F.col("hits"), _apart(w), F.lit("")))) / (F.length(w) + 2)).cast("int")) if more else F.array().cast("array<int>")
            rest = F.col("n_words").cast("int") - F.aggregate(n, F.lit(0), lambda a, y: a + y)
            word = F.when(x["judges"], _distance(F.concat(n, F.array(rest)), F.col("n_words"), x["shares"]))
            return F.when(x["judges"] | of_it(x["language"]), near(_distance(chars, F.col("n_chars"), x["chars"]), word, x["language"]))

        more_choices = F.transform("refs", other)
        choices = F.concat(choices, more_choices) if choices is not None else more_choices
    if choices is not None:
        worse = lambda x: F.greatest(x["char_distance"] / CHAR_MOST, F.when(F.col("n_words") >= MIN_WORDS, x["word_distance"] / WORD_MOST))
        best = F.array_min(F.transform(choices, lambda x: F.when(x.isNotNull(), F.struct(worse(x).alias("worse"), x.alias("x")))))
        counted = counted.withColumn("best", F.when(judged, best))
    else:
        counted = counted.withColumn("best", F.expr("cast(null as struct<worse: double, x: struct<char_distance: double, word_distance: double, language: string>>)"))
    kept = (~F.col("base_failed")) & F.coalesce(F.col("best.worse") <= 1, F.lit(True))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("best.x.char_distance", 6).alias("char_distance"), F.round("best.x.word_distance", 6).alias("word_distance"), F.col("best.x.language").alias("language"))


def oracle() -> str:
    """SQL for the same rows, where every lang is one of COMMON_WORDS."""
    chars = CLASSES | {"space": "[ \\t\\n\\x0B\\f\\r]"}
    known = ", ".join(f"('{w}')" for w in _known())
    classes = ", ".join("len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))" for p in chars.values())
    half = "sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(q)"
    return f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER () AS row FROM documents
), g AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, x) > 1 AS again FROM (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x FROM w WHERE len(w) >= 3)
), v AS (
  SELECT row, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE again GROUP BY row
), l AS (
  SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w
), b AS (
  SELECT w.row, doc_id, lang, text, w.w, len(w.w) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, length(text) AS n_chars FROM w JOIN l USING (row) LEFT JOIN v USING (row)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
), k AS (
  SELECT row, lang, n_chars, [{classes}] AS cl FROM f WHERE NOT base_failed
), ch AS (
  SELECT row, lang, n_chars AS total, unnest(range(1, {len(chars) + 2})) AS bin, unnest(list_append(cl, n_chars - list_sum(cl))) AS n FROM k
), wc AS (
  SELECT f.row, f.lang, f.n_words AS total, kw.word AS bin, count(u.word) AS n FROM f, (VALUES {known}) AS kw(word) LEFT JOIN (SELECT row, lower(unnest(w)) AS word FROM f) AS u ON u.row = f.row AND u.word = kw.word WHERE NOT f.base_failed GROUP BY ALL
), wo AS (
  SELECT row, lang, total, bin, n FROM wc UNION ALL SELECT row, lang, total, ' ', total - sum(n) FROM wc GROUP BY row, lang, total
), cr AS (
  SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM ch WHERE lang IS NOT NULL GROUP BY lang, bin
), wr AS (
  SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM wo WHERE lang IS NOT NULL GROUP BY lang, bin
), cd AS (
  SELECT row, r.lang AS language, sqrt(greatest(0, ({half}) / 2)) AS x FROM (SELECT row, bin, n / total AS p FROM ch WHERE n > 0) JOIN cr AS r USING (bin) GROUP BY row, r.lang
), wd AS (
  SELECT row, r.lang AS language, sqrt(greatest(0, ({half}) / 2)) AS x FROM (SELECT row, bin, n / total AS p FROM wo WHERE n > 0) JOIN wr AS r USING (bin) GROUP BY row, r.lang
), m AS (
  SELECT cd.row, min(row(greatest(cd.x / {CHAR_MOST}, CASE WHEN f.n_words >= {MIN_WORDS} THEN wd.x / {WORD_MOST} END), cd.x, wd.x, cd.language)) AS best
  FROM cd JOIN wd ON wd.row = cd.row AND wd.language = cd.language JOIN f ON f.row = cd.row WHERE f.n_chars >= {MIN_CHARS} GROUP BY cd.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(best[1] <= 1, true) AS kept,
  round(best[2], 6) AS char_distance, round(best[3], 6) AS word_distance, best[4] AS language FROM f LEFT JOIN m USING (row)
"""
