"""A table of odd documents, shared by the tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n long, mix int, pii string, score string, __id int, hash int, lang_pred string, bucket string"

CLEAN = "The quick brown fox jumps over the lazy dog and then it sleeps near the old stone wall of the quiet house. " * 4
OTHER = "Der schnelle braune Fuchs springt über den faulen Hund und schläft dann an der alten Mauer des stillen Hauses. " * 4
LONG = " ".join(f"word{i % 7919} of the {i % 311}." for i in range(120_000))  # about 2 MB
ROWS = [
    (1, CLEAN, "en", "a"),
    (2, OTHER, "de", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t \n", "en", "a"),
    (6, LONG, "en", "c"),
    (7, CLEAN, "en", "a"),
    (7, CLEAN, "en", "a"),
    (8, CLEAN.replace("lazy", "tired"), None, "a"),
    (None, CLEAN, "en", None),
    (9, "12 34 !! ##", "en", "b"),
    (10, "x", "en", "b"),
    (11, "a b c", "fr", "c"),
    (12, "a b c", "fr", "c"),
    (-5, "Ünïcödé ☃ 文字 с буквами", None, "c"),
    (13, "x\x00y |\\ <|im_end|> &amp; &lt;|", "en", "c"),
]


def table(spark):
    extra = ("w", 1, 2, "p", "s", 3, 4, "l", "b")
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in ROWS], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def alone(spark):
    return spark.createDataFrame([(*ROWS[0], 1, *("w", 1, 2, "p", "s", 3, 4, "l", "b"))], SCHEMA)
