"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its
result is written as Parquet and read again for the next one.  All but the last return the
columns of documents; the last returns pieces of documents in packed sequences.

Nulls: a document with a null or letterless text goes in the first stage, as every document does
if there is nothing to learn languages from; one with a null doc_id links with nothing and stays;
a null source is a source; null pseudonymised texts stay null.  Of rows that tie (repeated rows,
equal texts) one stays.  Very long texts are taken whole.  Extra columns, whatever their names,
pass through to the last stage, which ignores them.  Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language_id, mixing, ngram_join, packing, pseudonyms
from brindle.llm.queries import tokenizer
from brindle.llm.session import fresh, plain, shared_folder, table

#: A document goes if the language that covers most of it covers less than this share of its letters.
LEAST_SHARE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or without a main language, go."""
    prefix = fresh(docs, "told_lang_pred").removesuffix("lang_pred")
    told = language_id.identify(docs, language_id.train(docs), prefix)
    return told.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= LEAST_SHARE)).select(*plain(docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest doc_id stays, once."""
    return ngram_join.keep_representatives(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: numbers, dates and addresses become pseudonyms; n_chars, if there, follows the text."""
    out = pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark), into=fresh(docs, "pii"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*plain(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it, none to three times."""
    into, copy = fresh(docs, "mix"), fresh(docs, "copy")
    mixed = mixing.mix_sources(docs, into=into)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(f"{into}.copies").cast("int")))).select(*plain(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: token sequences of 4096."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("pseudonyms", hide_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL expresses neither a learned model nor a keyed permutation; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them goes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
