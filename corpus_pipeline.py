"""Training corpus from raw documents: language, near duplicates, benchmark overlap, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``docs``, whatever they are; the last returns one row per document read back from the token files. Null and empty texts,
null ids, repeated rows, empty tables and extra columns are handled as the docstrings of the operators say.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat.llm import jaccard, language, mixing, token_ids, winnow
from evcat.llm.folders import new_folder, read, written
from evcat.llm.queries import WORD
from evcat.session import configure


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compression classifier rejects: no letter at all, or a narrow margin."""
    configure(spark)
    dictionaries = language.learn(docs)
    return docs.filter(~language.identify(F.col("text"), dictionaries)["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar documents."""
    configure(spark)
    return jaccard.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lies in passages shared with the benchmark."""
    configure(spark)
    return winnow.contamination(docs, read(spark, sf_dir, "benchmark")).filter("NOT contaminated").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that every source comes near its target; a document taken twice is two rows."""
    configure(spark)
    return mixing.repeated(mixing.mix_sources(docs, F.regexp_count("text", F.lit(WORD))))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token-id files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    configure(spark)
    folder = new_folder(spark, "corpus")
    token_ids.write_token_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_ids.read_token_ids(spark, folder)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_files),
]

ORACLE_SQL = None  # the language stage has no SQL counterpart


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
