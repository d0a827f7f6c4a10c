"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

1. language ID: documents that the model rejects go (:func:`quarrygraph.llm.langid.keep_identified`);
2. n-gram Jaccard join: one document of each group of near copies (five-word shingles, Jaccard 0.80) stays, the one with
   the least id;
3. benchmark decontamination: documents that hold passages of the benchmark go;
4. secret scans: secrets are replaced by their kind in the text, and n_chars follows; every document stays;
5. packing: the documents' pieces in sequences of 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import decontaminate, jaccard_join, langid, packing, secret_scan
from quarrygraph.llm.common import discard, materialize

#: The tokenizer file of the last stage.
TOKENIZER = "byte_bpe_50k.json"
#: What the last stage returns of each piece.
PACKED = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
#: Words of a shingle and hundredths of similarity from which documents are near copies. The query op5_jaccard_join has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit_languages(langid.training_rows(docs)))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER)).select(*PACKED, "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the trained first stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``, every stage's result written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # a table of ours, but for the input
    return STAGES[-1][1](spark, docs, sf_dir)
