"""From raw documents to token ids: classify, filter by rules, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and rereads it as the next stage's docs. All stages but the
last return the columns they were given, whatever their names, and read doc_id, text and
source only. An empty table gives an empty one in every stage, and a text of any length
is one row throughout.

The mix is in training order when it is written: by the number of its file, then by row. Spark
does not keep that order when it rereads files, so encode returns both numbers with each
row; sorted by them, its result is the training order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, minhash, mixing, quality_rules
from tessera.llm.common import written

VOCABULARY = "byte_bpe_50k.json"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality classifier does not reject.

    A null text is judged as an empty one; repeated rows, and rows that share a doc_id or have
    none, are judged each by their own text.
    """
    _, scorer = classifier.learn(docs)
    return classifier.kept_rows(docs, scorer)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands.

    Null, empty and blank texts have too few words and go. Repeated rows, and rows that share a
    doc_id or have none, are judged each by their own text.
    """
    return quality_rules.kept_rows(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five words, 0.8).

    Null, empty and blank texts are near copies of nothing and stay. Of rows equal in doc_id and text one
    stays; rows without doc_id stay if no document with one is a near copy.
    """
    return minhash.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights, in training order; a document stands once for each copy.

    Texts without a word, null ones too, are never drawn. A null source is one of its own. Rows equal
    in doc_id and text stand together and are drawn equally often.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part, row, n_tokens and ids (little-endian uint32) of each row of the mix.

    part, row: number of the Parquet file and of the row in it, by which the mix is in training order;
    null where ``docs`` is not read from files. A null or empty text has no ids; repeated
    rows are encoded each.
    """
    vocabulary = public_tokenizers.path(VOCABULARY)
    try:
        placed = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no files, no places
        placed = docs.select("doc_id", "text", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("row"))
    out = bpe.encoded(placed, vocabulary, bpe.build_lexicon(docs, vocabulary), keep=("doc_id", "part", "row"), decode=False)
    return out.select("doc_id", "part", "row", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


STAGES = [("classify", classify), ("rules", rules), ("dedup", dedup), ("mix", mix), ("encode", encode)]

#: Weak labels, zstandard and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
