"""From raw documents to encoded training text, in stages that each read what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. `run` applies them in turn; between stages the documents are written as Parquet in the shared
folder and read again, so that no stage is ever recomputed for a later one.

Defined results: a document with a null, empty or blank text fails the rules and goes; of repeated rows one stays;
a row without an id is kept where no copy has one; extra columns travel with their row up to the encoding; an
empty table passes through all stages as one.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import mixing, pii, quality_rules, sentencepiece_codec, simhash
from tradewind.operators.lineage import shared_folder
from tradewind.sources.files import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the text."""
    replaced = pii.replace_entities(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return replaced.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by source weight; a document taken more than once is repeated."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    encoded = sentencepiece_codec.encode_checked(docs.select("doc_id", "lang", "source", "text"))
    pieces = F.coalesce(F.size("ids"), F.lit(0)).cast("bigint")
    return encoded.select("doc_id", "lang", "source", "ids", pieces.alias("n_pieces"), "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("pii_surrogates", personal_data),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

# Posteriors, hashes and vocabularies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
