"""A corpus from documents to token ids: quality, near-duplicates, secrets, mix and encoding, one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.llm import quality, secret_scan, sentencepiece_codec, simhash, source_mix
from omicspark.llm.queries import PIECE_BPE, table
from omicspark.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of this folder, does not reject."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret, open or encoded, is replaced by its kind in brackets."""
    plain = docs.select(*COLUMNS).withColumn("text", secret_scan.redact("text"))
    return plain.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: no row, one or two rows of a document, each with the words of one pass over it."""
    mixed = source_mix.mix(docs.select(*COLUMNS), carry=("text", "lang"))
    mixed = mixed.where("taken > 0").withColumn("text", F.explode(source_mix.taken_text(mixed)))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the checks of parity and round trip."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path(PIECE_BPE))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier, hashes and tokenizers have no SQL form; tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
