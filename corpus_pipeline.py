"""From raw documents to packed training sequences: five stages, each one of the training-data operators.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its predecessor kept; what it returns is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents, extra ones and those
of any name among them. A null in any column, an empty or very long text, ties and repeated rows have the result that the stage's docstring
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import Release, Scratch, table
from quillmark.llm.mil import keep_quality
from quillmark.llm.mixing import mix_documents
from quillmark.llm.near import keep_one_near
from quillmark.llm.packing import pack
from quillmark.llm.quality_rules import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is scored as an empty one; repeated rows go or stay alike."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy rejects go, null and empty texts among them; repeated rows go or stay alike."""
    return keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (candidates by SimHash, links by five-word shingles, similarity of at least 0.8)
    stays: the smallest id (null last), then the smallest hash of the text. Texts without words are one group; a row repeated in full
    stays once."""
    return keep_one_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them; documents of which it takes none, and those without words, go. A null
    source is a source."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null or empty text is its end alone."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), known_words=100_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; a stage's scratch tables, and its predecessor's output, go once its own output is written."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES:
        with Release() as release:
            docs, path = scratch.write(stage(spark, docs, sf_dir))
            release.spare(path)
        if last:
            scratch.drop(last)
        last = path
    return docs
