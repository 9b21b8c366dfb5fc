"""The corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, decontamination, SentencePiece sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinframe.llm import decontaminate as dc
from kinframe.llm import segment_sampling, simhash, suffix_dedup, toxicity
from kinframe.llm.queries import tokenizer_path
from kinframe.llm.shared import written


#: A passage of over 50 words is longer than this in any of the tables' languages.
REPEAT_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go; the rest stay unchanged.

    Null and empty texts stay; equal texts get equal scores, so copies and repeated rows go or stay together; without
    labels of both kinds nothing goes; extra columns stay, whatever their names; an empty table gives an empty one.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the smallest doc_id stays, unchanged.

    Texts without words, null ones included, are copies of one another; rows with a null doc_id and all rows that
    repeat the smallest doc_id stay; extra columns stay; an empty table gives an empty one.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES that start more than once are cut out of the texts; every document stays.

    All occurrences are cut alike, so ties don't arise; null texts stay null, a text that repeats as a whole becomes empty;
    repeated rows and null keys keep their rows; extra columns stay; an empty table gives an empty one.
    """
    return suffix_dedup.deduplicated(docs, REPEAT_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage (80 % of its words at one place) go.

    Each row is judged by its own text: null and empty ones stay, copies and repeated rows go together, whatever
    their keys; extra columns stay; an empty table or benchmark removes nothing.
    """
    return dc.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, as SentencePiece ids with their inclusion scores.

    Null and empty texts have one, without pieces; a text with a single segmentation has that one; the seed is the
    row's key, so repeated rows sample alike; ties of perturbed scores go by the pieces; other columns are left out; an
    empty table gives an empty result.
    """
    return segment_sampling.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", sample_pieces),
]

#: SQL can't say what a trained classifier keeps; tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each to what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
