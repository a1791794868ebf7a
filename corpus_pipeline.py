"""From raw documents to packed training sequences: five stages, each one operator of terralume.llm.

Every stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralume.llm import jaccard, mixing, packing, pii, quality
from terralume.llm.common import WorkFolder, fresh, table

#: Least quality score of a kept document, and copies a document gets in the mean.
KEEP_QUALITY, MIX_FACTOR, MIX_SEED = 0.5, 1.0, "pipeline-1"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score passes the label quantile; the others go.

    Empty and null texts are scored like any other. The ranker learns from the labelled
    documents among ``docs``; without labels of both classes it keeps all or, if every
    label is 0, none. Equal texts score alike, a score equal to the bar stays, repeated rows and
    null ids are scored like any row; an empty table stays empty. Texts of any length are scored
    whole, further columns of any name stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "pipeline_quality")
    return quality.score(docs, model, out=score).where(F.col(score) >= KEEP_QUALITY).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; five words and 80 percent.

    The one of least id stays (null ids last), ties by a hash of the text. Rows of one id and
    different texts are different documents; rows equal in id and text are one. Null, empty and
    blank texts are in no group and all stay. An empty table stays empty. Texts of any length are
    compared whole, further columns of any name stay.
    """
    return jaccard.keep_one(docs, words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows come out alike; an empty table stays empty. Texts of any length are read whole,
    further columns of any name stay.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies in random order, sources weighted by the square root of their counts; a document may get none.

    A null source is a source of its own, null ids hash as one id, rows of one id get equal
    counts; texts of any length are carried whatever they are. Equal rows get equal counts, further
    columns of any name stay. An empty table stays empty.
    """
    plain = [f"c{k}" for k in range(len(docs.columns))]  # clash with nothing that mixing adds
    named = dict(zip(docs.columns, plain))
    mixed = mixing.mix(docs.toDF(*plain), None, MIX_FACTOR, MIX_SEED, id_col=named["doc_id"], source=named["source"])
    return mixed.select(plain).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a training sequence.

    A null or empty text is its end token alone; copies and equal texts are packed each; ties
    between equal lengths go by where the rows lie. An empty table gives an empty result. A text of any
    length is tokenised whole; further columns are passed over.
    """
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learnt stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = WorkFolder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.put(name, docs)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
