"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and is written as Parquet before the next one reads it. All but the last return
the columns of ``documents``; where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casesignal.llm.line_dedup import dedup_lines
from casesignal.llm.mixing import mixed_documents
from casesignal.llm.pieces import encode
from casesignal.llm.quality_model import keep_good
from casesignal.llm.registry import piece_model
from casesignal.llm.simhash import keep_one
from casesignal.session import prepare, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more stay."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(_documents(docs), labels, least=0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document."""
    prepare(spark)
    out = dedup_lines(_documents(docs), min_docs=10, min_chars=1)
    kept = F.col("line_dedup")["text"]
    return _documents(out.withColumn("text", kept).withColumn("n_chars", F.length(kept).cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, stays of each group."""
    prepare(spark)
    return _documents(keep_one(_documents(docs), words=4, distance=4))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    prepare(spark)
    out = mixed_documents(_documents(docs), exact=True)
    return _documents(out.withColumn("n_chars", F.length("text").cast("long")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the hash of what they decode to."""
    # Whole texts and their ids pass through Python: small batches bound a worker.
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    out = encode(_documents(docs), piece_model())
    return out.select("doc_id", "lang", "source", "pieces.n_tokens", "pieces.ids", "pieces.decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece encoding", encoded),
]

#: The stages train a model and search for paths; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
