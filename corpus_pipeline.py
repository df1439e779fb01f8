"""A corpus run: toxic documents go, one of each group of near copies stays, benchmark passages and secrets go, and the rest is encoded.

STAGES are applied in order; each gets what its predecessor kept, written as Parquet and read again. Columns beyond those of documents
pass through all stages but the last. Empty tables pass through empty; rows with null or empty texts are kept by every stage (a null
text has no words, no shingles, no secrets and no pieces); ties and repeated rows are settled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate, minhash, pieces, secret_scan, toxicity
from quarrymill.llm.common import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model trained on the labelled documents of sf_dir that aren't held out. Null and empty texts stay; rows that repeat an id or a text stay or go alike with their text; without labels of both kinds all stay."""
    model = toxicity.train(toxicity.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.not_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked at a Jaccard similarity of 0.8 over five-word shingles. Of rows that repeat an id, all stay or go; documents without shingles or id stay."""
    groups = minhash.near_duplicates(docs, shingle=5, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth stand in a benchmark window; rows without an id, or of one id, are each judged by their own text."""
    found, _ = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]  # names of our own, so that no column clashes with the keys
    keyed = docs.toDF(*names).withColumn("own_id", F.col(names[docs.columns.index("doc_id")]).cast("long")).withColumn("own_key", decontaminate.text_key(names[docs.columns.index("text")]))
    kept = keyed.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left_anti")
    return kept.select(*names).toDF(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret replaced by a mark; n_chars, where it is there, follows the text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and n_best of every document, and the hash of the text that its ids decode to."""
    return pieces.encode_and_decode(docs).withColumn("decoded_sha256", F.sha2("text", 256)).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]
ORACLE_SQL = None  # SQL expresses neither the trained classifier nor the segmentation


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return kept
        kept.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
