"""The corpus pipeline: raw documents to clean, distinct, encoded ones.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``. ``run`` writes each stage's rows as
Parquet under the shared checkpoint folder and reads them back, so that a lost executor
never costs more than the stage at hand; the folder is deleted at the end.

Rows with nulls, empty texts and repeated rows go through every stage as the operators'
docstrings say: of equal texts, null among them, one row is left after exact dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontaminate import drop_contaminated
from corpusloom.llm.exact_dedup import drop_exact_copies
from corpusloom.llm.sentencepieces import encode_pieces
from corpusloom.llm.simhash import keep_one_of_each
from corpusloom.llm.toxicity import fit_toxicity, score_toxicity
from corpusloom.session import cut_lineage, is_train, scratch, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(is_train("doc_id", 5))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), score_col="_toxicity_score", hits_col="_toxicity_hits")
    return scored.where(F.col("_toxicity_score") < 0.5).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints (operator 4, as its contract defines them) the smallest id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document left: its ids, their number and digest, and that of the decoded text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(docs.select("doc_id", "text"), path, fields=("ids", "n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot learn the toxicity model or encode; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark, "pipeline") as folder:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stored(docs, f"{folder}/{k}-{name}")
        return cut_lineage(docs)
