"""A corpus pipeline of five of the operators in ``docloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last return the columns
of ``documents``.  ``run`` writes every stage's result as Parquet in the shared folder and reads it
back as the next one's documents, so a stage works on exactly what the one before kept, and a lost
executor costs at most a stage's unfinished tasks.

1. toxicity: documents that the factorization machine rejects go; it is fitted on the labelled rows
   of the documents that the stage gets, outside the held-out third.
2. near-duplicates: of each class the document with the least id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. personal data: found spans are replaced by their kind; n_chars follows.
5. pieces: (doc_id, n_tokens, token_ids).

Defined cases: null and empty texts pass all stages (they are neither toxic nor copies nor
contaminated) and have no tokens; tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bagminhash import drop_near_duplicates
from docloom.llm.common import shared_dir, tables
from docloom.llm.decontamination import drop_contaminated
from docloom.llm.pii import redact
from docloom.llm.sentencepieces import encode
from docloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, tables(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, tables(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: A trained classifier, locality-sensitive candidates and a CRF are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    path = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{path}/{k}-{name}")
    return docs
