"""The corpus pipeline: civil, distinct, uncontaminated, pseudonymous documents as piece ids.

``run`` applies the stages to a documents table; each stage's rows are materialised before the next reads them. A driver may
as well write each stage's rows as Parquet and hand them to the next. All but the last return the columns of documents,
whatever other columns there are. A null text passes every stage (it has no words: not toxic, fingerprint zero, not
contaminated, nothing personal, null ids), so does an empty one; as fingerprints zero link, one of both kinds stays. Rows
without an id stay, of rows that share one a single row. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, pieces, pii, simhash, toxicity
from quarryline.llm.common import checkpointed, free_name, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from the labels of docs, does not reject.

    Null and empty texts score as civil unless most labelled rows say otherwise; repeated rows are judged alike; without
    labels nothing is rejected.
    """
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each group linked by SimHash; rows without an id all stay, repeated ids once."""
    return simhash.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit fewer than one word in twenty; all that have no words."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars, if there, follows a text that changed."""
    kinds = free_name(docs, "pii_kinds")
    out = pii.pseudonymise(docs, kinds=kinds)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(kinds) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select([f"`{c}`" for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text; null for a null text, none for an empty one."""
    return pieces.round_trip(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", civil),
    ("simhash", distinct),
    ("decontamination", uncontaminated),
    ("pii", pseudonymous),
    ("pieces", encoded),
]
#: SQL expresses neither the classifier nor XXH64 nor the piece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
