"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns rows of the
same columns, the last one pieces of sequences. Stages keep other columns as
they are and add none, so a column may have any name. Null texts count as empty
and stay null; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lexical_packing, nb_svm, personal_data, set_join, toxicity
from lodestone.llm.registry import table
from lodestone.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``toxicity.REJECT``."""
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scoring(net)("text") < toxicity.REJECT)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``nb_svm.KEEP`` or more."""
    model = nb_svm.fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.where(nb_svm.scoring(model)("text") >= nb_svm.KEEP)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links connect.

    Documents without words are in no group and stay, as do rows without an id.
    Rows of one id are one document, of which one row stays.
    """
    joined = set_join.join_sets(docs.select("doc_id", "text"))
    kept = joined.where("component_id = doc_id").select("doc_id").distinct()
    found = docs.join(materialize(kept, "kept-ids"), "doc_id", "left_semi")
    return found.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; ``n_chars`` follows where a text changed."""
    mask = personal_data.masking(personal_data.learn(docs))
    masked = docs.select(*docs.columns, mask("text").alias("masked text"))
    changed = F.col("masked text") != F.col("text")
    return masked.select(
        *[
            F.col("masked text").alias("text")
            if c == "text"
            else F.when(changed, F.length("masked text")).otherwise(F.col(c)).cast("bigint").alias(c)
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids."""
    return lexical_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", one_of_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Learned models decide in the stages, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
