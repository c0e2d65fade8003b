"""A corpus pipeline of five stages, each one of the text operators.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written
and read again as the next one's documents. All but the last return the columns
of documents.

Defined cases, for every stage: an empty table gives no rows; columns beyond
those of documents pass through, whatever their names; no stage groups rows of
one id or text in one task. Nulls, ties and repeats are stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmark.llm import contamination, mixing, neardup, templates, toxicity
from chainmark.llm.work import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score stays below the threshold.

    A null text scores as an empty one; repeated rows score alike and stay or go
    together; a score equal to the threshold goes.
    """
    labels = table(spark, sf_dir, "labels")
    scored = toxicity.classify(docs, toxicity.fit(docs, labels))
    return scored.where("predicted = 0").select("doc.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring template lines out of the texts; documents stay.

    A null text stays null, as does a null n_chars of a text that keeps its
    lines; a null id ranks last; of several rows with the smallest id all keep
    the line; rows that share id and text count once.
    """
    found = templates.dedup_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("text"), "n_chars": length}
    return found.select(*[changed.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate group; of repeated rows one stays.

    Rows with a null id are linked with nothing and all stay; so do null and
    wordless texts, of equal rows one. Different texts of one id that is kept
    all stay.
    """
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    lone = docs.where(F.col("doc_id").isNull())
    first = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.select(*docs.columns).unionByName(lone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without benchmark passages.

    Null and wordless texts stay; repeated rows stay or go together.
    """
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources meet their target weights.

    A null source is a source of its own, ranked last; a null text has size 0
    and is taken 0 times; repeated rows and null ids are rows like any other.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between them are written as Parquet."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.keep(docs, f"{i}-{name.replace(' ', '-')}")
    return docs
