"""A corpus from raw documents to packed batches, in five stages.

Each stage is stored as Parquet in the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.llm import decontamination, line_dedup, packing, simhash, toxicity
from samplewright.llm.common import KEY, identified, table
from samplewright.session import Scratch, scratch

TOXIC = 0.3
BITS = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the threshold; the model is fitted on the labels of these documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(model, F.col("text")) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which nothing is left."""
    found = line_dedup.repeated_lines(docs)
    text = line_dedup.cleaned(found)
    kept = found.select("row", "n_lines_removed", text.alias("text")).filter(
        (F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S")
    )
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])}
    changed = F.col("n_lines_removed") > 0
    return kept.select(
        *[F.when(changed, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints of three-word shingles at two or fewer differing bits
    stays: the one with the smallest id, of repeated ids one row."""
    keyed = identified(docs)
    groups = simhash.near_duplicates(keyed.select(KEY, "row.text"), doc_id=KEY, bits=BITS)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(KEY))
    return keyed.join(first, KEY, "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = identified(docs)
    leaks = decontamination.contained_items(keyed.select(KEY, "row.text"), table(spark, sf_dir, "benchmark"), doc_id=KEY)
    held = leaks.select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(held, KEY, "left_anti").select("row.*")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document goes."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

# A logistic model and hashes of 64 bits stand between the documents and the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, one after the other.

    What a stage has stored goes once its result is stored, and that result once the next one is, so at the end only the
    last stage's rows are left in the shared folder.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        kept = Scratch(spark)
        with scratch(spark) as scope:
            docs = scope.keep(stage(spark, docs, sf_dir), kept)
        if before:
            before.close()
        before = kept
    return docs
