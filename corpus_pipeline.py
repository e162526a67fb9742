"""A corpus pipeline out of five of the operators.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and extra columns, and an empty
table; it returns the columns of its input (the last stage adds those of the mixture). Null texts count as empty. Rows with
equal doc_id are one document: they stay or go together, unless the quality of their texts differs. Rows without doc_id are
judged by their texts; no near duplicate removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchflow.llm import decontam, lines, mixing, quality, simhash
from pitchflow.llm.common import stored, sweep, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that many documents share; n_chars follows the text. Counts of lines that ``docs`` has stay."""
    own = {c: f"__{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    cut = lines.dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped")
    cut = cut.withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", lines.F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, with their places."""
    return mixing.mix(docs).orderBy("mix_position")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_shared_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixture),
]

#: The quality classifier is learnt, which SQL does not express; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of what all stages keep. A stage's own tables are deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
