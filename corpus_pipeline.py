"""The corpus pipeline: toxic texts go, one text of each near-duplicate class stays, repeated passages are cut out, texts that
hold benchmark items go, and the rest is encoded.

Each stage takes the rows its predecessor kept, written as Parquet and read again, and all but the last return the columns of
`documents`. Helper tables of a stage are removed when a later one begins, unless that one's input still reads them because the
result has not been written in between.

A null text is an empty one: it is not toxic, empty texts are copies of each other, nothing is cut from them, they hold no item
and have no tokens. Null ids stay, after all others where the smallest id decides; repeated rows are copies of each other.
Columns beyond those of `documents` stay until the last stage, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm import common, decontaminate, order_minhash, queries, sentencepiece_bpe, suffix_dedup, toxicity
from tillworks.session import release_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The helper folders of each stage that has been called and not yet cleared.
_DONE: list[list[str]] = []


def _clear(spark: SparkSession, docs: DataFrame) -> None:
    """Removes the helper folders of stages that `docs` does not read."""
    if not _DONE:
        return
    # a stage reads its folders together; their names are unique
    read = {part for file in docs.inputFiles() for part in file.split("/")}
    for folders in [*_DONE]:
        if not any(folder.rsplit("/", 1)[1] in read for folder in folders):
            _DONE.remove(folders)
            for folder in folders:
                release_folder(spark, folder)


def _stage(fn: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, docs)
        before = len(common.FOLDERS)
        result = fn(spark, docs, sf_dir)
        if len(common.FOLDERS) > before:
            _DONE.append(common.FOLDERS[before:])
        return result

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.7 (op 4); learned from the labelled rows that are not held out."""
    return toxicity.keep_below(docs, queries.toxicity_machine(spark, docs, sf_dir), 0.7)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate class (op 9)."""
    return order_minhash.one_of_each(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of 200 bytes or more that occur elsewhere (op 7)."""
    cut = suffix_dedup.without_repeats(docs, 200)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item (op 3)."""
    return decontaminate.without_items(docs, queries.table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them (op 2)."""
    found = sentencepiece_bpe.encode_texts(docs, queries.piece_model())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: None of the learned and text-matching stages can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
