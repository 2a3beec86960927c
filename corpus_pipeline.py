"""Corpus preparation as a chain of stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in
the shared folder and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, read_table
from specgrid.llm.linededup import drop_repeats
from specgrid.llm.minhash import near_duplicates
from specgrid.llm.mixing import mix
from specgrid.llm.pieces import encode_pieces, read_model
from specgrid.llm.queries import TOKENIZERS, train_toxicity
from specgrid.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject.

    Each row is scored by its own text, so repeated rows stay or go together, and a
    null or empty text is scored like a text without any telling word and stays.
    """
    return score(docs, train_toxicity(spark, docs, sf_dir)).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of passages; a document that was nothing but repeats goes.

    A null or empty text stays as it is, texts without repeats keep their
    ``n_chars``. Of repeated rows the first keeps its passages, the later ones go
    if they consist of such; rows too short to be a passage stay each.
    """
    out = drop_repeats(docs.select(*COLUMNS)).where("NOT emptied")
    shorter = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", shorter).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first by (doc_id, text) with null ids last.

    Rows that share a doc_id but not a text are documents of their own, and so is
    a row with a null doc_id: it goes only if its text is a near copy of one that
    stays. Rows of equal doc_id and text, nulls too, count once. A null or empty
    text is a copy of nothing else.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.join(near_duplicates(docs).where("kept").select("doc_id"), "doc_id", "left_semi")
    scratch = Scratch(spark, "near-dedup")
    once = docs.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    once = scratch.keep(once.withColumn("key", F.monotonically_increasing_id()), "keyed")
    groups = near_duplicates(once.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    placed = once.select("key", "doc_id", "text").join(groups, "key")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text", "key")).alias("first"))
    return once.join(first.select("first.key"), "key", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows are told apart by a hash of all columns beside the id, so rows that
    share a doc_id, or have none, are taken each on its own account; equal rows
    are interchangeable and count together.
    """
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS))
    mixed = mix(docs.select(F.col("row").alias("doc_id"), "text", "source", F.col("doc_id").alias("own")), keep=["own"])
    copies = mixed.where("copies > 0").groupBy("own", F.col("doc_id").alias("row")).agg(F.sum("copies").cast("int").alias("copies"))
    once = docs.dropDuplicates(["doc_id", "row"])
    taken = once.join(copies, (once["row"] == copies["row"]) & once["doc_id"].eqNullSafe(copies["own"])).select(*COLUMNS, "copies")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents, a row for each copy; a null or empty text has none."""
    return encode_pieces(docs, read_model(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL cannot express the stages; tests hold near-dedup against brute force and the others to columns, counts and single cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order; a stage's table goes when the next one is written. Extra columns are dropped by the first."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            scratch.drop(docs)
        docs = made
    return docs
