"""Named queries: each operator on its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.centroids import cluster_vectors
from specgrid.llm.chat import chat_digests
from specgrid.llm.common import read_table
from specgrid.llm.forest import nearest
from specgrid.llm.html import extract_pages
from specgrid.llm.linededup import drop_repeats
from specgrid.llm.minhash import near_duplicates
from specgrid.llm.mixing import mix
from specgrid.llm.packing import pack
from specgrid.llm.pieces import encode_pieces, read_model
from specgrid.llm.spelling import spelling_forms
from specgrid.llm.toxicity import Grammar, learn, sampled, score
from specgrid.llm.urls import judge
from specgrid.llm.vectors import near_vectors

#: Folder of the tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _held_out():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1


def train_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Grammar:
    """Grammar from the labels of the rows of ``docs`` that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~_held_out()).select("doc_id", "toxic")
    return learn(docs.select("doc_id", "text").join(sampled(labels), "doc_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train_toxicity(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_deleted", "emptied", "spans", "text")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return encode_pieces(read_table(spark, sf_dir, "documents"), model)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turn = F.col("id")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(rows.unionByName(more))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))[0]


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_mixing, op3_toxicity, op4_minhash, op5_vectors, op6_forest, op7_linededup, op8_pieces, op9_chat, op10_urls, op11_centroids, op12_packing, op13_spelling)
}
