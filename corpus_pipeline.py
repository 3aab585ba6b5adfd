"""A corpus pipeline: language ID, near-dedup, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents and no others.
Stages take an empty table, give an empty one, and keep very long texts whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, lang_id, mixing, neardup, secret_scan
from marketlens.llm.common import drop_folder, ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose words' labels are on the mean less certain than this are rejected, as are those without letters.
LEAST_CERTAINTY = 0.5
#: Near duplicates have a similarity of so many percent; a pair right at it shares no band with a probability of 8 in 100,000.
SIMILAR, BANDS, ROWS = 80, 40, 7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose words are of no recognised language; the others, also in several languages, get the predicted one.

    Null and empty texts are rejected; repeated rows and null ids are judged each by its text; of equally likely languages the first by name counts.
    """
    found = lang_id.label_documents(docs, lang_id.fit_on(docs))
    sure = found.filter((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAINTY))
    return sure.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows that repeat an id are one document.

    Texts without words and rows without an id are like no other and stay.
    """
    kept = neardup.near_duplicates(docs, SIMILAR, BANDS, ROWS).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.filter("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)
    return known.union(docs.filter("doc_id IS NULL").select(*COLUMNS))  # these stay, so they need no join


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with a mark in place of each secret; a null text stays null, and n_chars is the new length."""
    clean = secret_scan.redact(secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words go with their source's rate like the others."""
    return mixing.emit(mixing.mix(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, their number, and the SHA-256 of the text that they decode to; null counts as empty."""
    coded = bpe.round_trip(docs, stable=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't express the language model, the sketches or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is kept in the shared folder for the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the last stage read is no longer needed
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
