"""The operators' queries, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byte_bpe, lang_id, media, mixing, neardup, prefix_trie, quality, secret_scan, substring_dedup, turn_repair, url_filter, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_id": lambda spark, d: lang_id.op1(table(spark, d, "documents")),
    "op2_mixing": lambda spark, d: mixing.op2(table(spark, d, "documents")),
    "op3_minhash": lambda spark, d: neardup.op3(table(spark, d, "documents")),
    "op4_bpe": lambda spark, d: bpe.op4(table(spark, d, "documents"), stable=True),
    "op8_secret_scan": lambda spark, d: secret_scan.op8(table(spark, d, "documents")),
    "op9_quality": lambda spark, d: quality.op9(table(spark, d, "documents")),
    "op10_substring_dedup": lambda spark, d: substring_dedup.op10(table(spark, d, "documents")),
    "op5_ogg": lambda spark, d: media.op5(table(spark, d, "documents")),
    "op7_warc": lambda spark, d: warc.op7(table(spark, d, "pages")),
    "op6_url_filter": lambda spark, d: url_filter.op6(table(spark, d, "pages")),
    "op11_prefix_trie": lambda spark, d: prefix_trie.op11(table(spark, d, "conversations")),
    "op12_turn_repair": lambda spark, d: turn_repair.op12(table(spark, d, "conversations")),
    "op13_byte_bpe": lambda spark, d: byte_bpe.op13(table(spark, d, "documents")),
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL, "op3_minhash": neardup.OP3_SQL, "op6_url_filter": url_filter.OP6_SQL, "op7_warc": warc.OP7_SQL, "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_turn_repair": turn_repair.OP12_SQL,
}
