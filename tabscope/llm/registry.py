"""The registered queries of this folder and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import chat, codes, decontaminate, extract, langid, lm, mixing, quality, search, secrets, simhash, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {
        "op1_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op2_secrets": lambda s, d: secrets.report(table(s, d, "documents")),
        "op3_decontaminate": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_mixing": lambda s, d: mixing.report(table(s, d, "documents"), table(s, d, "labels")),
        "op5_extract": lambda s, d: extract.report(table(s, d, "pages")),
        "op6_warc": lambda s, d: warc.round_trip(table(s, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"),
        "op7_langid": lambda s, d: langid.report(table(s, d, "documents")),
        "op8_toxicity": lambda s, d: toxicity.report(table(s, d, "documents"), table(s, d, "labels")),
        "op9_lm": lambda s, d: lm.scores(table(s, d, "documents")),
        "op10_quality": lambda s, d: quality.report(table(s, d, "documents")),
        "op11_codes": lambda s, d: codes.report(table(s, d, "embeddings")),
        "op12_search": lambda s, d: search.ranked(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_chat": lambda s, d: chat.report(table(s, d, "conversations")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from tabscope.llm.sql import SQL

    return dict(SQL)
