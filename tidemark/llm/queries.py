"""Queries of the text problems (p6-p8), with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.stuffing import page_scores
from tidemark.llm.tokens import token_ids
from tidemark.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    sized = mixing.sizes(table(spark, folder, "documents"))
    return mixing.draw(sized, mixing.plan(sized, table(spark, folder, "mix_targets"))).withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized = mixing.sizes(table(spark, folder, "documents"))
    planned = mixing.plan(sized, table(spark, folder, "mix_targets"))
    return mixing.report(mixing.draw(sized, planned), planned)


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return page_scores(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where("flagged").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
