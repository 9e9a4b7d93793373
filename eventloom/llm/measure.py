"""Held-out figures of the learned operators: ``python -m eventloom.llm.measure DIR`` prints those of op1 and op9 on a folder of tables."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import queries


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, n, right: rows with a language, and those where it is the predicted one."""
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    found = queries.op1_language_id(spark, sf_dir).join(truth, "doc_id")
    return found.groupBy("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, toxic, predicted, n."""
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    return queries.op9_toxicity(spark, sf_dir).join(truth, "doc_id").groupBy("held_out", "toxic", "predicted").count().withColumnRenamed("count", "n")


if __name__ == "__main__":
    session = SparkSession.builder.appName("measure").getOrCreate()
    languages(session, sys.argv[1]).orderBy("held_out").show()
    toxicity(session, sys.argv[1]).orderBy("held_out", "toxic", "predicted").show()
