"""Extraction from the table of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..plans.registry import frame
from ..sources.scratch import small_batches


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


@frame("page_links", "R40 R42 R48 R49 L13 L10")
def page_links(spark, sf_dir):
    """Every link with anchor, rel and place on the page."""
    return pages(spark, sf_dir).select("page_id", F.explode(H.links_udf("html", "url")).alias("x")).select("page_id", "x.*")


@frame("page_outline", "L11 L10")
def page_outline(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(H.sections_udf("html", "url")).alias("pos", "x")).select("page_id", "pos", "x.*")


@frame("page_contents", "L1 L3 L4 L5 L8 L7")
def page_contents(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", H.content_udf("html", "url").alias("x"))
    return found.select("page_id", "x.title", "x.phones", "x.mails", "x.headings", F.sha2("x.main_text", 256).alias("text_hash"), F.size(F.split("x.main_text", " ")).alias("words"))
