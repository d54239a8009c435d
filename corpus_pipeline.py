"""A training corpus from raw documents: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result into the
shared folder and reads it back as the next one's documents. All but the last return the columns of documents.

Defined results, for every stage: rows are judged one by one, so rows that share an id or have none are kept, dropped and
redacted each for itself. A null text has no letter and goes at the first stage; later stages take it as empty. An empty
table stays empty. Further columns, whatever their names, go along untouched up to packing, which returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard, langid, packing, pii
from tessera.llm.common import discard, materialize, temporary, told

#: Near copies: word shingles of this width, and the similarity in percent from which two texts are linked.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
END_ID, CAPACITY = 2, 4096


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go; the others get the predicted language. The model learns from docs' own lang."""
    model = langid.train(docs.select("text", "lang"))
    others = F.struct(*[c for c in docs.columns if c != "text"])
    found = langid.identify(docs.select("text", others.alias("others")), model).where(F.col("lang_pred") != langid.UNKNOWN)
    given = {"text": F.col("text"), "lang": F.col("lang_pred")}
    return found.select(*[given.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space one stays, whatever their ids."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows one stays, that of the smallest id (a null id comes last); so does every row without words.

    Rows are linked by their own number, so that rows that share an id or have none are told apart.
    """
    others = F.struct(*[c for c in docs.columns if c != "text"])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", others.alias("others"))
    rows = materialize(rows, "numbered")
    _, found = jaccard.links(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    classes = jaccard.components(found, "classes")
    linked = materialize(rows.select("row", "doc_id").join(classes, F.col("row") == F.col("node")).select("row", "doc_id", "component"), "linked")
    # the smallest id as it is ordered: known ids first
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    stays = linked.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first")["row"].alias("row"))
    gone = materialize(linked.select("row").join(stays, "row", "left_anti"), "gone")
    stay = rows.join(told(gone), "row", "left_anti")
    return stay.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def redacted(text: Column, found: Column) -> Column:
    """text with each found span (kind, start, end; in any order) replaced by its kind in brackets; overlapping ones by the first's."""
    names = F.array(*[F.lit(f"[{k}]") for k in pii.KINDS])
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        low = F.greatest(acc["at"], x["start"])
        added = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (low - acc["at"]).cast("int")), F.when(x["start"] >= acc["at"], names[x["kind"]]).otherwise(""))
        return F.struct(added.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, 2**31 - 1)))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text becomes its kind in brackets; n_chars follows. Each row has its own spans, whatever its id."""
    rows, some = pii.find(docs, whole=True), F.size("found") > 0
    text = F.when(some, redacted(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    rows = rows.select(text.alias("text"), some.alias("some"), "others")
    given = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.when(F.col("some"), F.char_length("text")).otherwise(F.col("others")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[given.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY)


STAGES = [
    ("language", identify_language),
    ("exact copies", drop_copies),
    ("near copies", drop_near_copies),
    ("personal data", redact),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed corpus. What a stage wrote for itself, and its input, are deleted once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            made = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), outer=True)
        if last is not None:
            discard(last)
        docs = last = made
    return STAGES[-1][1](spark, docs, sf_dir)
