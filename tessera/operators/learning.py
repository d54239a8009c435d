"""Feature vectors, a provider classifier and text embeddings by truncated singular value decomposition."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import frame
from ..sources.scratch import small_batches, written

FEATURES = ("n_chars", "n_words", "mean_word", "digit_share", "upper_share", "mark_share", "n_lines")


def features(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    words = F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.lit(1))
    return docs.select("doc_id", F.length(text).cast("double").alias("n_chars"), words.cast("double").alias("n_words"), (n / words).alias("mean_word"), share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"), share("[^A-Za-z0-9\\s]").alias("mark_share"), F.regexp_count(text, F.lit("\n")).cast("double").alias("n_lines"))


def fit(rows: DataFrame, label: str, kind: str = "logistic"):
    """A model on rows with FEATURES and a 0/1 label; classes weigh the same."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two rows
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts.get(1, 1))).otherwise(total / (2 * counts.get(0, 1)))
    rows = rows.withColumn("weight", weight)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep")
    model = LogisticRegression(featuresCol="vector", labelCol=label, weightCol="weight", maxIter=50) if kind == "logistic" else GBTClassifier(featuresCol="vector", labelCol=label, weightCol="weight", maxDepth=3, maxIter=20, seed=42)
    return Pipeline(stages=[assembler, model]).fit(rows)


@frame("provider_probability", "N7 N8 N9 A8")
def provider_probability(spark, sf_dir):
    """A balanced logistic regression on four fifths of the labels, by a hash of the id; the rest is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = features(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(5)) == 0
    model = fit(rows.where(~held), "label")
    return model.transform(rows).select("doc_id", held.alias("held_out"), "label", "prediction", F.round(vector_to_array("probability")[1], 6).alias("probability"))


#: Terms are hashed to so many columns; the tables that passes send to the driver have a row of SIZE + SPARE numbers for each.
TERMS, SIZE, SPARE = 1 << 15, 128, 8
#: Parts in which a table is added up.
LOTS = 64


class TermColumns(dict):
    """The column of each word met, of a bounded number of words."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = column = crc32(word.encode()) % TERMS
        return column

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The columns of a text's terms, and how often each occurs."""
        words = re.findall(r"\w+", (text or "").lower())
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), return_counts=True)


def term_weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a text's terms, and 1 + the logarithm of how often each occurs."""
    columns, times = TermColumns().counts(text)
    return columns, 1 + np.log(times)


def term_rows(texts: DataFrame) -> DataFrame:
    """terms, times: the columns of each text's terms and how often each occurs, as four-byte numbers, beside what texts (text) has besides its text."""
    small_batches(texts.sparkSession)
    others = [c for c in texts.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        known = TermColumns()
        for batch in batches:
            found = [known.counts(t) for t in batch.column(0).to_pylist()]
            made = [pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*others, "terms", "times"])

    schema = texts.select(*others, *(F.lit(None).cast("binary").alias(n) for n in ("terms", "times"))).schema
    return texts.select("text", *others).mapInArrow(run, schema)


def _read(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch of term_rows, whose last columns are terms and times."""
    terms, times = (c.to_pylist() for c in batch.columns[-2:])
    return [(np.frombuffer(c, "<i4"), np.frombuffer(n, "<i4")) for c, n in zip(terms, times, strict=True)]


@dataclass
class Topics:
    """Each term's inverse document frequency and its row of the leading right singular vectors: TERMS rows, told to every task."""

    rarity: np.ndarray
    vectors: np.ndarray

    def rows(self, counted: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Texts, as columns and counts, as sparse rows of length one."""
        out = []
        for columns, times in counted:
            weights = (1 + np.log(times)) * self.rarity[columns]
            norm = np.sqrt((weights * weights).sum())
            out.append((columns, weights / norm if norm else weights))
        return out

    def embed(self, counted: list) -> np.ndarray:
        out = np.zeros((len(counted), self.vectors.shape[1]))
        for k, (columns, weights) in enumerate(self.rows(counted)):
            out[k] = weights @ self.vectors[columns]
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def _by_column(rows: DataFrame, work, width: int) -> np.ndarray:
    """The sum over all of term_rows of what work adds to a table of TERMS rows. Each task sends the rows that it touched; they are added up in parts."""

    def run(batches):
        import pyarrow as pa

        total, touched = np.zeros((TERMS, width)), np.zeros(TERMS, bool)
        for batch in batches:
            work(_read(batch), total, touched)
        for lot in range(LOTS):
            rows = np.flatnonzero(touched[lot::LOTS]) * LOTS + lot
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([total[rows].tobytes()], pa.binary())], names=["lot", "terms", "rows"])

    def add(key, table):
        import pyarrow as pa

        total = np.zeros((TERMS // LOTS, width))
        # in one order, so that sums are the same in every run
        for terms, rows in sorted(zip(table.column("terms").to_pylist(), table.column("rows").to_pylist(), strict=True)):
            total[np.frombuffer(terms, "<i4") // LOTS] += np.frombuffer(rows).reshape(-1, width)
        return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "terms": pa.array([b""], pa.binary()), "rows": pa.array([total.tobytes()], pa.binary())})

    schema = "lot int, terms binary, rows binary"
    # each task sends a table: as many as the cores can use, however much there is to read
    rows = rows.select("terms", "times").coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    out = np.zeros((TERMS, width))
    for r in rows.mapInArrow(run, schema).groupBy("lot").applyInArrow(add, schema).collect():
        out[r["lot"] :: LOTS] = np.frombuffer(r["rows"]).reshape(-1, width)
    return out


def topics(texts: DataFrame, size: int = SIZE, rounds: int = 2, seed: int = 11) -> Topics:
    """Topics of texts (text)."""
    return topics_of(written(term_rows(texts.select("text")), "terms"), size, rounds, seed)


def topics_of(rows: DataFrame, size: int = SIZE, rounds: int = 2, seed: int = 11) -> Topics:
    """Topics of a written table of term_rows: a truncated singular value decomposition of their weighted matrix A, in 1 + rounds passes.

    A random table of size + SPARE columns is multiplied by A'A and made orthogonal in each round; the last product gives the leading
    singular vectors within its span. The largest number of each vector is positive, so that they are the same in every run.
    """

    def count(counted, total, touched):
        for columns, _ in counted:
            total[columns] += 1
            touched[columns] = True

    n = rows.count()
    often = _by_column(rows, count, 1)[:, 0]
    rarity = np.where(often > 0, np.log((1 + n) / (1 + often)) + 1, 0)
    basis = np.random.default_rng(seed).normal(size=(TERMS, size + SPARE)) * (often > 0)[:, None]
    for _ in range(rounds):
        basis, _ = np.linalg.qr(basis)
        told = rows.sparkSession.sparkContext.broadcast(Topics(rarity, basis))

        def multiply(counted, total, touched, told=told):
            model = told.value
            for columns, weights in model.rows(counted):
                total[columns] += np.outer(weights, weights @ model.vectors[columns])
                touched[columns] = True

        product = _by_column(rows, multiply, size + SPARE)
        values, turn = np.linalg.eigh(basis.T @ product)
        leading = basis @ turn[:, np.argsort(-values)[:size]]
        basis = product
    sign = np.sign(leading[np.abs(leading).argmax(0), np.arange(leading.shape[1])])
    return Topics(rarity, leading * np.where(sign == 0, 1, sign))


def embedded(docs: DataFrame, model: Topics) -> DataFrame:
    """doc_id, vector (length one; zeros for a text without known terms) of docs (doc_id, text)."""
    return embedded_rows(term_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), model)


def embedded_rows(rows: DataFrame, model: Topics) -> DataFrame:
    """doc_id, vector of term_rows with a doc_id."""
    told = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = told.value.embed(_read(batch)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["doc_id", "vector"])

    return rows.select("doc_id", "terms", "times").mapInArrow(run, "doc_id long, vector array<float>")


@frame("text_embeddings", "N5")
def text_embeddings(spark, sf_dir):
    """Vectors of all texts by the topics of the texts themselves; no sentence model is at hand. Texts are taken apart once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(term_rows(docs), "terms")
    return embedded_rows(rows, topics_of(rows))
