"""Vector search by an inverted file of cells with product-quantised residuals, and the exact way through the same cells.

1. Fitting. Cell centres and the codebooks of the residuals' parts are k-means centres of a bounded sample (SAMPLE vectors, those of smallest
   hashed id). Every vector is indexed, whatever the sample.
2. Index. A table of each vector's cell, code (a byte for each part), angle to its cell's centre, and the vector of length one.
3. Search. Each query reads the codes of its nearest cells; queries and codes of a cell meet in one task, or in several where
   the cell or its queries are many. The best by code are ranked anew by their vectors.
4. Exact way. The k-th score found so bounds the rest: a cell whose nearest possible vector, by the angle to its centre less the cell's
   widest angle, can't reach it is not read; the vectors of all other cells are scored.

Scores are cosines, rounded to six places; ties go to the smaller id. Vectors that are null, of another length, of length zero, or hold
null or non-finite components take no part, as query or candidate. Ids are unique.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.dialect import Dialect
from ..plans.registry import frame
from ..sources.scratch import written

#: Vectors that an index is fitted on, at most.
SAMPLE = 16_384
#: Parts of a vector with a codebook each, and entries of a codebook at most.
PARTS, CODES = 16, 256
#: Cells at most: centres are told to every task.
MOST_CELLS = 4096
#: Vectors of a cell, and queries, that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 100_000, 2_000
#: Numbers that a task holds at once in a table of distances or scores (8 bytes each), and rows of vectors that it hands on at once.
HELD, HANDED = 1 << 21, 4_096


def matrix(column, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The valid rows of an Arrow list column as vectors of length one, and which rows they are; size: their length, else that of the first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    size = size or next((int(n) for n in lengths if n), 0)
    full = np.flatnonzero(lengths == size) if size else np.zeros(0, np.int64)
    # null components become NaN
    x = column.take(pa.array(full)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(full), size)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], full[good]


def _lists(x: np.ndarray):
    """Rows as an Arrow list column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _rows(column) -> np.ndarray:
    """Rows of an Arrow list column without nulls, all of one length."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(n: int, width: int):
    """Ranges of n rows whose table with so many columns is held at once."""
    step = max(1, HELD // max(1, width))
    return (slice(low, min(n, low + step)) for low in range(0, n, step))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre, and its squared distance less the vector's own square."""
    own, least, squares = np.zeros(len(x), np.int64), np.zeros(len(x)), (centres * centres).sum(1)
    for at in _slices(len(x), len(centres)):
        far = -2 * x[at] @ centres.T + squares
        own[at] = far.argmin(1)
        least[at] = far[np.arange(len(far)), own[at]]
    return own, least


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centres of x by Lloyd's rounds; a centre that loses its points takes the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own, far = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        if len(lost):
            centres[lost] = x[np.argsort(-far, kind="stable")[: len(lost)]]
    return centres


@dataclass
class Cells:
    """What is fitted: told to every task, at most MOST_CELLS + CODES vectors."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    probes: int = 1

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def cell(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        if n == 1:
            return _nearest(x, self.centres)[0][:, None]
        far = -2 * x @ self.centres.T + (self.centres * self.centres).sum(1)
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def angles(self, x: np.ndarray) -> np.ndarray:
        """The angle of each vector to each cell's centre."""
        norm = np.sqrt((self.centres * self.centres).sum(1))
        return np.arccos(np.clip(x @ (self.centres / np.maximum(norm, 1e-12)[:, None]).T, -1, 1))

    def angle(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The angle of each vector to the centre of its cell."""
        centres = self.centres[cell]
        norm = np.sqrt((centres * centres).sum(1))
        return np.arccos(np.clip((x * centres).sum(1) / np.maximum(norm, 1e-12), -1, 1))

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.parts(x - self.centres[cell])
        return np.stack([_nearest(r, b)[0] for r, b in zip(rest, self.books, strict=True)], 1).astype(np.uint8)

    def scores(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of vectors with those that have the codes, in a cell."""
        total = (x @ self.centres[cell])[:, None] + np.zeros(len(codes))
        for k, (q, b) in enumerate(zip(self.parts(x), self.books, strict=True)):
            total += (q @ b.T)[:, codes[:, k]]
        return total


def fit(vectors: DataFrame, sample: int = SAMPLE, cells: int | None = None, parts: int = PARTS) -> Cells:
    """Cells of vectors (id, vector): as many as the root of their number, unless given."""
    n = vectors.count()
    held = vectors.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    x, _ = matrix(held.column(0))
    if not len(x):
        return Cells(np.zeros((1, max(1, x.shape[1]))), [np.zeros((1, max(1, x.shape[1])))], [0, max(1, x.shape[1])])
    centres = k_means(x, min(MOST_CELLS, cells or math.ceil(math.sqrt(n))))
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
    made = Cells(centres, [], cuts)
    rest = x - centres[made.cell(x)[:, 0]]
    made.books = [k_means(r, CODES, seed=7 + k) for k, r in enumerate(made.parts(rest))]
    made.probes = probes_for(made, x)
    return made


def probes_for(cells: Cells, x: np.ndarray, k: int = 10, queries: int = 400, reached: float = 0.97) -> int:
    """How many cells a query reads so that they hold this share of the k nearest: by the sample's own neighbours."""
    asked = x[:: max(1, len(x) // queries)][:queries]
    nearest = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    rank = np.argsort(cells.cell(asked, len(cells.centres)), axis=1)  # of each cell, by nearness
    own = cells.cell(x)[:, 0]
    held = np.sort(np.take_along_axis(rank, own[nearest], axis=1).ravel())
    return int(held[min(len(held) - 1, math.ceil(reached * len(held)))]) + 1 if len(held) else 1


def index(vectors: DataFrame, cells: Cells) -> DataFrame:
    """id, cell, angle, code, unit of vectors (id, vector) and their other columns."""
    others = [c for c in vectors.columns if c not in ("id", "vector")]
    told_cells = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        import pyarrow as pa

        cells = told_cells.value
        for batch in batches:
            x, rows = matrix(batch.column(0), cells.size)
            cell = cells.cell(x)[:, 0]
            angle = cells.angle(x, cell)
            codes = cells.codes(x, cell)
            own = batch.take(pa.array(rows))
            made = [pa.array(cell, pa.int32()), pa.array(angle), pa.array([c.tobytes() for c in codes], pa.binary()), _lists(x)]
            yield pa.RecordBatch.from_arrays([*own.columns[1:], *made], names=["id", *others, "cell", "angle", "code", "unit"])

    kinds = (("cell", "int"), ("angle", "double"), ("code", "binary"), ("unit", "array<double>"))
    schema = vectors.select("id", *others, *(F.lit(None).cast(t).alias(n) for n, t in kinds)).schema
    return written(vectors.select("vector", "id", *others).mapInArrow(run, schema), "index")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best scores; ties go to smaller ids (of the columns)."""
    width, order = scores.shape[1], np.argsort(ids, kind="stable")
    scores = scores[:, order]
    bar = np.partition(scores, width - k, axis=1)[:, width - k, None] if width > k else np.full((len(scores), 1), -np.inf)
    above, level = scores > bar, scores == bar
    row, column = np.nonzero(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(1)[:, None])))
    return row, order[column]


def _joined(found: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among what its pieces (row, id, score) found."""
    row, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def _meet(told_cells, k: int, exact: bool):
    """The best of a cell's vectors for its queries: by codes, or by the vectors themselves."""

    def run(key, queries, vectors):
        import pyarrow as pa

        none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return none
        x, own, found = _rows(queries.column("unit")), queries.column("query_id").to_numpy(), []
        for at in _slices(vectors.num_rows, len(x)):
            some = vectors.slice(at.start, at.stop - at.start)
            ids = some.column("id").to_numpy()
            if exact:
                scores = np.round(x @ _rows(some.column("unit")).T, 6)
            else:
                codes = np.stack([np.frombuffer(c, np.uint8) for c in some.column("code").to_pylist()])
                scores = told_cells.value.scores(x, key[0].as_py(), codes)
            scores[own[:, None] == ids] = -np.inf
            row, column = _best(scores, ids, k)
            score = scores[row, column]
            keep = np.isfinite(score)
            found.append((row[keep], ids[column[keep]], score[keep]))
            # what is kept stays small, however many pieces there are
            found = [_joined(found, k)]
        row, ids, score = found[0]
        return pa.table({"query_id": pa.array(own[row]), "id": pa.array(ids), "score": pa.array(score)})

    return run


def _asked(ids: np.ndarray, x: np.ndarray, row: np.ndarray, cell: np.ndarray):
    """query_id, unit, cell of so many pairs of a query's row and a cell, in pieces: each pair has its vector with it."""
    import pyarrow as pa

    for low in range(0, len(row), HANDED):
        some = row[low : low + HANDED]
        columns = [pa.array(ids[some], pa.int64()), _lists(x[some]), pa.array(cell[low : low + HANDED], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "unit", "cell"])


def _scan(spark: SparkSession, asked: DataFrame, found: DataFrame, told_cells, k: int, exact: bool) -> DataFrame:
    """query_id, id, score: the k best of each cell that a query asks (query_id, unit, cell)."""
    sizes = found.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("blocks"))
    calls = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("turns"))
    sizes = F.broadcast(written(sizes.join(calls, "cell"), "cells"))  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = asked.join(sizes, "cell").withColumn("turn", part("query_id", "turns")).withColumn("block", every("blocks")).select("cell", "block", "turn", "query_id", "unit")
    right = found.join(sizes, "cell").withColumn("block", part("id", "blocks")).withColumn("turn", every("turns")).select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("turn").alias("t"), "id", "unit" if exact else "code")
    return left.groupBy("cell", "block", "turn").cogroup(right.groupBy("c", "b", "t")).applyInArrow(_meet(told_cells, k, exact), "query_id long, id long, score double")


def _top(rows: DataFrame, k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def search(queries: DataFrame, indexed: DataFrame, cells: Cells, k: int = 10, probes: int | None = None, candidates: int = 200, exact: bool = False, where: str = "true") -> DataFrame:
    """query_id, rank, id, score: the k nearest of each of queries (query_id, vector), its own id left out.

    indexed: see index; where: a condition on its other columns. Without exact, each query reads the codes of `probes` cells (by default as
    many as held 97% of the neighbours in the sample) and the vectors of its `candidates` best; with it, the result is that of
    comparing with every vector.
    """
    spark = queries.sparkSession
    probes, told_cells = probes or cells.probes, spark.sparkContext.broadcast(cells)
    found = indexed.where(where)

    def nearest(batches):
        for batch in batches:
            x, rows = matrix(batch.column(1), cells.size)
            ids = batch.column(0).to_numpy()[rows]
            for at in _slices(len(x), len(cells.centres)):
                near = told_cells.value.cell(x[at], probes)
                yield from _asked(ids[at], x[at], np.repeat(np.arange(len(near)), near.shape[1]), near.ravel())

    asked = written(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInArrow(nearest, "query_id long, unit array<double>, cell int"), "asked")
    units = asked.groupBy("query_id").agg(F.first("unit").alias("query_unit"))
    by_code = _top(_scan(spark, asked, found.select("id", "cell", "code"), told_cells, candidates, exact=False), candidates).select("query_id", "id")
    dot = F.aggregate(F.zip_with("query_unit", "unit", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    ranked = by_code.join(found.select("id", "unit"), "id").join(units, "query_id").select("query_id", "id", F.round(dot, 6).alias("score"))
    best = _top(ranked, k)
    if exact:
        best = written(best, "best")
        widest = [(r["cell"], r["angle"]) for r in found.groupBy("cell").agg(F.max("angle").alias("angle")).collect()]  # a row for each cell
        told_widest = spark.sparkContext.broadcast(widest)
        # fewer than k found: nothing can be left out
        bars = best.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("bar")).alias("bar"))
        seen = asked.groupBy("query_id").agg(F.first("unit").alias("unit"), F.collect_list("cell").alias("cells"))
        open_ = seen.join(bars, "query_id", "left").select("query_id", "unit", F.coalesce("bar", F.lit(-2.0)).alias("bar"))

        def reachable(batches):
            cell, widest = (np.array(x) for x in zip(*told_widest.value, strict=True)) if told_widest.value else (np.zeros(0, np.int32), np.zeros(0))
            for batch in batches:
                if not batch.num_rows or not len(cell):
                    continue
                ids, x, bar = batch.column(0).to_numpy(), _rows(batch.column(1)), batch.column(2).to_numpy()
                for at in _slices(len(x), len(told_cells.value.centres)):
                    least = np.maximum(0, told_cells.value.angles(x[at])[:, cell] - widest)
                    row, column = np.nonzero(np.cos(least) >= bar[at, None] - 1e-5)
                    yield from _asked(ids[at], x[at], row, cell[column])

        more = written(open_.mapInArrow(reachable, "query_id long, unit array<double>, cell int"), "open")
        best = _top(_scan(spark, more, found.select("id", "cell", "unit"), told_cells, k, exact=True), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _nearest_sql(d: Dialect) -> str:
    return """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, score FROM r WHERE rank <= 10"""


def _embeddings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors, vectors.where("id % 25 = 0").select(F.col("id").alias("query_id"), "vector")


@frame("nearest_vectors", "N1 N2", oracle=_nearest_sql)
def nearest_vectors(spark, sf_dir) -> DataFrame:
    """The ten nearest of many vectors (ids divisible by 25) among all, exactly, through the index."""
    vectors, queries = _embeddings(spark, sf_dir)
    cells = fit(vectors)
    return search(queries, index(vectors, cells), cells, exact=True)


@frame("indexed_vectors", "N1 N2")
def indexed_vectors(spark, sf_dir) -> DataFrame:
    """The ten nearest by the index alone, among the vectors of a label; recall is measured against the exact answer in the tests."""
    vectors, queries = _embeddings(spark, sf_dir)
    cells = fit(vectors)
    return search(queries, index(vectors, cells), cells, where="label = 3")
