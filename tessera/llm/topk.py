"""Exact top-k by integer inner product, with a three-phase uniform threshold.

The components of the vectors are dealt to m slices, as if each were a node of its own: a slice holds its part of all vectors,
in chunks of rows, and knows local scores only. A candidate's score is the sum of its m local scores.

1. Each slice sends, for each query, the k best entries of its local list. The full scores of these few are
   worked out; the k-th best of them is a safe lower bound of the k-th best of all.
2. The bound divided by m is broadcast as the cutoff: a row whose local scores all lie below it has a
   full score below the bound. So each slice sends the entries at or above the cutoff, which suffice.
3. A chunk's entries from all slices meet with its rows. Where a row's other parts are unknown and could, by the lengths of the
   vectors, still reach the bound, the remaining scores are worked out for that entry alone; the k best of each chunk are merged.

Queries are taken in blocks of a bounded size, all in the same jobs as long as their vectors can be broadcast
(QUERY_BYTES), so neither the broadcast nor a task's matrix of local scores grows with the input. Scores are exact: products are
formed in float64 while they stay below 2^53 and in Python integers beyond that.

Defined results: vectors that are null, empty, of another length than the rest or that hold null or
non-finite components take no part, nor do rows with a null id. Of repeated query ids the
smallest vector is asked; repeated candidate rows each count. A row with the query's own id is never
its answer. Ties go to the smaller id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shuffle_partitions

#: Bytes of query vectors of one round of jobs, which are broadcast.
QUERY_BYTES = 64_000_000
#: Rows of a chunk, and cells of a matrix of local scores held at once.
CHUNK_ROWS = 4096
CELLS = 2_000_000
#: In place of a slice's number: a chunk's ids.
IDS = -1


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    return F.when(ok, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def _exact(a: np.ndarray, b: np.ndarray):
    """a and b as numbers whose inner products are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if top < 2**53 else object
    return a.astype(kind), b.astype(kind)


def _dots(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by queries."""
    a, b = _exact(rows, queries)
    return a @ b.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a column, ties to the smaller id, best first."""
    near = np.arange(len(score))
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return near[np.lexsort((ids[near], -score[near]))][:k]


def _packed(x: np.ndarray) -> bytes:
    """A matrix of whole numbers in the smallest of three widths, which comes first."""
    for code, kind in enumerate(("<i2", "<i4", "<i8")):
        if kind == "<i8" or not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([code]) + x.astype(kind).tobytes()
    return b""


def _unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, ("<i2", "<i4", "<i8")[raw[0]], offset=1).astype(np.int64).reshape(rows, -1)


def _chunks(cuts: list[tuple[int, int]]):
    """Vectors to chunks: their ids, and each slice's part of them."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                data = [part.column(0).to_numpy().astype("<i8").tobytes(), *[_packed(v[:, a:b]) for a, b in cuts]]
                n = len(data)
                columns = [pa.array([chunk] * n, pa.int64()), pa.array([IDS, *range(n - 1)], pa.int32()), pa.array([part.num_rows] * n, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "slice", "rows", "data"])
                chunk += 1

    return run


def _blocks(n_queries: int, rows: int):
    step = max(1, CELLS // max(1, rows))
    return [(at, min(n_queries, at + step)) for at in range(0, n_queries, step)]


def _local_lists(asked, cuts, k: int):
    """slice, query, chunk, row, score: the k + 1 best local scores of each query in each slice's chunks of one task (one may be the query itself)."""

    def run(batches):
        import pyarrow as pa

        _, qs = asked.value
        best: dict = {}
        for batch in batches:
            for chunk, s, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, (a, b) = _unpacked(data, n), cuts[s]
                held_s, held_c, held_r = best.get(s) or (np.zeros((len(qs), 0)), np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0), np.int64))
                new_s, new_c, new_r = [], [], []
                for lo, hi in _blocks(len(qs), n):
                    local = _dots(qs[lo:hi, a:b], v)
                    top = np.argpartition(-local, min(k, n - 1), axis=1)[:, : k + 1] if n > k + 1 else np.tile(np.arange(n), (hi - lo, 1))
                    score = np.concatenate([held_s[lo:hi], np.take_along_axis(local, top, 1)], axis=1)
                    row, at = np.concatenate([held_r[lo:hi], top], axis=1), np.concatenate([held_c[lo:hi], np.full(top.shape, chunk)], axis=1)
                    keep = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    for out, x in zip((new_s, new_c, new_r), (score, at, row), strict=True):
                        out.append(np.take_along_axis(x, keep, 1))
                best[s] = tuple(np.concatenate(x) for x in (new_s, new_c, new_r))
        for s, (score, chunk, row) in best.items():
            of = np.repeat(np.arange(len(qs)), score.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(of), s), pa.int32()), pa.array(of, pa.int64()), pa.array(chunk.ravel()), pa.array(row.ravel().astype(np.int64)), pa.array(score.ravel().astype(np.float64), pa.float64())],
                names=["slice", "query", "chunk", "row", "score"],
            )

    return run


def _entries(asked, cuts, cutoff):
    """chunk, slice, data: the entries (query, row, local score) at or above the cutoff of one slice's chunk."""

    def run(batches):
        import pyarrow as pa

        (_, qs), low = asked.value, cutoff.value[0]
        for batch in batches:
            for chunk, s, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, (a, b) = _unpacked(data, n), cuts[s]
                found = []
                for lo, hi in _blocks(len(qs), n):
                    local = _dots(qs[lo:hi, a:b], v)
                    of, row = np.nonzero(local >= low[lo:hi, None])
                    found.append((of + lo, row, local[of, row].astype(np.int64)))
                of, row, score = (np.concatenate([f[i] for f in found]) for i in range(3))
                if len(of):
                    raw = of.astype("<u4").tobytes() + row.astype("<u2").tobytes() + score.astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([s], pa.int32()), pa.array([len(of)], pa.int32()), pa.array([raw], pa.binary())], names=["chunk", "slice", "rows", "data"])

    return run


def _resolved(asked, cuts, cutoff, k: int, resolved: Accumulator | None):
    """A chunk's rows and entries: full scores where the entries alone don't give them; query_id, vec_id, score of the k best."""

    def run(key, entries, rows):
        import pyarrow as pa

        (ids_q, qs), (_, bound) = asked.value, cutoff.value
        slices, data, sizes = rows.column("slice").to_pylist(), rows.column("data").to_pylist(), rows.column("rows").to_pylist()
        n, m = sizes[0], len(cuts)
        ids = np.frombuffer(data[slices.index(IDS)], "<i8")
        parts = {s: _unpacked(x, n) for s, x in zip(slices, data, strict=True) if s != IDS}
        place, of_slice, local = [], [], []
        for s, count, raw in zip(entries.column("slice").to_pylist(), entries.column("rows").to_pylist(), entries.column("data").to_pylist(), strict=True):
            q, r = np.frombuffer(raw, "<u4", count).astype(np.int64), np.frombuffer(raw, "<u2", count, 4 * count).astype(np.int64)
            place.append(q * n + r)
            of_slice.append(np.full(count, s))
            local.append(np.frombuffer(raw, "<i8", count, 6 * count))
        place, of_slice, local = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (place, of_slice, local))
        pairs, at = np.unique(place, return_inverse=True)
        q, r = pairs // n, pairs % n
        other = ids[r] != ids_q[q]
        known = np.zeros((len(pairs), m), bool)
        known[at, of_slice] = True
        score = np.zeros((len(pairs), m), np.int64)
        score[at, of_slice] = local
        # what the unknown parts can add at most, by the lengths of the vectors; a little more for rounding
        most = score.sum(axis=1).astype(np.float64)
        for s, (a, b) in enumerate(cuts):
            lengths = np.sqrt((qs[:, a:b].astype(np.float64) ** 2).sum(axis=1)), np.sqrt((parts[s].astype(np.float64) ** 2).sum(axis=1))
            most += np.where(known[:, s], 0, lengths[0][q] * lengths[1][r] * (1 + 1e-9) + 1)
        keep = np.flatnonzero(other & (most >= bound[q]))
        q, r, known, score = q[keep], r[keep], known[keep], score[keep]
        for s, (a, b) in enumerate(cuts):
            for lo in range(0, len(q), 100_000):
                ask = lo + np.flatnonzero(~known[lo : lo + 100_000, s])
                x, y = _exact(parts[s][r[ask]], qs[q[ask], a:b])
                score[ask, s] = (x * y).sum(axis=1).astype(np.int64)
        if resolved is not None:
            resolved.add(int((~known.all(axis=1)).sum()))
        total = score.sum(axis=1)
        order = np.lexsort((ids[r], -total, q))
        q, r, total = q[order], r[order], total[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        best = rank < k
        return pa.table({"query_id": pa.array(ids_q[q[best]], pa.int64()), "vec_id": pa.array(ids[r[best]], pa.int64()), "score": pa.array(total[best], pa.int64())})

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), *(c for c in ("vec_id", "chunk", "row") if c in found.columns))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answers(chunks: DataFrame, asked, cuts, k: int, resolved: Accumulator | None) -> DataFrame:
    """query_id, vec_id, score of the k best of each query in each chunk."""
    sc, n = chunks.sparkSession.sparkContext, len(asked.value[0])
    m, parts = len(cuts), chunks.where(F.col("slice") != IDS)
    entry = "chunk long, slice int, rows int, data binary"
    whole = chunks.groupBy("chunk")

    # 1. local lists; their entries' full scores; the bound
    lists = parts.mapInArrow(_local_lists(asked, cuts, k), "slice int, query long, chunk long, row long, score double")
    seen = materialize(_ranked(lists, k + 1, "slice", "query").groupBy("chunk").agg(F.collect_set(F.struct("query", "row")).alias("pairs")), "seen")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q, r = np.array([p["query"] for p in pairs]), np.array([p["row"] for p in pairs])
                raw = q.astype("<u4").tobytes() + r.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([IDS], pa.int32()), pa.array([len(q)], pa.int32()), pa.array([raw], pa.binary())], names=["chunk", "slice", "rows", "data"])

    first = seen.mapInArrow(pack, entry).groupBy("chunk").cogroup(whole).applyInArrow(_whole_scores(asked, cuts), "query long, vec_id long, score long")
    kth = _ranked(first, k, "query").where(F.col("rank") == k).select("query", "score").toPandas()  # a number for each query of the round
    bound = np.full(n, -np.inf)
    bound[kth["query"]] = np.nextafter(kth["score"].to_numpy(np.float64), -np.inf)  # not above the score itself
    # 2. and 3. a query with fewer than k candidates has no bound: all rows are collected
    cutoff = sc.broadcast((np.floor(bound / m), bound))
    entries = parts.mapInArrow(_entries(asked, cuts, cutoff), entry)
    return entries.groupBy("chunk").cogroup(whole).applyInArrow(_resolved(asked, cuts, cutoff, k, resolved), "query_id long, vec_id long, score long")


def _whole_scores(asked, cuts):
    """query, vec_id, score of the listed pairs of a chunk, all parts worked out."""

    def run(key, listed, rows):
        import pyarrow as pa

        ids_q, qs = asked.value
        slices, data, n = rows.column("slice").to_pylist(), rows.column("data").to_pylist(), rows.column("rows").to_pylist()[0]
        ids = np.frombuffer(data[slices.index(IDS)], "<i8")
        q, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for count, raw in zip(listed.column("rows").to_pylist(), listed.column("data").to_pylist(), strict=True):
            q, r = np.r_[q, np.frombuffer(raw, "<u4", count)], np.r_[r, np.frombuffer(raw, "<u2", count, 4 * count)]
        q, r = q.astype(np.int64), r.astype(np.int64)
        total = np.zeros(len(q), np.int64)
        for s, raw in zip(slices, data, strict=True):
            if s != IDS:
                x, y = _exact(_unpacked(raw, n)[r], qs[q, cuts[s][0] : cuts[s][1]])
                total += (x * y).sum(axis=1).astype(np.int64)
        other = ids[r] != ids_q[q]
        return pa.table({"query": pa.array(q[other], pa.int64()), "vec_id": pa.array(ids[r[other]], pa.int64()), "score": pa.array(total[other], pa.int64())})

    return run


def top_k(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5, slices: int = 2, scale: int = 256, resolved: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. resolved, if given, counts the entries whose remaining scores were worked out."""
    spark = df.sparkSession
    bounded_batches(spark)
    given = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("given"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = given.select("id", quantize(F.col("given"), scale).alias("v"), "q").where("id is not null and v is not null")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = length["d"]
    rows = rows.where(F.size("v") == d)
    edges = np.linspace(0, d, max(1, min(slices, d)) + 1).astype(int).tolist()
    cuts = list(zip(edges, edges[1:], strict=False))
    chunks = rows.select("id", "v").mapInArrow(_chunks(cuts), "chunk long, slice int, rows int, data binary")
    chunks = materialize(chunks.repartition(shuffle_partitions(spark), "slice", "chunk"), "chunks")
    queries = materialize(rows.where("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    rounds = max(1, -(-queries.count() * d * 8 // QUERY_BYTES))
    out = None
    for i in range(rounds):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i).orderBy("id").toPandas()  # about QUERY_BYTES
        if own.empty:
            continue
        ids = own["id"].to_numpy(np.int64)
        asked = spark.sparkContext.broadcast((ids, np.array(own["v"].tolist(), np.int64)))
        found = _ranked(_answers(chunks, asked, cuts, k, resolved), k, "query_id").select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
