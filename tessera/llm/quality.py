"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes (A-Z lower-cased, digits as 0), ORDER of them at a time, so its tables saturate.

1. Every trusted text is counted. Tasks send their distinct n-grams with counts to shards, whose number grows with the texts. A shard
   holds all n-grams whose contexts end in the same two bytes, so that
   counts, contexts and continuation counts of all orders above two meet in one shard.
2. Counts of counts over all shards give each order's three discounts. Each shard joins its counts with
   its contexts' totals to the discounted probabilities; what the discounts freed is the context's
   weight for the next lower order. Orders one and two are tables of 2^16 cells at most.
3. The probabilities stay in their shards; no n-gram is left out, however many there are, and only orders one
   and two are sent to every task. Texts are packed in blocks. A block asks each shard once for its distinct
   n-grams: questions meet the shard's probabilities in one task, one block's questions at a time, and the answers
   meet the block's texts by a second shuffle.
4. Texts fall into two halves by a hash of their text, copies together, and each half is scored by the
   model of the other half's trusted texts, so no text is scored by a model that has seen it.
5. Each text's perplexity is compared with a quantile of the trusted texts' perplexities in its language.

Defined results: a text that is null or empty has no perplexity and isn't kept. A language without
trusted texts, or a null one, has the quantile of all trusted texts; with no trusted text at
all every text that isn't empty is kept and has perplexity 256. Repeated rows are each scored; an empty table gives
no rows. A language with fewer than MIN_TRUSTED trusted texts takes the larger of both quantiles. A text is trusted if any of its labels says quality 1; labels without a document have no effect.
"""

from __future__ import annotations

import bz2
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOLD_ROWS, bounded_batches, hot_limit, materialize, shuffle_partitions, split_batches, text_buffers
from .jaccard import _planes, _unplanes

ORDER = 5
#: Bytes of text for each shard of the model, and shards at least and at most (one for each two bytes that end a context).
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 16_000_000, 64, 65536
#: A block's bytes of text and rows at most (one text at least).
BLOCK_BYTES, BLOCK_ROWS = 6_000_000, 50_000
#: In place of a level: a question.
QUESTION = ORDER + 1
#: Answers are logarithms as whole numbers of four bytes, in parts of this.
FIXED = 2.0**26
QUANTILE, SLACK = 0.995, 1.5
MIN_TRUSTED = 50
#: Ids of trusted texts that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_U = np.uint64


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The five bytes that end at each place, newlines before a text's start."""
    folded = _FOLD[data].astype(np.uint64)
    key = folded.copy()
    n = len(data)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    for back in range(1, ORDER):
        before = np.full(n, 10, np.uint64)
        before[back:] = folded[: max(0, n - back)]
        before[place < back] = 10
        key |= before << _U(8 * back)
    return key


def shards_for(size: int) -> int:
    """Shards of a model of so many bytes of text: as the text grows there are more of them, of about a size."""
    return min(MOST_SHARDS, max(LEAST_SHARDS, 1 << max(0, size // SHARD_BYTES).bit_length()))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes of the context."""
    return ((key >> _U(8)) & _U(0xFFFF)).astype(np.int64) * 40503 % 65536 * shards // 65536


def _cut(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by shard, and where each shard's begin (n + 1)."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))


def _count(shards: int):
    def run(batches):
        import pyarrow as pa

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            order, cut = _cut(_shard(keys, shards), shards)
            found = [(s, order[cut[s] : cut[s + 1]]) for s in np.flatnonzero(np.diff(cut)).tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.int32()), pa.array([_planes(keys[i], ORDER) for _, i in found], pa.binary()), pa.array([counts[i].astype("<u4").tobytes() for _, i in found], pa.binary())],
                names=["shard", "keys", "counts"],
            )

        for batch in split_batches(batches, 1_000_000):
            new, n = np.unique(_grams(*text_buffers(batch.column(0))), return_counts=True)
            keys, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1_000_000:
                yield rows()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield rows()

    return run


def _merge(key, table):
    """A shard's n-grams, each once."""
    import pyarrow as pa

    keys = np.concatenate([_unplanes(x, ORDER) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
    keys, which = np.unique(keys, return_inverse=True)
    counts = np.bincount(which, weights=counts).astype("<i8")
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([_planes(keys, ORDER)], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _lower(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of the highest order, and continuation counts of those below down to three (and two, of this shard's contexts)."""
    out = {ORDER: (keys, counts)}
    for order in range(ORDER - 1, 1, -1):
        keys, counts = np.unique(keys & _U((1 << 8 * order) - 1), return_counts=True)
        out[order] = (keys, counts)
    return out


def _of_counts(batches):
    """How many n-grams of each order have each count (to 63), as kind 0, order * 64 + count; the bigrams' continuation counts, as kind 1, bigram."""
    import pyarrow as pa

    for batch in batches:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            levels = _lower(_unplanes(keys, ORDER), np.frombuffer(counts, "<i8"))
            found = [(0, 64 * order + np.arange(64), np.bincount(np.minimum(levels[order][1], 63), minlength=64)) for order in range(3, ORDER + 1)]
            for kind, at, n in (*found, (1, levels[2][0].astype(np.int64), levels[2][1])):
                for column, value in zip(out, (np.full(len(at), kind), at, n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["kind", "at", "n"])


def discounts(n: np.ndarray) -> np.ndarray:
    """Discount of counts 0, 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *[min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]])


def _level(keys: np.ndarray, counts: np.ndarray, d: np.ndarray):
    """N-grams with their discounted probabilities, contexts with their weights for the lower order."""
    context = keys >> _U(8)
    heads, which = np.unique(context, return_inverse=True)
    total = np.bincount(which, weights=counts)
    prob = (counts - d[np.minimum(counts, 3)]) / total[which]
    weight = 1 - np.bincount(which, weights=prob, minlength=len(heads))
    return keys, prob.astype("<f4"), heads, weight.astype("<f4")


def _probabilities(d: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = _lower(_unplanes(keys, ORDER), np.frombuffer(counts, "<i8"))
                for order in range(3, ORDER + 1):
                    rows.append((shard, order, *[x.tobytes() for x in _level(*levels[order], d[order])]))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "level", "keys", "prob", "heads", "weight"])

    return run


class Model:
    def __init__(self, bigrams: np.ndarray, rows: list):
        """bigrams: continuation counts, 256 by 256. rows: level, keys, prob, heads, weight of each shard."""
        total = bigrams.sum()
        single = (bigrams > 0).sum(axis=0).astype(np.float64)
        base = (single + 0.5) / (single.sum() + 128)
        kinds = np.bincount(np.minimum(bigrams.ravel(), 63), minlength=64)
        d = discounts(kinds)
        of = bigrams.sum(axis=1)
        part = np.where(bigrams > 0, (bigrams - d[np.minimum(bigrams, 3)]) / np.maximum(of, 1)[:, None], 0)
        self.two = part + (1 - part.sum(axis=1))[:, None] * base[None, :] if total else np.full((256, 256), 1 / 256)
        self.levels = {}
        for order in range(3, ORDER + 1):
            mine = [r for r in rows if r[0] == order]
            keys, heads = (np.concatenate([np.frombuffer(r[i], "<u8") for r in mine]) if mine else np.zeros(0, np.uint64) for i in (1, 3))
            prob, weight = (np.concatenate([np.frombuffer(r[i], "<f4") for r in mine]) if mine else np.zeros(0, np.float32) for i in (2, 4))
            a, b = np.argsort(keys), np.argsort(heads)
            self.levels[order] = keys[a], prob[a], heads[b], weight[b]

    @staticmethod
    def _get(keys, values, wanted, default):
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        p = self.two[((grams >> _U(8)) & _U(255)).astype(np.int64), (grams & _U(255)).astype(np.int64)]
        for order in range(3, ORDER + 1):
            keys, prob, heads, weight = self.levels[order]
            part = grams & _U((1 << 8 * order) - 1)
            p = self._get(keys, prob, part, 0.0) + self._get(heads, weight, part >> _U(8), 1.0) * p
        return np.log(p)


def shares(trusted: DataFrame, text: str = "text", name: str = "counts", shards: int = LEAST_SHARDS) -> tuple[np.ndarray, DataFrame]:
    """The bigrams' continuation counts, and each shard's probabilities of the higher orders, of all texts of trusted."""
    schema = "shard int, keys binary, counts binary"
    texts = trusted.where(F.length(text) > 0).select(F.col(text).alias("text"))
    merged = materialize(texts.mapInArrow(_count(shards), schema).groupBy("shard").applyInArrow(_merge, schema), name)
    # a row for each order and count, and for each bigram: 66,000 at most
    found = merged.mapInArrow(_of_counts, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    hist, bigrams = np.zeros((ORDER + 1, 64), np.int64), np.zeros((256, 256), np.int64)
    for r in found:
        (bigrams if r["kind"] else hist).ravel()[r["at"]] = r["n"]
    d = np.array([discounts(h) if i > 2 else np.zeros(4) for i, h in enumerate(hist)])
    return bigrams, merged.mapInArrow(_probabilities(d), "shard int, level int, keys binary, prob binary, heads binary, weight binary")


def _asked(data: np.ndarray, off: np.ndarray, halves: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, with its text's half above; the distinct ones; their order by half and shard; where each shard's start."""
    grams = _grams(data, off) | (np.repeat(halves.astype(np.uint64), np.diff(off)) << _U(8 * ORDER))
    distinct = np.sort(grams)
    distinct = distinct[np.flatnonzero(np.diff(distinct, prepend=distinct[:1] + _U(1)))]
    shard = _shard(distinct, shards) + shards * (distinct >> _U(8 * ORDER)).astype(np.int64)
    return grams, distinct, *_cut(shard, 2 * shards)


def _blocks(make):
    """Rows packed in blocks, in the order in which they come: make(block, batch) gives each block's record batch."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block, held, size, rows = TaskContext.get().partitionId() << 24, [], 0, 0
        whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for batch in split_batches(batches, BLOCK_BYTES, batches_text):
            more = int(text_buffers(batch.column(batch.num_columns - 1))[1][-1])
            if held and (size + more > BLOCK_BYTES or rows + batch.num_rows > BLOCK_ROWS):
                yield make(block, whole())
                block, held, size, rows = block + 1, [], 0, 0
            held.append(batch)
            size, rows = size + more, rows + batch.num_rows
        if held:
            yield make(block, whole())

    batches_text = make.text
    return run


class _Texts:
    """Blocks as their texts, and their other columns with the texts' lengths last."""

    def __init__(self, text: str):
        self.text = text

    def __call__(self, block: int, batch):
        import pyarrow as pa

        data, off = text_buffers(batch.column(batch.num_columns - 1))
        rest = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(off))], names=batch.schema.names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rest)
        columns = [pa.array([block], pa.int64()), pa.array([bz2.compress(_FOLD[data].tobytes())], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "texts", "rest"])


class _Questions:
    """What each block asks of each shard, with a check of all that it asks."""

    def __init__(self, text: str, half: str, shards: int):
        self.text, self.half, self.shards = text, half, shards

    def __call__(self, block: int, batch):
        import pyarrow as pa

        data, off = text_buffers(batch.column(batch.num_columns - 1))
        halves = batch.column(batch.schema.get_field_index(self.half)).to_numpy().astype(np.int64)
        _, distinct, order, cut = _asked(data, off, halves, self.shards)
        some = np.flatnonzero(np.diff(cut)).tolist()
        keys = [_planes(distinct[order[cut[k] : cut[k + 1]]], ORDER) for k in some]
        columns = [pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(keys, pa.binary()), pa.array([_check(distinct)] * len(some), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "shard", "keys", "check"])


def _check(distinct: np.ndarray) -> int:
    return zlib.crc32(distinct.tobytes())


def _opened(texts: bytes, rest: bytes, half: str, shards: int):
    """A block's other columns, lengths and offsets of its texts, and what it asks (see _asked)."""
    import pyarrow as pa

    rows = pa.ipc.open_stream(rest).read_next_batch()
    n = rows.column(rows.num_columns - 1).to_numpy()
    off = np.concatenate([[0], np.cumsum(n)])
    halves = rows.column(rows.schema.get_field_index(half)).to_numpy().astype(np.int64)
    return rows, n, off, _asked(np.frombuffer(bz2.decompress(texts), np.uint8), off, halves, shards)


def _answers(bigrams, shards: int):
    """Of each shard the probabilities come first; then its questions, whose logarithms are returned."""

    def run(batches):
        import pyarrow as pa

        now, held, model = None, [], None
        for batch in batches:
            out = []
            for shard, level, block, check, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    now, held, model = shard, [], None
                if level < QUESTION:
                    held.append((level, *row))
                    continue
                model = model or Model(bigrams.value[shard // shards], held)
                held = []
                logs = np.maximum(-model.log_prob(_unplanes(row[0], ORDER)), 0) * FIXED
                out.append((block, shard, check, np.rint(np.minimum(logs, 2.0**32 - 1)).astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "shard", "check", "answer"])

    return run


def _scores(names: list[str], half: str, shards: int):
    """A block's texts with the answers to what it asks."""

    def run(key, answers, blocks):
        import pyarrow as pa

        texts, rest = (blocks.column(c).to_pylist()[0] for c in ("texts", "rest"))
        rows, n, off, (grams, distinct, order, _) = _opened(texts, rest, half, shards)
        answers = answers.sort_by("shard")
        found = np.concatenate([np.zeros(0), *[np.frombuffer(x, "<u4") / -FIXED for x in answers.column("answer").to_pylist()]])
        if len(found) != len(distinct) or {*answers.column("check").to_pylist()} - {_check(distinct)}:
            raise RuntimeError(f"block {key[0]}: {len(found)} answers to {len(distinct)} questions, or to others: the rows came in another order when they were read again; write them to a table first")
        logs = np.zeros(len(distinct))
        logs[order] = found
        value, some = np.full(len(n), np.nan), n > 0
        if some.any():
            value[some] = np.exp(-np.add.reduceat(logs[np.searchsorted(distinct, grams)], off[:-1][some]) / n[some])
        return pa.Table.from_arrays([*rows.columns[:-1], pa.array(value, pa.float64(), mask=~some)], names=names)

    return run


def perplexity(df: DataFrame, models: list[tuple[np.ndarray, DataFrame]], half: str = "half", text: str = "text", shards: int = LEAST_SHARDS) -> DataFrame:
    """df without its text, plus perplexity under the model (see shares; of so many shards) that its half (0 or 1) names.

    df is read twice, for what its blocks ask and for their texts, and must give its rows in one order, as written tables do; else an
    error is raised.
    """
    from pyspark.sql import types as T

    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    fields = [f for f in df.schema.fields if f.name != text]
    rows_of = df.select(*[f.name for f in fields], text)
    packed = rows_of.mapInArrow(_blocks(_Texts(text)), "block long, texts binary, rest binary")
    met = rows_of.mapInArrow(_blocks(_Questions(text, half, shards)), "block long, shard int, keys binary, check long").withColumn("level", F.lit(QUESTION))
    for k, (_, rows) in enumerate(models):
        met = met.unionByName(rows.withColumn("shard", F.col("shard") + k * shards), allowMissingColumns=True)
    met = met.select("shard", "level", "block", "check", "keys", "prob", "heads", "weight").repartition(parts, "shard").sortWithinPartitions("shard", "level")
    answers = met.mapInArrow(_answers(spark.sparkContext.broadcast([b for b, _ in models]), shards), "block long, shard int, check long, answer binary")
    scores = _scores([*[f.name for f in fields], "perplexity"], half, shards)
    # cogrouped, not united: a block's number holds its partition's, which a union would shift
    return answers.groupBy("block").cogroup(packed.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(scores, T.StructType([*fields, T.StructField("perplexity", T.DoubleType())]))


def by_key(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the values of their key, null without one. Languages are few, and are told to all tasks; of many keys those that
    rows hold often are, so that no task takes all rows of one."""
    if values.count() <= TOLD_ROWS:
        return rows.join(F.broadcast(values), key, "left")
    often = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times")).where(F.col("times") > hot_limit(rows.sparkSession, rows.count()))
    often = F.broadcast(often.select(key).join(values, key, "left"))
    known = rows.where(F.col(key).isNotNull())
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema.fields if f.name != key])
    return known.join(often, key).unionByName(known.join(often, key, "left_anti").join(values, key, "left")).unionByName(none)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, shards: int | None = None) -> DataFrame:
    """doc_id, lang, trusted, perplexity, threshold, kept; one row for each row of docs (doc_id, text, lang). shards: of the model; by default as many as the texts' size asks for."""
    bounded_batches(docs.sparkSession)
    good = materialize(labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct(), "trusted")
    marked = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    rows = docs.select("doc_id", "lang", "text").join(marked, F.col("doc_id") == F.col("good_id"), "left")
    rows = rows.select("doc_id", "lang", F.col("good_id").isNotNull().alias("trusted"), "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"))
    if good.count() > BROADCAST_IDS:
        rows = materialize(rows, "marked")  # a shuffle gives no order twice
    shards = shards or shards_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    models = [shares(rows.where((F.col("trusted")) & (F.col("half") == 1 - k)), name=f"counts-{k}", shards=shards) for k in (0, 1)]
    scored = materialize(perplexity(rows, models, shards=shards), "scored")
    seen = scored.where("trusted and perplexity is not null")
    by_lang = seen.where("lang is not null").groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("own"), F.count("*").alias("n"))
    by_lang = materialize(by_lang, "by-language")
    overall = seen.agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("general"))
    out = by_key(scored, by_lang, "lang").crossJoin(F.broadcast(overall))  # one row
    threshold = F.when(F.col("n") < MIN_TRUSTED, F.greatest("own", "general")).otherwise(F.coalesce("own", "general"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "trusted", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
