"""N-gram Jaccard join by a token-group matrix.

Two texts are linked when the Jaccard similarity of their sets of word shingles reaches a threshold.
The result gives each document its class, the smallest id reachable by links.

1. Bound against everything else. A text with a link of similarity t shares at least t of its
   shingles with another text. Each task sends the shingle hashes of its texts, packed and dealt by hash
   to owner tasks, which answer which of them occur in more than one text. Only texts whose
   share of such shingles reaches t go on; no other text can have a link.
2. Groups. Texts with equal sets are one class and go on as one representative. Of each
   representative the rarest shingles by a sketch of their numbers (as many as a link can't do without) tie it to a neighbourhood;
   linked texts always fall into the same one, as they share one of these shingles.
3. Token-group matrix. Texts of a neighbourhood are dealt to blocks. A
   task partitions the texts of a block into groups of similar ones, stores each
   group's token union as a row of a bit matrix and bounds each query's overlap with each group by one matrix
   product. Only groups that reach the query's least overlap are opened: the exact overlap with each
   member decides. A task returns links enough to connect what it linked, not all of them.
4. Neighbourhoods of many blocks (see neighbour_links): blocks first, then the most linked text of each block's
   classes, then the pairs of blocks that still hold different classes.
5. The links' connected components, found by joins, are the classes.

A word is known by its BLAKE2b digest of 128 bits, a shingle by two 64-bit chains over its words' digests, a set by the
BLAKE2b digest of its shingles. Shingles are equal when both their chains are; the first alone may only lead to more
texts being compared. Comparisons are of whole sets; nothing is capped or sampled.

Hot shingles: a task sends each distinct shingle once, however many of its texts hold it.

Defined results: A-Z is lower-cased and words are split at [\\x20\\x09-\\x0D]. A text with fewer words than
the width has its whole word sequence as its one shingle; a text without words (null or empty
too) has an empty set and is linked with nothing, so its class is its own id. Repeated rows and rows that share an id
are one node of the graph. A row with a null id links nothing; its class is that of an equal set, or null. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_groups, materialize, shuffle_partitions, split_batches, temporary, text_buffers, told
from .components import components
from .shingles import WordDigests, shingle_sets

#: Bits of a shingle's hash that the first bound compares: so many more than the number of shingles takes, and at most as many as BOUND_BYTES
#: hold. Equal bits of unequal shingles only let more texts go on; of all shingles about one in 2^SPARE_BITS meets another so.
SPARE_BITS, BOUND_BYTES = 6, 5
#: Cells of the sketch of how many texts hold a shingle, a byte each; it orders shingles only, so any size gives right results.
SKETCH_BITS, SKETCH_PARTS = 24, 64
#: Shingles that a task packs together.
CHUNK_TOKENS = 1_000_000
CHUNK_DOCS = 60_000
#: Texts and shingles of a block, and texts of a group of the matrix.
BLOCK_DOCS = 1000
BLOCK_TOKENS = 2_000_000
GROUP_DOCS = 32
#: Rows of three numbers that may be broadcast.
BROADCAST_ROWS = 500_000
#: Columns of a bit matrix held at once.
COLUMNS = 8192

_PACKED = "bucket int, chunk long, kind int, a binary, b binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, byte by byte: the high bytes of sorted numbers then compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    cells = np.frombuffer(raw, np.uint8).reshape(width, -1)
    wide = np.zeros((cells.shape[1], 8), np.uint8)
    wide[:, :width] = cells.T
    return wide.view("<u8").ravel()


def _squeezed(raw: bytes) -> bytes:
    """raw in few bytes, its length first: the shuffle's own compression finds repeats only, not numbers that are small."""
    import pyarrow as pa

    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(raw: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(raw[4:], decompressed_size=int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True)


def _fingerprints(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BLAKE2b digest of each set's shingles in their order, as two numbers."""
    raw = b"".join(blake2b(one[i:j].tobytes() + two[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    cells = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return cells[:, 0], cells[:, 1]


def _pack(width: int, n_buckets: int, bits: int):
    """Texts to packed rows: kind 0, a chunk's documents; kind 1, its distinct shingles of one bucket."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 24, 0
        held: list = []
        words = WordDigests()

        def flush():
            nonlocal seq, held
            ids = np.concatenate([h[0] for h in held])
            known = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            fp = [np.concatenate([h[k] for h in held]) for k in (3, 4)]
            tokens = np.concatenate([h[5] for h in held]) >> np.uint64(64 - bits)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, doc = tokens[order], doc[order]
            new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            count = np.diff(np.r_[start, len(tokens)])
            several = count > 1
            local = np.bincount(doc[np.repeat(several, count)], minlength=len(sizes)) if len(tokens) else np.zeros(len(sizes), np.int64)
            distinct, owner = tokens[start], np.where(several, 0xFFFF, doc[start])
            chunk = base + seq
            seq += 1
            kinds, buckets = [0], [int(chunk % n_buckets)]
            a = [b"".join(x.astype("<i8").tobytes() for x in (ids, sizes, local, *fp))]
            b = [known.astype(np.uint8).tobytes()]
            edges = np.searchsorted(distinct, (np.arange(1, n_buckets) * (1 << bits)) // n_buckets)
            for k, (t, o) in enumerate(zip(np.split(distinct, edges), np.split(owner, edges), strict=True)):
                if len(t):
                    kinds.append(1)
                    buckets.append(k)
                    a.append(_squeezed(_planes(np.diff(t, prepend=np.uint64(0)), BOUND_BYTES)))  # in order: steps are small
                    b.append(_squeezed(_planes(o.astype(np.uint64), 2)))
            held = []
            columns = [pa.array(buckets, pa.int32()), pa.array([chunk] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "kind", "a", "b"])

        n_tokens = n_docs = 0
        for batch in split_batches(batches, 1_000_000):
            data, off = text_buffers(batch.column(1))
            tokens, more, at = shingle_sets(data, off, width, words)
            ids = batch.column(0)
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.diff(at), *_fingerprints(tokens, more, at), tokens))
            n_tokens, n_docs = n_tokens + len(tokens), n_docs + batch.num_rows
            if n_tokens > CHUNK_TOKENS or n_docs > CHUNK_DOCS - 5000:
                yield flush()
                n_tokens = n_docs = 0
        if held:
            yield flush()

    return run


def _owner(key, table):
    """Which of a bucket's shingles occur in several texts; documents' rows pass through."""
    import pyarrow as pa

    kinds = table.column("kind").to_numpy()
    chunks = table.column("chunk").to_numpy()
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    out = [(int(chunks[i]), 0, a[i], b[i]) for i in np.flatnonzero(kinds == 0)]
    rows = np.flatnonzero(kinds == 1)
    if len(rows):
        parts = [np.cumsum(_unplanes(_spread(a[i]), BOUND_BYTES), dtype=np.uint64) for i in rows]
        owners = np.concatenate([_unplanes(_spread(b[i]), 2) for i in rows])
        sizes = np.array([len(p) for p in parts])
        tokens = np.concatenate(parts)
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        again = np.r_[False, t[1:] == t[:-1]]
        again[:-1] |= again[1:]
        hit = np.zeros(len(tokens), bool)
        hit[order] = again
        for i, lo, hi in zip(rows, np.r_[0, np.cumsum(sizes)[:-1]], np.cumsum(sizes), strict=True):
            own = owners[lo:hi][hit[lo:hi]]
            own = own[own != 0xFFFF]
            if len(own):
                out.append((int(chunks[i]), 1, own.astype("<u2").tobytes(), b""))
    columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.Table.from_arrays(columns, names=["chunk", "kind", "a", "b"])


def _signatures(key, table):
    """A chunk's answers added up: for each text its size, shingles found elsewhere, and fingerprint."""
    import pyarrow as pa

    a, kinds = table.column("a").to_pylist(), table.column("kind").to_pylist()
    at = kinds.index(0)
    ids, sizes, local, fp1, fp2 = np.frombuffer(a[at], "<i8").reshape(5, -1)
    known = np.frombuffer(table.column("b").to_pylist()[at], np.uint8).astype(bool)
    found = [np.frombuffer(x, "<u2") for x, k in zip(a, kinds, strict=True) if k == 1]
    shared = local + (np.bincount(np.concatenate(found), minlength=len(ids)) if found else 0)
    columns = [pa.array(ids, pa.int64(), mask=~known), *[pa.array(x, pa.int64()) for x in (sizes, shared, fp1, fp2)]]
    return pa.Table.from_arrays(columns, names=["doc_id", "n", "shared", "fp1", "fp2"])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, shared, fp1, fp2 of each row of docs (doc_id, text)."""
    n_buckets = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(8 * BOUND_BYTES, max(24, (size // 6).bit_length() + SPARE_BITS))  # a word takes some six bytes
    packed = docs.select("doc_id", "text").mapInArrow(_pack(width, n_buckets, bits), _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(_owner, "chunk long, kind int, a binary, b binary")
    return answers.groupBy("chunk").applyInArrow(_signatures, "doc_id long, n long, shared long, fp1 long, fp2 long")


def _least(n, percent: int):
    """The least overlap that a set of n shingles needs for a link."""
    return -((-percent * n) // 100)


def _links(percent: int):
    """Links between the texts of two blocks (sides 0 and 1), or of one (side 2): enough to connect what is linked.

    With them, the most linked text of each class of one block (kind 1), by which it is compared with other blocks' classes.
    """

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])  # the forest returned doesn't depend on the order of arrival
        ids, sides = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, "<u8").reshape(2, -1) for x in table.column("tokens").to_pylist()]
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        if not len(left) or not len(right):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sizes = np.array([s.shape[1] for s in sets])
        one, two = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
        doc = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((two, one))  # shingles are equal when both digests are
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        column = np.empty(len(order), np.int64)
        column[order] = np.cumsum(new) - 1
        useful = np.bincount(column) > 1
        place = np.cumsum(useful) - 1
        keep = useful[column]
        doc, column = doc[keep], place[column[keep]]
        width = int(useful.sum())
        # texts with their smallest common shingle in common are laid side by side, so that groups hold similar ones
        smallest = np.full(len(sets), width)
        np.minimum.at(smallest, doc, column)
        right = right[np.lexsort((sizes[right], smallest[right]))]
        groups = np.arange(len(right)) // GROUP_DOCS
        n_groups = int(groups[-1]) + 1
        row_of = np.full(len(sets), -1)
        row_of[right] = np.arange(len(right))
        query_of = np.full(len(sets), -1)
        query_of[left] = np.arange(len(left))
        need = _least(sizes[left], percent)

        def matrix(rows_of, n_rows, lo, hi):
            m = np.zeros((n_rows, hi - lo), np.float32)
            at = (rows_of[doc] >= 0) & (column >= lo) & (column < hi)
            m[rows_of[doc[at]], column[at] - lo] = 1
            return m

        # the bound: overlap of each query with each group's token union
        bound = np.zeros((len(left), n_groups), np.float32)
        group_of = np.where(row_of >= 0, row_of // GROUP_DOCS, -1)
        for lo in range(0, width, COLUMNS):
            hi = min(width, lo + COLUMNS)
            bound += matrix(query_of, len(left), lo, hi) @ matrix(group_of, n_groups, lo, hi).T
        opened = bound >= need[:, None]
        overlap = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, width, COLUMNS):
            hi = min(width, lo + COLUMNS)
            q, r = matrix(query_of, len(left), lo, hi), matrix(row_of, len(right), lo, hi)
            for g in np.flatnonzero(opened.any(axis=0)):
                ask = np.flatnonzero(opened[:, g])
                members = slice(g * GROUP_DOCS, min((g + 1) * GROUP_DOCS, len(right)))
                overlap[ask, members] += q[ask] @ r[members].T
        union = sizes[left][:, None] + sizes[right][None, :] - overlap
        linked = (100 * overlap.astype(np.float64) >= percent * union.astype(np.float64)) & (overlap > 0)
        linked &= ids[left][:, None] != ids[right][None, :]
        # a spanning forest of the links
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in np.argwhere(linked):
            a, b = root(int(ids[left[i]])), root(int(ids[right[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((0, int(ids[left[i]]), int(ids[right[j]])))
        if (sides == 2).all():
            best: dict = {}
            for i, n in zip(ids[left].tolist(), linked.sum(axis=1).tolist(), strict=True):
                c = root(i)
                best[c] = max(best.get(c, (-1, 0)), (n, -i))
            out += [(1, -i, c) for c, (_, i) in sorted(best.items())]
        return pa.table({name: pa.array([r[k] for r in out], t) for k, (name, t) in enumerate((("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())))})

    return run


def _token_rows(width: int):
    """doc_id, n, fp1, fp2, tokens of the texts whose set is the one that is looked for."""

    def run(batches):
        import pyarrow as pa

        words = WordDigests()
        for batch in split_batches(batches, 1_000_000):
            data, off = text_buffers(batch.column(1))
            tokens, more, at = shingle_sets(data, off, width, words)
            fp1, fp2 = _fingerprints(tokens, more, at)
            want1, want2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            same = (fp1 == want1) & (fp2 == want2)
            sets = [tokens[at[i] : at[i + 1]].astype("<u8").tobytes() + more[at[i] : at[i + 1]].astype("<u8").tobytes() for i in np.flatnonzero(same)]
            ids = batch.column(0).filter(pa.array(same))
            columns = [ids, pa.array(np.diff(at)[same], pa.int64()), pa.array(fp1[same]), pa.array(fp2[same]), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp1", "fp2", "tokens"])

    return run


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches):
    """How many of a chunk's shingles fall into each cell, cut into parts: the cells that are not empty as steps, and their numbers."""
    import pyarrow as pa

    def told(held):
        cell, n = np.unique(_cells(np.concatenate(held)), return_counts=True)
        bounds = np.searchsorted(cell, np.arange(SKETCH_PARTS + 1) << SKETCH_BITS - 6)
        parts = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if lo < hi]
        steps = [_squeezed(_planes(np.diff(cell[lo:hi] - (k << SKETCH_BITS - 6), prepend=0).astype(np.uint64), 3)) for k, lo, hi in parts]
        numbers = [_squeezed(np.minimum(n[lo:hi], 255).astype(np.uint8).tobytes()) for _, lo, hi in parts]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), pa.array(steps, pa.binary()), pa.array(numbers, pa.binary())], names=["part", "steps", "numbers"])

    held, size = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(np.frombuffer(x, "<u8", len(x) // 16))
            size += len(held[-1])
            if size > 2 * CHUNK_TOKENS:
                yield told(held)
                held, size = [], 0
    if held:
        yield told(held)


def _add_sketches(key, table):
    import pyarrow as pa

    total = np.zeros(1 << SKETCH_BITS - 6, np.int64)
    for steps, numbers in zip(table.column("steps").to_pylist(), table.column("numbers").to_pylist(), strict=True):
        total[np.cumsum(_unplanes(_spread(steps), 3)).astype(np.int64)] += np.frombuffer(_spread(numbers), np.uint8)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())})


def _often(sets: DataFrame) -> np.ndarray:
    """The sketch over all sets (tokens): at least how often each cell's shingles occur, 255 at most."""
    rows = sets.select("tokens").mapInArrow(_sketch, "part int, steps binary, numbers binary").groupBy("part").applyInArrow(_add_sketches, "part int, cells binary")
    out = np.zeros((SKETCH_PARTS, 1 << SKETCH_BITS - 6), np.uint8)
    for r in rows.collect():  # SKETCH_PARTS rows, 2^SKETCH_BITS bytes
        out[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def _prefixes(percent: int, often):
    """The shingles of which a linked text must share one: those that seem rarest; one that certainly is the only one of its kind ties nothing."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, x in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_pylist(), strict=True):
                mine = np.frombuffer(x, "<u8", len(x) // 16)
                n = often.value[_cells(mine)]
                order = np.argsort(n, kind="stable")[: len(mine) - _least(len(mine), percent) + 1]  # mine is in order: so are equal ones
                order = order[n[order] > 1]
                ids.append(np.full(len(order), i))
                tokens.append(mine[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(tokens).view(np.int64))], names=["doc_id", "token"])

    return run


def _compare(work: DataFrame, percent: int, by: list[str]) -> DataFrame:
    return work.groupBy(*by).applyInArrow(_links(percent), "kind int, a long, b long")


def _dealt(texts: DataFrame, by: list[str]) -> DataFrame:
    """texts (doc_id, n and by) with the number of blocks of each group, and each text's block by a hash of its id."""
    sizes = texts.groupBy(*by).agg(F.count("*").alias("c"), F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    return join_groups(texts, materialize(sizes, "groups"), by, "c").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))


def neighbour_links(texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), enough to connect every class, among texts (doc_id, n, hood) of each neighbourhood; sets: doc_id, tokens.

    1. Blocks. A neighbourhood's texts are dealt to blocks, each of which is one task's matrix.
    2. Central texts. Each class of a block sends its most linked text on; these are dealt and compared in the same way, until
       a neighbourhood's fit one block or stay as many. Near copies of one text are one class after these rounds, whose cost
       grows with their number and not with its square.
    3. What is left. Only pairs of blocks that hold different classes of a neighbourhood are compared: no link is lost.
    """
    tokens = sets.select("doc_id", "tokens")
    # the sets are large and stay where they are: a few numbers for each text are told to all tasks, unless they are too many
    placed = lambda rows: tokens.join(told(rows, BROADCAST_ROWS), "doc_id")
    dealt = materialize(_dealt(texts, ["hood"]), "dealt-0")
    found = materialize(_compare(placed(dealt.select("doc_id", "hood", "block")).withColumn("side", F.lit(2)), percent, ["hood", "block"]), "links-0")
    large = materialize(dealt.where("blocks > 1").select("doc_id", "n", "hood"), "large")
    n = large.count()
    if not n:
        return found.where("kind = 0").select("a", "b")
    step = 0
    while True:
        centres = large.join(found.where("kind = 1").select(F.col("a").alias("doc_id")).distinct(), "doc_id")
        dealt = materialize(_dealt(centres, ["hood"]), f"dealt-{step + 1}")
        left = dealt.count()
        step += 1
        more = _compare(placed(dealt.select("doc_id", "hood", "block")).withColumn("side", F.lit(2)), percent, ["hood", "block"])
        # the texts that are not asked again keep their links
        found = materialize(found.where("kind = 0").unionByName(more), f"links-{step}")
        if left > n / 2 or dealt.where("blocks > 1").isEmpty():
            break
        n = left
    known = found.where("kind = 0").select("a", "b")
    classes = components(known, "coarse")
    held = large.join(classes, large["doc_id"] == classes["node"], "left").select("doc_id", "n", "hood", F.coalesce("component", "doc_id").alias("class"))
    held = materialize(held, "held")
    sizes = held.groupBy("hood", "class").agg(F.count("*").alias("size"))
    several = sizes.groupBy("hood").agg(F.count("*").alias("c"), F.sum("size").alias("texts")).where("c > 1")
    open_ = join_groups(held, several.select("hood", "texts"), ["hood"], "texts").drop("texts")
    open_ = join_groups(open_, sizes, ["hood", "class"], "size")
    # large classes have blocks of their own; the texts of small ones share blocks; texts of about a size lie together
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    open_ = open_.select("doc_id", "n", "hood", F.when(F.col("size") >= BLOCK_DOCS, F.col("class")).otherwise(F.lit(None)).alias("own"), band.alias("band"))
    open_ = materialize(open_, "open")
    if open_.isEmpty():
        return known
    open_ = open_.withColumn("kin", F.coalesce(F.col("own").cast("string"), F.lit("")))
    dealt = materialize(_dealt(open_, ["hood", "kin", "band"]), "dealt-open")
    spans = dealt.groupBy("hood", "kin", "band", "block").agg(F.min("n").alias("small"), F.max("n").alias("large"))
    spans = materialize(spans.withColumn("x", F.concat_ws(":", "kin", "band", "block")), "spans")
    one, two = spans.select("hood", "x", F.col("kin").alias("kin1"), F.col("small").alias("s1"), F.col("large").alias("l1")), spans.select("hood", F.col("x").alias("y"), F.col("kin").alias("kin2"), F.col("small").alias("s2"), F.col("large").alias("l2"))
    near = (100 * F.col("l1") >= percent * F.col("s2")) & (100 * F.col("l2") >= percent * F.col("s1"))
    pairs = one.join(two, "hood").where((F.col("x") <= F.col("y")) & near & ((F.col("kin1") != F.col("kin2")) | (F.col("kin1") == ""))).select("hood", "x", "y")
    sides = pairs.select("hood", "x", "y", F.col("x").alias("at"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side")).union(
        pairs.where("x <> y").select("hood", "x", "y", F.col("y").alias("at"), F.lit(1).alias("side"))
    )
    members = dealt.select("doc_id", "hood", F.concat_ws(":", "kin", "band", "block").alias("at")).join(sides, ["hood", "at"])
    members = materialize(members.select("doc_id", "hood", "x", "y", "side"), "members")
    rest = _compare(placed(members).select("hood", "x", "y", "side", "doc_id", "tokens"), percent, ["hood", "x", "y"])
    return known.union(rest.where("kind = 0").select("a", "b"))


def links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows of docs (doc_id, text), and links (a, b) enough to connect every class."""
    bounded_batches(docs.sparkSession)
    with temporary(docs.sparkSession):
        sig = materialize(signatures(docs, width), "signatures", outer=True)
        named = sig.where("n > 0 and doc_id is not null")
        first = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
        able = named.where(100 * F.col("shared") >= percent * F.col("n"))
        reps = able.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id")).join(first, ["fp1", "fp2"]).where("doc_id = first")
        equal = join_groups(named, materialize(first.where("c > 1"), "equal"), ["fp1", "fp2"], "c").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))

        # few wanted texts are told to the readers of docs; with more of them, docs are shuffled
        wanted = materialize(reps.select("doc_id", "fp1", "fp2"), "wanted")
        found = docs.select("doc_id", "text").join(told(wanted, BROADCAST_ROWS), "doc_id").select("doc_id", "text", "fp1", "fp2")
        sets = materialize(found.mapInArrow(_token_rows(width), "doc_id long, n long, fp1 long, fp2 long, tokens binary"), "sets")
        if not sets.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows; else nothing is shuffled
            sets = materialize(sets.dropDuplicates(["doc_id", "fp1", "fp2"]), "sets-once")

        # neighbourhoods: the shingles, rarest first by a sketch, of which a linked text must share one
        prefixes = _prefixes(percent, docs.sparkSession.sparkContext.broadcast(_often(sets)))
        least = materialize(sets.select("doc_id", "tokens").mapInArrow(prefixes, "doc_id long, token long"), "ties")
        lows = least.groupBy("token").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1")
        near = join_groups(least, materialize(lows, "lows"), ["token"], "c").select("a", F.col("doc_id").alias("b")).distinct()
        around = components(near, "neighbourhoods")
        texts = sets.select("doc_id", "n").join(around, sets["doc_id"] == around["node"]).select("doc_id", "n", F.col("component").alias("hood"))
        found = materialize(neighbour_links(materialize(texts, "texts"), sets, percent).union(equal), "links", outer=True)
    return sig, found


def jaccard_classes(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each row of df."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig, found = links(docs, width, percent)
    classes = components(found, "classes")
    named = sig.where("doc_id is not null")
    joined = named.join(classes, named["doc_id"] == classes["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    # rows without an id follow an equal set that has one; there may be many of them to one set
    nulls = sig.where("doc_id is null").select("doc_id", "n", "fp1", "fp2")
    if nulls.isEmpty():
        return joined
    keyed = named.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("own"))
    groups = nulls.groupBy("fp1", "fp2").agg(F.count("*").alias("times")).join(keyed, ["fp1", "fp2"], "left")
    groups = groups.join(classes, groups["own"] == classes["node"], "left").select("fp1", "fp2", "times", F.coalesce("component", "own").alias("class"))
    rows = join_groups(nulls, materialize(groups, "nulls"), ["fp1", "fp2"], "times")
    return joined.union(rows.select("doc_id", "n", "class"))
