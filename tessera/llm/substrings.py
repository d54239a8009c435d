"""Removal of repeated substrings by sorted suffixes.

A byte goes when it is covered by a string of `length` bytes that also starts in a text with a smaller id.
Strings are judged on the texts as they come; they may overlap and never cross texts.

1. Anchors. A string's anchor is its k-byte piece with the smallest hash, so equal strings have equal
   anchors at equal places. Each task sends its texts' distinct anchors, packed, to owner
   tasks, each of which has one range of their hashes; the owners answer which occur in several texts. Suffixes
   whose anchor occurs in one text only can't be repeated and go no further.
2. Splitters. Each owner returns the leading eight bytes of a bounded sample of its repeated anchors; the
   weighted quantiles of all samples are the splitters.
3. Suffixes. The suffixes that remain are sent, those of one anchor as one stretch
   of text, and range-partitioned by their anchor's leading bytes. A bucket sorts its suffixes by multikey quicksort on
   characters of eight bytes: parts that are equal in one character go on to the next.
   In each run of equal strings those of the smallest id stay, and the others are marked. Splitters are
   whole characters, so equal strings never lie on both sides of a boundary.
4. Equal stretches that meet in one task (their bytes are compared) are sent once, with their smallest id. The suffixes of an anchor
   that holds a large part of its bucket are partitioned one by one, by all their bytes, so no group lands in one task.
5. The marked strings of a text are merged to spans, and the remaining bytes are digested.

Texts that equal one with a smaller id (120 bits of SHA-256) go entirely when they have `length` bytes;
they add no strings of their own.

Defined results: null counts as empty. A text shorter than the length loses nothing. Rows of equal id
don't remove each other's bytes; repeated rows get equal answers. A row with a null id loses nothing and removes nothing. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_groups, materialize, mix64, shuffle_partitions, split_batches, text_buffers
from .jaccard import _planes, _unplanes
from .shingles import SALTS, digests, eights, same_bytes

#: Bytes of an anchor (a sum of 16 and 8); must be less than the length of the strings.
ANCHOR = 24
#: Bytes of an anchor's hash that are sent.
HASH_BYTES = 5
CHUNK_ANCHORS = 400_000
CHUNK_DOCS = 12_000
CHUNK_STRETCHES = 100_000
#: Buckets for each shuffle partition: a task holds one at a time.
BUCKETS_PER_PARTITION = 4
#: One in so many anchors may be a sample, and samples that an owner returns at most.
SAMPLED, SAMPLES = 64, 256
#: An anchor is dealt out string by string if it holds more than this share of its bucket, and so many texts.
HOT_SHARE, HOT_LEAST = 0.5, 256

_RNG = np.random.default_rng(77003)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MULTI, _HOT = 0x8000, 0x4000


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    h = _BYTE[data]
    for mul, step in zip(_MUL[:3], (1, 2, 4), strict=True):
        h = h[:-step] * mul + h[step:]
    eight = h
    h = h[:-8] * _MUL[3] + h[8:]
    return mix64(h[: len(h) - 8] * _MUL[4] + eight[16:])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    n, step = len(x), 1
    y = x
    while step * 2 <= width:
        y = pick(y[:-step], y[step:])
        step *= 2
    return pick(y[: n - width + 1], y[width - step : width - step + n - width + 1])


def anchors(data: np.ndarray, off: np.ndarray, length: int):
    """Stretches of neighbouring strings with the same anchor: the anchor's hash, text, first string, number of strings (the width of a string's anchors at most); and the hash of each piece."""
    width = length - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint64)
    hashes = _anchor_hashes(data)
    low = _slide(hashes, width, np.minimum)  # of the string that starts here
    # strings that end beyond their text are no strings
    valid = np.ones(len(low), bool)
    for end in off[1:-1].tolist():
        valid[max(0, end - length + 1) : end] = False
    new = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= valid[1:] != valid[:-1]
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(low)])
    begin, n = begin[valid[begin]], n[valid[begin]]
    doc = np.searchsorted(off, begin, side="right") - 1
    h = low[begin]
    if len(n) and n.max() > width:  # a periodic text
        times = -(-n // width)
        of = np.repeat(np.arange(len(n)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        begin, n, doc, h = begin[of] + nth * width, np.minimum(n[of] - nth * width, width), doc[of], h[of]
    return h, doc, begin, n, hashes


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do; zeros beyond the end."""
    return eights(data).byteswap()


def leading(word: np.ndarray, hashes: np.ndarray, h: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """The leading character of each stretch's anchor (word: see big_endian). The anchor lies in all strings of the stretch."""
    out, left = np.zeros(len(h), np.uint64), np.arange(len(h))
    for j in range(length - ANCHOR + 1):
        at = begin[left] + n[left] - 1 + j
        hit = hashes[np.minimum(at, len(hashes) - 1)] == h[left]
        out[left[hit]] = word[at[hit]]
        left = left[~hit]
        if not len(left):
            break
    return out


def multikey(word: np.ndarray, start: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings at start: their order, and where runs of equal strings begin in it.

    places: where a string's characters of eight bytes begin (word: see big_endian). All parts that are equal so far
    are sorted by their next character together; a part whose strings agree in it, or that holds one string, needs no sort.
    """
    order = np.argsort(word[start], kind="stable")
    first = np.r_[True, (c := word[start[order]])[1:] != c[:-1]] if len(order) else np.zeros(0, bool)
    for p in places[1:]:
        c = word[start[order] + p]
        change = np.r_[False, (c[1:] != c[:-1]) & ~first[1:]]  # within a part
        if not change.any():
            continue
        part = np.cumsum(first) - 1
        mixed = np.bincount(part[change], minlength=part[-1] + 1) > 0
        at = np.flatnonzero(mixed[part])
        by = at[np.lexsort((c[at], part[at]))]
        order[at], c[at] = order[by], c[by]
        first = first | np.r_[False, (c[1:] != c[:-1]) & ~first[1:]]
    return order, np.flatnonzero(first)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - 8 * HASH_BYTES)


def _sampled(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ np.uint64(0x2545F4914F6CDD1D)) < np.uint64(2**64 // SAMPLED)


def _send_anchors(length: int, n_buckets: int):
    """kind 0: a chunk's texts and the anchors that several of them hold; kind 1: distinct anchors of one bucket; kind 2: samples with leading characters."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, seq, held = TaskContext.get().partitionId() << 24, 0, []

        def flush():
            nonlocal seq, held
            keys = [np.concatenate([x[k] for x in held]) for k in range(3)]
            tokens, docs, at = [], [], 0
            for x in held:
                tokens.append(x[3])
                docs.append(x[4] + at)
                at += len(x[0])
            tokens, docs = np.concatenate(tokens), np.concatenate(docs)
            both = np.unique(tokens << np.uint64(16) | docs.astype(np.uint64))  # 40 bits and 16
            tokens, docs = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
            start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
            count = np.diff(np.r_[start, len(tokens)])
            several = np.repeat(count > 1, count)
            distinct = tokens[start]
            value = np.where(count > 1, _MULTI | np.minimum(count, 0x7FFF), docs[start])
            chunk, kinds, buckets = base + seq, [0], [int((base + seq) % n_buckets)]
            seq += 1
            a, b = [b"".join(k.astype("<i8").tobytes() for k in keys)], [_planes(both[several], 7)]
            edges = np.searchsorted(distinct, (np.arange(1, n_buckets) * (1 << 8 * HASH_BYTES)) // n_buckets)
            for k, (t, v) in enumerate(zip(np.split(distinct, edges), np.split(value, edges), strict=True)):
                if len(t):
                    kinds.append(1)
                    buckets.append(k)
                    a.append(_planes(t, HASH_BYTES))
                    b.append(_planes(v.astype(np.uint64), 2))
            some, which = np.unique(np.concatenate([x[5] for x in held]), return_index=True)
            word = np.concatenate([x[6] for x in held])[which]
            edges = np.searchsorted(some, (np.arange(1, n_buckets) * (1 << 8 * HASH_BYTES)) // n_buckets)
            for k, (t, v) in enumerate(zip(np.split(some, edges), np.split(word, edges), strict=True)):
                if len(t):
                    kinds.append(2)
                    buckets.append(k)
                    a.append(t.astype("<u8").tobytes())
                    b.append(v.astype("<u8").tobytes())
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array([chunk] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                names=["bucket", "chunk", "kind", "a", "b"],
            )

        n = m = 0
        for batch in split_batches(batches, 1_000_000):
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(at, CHUNK_DOCS)
                if m + part.num_rows > 0x3FFF:
                    yield flush()
                    n = m = 0
                data, off = text_buffers(part.column(1))
                h, doc, begin, size, hashes = anchors(data, off, length)
                some = np.flatnonzero(_sampled(_short(h)))
                word = leading(big_endian(data), hashes, h[some], begin[some], size[some], length)
                held.append((*[part.column(k).to_numpy() for k in (0, 2, 3)], _short(h), doc, _short(h)[some], word))
                n, m = n + len(h), m + part.num_rows
            if n > CHUNK_ANCHORS:
                yield flush()
                n = m = 0
        if held:
            yield flush()

    return run


def _own_anchors(key, table):
    """The anchors of a bucket that occur in several texts, back to their chunks."""
    import pyarrow as pa

    kinds, chunks = table.column("kind").to_numpy(), table.column("chunk").to_numpy()
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    out = [(int(chunks[i]), 0, a[i], b[i]) for i in np.flatnonzero(kinds == 0)]
    rows = np.flatnonzero(kinds == 1)
    if len(rows):
        parts = [_unplanes(a[i], HASH_BYTES) for i in rows]
        value = np.concatenate([_unplanes(b[i], 2) for i in rows]).astype(np.int64)
        bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
        tokens = np.concatenate(parts)
        multi = value >= _MULTI
        weight = np.where(multi, value & 0x7FFF, 1)
        order = np.argsort(tokens, kind="stable")
        start = np.flatnonzero(np.r_[True, tokens[order][1:] != tokens[order][:-1]])
        total = np.add.reduceat(weight[order], start)
        held = np.zeros(len(tokens), np.int64)
        held[order] = np.repeat(total, np.diff(np.r_[start, len(tokens)]))
        repeated = held > 1
        hot = held > max(HOT_LEAST, HOT_SHARE * total[total > 1].sum())
        tell = np.where(multi, hot, repeated)
        for i, lo, hi in zip(rows, bounds[:-1], bounds[1:], strict=True):
            pick = np.flatnonzero(tell[lo:hi]) + lo
            if len(pick):
                answer = np.where(multi[pick], _MULTI, value[pick]) | np.where(hot[pick], _HOT, 0)
                out.append((int(chunks[i]), 1, _planes(tokens[pick], HASH_BYTES), _planes(answer.astype(np.uint64), 2)))
        rows = np.flatnonzero(kinds == 2)
        if len(rows):
            some, which = np.unique(np.concatenate([np.frombuffer(a[i], "<u8") for i in rows]), return_index=True)
            word = np.concatenate([np.frombuffer(b[i], "<u8") for i in rows])[which]
            known, lead = np.unique(tokens, return_index=True)
            weight = held[lead][np.searchsorted(known, some)]
            pick = np.flatnonzero(weight > 1)
            pick = pick[np.argsort(mix64(some[pick] ^ np.uint64(0x2545F4914F6CDD1D)))][:SAMPLES]
            if len(pick):
                out.append((-1 - int(key[0].as_py()), 2, word[pick].astype("<u8").tobytes(), weight[pick].astype("<u8").tobytes()))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "kind", "a", "b"])


def _marks(key, table):
    """For each text its repeated anchors; the lowest bit of a number says that it is hot."""
    import pyarrow as pa

    kinds = table.column("kind").to_pylist()
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    if 0 not in kinds:  # an owner's samples: leading characters, then their weights
        return pa.table({"doc_id": pa.array([None], pa.int64()), "f1": pa.array([None], pa.int64()), "f2": pa.array([None], pa.int64()), "marks": pa.array([a[0] + b[0]], pa.binary())})
    at = kinds.index(0)
    ids, f1, f2 = np.frombuffer(a[at], "<i8").reshape(3, -1)
    local = _unplanes(b[at], 7)
    t, d = [local >> np.uint64(16)], [(local & np.uint64(0xFFFF)).astype(np.int64)]
    told_t = [_unplanes(x, HASH_BYTES) for x, k in zip(a, kinds, strict=True) if k == 1]
    told_v = [_unplanes(x, 2).astype(np.int64) for x, k in zip(b, kinds, strict=True) if k == 1]
    hot = np.zeros(0, np.uint64)
    if told_t:
        told_t, told_v = np.concatenate(told_t), np.concatenate(told_v)
        hot = told_t[(told_v & _HOT) > 0]
        one = told_v < _MULTI
        t.append(told_t[one])
        d.append(told_v[one] & 0x3FFF)
    t, d = np.concatenate(t), np.concatenate(d)
    t = t << np.uint64(1) | np.isin(t, hot).astype(np.uint64)
    order = np.lexsort((t, d))
    t, bounds = t[order].astype("<u8"), np.searchsorted(d[order], np.arange(len(ids) + 1))
    marks = [t[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(ids))]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "marks": pa.array(marks, pa.binary())})


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many stretches, end to end."""
    ends = np.cumsum(size)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return data[index]


def splitters(samples: list[bytes], n_buckets: int) -> np.ndarray:
    """Characters that cut the samples' weight into n_buckets about equal parts; fewer where one character weighs more than a part."""
    cells = [np.frombuffer(x, "<u8").reshape(2, -1) for x in samples]
    word, weight = (np.concatenate([np.zeros(0, np.uint64), *[c[k] for c in cells]]) for k in (0, 1))
    order = np.argsort(word)
    total = np.cumsum(weight[order].astype(np.float64))
    if not len(total):
        return np.zeros(0, np.uint64)
    return np.unique(word[order][np.searchsorted(total, total[-1] * np.arange(1, n_buckets) / n_buckets)])


def _send_suffixes(length: int, n_buckets: int, cuts: np.ndarray):
    """kind 0: where a chunk's stretches lie; kind 1: the distinct stretches of one bucket, with their smallest ids."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, seq, held, keys = TaskContext.get().partitionId() << 24, 0, [], []

        def flush():
            nonlocal seq, held, keys
            ids, f1, f2 = (np.concatenate([x[k] for x in keys]) for k in range(3))
            counts = np.cumsum([0, *[len(x[0]) for x in keys]])
            doc = np.concatenate([x[0] + c for x, c in zip(held, counts, strict=False)])
            first, n, route, digest, second = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4, 5))
            blob = np.concatenate([x[6] for x in held])
            size = n + length - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((ids[doc], second, digest))
            near = np.flatnonzero((digest[order][1:] == digest[order][:-1]) & (second[order][1:] == second[order][:-1]) & (size[order][1:] == size[order][:-1]))
            word = eights(blob)
            new = np.ones(len(order), bool)
            new[near + 1] = ~same_bytes(word, begin[order[near]], word, begin[order[near + 1]], size[order[near]])
            lead = order[new]  # of equal stretches, one of the smallest id
            entry = np.empty(len(order), np.int64)
            entry[order] = np.cumsum(new) - 1
            whole = ids[doc] > ids[doc[lead]][entry]  # a smaller id in this very chunk has the stretch
            bucket = route[lead]
            chunk = base + seq
            seq += 1
            out = [(int(chunk % n_buckets), chunk, 0, b"".join(x.astype("<i8").tobytes() for x in (np.array([len(ids), len(doc)]), ids, f1, f2)), b"".join(x.astype(t).tobytes() for x, t in ((doc, "<u4"), (first, "<u4"), (entry, "<u4"), (n, "u1"), (whole, "u1"))))]
            by = np.lexsort((lead, bucket))
            for k, part in zip(*_split(bucket[by], by), strict=True):
                at = lead[part]
                a = _take(blob, begin[at], size[at]).tobytes()
                b = b"".join((_planes(part.astype(np.uint64), 4), n[at].astype(np.uint8).tobytes(), _planes(ids[doc[at]].view(np.uint64), 8)))
                out.append((int(k), chunk, 1, a, b))
            held, keys = [], []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "kind", "a", "b"])

        waiting = 0
        for batch in split_batches((b.filter(b.column(4).is_valid()) for b in batches), 1_000_000):
            data, off = text_buffers(batch.column(1))
            h, doc, first, n, hashes = anchors(data, off, length)
            marks = batch.column(4).fill_null(b"").to_pylist()
            mark = np.frombuffer(b"".join(marks), "<u8")
            owner = np.repeat(np.arange(len(marks), dtype=np.uint64), [len(m) // 8 for m in marks])
            known = (mark >> np.uint64(1)) * np.uint64(1 << 20) + owner
            mine = _short(h) * np.uint64(1 << 20) + doc.astype(np.uint64)
            near = np.minimum(np.searchsorted(known, mine, sorter=(s := np.argsort(known))), max(0, len(known) - 1))
            found = known[s[near]] == mine if len(known) else np.zeros(len(mine), bool)
            hot = found & ((mark[s[near]] & np.uint64(1)) > 0) if len(known) else found
            h, doc, first, n, hot = (x[found] for x in (h, doc, first, n, hot))
            if not len(h):
                continue
            bucket = np.searchsorted(cuts, leading(big_endian(data), hashes, h, first, n, length), side="right")
            if hot.any():  # hot stretches are cut into single strings
                times = np.where(hot, n, 1)
                of = np.repeat(np.arange(len(n)), times)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                doc, first, n, hot, bucket = doc[of], first[of] + nth, np.where(hot, 1, n)[of], hot[of], bucket[of]
            size = n + length - 1
            digest, second = digests(eights(data), first, size, SALTS)
            route = np.where(hot, (digest >> np.uint64(32)).astype(np.int64) * n_buckets >> 32, bucket)
            keys.append(tuple(batch.column(k).to_numpy() for k in (0, 2, 3)))
            held.append((doc, first - off[doc], n, route, digest, second, _take(data, first, size)))
            waiting += len(n)
            if waiting > CHUNK_STRETCHES:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    return run


def _split(keys: np.ndarray, values: np.ndarray):
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.r_[0, cut]], np.split(values, cut)


def _own_suffixes(length: int):
    """Sort a bucket's suffixes; mark those whose string starts in a text with a smaller id."""

    def run(key, table):
        import pyarrow as pa

        kinds, chunks = table.column("kind").to_numpy(), table.column("chunk").to_numpy()
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        out = [(int(chunks[i]), 0, a[i], b[i]) for i in np.flatnonzero(kinds == 0)]
        rows = np.flatnonzero(kinds == 1)
        if len(rows):
            counts = [len(b[i]) // 13 for i in rows]
            entry = np.concatenate([_unplanes(b[i][: 4 * c], 4) for i, c in zip(rows, counts, strict=True)])
            n = np.concatenate([np.frombuffer(b[i][4 * c : 5 * c], np.uint8) for i, c in zip(rows, counts, strict=True)]).astype(np.int64)
            ids = np.concatenate([_unplanes(b[i][5 * c :], 8) for i, c in zip(rows, counts, strict=True)]).view(np.int64)
            data = np.frombuffer(b"".join(a[i] for i in rows), np.uint8)
            size = n + length - 1
            begin = np.cumsum(size) - size
            of = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = begin[of] + nth
            order, lead = multikey(big_endian(data), start, [*range(0, length - 7, 8), length - 8])
            smallest = np.minimum.reduceat(ids[of[order]], lead)
            mark = np.zeros(len(order), bool)
            mark[order] = ids[of[order]] > np.repeat(smallest, np.diff(np.r_[lead, len(order)]))
            bits = np.bitwise_or.reduceat(np.where(mark, np.left_shift(1, nth), 0), np.cumsum(n) - n)
            bounds = np.r_[0, np.cumsum(counts)]
            for i, lo, hi in zip(rows, bounds[:-1], bounds[1:], strict=True):
                pick = np.flatnonzero(bits[lo:hi]) + lo
                if len(pick):
                    out.append((int(chunks[i]), 1, _planes(entry[pick], 4), bits[pick].astype("<u4").tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "kind", "a", "b"])

    return run


def _spans(length: int):
    """The removed spans of a chunk's texts, as pairs of numbers."""

    def run(key, table):
        import pyarrow as pa

        kinds = table.column("kind").to_pylist()
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        at = kinds.index(0)
        head = np.frombuffer(a[at], "<i8")
        n_docs, m = int(head[0]), int(head[1])
        ids, f1, f2 = head[2:].reshape(3, n_docs)
        doc, first, entry = np.frombuffer(b[at][: 12 * m], "<u4").reshape(3, m).astype(np.int64)
        n, whole = np.frombuffer(b[at][12 * m :], np.uint8).reshape(2, m)
        bits = np.zeros(int(entry.max()) + 1, np.int64)
        for x, y, k in zip(a, b, kinds, strict=True):
            if k == 1:
                bits[_unplanes(x, 4).astype(np.int64)] = np.frombuffer(y, "<u4")
        mask = np.where(whole > 0, np.left_shift(np.int64(1), n.astype(np.int64)) - 1, bits[entry])
        starts, docs = [], []
        for j in range(length - ANCHOR + 1):
            hit = np.flatnonzero(mask >> j & 1)
            starts.append(first[hit] + j)
            docs.append(doc[hit])
        starts, docs = np.concatenate(starts), np.concatenate(docs)
        order = np.lexsort((starts, docs))
        starts, docs = starts[order], docs[order]
        out = {"doc_id": [], "f1": [], "f2": [], "spans": []}
        if len(starts):
            new = np.r_[True, (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + length)]
            lead = np.flatnonzero(new)
            low, high = starts[lead], starts[np.r_[lead[1:], len(starts)] - 1] + length
            pairs = np.stack([low, high], 1).astype("<i8")
            for d, part in zip(*_split(docs[lead], np.arange(len(lead))), strict=True):
                out["doc_id"].append(int(ids[d]))
                out["f1"].append(int(f1[d]))
                out["f2"].append(int(f2[d]))
                out["spans"].append(pairs[part].tobytes())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "f1": pa.array(out["f1"], pa.int64()), "f2": pa.array(out["f2"], pa.int64()), "spans": pa.array(out["spans"], pa.binary())})

    return run


_PACKED = "bucket int, chunk long, kind int, a binary, b binary"
_ANSWER = "chunk long, kind int, a binary, b binary"


def repeated_spans(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, spans of each row of df: spans holds pairs of little-endian 64-bit numbers, the byte ranges to remove."""
    if not ANCHOR + 8 <= length <= ANCHOR + 31:
        raise ValueError(f"length must lie between {ANCHOR + 8} and {ANCHOR + 31}")
    bounded_batches(df.sparkSession)
    n_buckets = BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.sha2(body, 256).alias("sha"))
    docs = docs.select("doc_id", "text", *[F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(name) for name, at in (("f1", 1), ("f2", 16))])
    own = ["doc_id", "f1", "f2"]
    named = docs.where("doc_id is not null")
    sent = named.mapInArrow(_send_anchors(length, n_buckets), _PACKED)
    told = sent.groupBy("bucket").applyInArrow(_own_anchors, _ANSWER).groupBy("chunk").applyInArrow(_marks, "doc_id long, f1 long, f2 long, marks binary")
    marks = materialize(told, "marks")
    samples = marks.where("doc_id is null").select("marks").collect()  # SAMPLES pairs of numbers for each bucket at most
    cuts = splitters([r["marks"] for r in samples], n_buckets)
    marks = marks.where("doc_id is not null")
    firsts = materialize(marks.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")), "firsts")
    marks = join_groups(marks, firsts, ["f1", "f2"], "times").withColumn("copy", F.col("doc_id") > F.col("first")).drop("first", "times")
    known = marks.groupBy(*own).agg(F.max("copy").alias("copy"), F.max("marks").alias("marks"))
    known = materialize(known, "known")
    # left joins both here and below, so that one exchange of the texts serves both; texts without marks are left out by the tasks
    asked = docs.join(known.where("not copy and octet_length(marks) > 0").drop("copy"), own, "left")
    packed = asked.select("doc_id", "text", "f1", "f2", "marks").mapInArrow(_send_suffixes(length, n_buckets, cuts), _PACKED)
    sorted_ = packed.groupBy("bucket").applyInArrow(_own_suffixes(length), _ANSWER).groupBy("chunk").applyInArrow(_spans(length), "doc_id long, f1 long, f2 long, spans binary")
    found = sorted_.dropDuplicates(own).select(*own, "spans", F.lit(False).alias("copy"))
    found = found.unionByName(known.where("copy").select(*own, F.lit(None).cast("binary").alias("spans"), "copy"))
    return docs.join(found, own, "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))


def remove_repeats(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for; one row for each row of df."""
    kept = ", kept binary" if keep_bytes else ""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in split_batches(batches):
            spans, copies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            data, off = text_buffers(batch.column(1))
            out = ([], [], [], [], [])
            for i, (raw, copy) in enumerate(zip(spans, copies, strict=True)):
                body = data[off[i] : off[i + 1]].tobytes()
                pairs = np.frombuffer(raw or b"", "<i8").reshape(-1, 2).tolist()
                if copy and len(body) >= length:
                    pairs = [[0, len(body)]]
                parts, at = [], 0
                for lo, hi in pairs:
                    parts.append(body[at:lo])
                    at = hi
                rest = b"".join([*parts, body[at:]])
                for x, v in zip(out, (len(body), len(body) - len(rest), len(pairs), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    x.append(v)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                columns.append(pa.array(out[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return repeated_spans(df, length, doc_id, text).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")
