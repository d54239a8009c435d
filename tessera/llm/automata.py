"""Removal of repeated runs of words by suffix automata of reference shards.

A word goes when a window of `length` words covers it whose words also start earlier: in a text with a smaller id, or
before it in the same text. Windows are judged on the texts as they come and never cross texts.

1. Anchors. A window's anchor is its gram of eight words (fewer for short windows) with the smallest hash, so equal windows have equal anchors at equal places.
   Windows whose anchor occurs only once, or only in copies of one text, can't be repeated and go no further.
2. Shards. The stretches of words around repeated anchors are the reference. They are dealt to shards by their
   anchor; the stretches of an anchor that would fill a large part of a shard are cut into single windows and dealt by
   all their bytes, so no group lands in one task. Equal stretches that meet in one task are sent once, with the earliest place.
3. Automata. A shard's stretches stream, earliest first, through a suffix automaton over the shard's words that grows with
   each of them: a state's suffix link tells how many of the last words occurred before, which is the matching
   statistic against all that came earlier. Where it reaches the length, the window that ends there is repeated.
4. The repeated windows of a text are merged to maximal spans, and the words in them go.

An automaton is made and read in one task of its shard rather than told to all tasks: telling every automaton to every task is quadratic in the
size of the corpus. Words are numbered within a shard by their bytes, so that nothing rests on hashes but the
choice of what is looked at. Texts that equal one with a smaller id (SHA-256) go entirely when they have `length` words.

Defined results: null counts as empty. A text shorter than the length loses nothing. Rows of equal id don't remove each other's
words; repeated rows get equal answers. A row with a null id loses nothing and removes nothing. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_groups, materialize, mix64, shuffle_partitions, split_batches
from .substrings import _slide

#: Words of an anchor at most; long ones seldom come again by chance, so little but repeated text is looked at.
GRAM = 8
#: Stretches that a task merges before it sends them.
CHUNK_STRETCHES = 100_000
#: Stretches of a shard, about; an anchor with more than a quarter of them is dealt window by window.
SHARD_STRETCHES = 4096
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_of(length: int) -> int:
    return max(2, min(GRAM, 2 * length // 5))


def words_of(bodies: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of many texts, end to end, where each text's begin (len + 1), and a 32-bit hash of each word: equal words have equal ones, whatever the task."""
    from zlib import crc32

    words, at = [], [0]
    for body in bodies:
        words += body.split()
        at.append(len(words))
    return words, np.array(at), np.fromiter(map(crc32, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, at: np.ndarray, length: int, again: bool = False):
    """Stretches of neighbouring windows of a text with the same anchor: the anchor (even, positive), the text, the first window, the number of windows.

    again: and whether windows of the stretch may equal each other. Windows and texts begin at words (see words_of).
    """
    none, gram = np.zeros(0, np.int64), gram_of(length)
    width = length - gram + 1
    if len(hashes) < length:
        return none, none, none, none, none
    h = hashes
    for k in range(1, gram):
        h = h[:-1] * _MUL + hashes[k:]
    low = (_slide(mix64(h), width, np.minimum) >> np.uint64(2)).astype(np.int64) << 1
    doc = np.searchsorted(at, np.arange(len(low)), side="right") - 1
    valid = np.arange(len(low)) + length <= at[doc + 1]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(low)])
    first, n = first[valid[first]], n[valid[first]]
    if len(n) and n.max() > width:  # a periodic text
        times = -(-n // width)
        of = np.repeat(np.arange(len(n)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        first, n = first[of] + nth * width, np.minimum(n[of] - nth * width, width)
    soon = np.zeros(len(h) + 1, np.int64)  # grams that come again so soon that one stretch can hold both
    for d in range(1, width if again else 1):
        soon[1 : len(h) - d + 1] |= h[d:] == h[:-d]
    soon = np.cumsum(soon)
    return low[first], doc[first], first, n, soon[first + n + width - 1] > soon[first]


def _part(body: bytes) -> int:
    """Tells the texts of one id apart; the same as _part_column."""
    from hashlib import sha256

    return int(sha256(body).hexdigest()[:15], 16)


def _part_column(digest):
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _send_anchors(length: int):
    """The distinct anchors of each text, with their number of stretches."""

    def run(batches):
        import pyarrow as pa

        for batch in split_batches(batches, 4_000_000):
            bodies = [(t or "").encode() for t in batch.column(1).to_pylist()]
            parts = np.array([_part(b) for b in bodies], np.int64)
            _, at, hashes = words_of(bodies)
            anchor, doc, _, _, again = anchors(hashes, at, length, again=True)
            weight = 1 + again.astype(np.int64)
            order = np.lexsort((anchor, doc))
            anchor, doc, weight = anchor[order], doc[order], weight[order]
            lead = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])][: len(anchor)])
            n = np.add.reduceat(weight, lead) if len(lead) else weight
            ids = batch.column(0).to_numpy()[doc[lead]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor[lead], ids, parts[doc[lead]], n)], names=["anchor", "doc_id", "part", "n"])

    return run


_STRETCH = "shard long, doc_id long, part long, first int, n int, words binary, bits int"


def _send_stretches(length: int, shards: int):
    """The distinct stretches of a chunk around repeated anchors, with their earliest place; of the others those that are repeated are told as such."""

    def run(batches):
        import pyarrow as pa

        held = []

        def merged():
            lead, rows = {}, []  # the place of the first stretch with these words
            for shard, doc_id, part, first, n, words in sorted(held, key=lambda x: x[1:4]):
                place = lead.setdefault(words, (doc_id, part, first))
                if place == (doc_id, part, first) or (place[0] == doc_id and place[1] != part):
                    rows.append((shard, doc_id, part, first, n, words, 0))
                else:
                    rows.append((doc_id, doc_id, part, first, n, None, (1 << n) - 1))
            held.clear()
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["shard", "doc_id", "part", "first", "n", "words", "bits"])

        for batch in split_batches(batches, 4_000_000):
            ids, texts, marks, copies = (c.to_pylist() for c in batch.columns)
            rows = [(i, t.encode(), m, c or ()) for i, t, m, c in zip(ids, texts, marks, copies, strict=True) if m]
            rows = [(i, t, _part(t), m) for i, t, m, c in rows if not c or _part(t) not in c]
            words, at, hashes = words_of([t for _, t, _, _ in rows])
            anchor, doc, first, n, _ = anchors(hashes, at, length)
            bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
            for (i, _, part, marks), begin, lo, hi in zip(rows, at[:-1].tolist(), bounds[:-1], bounds[1:], strict=True):
                marks = np.sort(np.array(marks, np.int64))
                near = marks[np.minimum(np.searchsorted(marks, anchor[lo:hi]), len(marks) - 1)]
                hit = np.flatnonzero(near >> 1 == anchor[lo:hi] >> 1)
                for a, f, k, h in zip(anchor[lo:hi][hit].tolist(), first[lo:hi][hit].tolist(), n[lo:hi][hit].tolist(), (near[hit] & 1).tolist(), strict=True):
                    if h:
                        for j in range(f, f + k):
                            window = b" ".join(words[j : j + length])
                            held.append((hashes_of(window) % shards, i, part, j - begin, 1, window))
                    else:
                        held.append(((a >> 1) % shards, i, part, f - begin, k, b" ".join(words[f : f + k + length - 1])))
            if len(held) > CHUNK_STRETCHES:
                yield merged()
        if held:
            yield merged()

    return run


def hashes_of(window: bytes) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(window, digest_size=7).digest(), "little")


class SuffixAutomaton:
    """The automaton of all suffixes of the sequences fed to it, built as they come."""

    def __init__(self):
        self.size, self.link, self.next = [0], [-1], [{}]

    def _state(self, size: int, link: int, following: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the shorter strings of q that p reaches by c."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def feed(self, sequence: list[int]) -> list[int]:
        """Add a sequence; for each of its places, how many of the items up to it occurred before as a run."""
        last, statistic = 0, []
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:  # all of the sequence so far occurred
                last = self._split(last, q, c)
                statistic.append(self.size[last])
                continue
            cur, p = self._state(self.size[last] + 1, 0, {}), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                self.link[cur] = self._split(p, self.next[p][c], c)
            last = cur
            statistic.append(self.size[self.link[cur]])
        return statistic


def _by_windows(rows: list, length: int) -> dict:
    """Bits of rows some of which are texts of one id, which don't remove each other's words: window by window."""
    seen, out = {}, {}
    for at, doc_id, part, n, words in rows:
        bits, words = 0, words.split()
        for j in range(n):
            window = tuple(words[j : j + length])
            smallest, parts = seen.setdefault(window, (doc_id, set()))
            if smallest < doc_id or part in parts:
                bits |= 1 << j
            elif smallest == doc_id:
                parts.add(part)
        out[at] = bits
    return out


def _judge(length: int):
    """The repeated windows of a shard's stretches, as bits."""

    def run(key, table):
        import pyarrow as pa

        columns = [table.column(c).to_pylist() for c in ("doc_id", "part", "first", "n", "words", "bits")]
        doc_id, part, first, n, words, bits = columns
        # rows that are equal in id and text send equal stretches
        places = {(i, p, f, w is None): r for r, (i, p, f, w) in enumerate(zip(doc_id, part, first, words, strict=True))}
        order = [places[x] for x in sorted(places)]
        parts, several = {}, set()  # ids with several texts here
        for r in order:
            if words[r] is not None and parts.setdefault(doc_id[r], part[r]) != part[r]:
                several.add(doc_id[r])
        if several:
            for r, found in _by_windows([(r, doc_id[r], part[r], n[r], words[r]) for r in order if words[r] is not None], length).items():
                bits[r] = found
        else:
            seen, numbers, automaton = set(), {}, SuffixAutomaton()
            for r in order:
                if words[r] is None:
                    continue
                if words[r] in seen:
                    bits[r] = (1 << n[r]) - 1
                    continue
                seen.add(words[r])
                statistic = automaton.feed([numbers.setdefault(w, len(numbers)) for w in words[r].split(b" ")])
                bits[r] = sum(1 << j for j in range(n[r]) if statistic[j + length - 1] >= length)
        pick = [r for r in order if bits[r]]
        return pa.table([pa.array([c[r] for r in pick], t) for c, t in zip((doc_id, part, first, bits), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "part", "first", "bits"])

    return run


def repeated_windows(df: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text", shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """doc_id, text, repeats of each row of df: repeats holds (part, first, bits): the text they belong to, a window, and which of it and those after it are repeated; first is -1 for a whole copy."""
    if not 4 <= length <= GRAM + 25:
        raise ValueError(f"length must lie between 4 and {GRAM + 25}")
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = docs.where("doc_id is not null")
    digests = materialize(named.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).distinct(), "digests")
    firsts = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"), "firsts")
    copies = join_groups(digests, firsts, ["digest"], "times").where("doc_id > first").select("doc_id", _part_column(F.col("digest")).alias("part"))
    copies = materialize(copies, "copies")

    sent = materialize(named.mapInArrow(_send_anchors(length), "anchor long, doc_id long, part long, n long"), "anchors")
    repeated = sent.groupBy("anchor").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("part").alias("low"), F.max("part").alias("high"))
    repeated = materialize(repeated.where("most > 1 or low < high").select("anchor", "n"), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-total // shard_stretches))
    hot = F.col("n") > max(64, shard_stretches // 4)
    marks = join_groups(sent.select("anchor", "doc_id"), repeated, ["anchor"], "n").groupBy("doc_id").agg(F.collect_set(F.col("anchor") + hot.cast("long")).alias("marks"))
    known = marks.join(copies.groupBy("doc_id").agg(F.collect_list("part").alias("copies")), "doc_id", "left")

    # left joins both here and below, so that one exchange of the texts can serve both
    asked = docs.join(known, "doc_id", "left").select("doc_id", "text", "marks", "copies")
    stretches = asked.mapInArrow(_send_stretches(length, shards), _STRETCH)
    found = stretches.groupBy("shard").applyInArrow(_judge(length), "doc_id long, part long, first int, bits int")
    found = found.unionByName(copies.select("doc_id", "part", F.lit(-1).alias("first"), F.lit(0).alias("bits")))
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("part", "first", "bits")).alias("repeats"))
    return docs.join(found, "doc_id", "left")


def spans(repeats: list[dict] | None, part: int, n_words: int, length: int) -> list[tuple[int, int]]:
    """The maximal spans of words to remove from a text."""
    out: list[list[int]] = []
    starts = []
    for r in repeats or ():
        if r["part"] == part:
            if r["first"] < 0:
                return [(0, n_words)] if n_words >= length else []
            starts.extend(r["first"] + j for j in range(r["bits"].bit_length()) if r["bits"] >> j & 1)
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + length
        else:
            out.append([s, s + length])
    return [(a, b) for a, b in out]


def remove_repeats(df: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (pairs of word numbers), and the kept words if asked for; one row for each row of df."""
    kept = ", kept string" if keep_text else ""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in split_batches(batches):
            out = ([], [], [], [], [])
            for body, repeats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = body.encode()
                words = body.split()
                gone = spans(repeats, _part(body) if repeats else 0, len(words), length)
                rest, at = [], 0
                for lo, hi in gone:
                    rest += words[at:lo]
                    at = hi
                rest += words[at:]
                joined = b" ".join(rest)
                for column, v in zip(out, (len(words), len(words) - len(rest), hashlib.sha256(joined).hexdigest(), [list(x) for x in gone], joined.decode()), strict=True):
                    column.append(v)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.list_(pa.int64())))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            if keep_text:
                columns.append(pa.array(out[4], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return repeated_windows(df, length, doc_id, text).mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>{kept}")
