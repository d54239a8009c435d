"""Packing by minimum bin slack: documents' token ids become sequences of a fixed capacity.

A document longer than the capacity is cut into full windows and a remainder. The remainders and the
short documents wait in a multiset of lengths; each window takes its longest one and then the multiset
of others that a bitset subset-sum program brings closest to the capacity, its counts found by
backtracking. Windows are filled where the texts are read, so nothing is shuffled. What is left
at the end of a task is packed the same way, so a task pads little more than one window.

Ids are those of the tokenizers library's plain call on the whole text, so a special token's string is that token.

Defined results: null counts as empty text (its one token is the end id); repeated rows are packed each;
a row with a null id is packed under a null id; an empty table gives no rows; other columns are ignored.
Sequence ids are unique over the table: the task's number and a count within it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, split_batches, text_buffers
from .shingles import digests, eights, same_bytes, word_places

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that wait in a task before windows are filled down to half of them.
WAITING = 20_000
#: Chunks whose ids a worker remembers, about 60 bytes each, and bytes of chunks.
REMEMBERED, REMEMBERED_BYTES = 400_000, 8_000_000
_LETTER_CLASS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"  # letters that stay one letter under the vocabulary's normalisation
_MARK_CLASS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe
_SIMPLE = re.compile(f"[{_LETTER_CLASS}]+[{_MARK_CLASS}]*")
_PARTS = re.compile(f"[{_LETTER_CLASS}]+|[0-9]|[{_MARK_CLASS}]+")
_COMMON = re.compile(f"[{_LETTER_CLASS}0-9{_MARK_CLASS}]+")
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x0A]] = True


class ChunkEncoder:
    """Ids of whole texts, by chunks between spaces and newlines, which no token of the vocabulary spans.

    Distinct chunks are encoded by the tokenizers library, and their bytes and ids remembered. A chunk is looked up by
    a 64-bit digest and taken for the remembered one only if its bytes are the same. Chunks of common letters, digits
    and marks are encoded many at a time and told apart by the tokens that end a word.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.size, self.at, self.long = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.raw = np.zeros(0, "<u4"), np.zeros(0, np.uint8)

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(chunks)
        plain, words = [], []
        for i, c in enumerate(chunks):
            if _SIMPLE.fullmatch(c):
                plain.append(i)
                words.append(1 if c[-1].isalpha() else 2)
            elif _COMMON.fullmatch(c):
                plain.append(i)
                words.append(len(_PARTS.findall(c)))
        for at in range(0, len(plain), 200):
            some = plain[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([chunks[i] for i in some])], add_special_tokens=False)[0].ids, "<u4")
            ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(words[at : at + 200])
            if len(ends) == last[-1]:  # a special token in a chunk ends no word, and the numbers differ
                for i, lo, hi in zip(some, [0, *(cut := ends[last - 1].tolist())][:-1], cut, strict=True):
                    out[i] = ids[lo:hi]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4")
        return out

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        found = self._encode([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size, long = np.array([len(x) for x in found], np.int64), ends - starts
        start, place = len(self.pool) + np.cumsum(size) - size, len(self.raw) + np.cumsum(long) - long
        self.pool = np.concatenate([self.pool, *found])
        self.raw = np.concatenate([self.raw, data[np.arange(int(long.sum())) + np.repeat(starts - (np.cumsum(long) - long), long)]])
        at = np.searchsorted(self.hashes, hashes)  # both are in order
        pairs = ((self.hashes, hashes), (self.start, start), (self.size, size), (self.at, place), (self.long, long))
        self.hashes, self.start, self.size, self.at, self.long = (np.insert(x, at, new) for x, new in pairs)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's begin (len + 1)."""
        starts, ends, at = word_places(data, off, _BETWEEN)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        word, long = eights(data), ends - starts
        hashes = digests(word, starts, long)[0]
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED or len(self.raw) > REMEMBERED_BYTES:
            self.clear()
        near = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[near] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], data, starts[one[new]], ends[one[new]])
        place = np.searchsorted(self.hashes, distinct)[which]
        start, size, pool = self.start[place], self.size[place], self.pool
        same = self.long[place] == long
        same[same] = same_bytes(word, starts[same], eights(self.raw), self.at[place[same]], long[same])
        if not same.all():  # equal digests of different chunks: these are encoded for themselves
            odd = np.flatnonzero(~same)
            found = self._encode([data[starts[i] : ends[i]].tobytes().decode() for i in odd])
            size[odd] = [len(x) for x in found]
            start[odd] = len(pool) + np.cumsum(size[odd]) - size[odd]
            pool = np.concatenate([pool, *found])
        stop = np.cumsum(size)
        ids = pool[np.arange(int(stop[-1])) + np.repeat(start - (stop - size), size)]
        return ids, np.r_[0, stop][at]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(tokenizer_file: str) -> ChunkEncoder:
    if tokenizer_file not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[tokenizer_file] = ChunkEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def closest(lengths: list[int], waiting: dict[int, list], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to room as can be, and not over it.

    lengths: in order, with the pieces that wait of each. Longer lengths are offered first, their counts in
    powers of two; the program stops at an exact fill.
    """
    mask, reach, full = (1 << (room + 1)) - 1, 1, 1 << room
    steps = []
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        left, part = min(len(waiting[length]), room // length), 1
        while left and not reach & full:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << (length * part) & mask
            left -= part
            part *= 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


class Packer:
    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []  # that wait, in order
        self.n = 0
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        for start in range(0, total, self.capacity):
            part = ids[4 * start : 4 * (start + self.capacity)]
            piece = (doc_id, start, len(part) // 4, zlib.crc32(part), total)
            if piece[2] == self.capacity:
                self.place([piece])
            else:
                if piece[2] not in self.waiting:
                    self.waiting[piece[2]] = []
                    insort(self.lengths, piece[2])
                self.waiting[piece[2]].append(piece)
                self.n += 1
        if self.n > WAITING:
            self.fill(WAITING // 2)

    def take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.n -= 1
        return piece

    def fill(self, down_to: int) -> None:
        while self.n > down_to:
            window = [self.take(self.lengths[-1])]
            for length, count in closest(self.lengths, self.waiting, self.capacity - window[0][2]).items():
                window += [self.take(length) for _ in range(count)]
            self.place(window)


def pack(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        packer, coder = Packer(capacity, TaskContext.get().partitionId() << 33), encoder(tokenizer_file)

        def made():
            columns = zip(*packer.rows, strict=True) if packer.rows else [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            packer.rows = []
            return out

        for batch in split_batches(batches, 1_000_000):
            ids, at = coder.encode(*text_buffers(batch.column(1)))
            for i, lo, hi in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packer.add(i, ids[lo:hi].tobytes() + end)
            if len(packer.rows) > 10_000:
                yield made()
        packer.fill(0)
        yield made()
        _ENCODERS.clear()  # a reused worker would hold on to it in stages that need no tokenizer
        del coder
        give_back()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
