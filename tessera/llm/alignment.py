"""Alignment of two tokenizers over the distinct segments of a corpus.

Texts are cut into segments before runs of white space, where no token of either vocabulary can reach across; so each
distinct segment is tokenised and aligned once, whatever the number of texts that hold it.

Why such a cut is safe. The cut lies between a character that is no white space and one of the white-space characters for which
`cutters` has looked through both vocabularies: no entry of either has such a pair of characters inside, so no merge crosses the
cut. The byte-level tokenizer's own pattern also ends a match there, and looks ahead only from white space, which a segment
holds whole. The second tokenizer puts a space before what it encodes: a segment's leading space is left to it, and before other
white space the lone space piece that it adds is dropped again (no entry joins the two, which `cutters` checks as well).

1. Chunks. Tasks cut chunks of texts into segments and number a chunk's distinct segments; a text is a list of their numbers.
2. Distinct segments. All chunks' segments meet by their text; equal ones follow each other and are tokenised and aligned once.
   The alignments return to their chunks.
3. Texts are composed of their segments' alignments. A chunk tells in how many of its texts it has each pair of linked ids, and
   keeps each text's pairs as numbers.
4. Counts of the pairs over the corpus return to the chunks, and each text's links are scored.

Defined results: a null or empty text, or one whose tokens' bytes differ from a space and the text in either tokenizer, has no
tokens: zeros and an empty string; it counts in no pair. Null ids are kept; rows of equal id and repeated rows are texts
of their own. An empty table gives no rows; other columns are ignored. df is read twice and must give its rows in the same order both times, as
written tables do; a chunk that doesn't find its segments again raises an error.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_groups, materialize, split_batches
from .jaccard import _planes, _unplanes

#: Characters of a chunk of texts, about, and texts of it.
CHUNK_CHARS, CHUNK_DOCS = 40_000_000, 50_000
#: White space that may start a segment, if the vocabularies allow it.
WHITE = " \n\t\r"
#: Segments that go through the tokenizers together.
BATCH = 2000


def _byte_table() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others counted from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Pair:
    """The two tokenizers: ids of texts, and each id's bytes."""

    def __init__(self, first_file: str, second_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_file)
        table, vocabulary = _byte_table(), self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.first_bytes[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()
        self.second_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.second_bytes.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        self.cutters = self._cutters()

    def _cutters(self) -> str:
        """The white-space characters before which any text may be cut after a character that is no white space."""
        out = []
        for c in WHITE:
            byte, crossed = c.encode(), False
            for entry in self.first_bytes + self.second_bytes:
                at = entry.find(byte, 1)
                while at > 0 and not crossed:
                    before = entry[:at].decode("utf-8", "replace")[-1:]
                    crossed = not before.isspace()
                    at = entry.find(byte, at + 1)
            if c != " ":
                crossed |= any(b" " + byte in entry for entry in self.second_bytes)
            if not crossed:
                out.append(c)
        return "".join(out)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments, which begin with white space."""
        first = [e.ids for e in self.first.encode_batch(segments, add_special_tokens=False)]
        second = self.second.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return first, [ids if s[0] == " " else ids[1:] for s, ids in zip(segments, second, strict=True)]

    def align(self, segments: list[str]) -> list[str | None]:
        """Each segment's groups as `a1,a2|b1;a3|b2`; none if the bytes of its tokens differ from it."""
        out = []
        for segment, a, b in zip(segments, *self.encode(segments), strict=True):
            raw = segment.encode()
            mine, other = [self.first_bytes[i] for i in a], [self.second_bytes[i] for i in b]
            if b"".join(mine) != raw or b"".join(other) != raw:
                out.append(None)
                continue
            ends = {0}
            total = 0
            for x in mine:
                total += len(x)
                ends.add(total)
            groups, j, end, other_end, left = [], 0, 0, 0, []
            for i, x in zip(a, mine, strict=True):
                end += len(x)
                left.append(i)
                right_from = j
                k, reach = j, other_end
                while k < len(b) and reach < end:
                    reach += len(other[k])
                    k += 1
                if reach == end:
                    groups.append(f"{','.join(map(str, left))}|{','.join(map(str, b[right_from:k]))}")
                    j, other_end, left = k, reach, []
            out.append(";".join(groups))
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(first_file: str, second_file: str) -> Pair:
    """The tokenizers, loaded once in a worker."""
    if (first_file, second_file) not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[first_file, second_file] = Pair(first_file, second_file)
    return _PAIRS[first_file, second_file]


def segmenter(cutters: str):
    """Cuts a text that begins with a space before runs of white space that begin with a cutter."""
    if not cutters:
        return lambda text: [text]
    # a run of white space before which no cut is safe goes on with the segment, as does one at the end
    found = re.compile(rf"\s*\S+(?:(?![{re.escape(cutters)}])\s+\S+)*(?:\s+\Z)?").findall
    return lambda text: found(text) or [text]


def _chunks(files: tuple[str, str], texts: bool):
    """texts: each text as numbers of its chunk's segments, and a check of these; else: the distinct segments of each chunk with theirs."""

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        cut = segmenter(pair(*files).cutters)
        base, seq = TaskContext.get().partitionId() << 24, 0
        index, chars, docs, id_type = {}, 0, 0, pa.null()

        def ended():
            check = zlib.crc32("\0".join(index).encode())
            n = len(index)
            if texts:  # a last row of the chunk
                columns = [pa.nulls(1, id_type), pa.array([base + seq], pa.int64()), pa.nulls(1, pa.binary()), pa.array([check], pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk", "codes", "check"])
            columns = [pa.array(list(index), pa.string()), pa.array(np.full(n, base + seq, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, check, np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["segment", "chunk", "number", "check"])

        for batch in split_batches(batches):
            ids, codes, chunks, id_type = batch.column(0), [], [], batch.column(0).type
            for body in batch.column(1).to_pylist():
                if chars > CHUNK_CHARS or docs >= CHUNK_DOCS:
                    if index:
                        yield ended()
                    index, chars, docs, seq = {}, 0, 0, seq + 1
                numbers = [index.setdefault(s, len(index)) for s in cut(f" {body}")] if body else []
                codes.append(_planes(np.array(numbers, np.uint64), 3))
                chunks.append(base + seq)
                chars, docs = chars + len(body or ""), docs + 1
            if texts:
                yield pa.RecordBatch.from_arrays([ids, pa.array(chunks, pa.int64()), pa.array(codes, pa.binary()), pa.nulls(len(codes), pa.int64())], names=["doc_id", "chunk", "codes", "check"])
        if index:
            yield ended()

    return run


def _align(files: tuple[str, str]):
    """Equal segments follow each other: one tokenisation for all of them."""

    def run(batches):
        import pyarrow as pa

        tokenizers, known, known_groups = pair(*files), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = part.column(0).to_pylist()
                new = [s for k, s in enumerate(rows) if s != (rows[k - 1] if k else known)]
                found = iter(tokenizers.align(new) if new else [])
                groups = []
                for s in rows:
                    if s != known:
                        known, known_groups = s, next(found)
                    groups.append(known_groups)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(groups, pa.string())], names=["chunk", "number", "check", "groups"])

    return run


def varints(x: np.ndarray) -> bytes:
    """Numbers below 2^35 in seven bits a byte, low bits first; the high bit says that more follow."""
    x = x.astype(np.uint64)
    cells = np.stack([(x >> np.uint64(7 * k)) & np.uint64(127) for k in range(5)], 1).astype(np.uint8)
    size = 1 + sum((x >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    place = np.arange(5)
    cells |= np.where(place < (size - 1)[:, None], 128, 0).astype(np.uint8)
    return cells[place < size[:, None]].tobytes()


def unvarints(raw: bytes) -> np.ndarray:
    cells = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(cells < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    nth = np.arange(len(cells)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((cells & 127).astype(np.int64) << 7 * nth, first) if len(first) else np.zeros(0, np.int64)


_COMPOSED = "chunk long, row int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, number int, a int, b int, docs long"


def _compose(id_name: str):
    """A row is a text with its figures and pairs (steps between their numbers, and how often), or a pair of the chunk with the number of texts that hold it."""

    def run(key, texts, segments):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        checks = {*texts.column("check").drop_null().to_pylist(), *segments.column("check").to_pylist()}
        if len(checks) > 1:
            raise ValueError("the texts came in another order when they were read again: write them to a table first")
        texts = texts.filter(pc.is_valid(texts.column("codes")))
        groups = [None] * segments.num_rows
        for k, g in zip(segments.column("number").to_pylist(), segments.column("groups").to_pylist(), strict=True):
            groups[k] = g
        index, pairs, figures, starts = {}, [], [], [0]
        for g in groups:
            n_a = n_b = n_groups = n_links = 0
            for group in g.split(";") if g is not None else ():
                n_groups += 1
                if "," not in group:  # one token on each side: the group is the pair
                    n_a, n_b, n_links = n_a + 1, n_b + 1, n_links + 1
                    pairs.append(index.setdefault(group, len(index)))
                    continue
                left, right = (x.split(",") for x in group.split("|"))
                n_a, n_b, n_links = n_a + len(left), n_b + len(right), n_links + len(left) * len(right)
                pairs.extend([index.setdefault(f"{x}|{y}", len(index)) for x in left for y in right])
            figures.append((n_a, n_b, n_groups, n_links))
            starts.append(len(pairs))
        figures = np.array(figures, np.int64).reshape(-1, 4)
        pairs, starts = np.array(pairs, np.int64), np.array(starts)
        size = np.diff(starts)
        docs_of = np.zeros(len(index), np.int64)
        bad = np.array([g is None for g in groups], bool)
        ids = texts.column(id_name)
        rows = ([], [], [], [], [], [])
        for raw in texts.column("codes").to_pylist():
            code = _unplanes(raw, 3).astype(np.int64)
            if not len(code) or bad[code].any():
                values = (0, 0, 0, 0, "", b"")
            else:
                n = size[code]
                of = np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held, times = np.unique(pairs[of], return_counts=True)
                docs_of[held] += 1
                digest = hashlib.sha256(";".join([groups[c] for c in code.tolist()]).encode()).hexdigest()
                values = (*figures[code].sum(0).tolist(), digest, varints(np.stack([np.diff(held, prepend=0), times], 1).ravel()))
            for column, v in zip(rows, values, strict=True):
                column.append(v)
        chunk, m, p = key[0].as_py(), texts.num_rows, len(index)
        none = lambda t, k: pa.nulls(k, t)
        a, b = (pa.array([int(x.split("|")[k]) for x in index], pa.int32()) for k in (0, 1))
        both = {
            "chunk": (pa.array([chunk] * m, pa.int64()), pa.array([chunk] * p, pa.int64())),
            id_name: (ids, none(ids.type, p)),
            "row": (pa.array(range(m), pa.int32()), none(pa.int32(), p)),
            **{c: (pa.array(v, pa.int64()), none(pa.int64(), p)) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), rows, strict=False)},
            "groups_sha256": (pa.array(rows[4], pa.string()), none(pa.string(), p)),
            "held": (pa.array(rows[5], pa.binary()), none(pa.binary(), p)),
            "number": (none(pa.int32(), m), pa.array(range(p), pa.int32())),
            "a": (none(pa.int32(), m), a),
            "b": (none(pa.int32(), m), b),
            "docs": (none(pa.int64(), m), pa.array(docs_of, pa.int64())),
        }
        return pa.table({name: pa.chunked_array([*(x.chunks if isinstance(x, pa.ChunkedArray) else [x]), y]) for name, (x, y) in both.items()})

    return run


def _score(id_name: str):
    def run(key, texts, pairs):
        import pyarrow as pa

        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        number = pairs.column("number").to_numpy()
        count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
        sums, bests = [], []
        for raw in texts.column("held").to_pylist():
            steps = unvarints(raw).reshape(-1, 2)
            at, times = np.cumsum(steps[:, 0]), steps[:, 1]
            sums.append(int((count[at] * times).sum()))
            bests.append(int((best[at] * times).sum()))
        names = [id_name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        made = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({n: made.get(n) if n in made else texts.column(n) for n in names})

    return run


def segment_alignments(df: DataFrame, first_file: str, second_file: str, text: str = "text") -> DataFrame:
    """segment, groups of the distinct segments of df's texts (a leading space included): the general form of what op12 composes."""
    bounded_batches(df.sparkSession)
    files = (first_file, second_file)
    sent = df.select(F.lit(0).alias("id"), F.col(text).alias("text")).mapInArrow(_chunks(files, texts=False), "segment string, chunk long, number int, check long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pair(*files).align(rows), pa.string())], names=["segment", "groups"])

    return sent.select("segment").distinct().mapInArrow(run, "segment string, groups string")


def align_tokenizers(df: DataFrame, first_file: str, second_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and for each text n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; first_file: a byte-level tokenizer of the tokenizers library, second_file: a sentencepiece model."""
    bounded_batches(df.sparkSession)
    files = (first_file, second_file)
    id_type = df.select(doc_id).schema[0].dataType.simpleString()
    own = "doc_id"
    docs = df.select(F.col(doc_id).alias(own), F.col(text).alias("text"))
    texts = docs.mapInArrow(_chunks(files, texts=True), f"{own} {id_type}, chunk long, codes binary, check long")
    sent = docs.mapInArrow(_chunks(files, texts=False), "segment string, chunk long, number int, check long")
    aligned = sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(_align(files), "chunk long, number int, check long, groups string")
    schema = _COMPOSED.replace("row int", f"{own} {id_type}, row int")
    composed = materialize(texts.groupBy("chunk").cogroup(aligned.groupBy("chunk")).applyInArrow(_compose(own), schema), "composed")

    told = composed.where("number is not null").select("chunk", "number", "a", "b", "docs")
    counts = materialize(told.groupBy("a", "b").agg(F.sum("docs").alias("count"), F.count("*").alias("chunks")), "counts")
    # one row for each id of the first vocabulary, which is no larger than its file
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"), "chunks")
    scored = join_groups(told.select("chunk", "number", "a", "b"), counts, ["a", "b"], "chunks").select(F.col("chunk").alias("of"), "number", "count", F.col("best").cast("int").alias("best"))
    whole = composed.where("number is null").drop("number", "a", "b", "docs", "row")
    out = f"{own} {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = whole.groupBy("chunk").cogroup(scored.groupBy("of")).applyInArrow(_score(own), out)
    return found.withColumnRenamed(own, doc_id) if doc_id != own else found
