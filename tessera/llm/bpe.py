"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding, at places where the split pattern always ends a match: in front
of one space that stands between two characters other than white space. Decoding joins the raw bytes
of the ids, so that ids that cut a character are kept whole.

Defined results: null counts as empty text, which has no ids; repeated rows are encoded each; an empty
table gives no rows; other columns are passed through; one that has the name of a result column gets an underscore in front of its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts longer than this many characters are cut at safe places before they are encoded.
SPLIT_CHARS = 65_536
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CODECS: dict = {}


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[str]:
        """Pieces of text that no match of the pattern spans, each of SPLIT_CHARS or a little more where a safe place exists."""
        at = 0
        while len(text) - at > SPLIT_CHARS:
            found = _SAFE.search(text, at + SPLIT_CHARS)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= SPLIT_CHARS:
            return self.encoding.encode_ordinary(text)
        return [i for part in self.parts(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def codec(rank_file: str, pattern: str) -> Codec:
    """One for each Python worker."""
    key = (rank_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _with(df: DataFrame, text: str, made: list[tuple[str, T.DataType]], work, max_bytes: int = 8_000_000) -> DataFrame:
    import pyarrow as pa

    from .common import aside, split_batches

    given, df = df.columns.index(text), aside(df, [name for name, _ in made])
    text = df.columns[given]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in made]])

    def run(batches):
        for batch in split_batches(batches, max_bytes, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            columns = work(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[n for n, _ in made]])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str, rank_file: str, pattern: str) -> DataFrame:
    """df plus ids (array of int)."""

    def work(texts):
        import pyarrow as pa

        c = codec(rank_file, pattern)
        return [pa.array([c.encode(t or "") for t in texts], pa.list_(pa.int32()))]

    return _with(df, text, [("ids", T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, ids: str, rank_file: str, pattern: str, out: str = "decoded") -> DataFrame:
    """df plus the raw bytes of its ids; null ids give empty bytes."""
    import pyarrow as pa

    from .common import aside

    given, df = df.columns.index(ids), aside(df, [out])
    ids = df.columns[given]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([c.decode(x or []) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def round_trip_digest(df: DataFrame, text: str, rank_file: str, pattern: str) -> DataFrame:
    """df plus n_tokens, ids_sha256 and decoded_sha256: encode, decode, digest, in one pass over the texts."""

    def work(texts):
        import hashlib

        import pyarrow as pa

        c = codec(rank_file, pattern)
        counts, ids_sha, bytes_sha = [], [], []
        for t in texts:
            ids = c.encode(t or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            bytes_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]

    return _with(df, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], work)
