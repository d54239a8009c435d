"""Language identification: scripts narrow the candidates, Viterbi labels the words.

Training counts byte trigrams (A-Z lower-cased; blanks, digits and ASCII marks all one
blank) of labelled texts by language, and the letters of each script (ranges of code points). Tasks send counts by
language and shard; the model is a table of a fixed size for each language.

Prediction scores every word under every language. Languages that don't use the word's script are
ruled out where others use it. A Viterbi pass over the words of a text, with a penalty for each switch of
language, labels spans; the language with most bytes is the text's, and its share is the score.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing was learned. Rows with a null language, or null texts, teach nothing. Ties go to the language first in
alphabetical order. Repeated rows are each predicted; an empty table gives no rows. Input columns are passed
through; one that has the name of a result column gets an underscore in front of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, bounded_batches, split_batches, text_buffers

#: Trigrams are hashed to so many cells; a language's model is one number for each.
CELLS = 1 << 16
SHARDS = 16
#: Each language costs CELLS * 4 bytes of the broadcast model; more languages than this are refused.
MAX_LANGUAGES = 256
#: Log-likelihood that a change of language costs.
SWITCH = 10.0
SMOOTHING = 0.5
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
for _c in range(26):
    _PLAIN[97 + _c] = _PLAIN[65 + _c] = 97 + _c
#: Scripts as ranges of code points. Blocks of the Unicode standard.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "syriac": [(0x700, 0x74F), (0x860, 0x86F)],
    "thaana": [(0x780, 0x7BF)],
    "nko": [(0x7C0, 0x7FF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "khmer": [(0x1780, 0x17FF), (0x19E0, 0x19FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "tifinagh": [(0x2D30, 0x2D7F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F)],
    "bopomofo": [(0x3100, 0x312F), (0x31A0, 0x31BF)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
    "yi": [(0xA000, 0xA4CF)],
    "gothic": [(0x10330, 0x1034F)],
    "deseret": [(0x10400, 0x1044F)],
    "adlam": [(0x1E900, 0x1E95F)],
}
N_SCRIPTS = len(SCRIPTS)
_RANGES = sorted((low, high, i) for i, ranges in enumerate(SCRIPTS.values()) for low, high in ranges)
_FIRST = np.array([low for low, _, _ in _RANGES])
_LAST = np.array([high for _, high, _ in _RANGES])
_BIT = np.array([1 << i for _, _, i in _RANGES], np.int64)


def script_bits(data: np.ndarray) -> np.ndarray:
    """The script, as one bit, of the character that starts at each byte; 0 for other bytes and for marks of no script."""
    bits = np.zeros(len(data), np.int64)
    letter = data & 0xDF
    bits[(letter >= 65) & (letter <= 90) & (data < 128)] = 1  # Latin comes first
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        wide = np.zeros(len(data) + 3, np.int64)
        wide[: len(data)] = data & 0x3F
        lead = data[at].astype(np.int64)
        two, three = wide[at + 1], wide[at + 2]
        point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | two, (lead & 0x0F) << 12 | two << 6 | three)
        point = np.where(lead < 0xF0, point, (lead & 0x07) << 18 | two << 12 | three << 6 | wide[at + 3])
        i = np.maximum(np.searchsorted(_FIRST, point, side="right") - 1, 0)
        bits[at] = np.where((point >= _FIRST[i]) & (point <= _LAST[i]), _BIT[i], 0)
    return bits


def _cells(data: np.ndarray, off: np.ndarray):
    """The trigram cell of each byte (CELLS for blanks), and where words start, by text."""
    mid = _PLAIN[data]
    before, after = np.empty_like(mid), np.empty_like(mid)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    full = np.diff(off) > 0
    before[off[:-1][full]], after[off[1:][full] - 1] = 32, 32
    key = before.astype(np.uint32) << np.uint32(16) | mid.astype(np.uint32) << np.uint32(8) | after
    cell = (key * np.uint32(2654435761)) >> np.uint32(16)
    blank = mid == 32
    cell[blank] = CELLS
    starts = np.flatnonzero(~blank & (before == 32))
    return cell, blank, starts


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (cells + 1, languages) and script sets, from all rows of df."""

    def count(batches):
        import pyarrow as pa

        cells: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in split_batches(batches, 2_000_000):
            langs = np.array(batch.column(1).to_pylist(), object)
            data, off = text_buffers(batch.column(0))
            if not len(data):
                continue
            cell, _, _ = _cells(data, off)
            owner = np.repeat(np.arange(len(langs)), np.diff(off))
            for name in set(langs):
                mine = (langs == name)[owner]
                cells[name] = cells.get(name, 0) + np.bincount(cell[mine], minlength=CELLS + 1)[:CELLS]
                used = script_bits(data[mine])
                scripts[name] = scripts.get(name, 0) + np.bincount(np.frexp(used[used > 0])[1] - 1, minlength=N_SCRIPTS)
        rows = [(name, k, part.astype("<i8").tobytes()) for name, c in cells.items() for k, part in enumerate(np.split(c, SHARDS))]
        rows += [(name, SHARDS, s.astype("<i8").tobytes()) for name, s in scripts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["lang", "shard", "counts"])

    def add(key, table):
        import pyarrow as pa

        total = np.sum([np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"lang": pa.array([key[0].as_py()]), "shard": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    bounded_batches(df.sparkSession)
    schema = "lang string, shard int, counts binary"
    taught = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = taught.mapInArrow(count, schema).groupBy("lang", "shard").applyInArrow(add, schema)
    rows = counts.collect()  # SHARDS + 1 rows for each language
    names = sorted({r["lang"] for r in rows})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} can be told apart")
    table = np.zeros((CELLS + 1, max(1, len(names))), np.float32)
    scripts = np.zeros(max(1, len(names)), np.int64)
    for j, name in enumerate(names):
        parts = {r["shard"]: np.frombuffer(r["counts"], "<i8") for r in rows if r["lang"] == name}
        seen = np.concatenate([parts[k] for k in range(SHARDS)]).astype(np.float64) + SMOOTHING
        table[:CELLS, j] = np.log(seen / seen.sum())
        kinds = parts[SHARDS]
        scripts[j] = sum(1 << i for i in range(N_SCRIPTS) if kinds[i] and kinds[i] >= SCRIPT_SHARE * kinds.sum())
    return names, table, scripts


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores: words by labels; first: number of each text's first word (len + 1). All texts advance together."""
    n, labels = scores.shape
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more than t words
    came = np.zeros(n, np.int16)
    moved = np.zeros((n, labels), bool)
    value = np.zeros((len(count), labels), np.float32)
    for t in range(longest):
        k = alive[t]
        at = begin[:k] + t
        if t:
            v = value[:k]
            best = v.argmax(axis=1)
            jump = (v[np.arange(k), best] - np.float32(switch))[:, None]
            moved[at] = jump > v
            came[at] = best
            value[:k] = np.maximum(v, jump) + scores[at]
        else:
            value[:k] = scores[at]
        value[:k] -= value[:k].max(axis=1, keepdims=True)
    out = np.zeros(n, np.int16)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        now = state[:k]
        out[at] = now
        if t:
            state[:k] = np.where(moved[at, now], came[at], now)
    return out


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = np.r_[0, np.cumsum(_PLAIN[data] != 32, dtype=np.int64)]
    plain = np.r_[0, np.cumsum((_PLAIN[data] != 32) & (data < 128), dtype=np.int64)]
    found = plain[off[1:]] > plain[off[:-1]]
    for i in np.flatnonzero(~found & (ascii_letter[off[1:]] > ascii_letter[off[:-1]])):
        found[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode()))
    return found


def identify(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", spans: bool = False, switch: float = SWITCH) -> DataFrame:
    """df plus lang_pred and score, and if asked for spans: (start, end, lang) in code points, end exclusive."""
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        made.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))))
    given, df = df.columns.index(text), aside(df, [field.name for field in made])
    text = df.columns[given]
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        names, table, scripts = shared.value
        for batch in split_batches(batches, 2_000_000, text):
            data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
            n = batch.num_rows
            pred, score = np.full(n, -1), np.zeros(n)
            found: list = [[] for _ in range(n)]
            letters = _has_letter(data, off)
            if names and len(data):
                cell, blank, starts = _cells(data, off)
            if names and len(data) and len(starts):
                scores = np.empty((len(starts), len(names)), np.float32)
                for lo in range(0, len(starts), 100_000):  # of some hundred thousand bytes at a time
                    end = starts[lo + 100_000] if lo + 100_000 < len(starts) else len(cell)
                    scores[lo : lo + 100_000] = np.add.reduceat(table[cell[starts[lo] : end]], starts[lo : lo + 100_000] - starts[lo], axis=0)
                size = np.add.reduceat((~blank).astype(np.int64), starts)
                used = np.bitwise_or.reduceat(script_bits(data), starts)
                fits = (used[:, None] & scripts[None, :]) != 0
                scores[~fits & fits.any(axis=1)[:, None]] -= 1e4
                first = np.searchsorted(starts, off)
                label = viterbi(scores, first, switch)
                owner = np.repeat(np.arange(n), np.diff(first))
                mass = np.bincount(owner * len(names) + label, weights=size, minlength=n * len(names)).reshape(n, -1)
                total = mass.sum(axis=1)
                some = letters & (total > 0)
                pred[some] = mass[some].argmax(axis=1)
                score[some] = mass[some].max(axis=1) / total[some]
                if spans:
                    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])
                    last = np.r_[new[1:], len(owner)] - 1
                    for i, a, b, w in zip(owner[new], starts[new], starts[last] + size[last], label[new], strict=True):
                        if letters[i]:
                            found[i].append({"start": int(point[a] - point[off[i]]), "end": int(point[b] - point[off[i]]), "lang": names[w]})
            columns = [*batch.columns, pa.array([names[p] if p >= 0 else UNKNOWN for p in pred], pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[m.name for m in made]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *made]))


def held_out(doc_id):
    """Rows that teach nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
