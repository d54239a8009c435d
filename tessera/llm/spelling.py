"""Spelling variants of words, found by Aho-Corasick automata over their halves.

Two words are near if one inserted, deleted or replaced character turns one into the other. Such an edit leaves one
half of a word as it is: the other word then begins with its first half, or ends in its second one.

1. Counts. Tasks count the words of whole texts and send each word once for so many texts.
2. Shards. Both segments of every word go to automaton shards, chosen by the segment's side, the word's length and the
   segment's outer characters. A word that is looked up visits the six shards in which a near word's segment can be.
   A key with many words is dealt over several shards by word, and its visitors over several blocks.
3. Scan. A shard's automaton finds all its segments in all words that visit; a hit counts if a first segment lies at the
   start, a second one at the end, and the lengths differ by one at most. What is left of the two words is compared through
   an index of the left parts with one character masked or dropped, so no list of words with a common segment is
   gone through; the edit is then verified on the words.
4. Only each word's number of near words and the most frequent of them leave a shard, so pairs are never written out.
5. Forms. A word's form is its most frequent near word, if that is `factor` times as frequent; roots follow the forms by joins
   that double their reach.

Defined results: null and empty texts have no words; a null id is passed on as such; repeated rows count each time.
Ties between near words go to the smallest in code-point order. Words of fewer than `min_chars` characters take no part.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, split_batches, temporary, told

#: Distinct words that a task holds before it sends their counts.
HELD_WORDS = 300_000
#: Segments of a shard, about, and words that visit one block of a shard of a hot key.
SHARD_WORDS, BLOCK_WORDS = 20_000, 100_000
#: Outer characters of a segment that choose its shard, at most.
OUTER = 3


def word_counts(df: DataFrame, pattern: str, change: Callable[[object, str], str] | None = None, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1, least: int = 1) -> DataFrame:
    """word, n: the maximal runs of pattern in texts whose A-Z are lower-cased, with their number of occurrences.

    change: gives the word to count for a word and its text's id. min_chars: shorter words are left out, after the change;
    least: rarer ones.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        runs, counts = re.compile(pattern), Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in split_batches(batches):
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body:
                    # bytes.lower() changes A-Z only
                    for word, n in Counter(runs.findall(body.encode().lower().decode())).items():
                        if len(word) >= min_chars:
                            if change:
                                word = change(i, word)
                                if len(word) < min_chars:
                                    continue
                            counts[word] += n
            if len(counts) > HELD_WORDS:
                yield flush()
        if counts:
            yield flush()

    counted = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def _masked(rest: str) -> set[str]:
    return {f"{rest[:i]}\0{rest[i + 1 :]}" for i in range(len(rest))}


def _dropped(rest: str) -> set[str]:
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


class Shard:
    """An automaton over segments of words, and for each segment an index of what is left of its words."""

    def __init__(self, words: list[tuple[str, int, int]]):
        """words: word, number of occurrences, and which of its halves (0, 1) belongs to this shard."""
        import ahocorasick

        self.automaton, self.counts, self.places = ahocorasick.Automaton(), {}, {}
        for word, n, side in words:
            self.counts[word] = n
            segment, rest = _halves(word)[side], _halves(word)[1 - side]
            if segment not in self.places:
                self.places[segment] = ({}, {})
                self.automaton.add_word(segment, segment)
            index = self.places[segment][side]
            for key in ((0, rest), *((1, x) for x in _masked(rest)), *((2, x) for x in _dropped(rest))):
                index.setdefault((len(word), *key), []).append(word)
        if self.places:
            self.automaton.make_automaton()

    def near(self, word: str) -> set[str]:
        """This shard's words one edit from word. One that both its halves find is left to the first, in its own shard."""
        found, n = set(), len(word)
        if not self.places:
            return found
        for end, segment in self.automaton.iter(word):
            heads, tails = self.places[segment]
            if end + 1 == len(segment) and heads:
                found |= self._edits(heads, word, word[len(segment) :])
            if end + 1 == n and tails:
                rest = word[: n - len(segment)]
                found |= {w for w in self._edits(tails, word, rest) if not word.startswith(_halves(w)[0])}
        return found

    @staticmethod
    def _edits(index: dict, word: str, rest: str) -> set[str]:
        n = len(word)
        keys = [(n, 1, x) for x in _masked(rest)] + [(n + 1, 2, rest)] + [(n - 1, 0, x) for x in _dropped(rest)]
        return {w for key in keys for w in index.get(key, ()) if one_edit(w, word)}


def _scan(key, table):
    """For each word that visits a shard its number of near words there, and the most frequent of them."""
    import pyarrow as pa

    held, asked = [], set()
    for word, n, side in zip(table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("side").to_pylist(), strict=True):
        if side is None:
            asked.add(word)
        else:
            held.append((word, n, side))
    shard, out = Shard(held), ([], [], [], [])
    for word in asked if held else ():
        near = shard.near(word)
        if near:
            best = min(near, key=lambda w: (-shard.counts[w], w))
            for column, value in zip(out, (word, len(near), -shard.counts[best], best), strict=True):
                column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "minus", "best"])


def near_words(words: DataFrame, min_chars: int = 2, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n, n_near, best, best_n of words (word, n; distinct and not null): how many words are near each, and the most frequent of these."""
    spark, outer = words.sparkSession, min(OUTER, max(1, min_chars // 2))
    words = materialize(words.select("word", "n").where(F.char_length("word") >= max(2, min_chars)), "words")
    shards = max(1, math.ceil(2 * words.count() / shard_words))
    size = F.char_length("word")

    def at(side: int, step: int):
        cut = F.substring("word", 1, outer) if side == 0 else F.substring("word", -outer, outer)
        return F.struct(F.lit(side).alias("side"), (size + step).alias("size"), cut.alias("outer"))

    held = words.select("word", "n", F.explode(F.array(at(0, 0), at(1, 0))).alias("key")).select("word", "n", "key.*")
    asked = words.select("word", F.explode(F.array(*(at(s, step) for s in (0, 1) for step in (-1, 0, 1)))).alias("key")).select("word", "key.*")
    key = ["side", "size", "outer"]
    hot = held.groupBy(*key).count().where(F.col("count") > shard_words).withColumnRenamed("count", "held_n")
    hot = materialize(hot, "hot")
    cold_shard = F.pmod(F.xxhash64(*key), F.lit(shards))
    if hot.isEmpty():
        held, asked = held.select("word", "n", "side", cold_shard.alias("shard")), asked.select("word", cold_shard.alias("shard"))
    else:
        # few keys: each has shard_words of all words
        visits = asked.join(F.broadcast(hot.select(*key)), key).groupBy(*key).count()
        hot = hot.join(visits, key, "left").select(*key, F.ceil(F.col("held_n") / shard_words).alias("subs"), F.ceil(F.coalesce("count", F.lit(1)) / block_words).alias("blocks"))
        hot = told(materialize(hot, "hot-keys"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "word"), F.col(n))
        own = F.xxhash64(*key, "sub", "block").alias("shard")
        hot_held = held.join(hot, key).withColumn("sub", part("subs", 1)).withColumn("block", every("blocks")).select("word", "n", "side", own)
        hot_asked = asked.join(hot, key).withColumn("block", part("blocks", 2)).withColumn("sub", every("subs")).select("word", own)
        held = held.join(hot, key, "left_anti").select("word", "n", "side", cold_shard.alias("shard")).unionByName(hot_held)
        asked = asked.join(hot, key, "left_anti").select("word", cold_shard.alias("shard")).unionByName(hot_asked)
    rows = held.unionByName(asked.select("word", F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("side"), "shard"))
    found = rows.groupBy("shard").applyInArrow(_scan, "word string, n_near long, minus long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "best")).alias("top"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("top.best").alias("best"), (-F.col("top.minus")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the chain of each word of links (word, form) ends. Chains have no circles."""
    with temporary(links.sparkSession):
        now, step = materialize(links.select("word", F.col("form").alias("root")), "roots-0"), 0
        while True:
            step += 1
            ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
            new = materialize(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
            now = new.select("word", "root")
            if new.where("moved").isEmpty():
                break
        found = materialize(now, "roots", outer=True)
    return found


def variants(words: DataFrame, factor: int = 5, min_chars: int = 2, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n).

    form: the most frequent near word, if it has at least factor times (more than once) the word's occurrences.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1: forms would go in circles")
    near = near_words(words, min_chars, shard_words, block_words)
    holds = F.col("best_n") >= factor * F.col("n")
    formed = materialize(near.select("word", "n", "n_near", F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
