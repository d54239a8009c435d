"""Runs of words, aligned tokenizers and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_llm import frame, passages
from tessera.llm import alignment, automata, queries, spelling

SF = f"{DATA}/sf0.001"
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def texts_of(spark, name="sf0.001"):
    return spark.read.parquet(f"{DATA}/{name}/documents.parquet").select("doc_id", "text").collect()


# runs of words


def removed_words(rows, length):
    """(doc_id, text): n_words, n_removed, kept_sha256 of each row, window by window."""
    places = collections.defaultdict(lambda: [None, set()])
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - length + 1) if i is not None else ():
            p = places[tuple(w[s : s + length])]
            p[0] = i if p[0] is None else min(p[0], i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone, seen = set(), set()
        for s in range(len(w) - length + 1) if i is not None else ():
            window = tuple(w[s : s + length])
            if places[window][0] < i or window in seen:
                gone |= set(range(s, s + length))
            seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def removed(df, **kw):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in automata.remove_repeats(df, **kw).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length", [7, 20])
def test_repeated_words(spark, seed, length):
    texts = passages(seed)
    df = frame(spark, texts, extra=seed == 1)
    expected = removed_words(list(enumerate(texts)), length)
    same(removed(df, length=length), expected)
    assert sum(r[2] for r in expected) > 0


def test_repeated_words_with_small_shards(spark):
    texts = passages(3, 90)
    df = frame(spark, texts)
    found = automata.repeated_windows(df, 7, shard_stretches=8).select("doc_id", "repeats").collect()
    expected = {r[0]: r[2] for r in removed_words(list(enumerate(texts)), 7)}
    for r in found:
        body = (texts[r["doc_id"]] or "").encode()
        spans = automata.spans(r["repeats"], automata._part(body), len(body.split()), 7)
        assert sum(b - a for a, b in spans) == expected[r["doc_id"]]


def test_repeated_words_with_null_and_equal_ids(spark):
    rng = random.Random(5)
    a, b, c = ([rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(40)] for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(a)), (1, " ".join(b[:20] + a)), (None, " ".join(a)), (2, " ".join(a[5:] + c + c)), (2, " ".join(c)), (3, " ".join(c[3:30])), (4, None), (None, None), (5, "")]
    rows += [(6, "x y " * 40), (7, "z\x1c" * 50), (8, " ".join(a) + " " + " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(removed(df), removed_words(rows, 20))
    assert removed(df.limit(0)) == []


def test_a_hot_passage_and_a_long_text(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = [" ".join([word() for _ in range(10)] + passage + [word() for _ in range(10)]) for _ in range(1500)]
    texts += [" ".join(word() for _ in range(60_000)), " ".join(["a", "b", "c"] * 20_000)]
    same(removed(frame(spark, texts)), removed_words(list(enumerate(texts)), 20))


def test_op11_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in texts_of(spark)]
    found = [tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in queries.op11_automata(spark, SF).collect()]
    same(found, removed_words(rows, 20))
    assert sum(r[2] for r in found) > 1000


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4))
@settings(max_examples=200, deadline=None)
def test_matching_statistics(sequences):
    fed, automaton = [], automata.SuffixAutomaton()
    for s in sequences:
        got = automaton.feed(s)
        for i in range(len(s)):
            before = [*fed, s[:i]]  # a run that ends earlier in s lies in s[:i]
            best = max((k for k in range(i + 2) if any(s[i + 1 - k : i + 1] == t[j : j + k] for t in before for j in range(len(t) - k + 1))), default=0)
            assert got[i] == best
        fed.append(s)


# aligned tokenizers


def aligned_whole(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text, without segments."""
    pair, docs, counts = alignment.Pair(*FILES), [], collections.Counter()
    for t in texts:
        groups = []
        if t:
            a = pair.first.encode(" " + t, add_special_tokens=False).ids
            b = pair.second.encode(t)
            left, right = [pair.first_bytes[i] for i in a], [pair.second_bytes[i] for i in b]
            if b"".join(left) == b"".join(right) == (" " + t).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        docs.append(groups)
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    highest = collections.Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        best = sum(counts[x] == highest[x[0]] for x in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return out


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  ", "\n", "a", " a  b\t c \n\nd  ", "x\ry;\r\nz);\r\n", "nbsp  à  b   c", "　漢字かな交じり文 ☃️ 🙂🙂", "it's we'll 1234 56.78", "a▁b", "<|endoftext|> <s> </s> <0x41> <unk>",
    "end\x1c next\x1d\n\x85 \x0b x", "ﬁ ① ﷺ", "​ ﻿ b", "aaaa" * 800, "é" * 300, "\x00 z", "word " * 400, " lead", "trail   ",
]


def test_alignment_of_odd_texts(spark):
    texts = ODD + passages(4, 40)
    rows = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.align_tokenizers(frame(spark, texts, extra=True), *FILES).collect()}
    assert [rows[i] for i in range(len(texts))] == aligned_whole(texts)


def test_alignment_in_small_chunks(spark, monkeypatch):
    texts = ODD + passages(5, 40)
    tokenizers = alignment.Pair(*FILES)
    assert " " in tokenizers.cutters and "\r" not in tokenizers.cutters
    cut = alignment.segmenter(tokenizers.cutters)
    for t in texts:
        if t:
            assert "".join(cut(" " + t)) == " " + t
            a, b = tokenizers.encode(cut(" " + t))
            assert sum(a, []) == tokenizers.first.encode(" " + t, add_special_tokens=False).ids
            assert sum(b, []) == tokenizers.second.encode(t)
    df = frame(spark, texts).repartition(7)
    df.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/aligned-texts")
    df = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/aligned-texts")
    rows = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.align_tokenizers(df, *FILES).collect()}
    assert [rows[i] for i in range(len(texts))] == aligned_whole(texts)
    assert alignment.align_tokenizers(df.limit(0), *FILES).collect() == []


def test_alignment_keeps_equal_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    rows = [(r["doc_id"], *(r[c] for c in ALIGNED)) for r in alignment.align_tokenizers(df, *FILES).collect()]
    same(rows, [(i, *x) for i, x in zip([None, 1, 1, 1], aligned_whole(["a b", "a b", "a b", "c"]), strict=True)])


@given(st.lists(st.integers(0, 2**34), max_size=20))
def test_varints(x):
    assert alignment.unvarints(alignment.varints(np.array(x, np.int64))).tolist() == x


def test_op12_whole_table(spark):
    rows = texts_of(spark)
    expected = aligned_whole([r["text"] for r in rows])
    found = [(r["doc_id"], *(r[c] for c in ALIGNED)) for r in queries.op12_alignment(spark, SF).collect()]
    same(found, [(r["doc_id"], *x) for r, x in zip(rows, expected, strict=True)])


# spelling


def edits(word, alphabet):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in alphabet} | {a + c + b for a, b in cuts for c in alphabet}
    return out - {word}


def spelt(counts, factor=5):
    alphabet = {c for w in counts for c in w}
    near = {w: sorted(edits(w, alphabet) & set(counts)) for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= factor * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


SPELT = ("word", "form", "root", "n", "n_near", "form_n")


def made_words(seed, n, alphabet="abcé"):
    rng, counts = random.Random(seed), {}
    for _ in range(n):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8)))
        counts[w] = rng.choice([1, 2, 5, 6, 30, 200, 1000])
        if rng.random() < 0.3:
            counts["prefix" + w] = rng.randrange(1, 60)
    return counts


@pytest.mark.parametrize("sizes", [(20_000, 100_000), (7, 5)])
def test_spelling_variants(spark, sizes):
    counts = made_words(sizes[0], 700)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = [tuple(r[c] for c in SPELT) for r in spelling.variants(df, 5, 2, *sizes).collect()]
    same(rows, spelt(counts))
    assert len({r[2] for r in rows if r[1] and r[2] != r[1]}) > 0  # chains of several forms
    assert spelling.variants(df.limit(0), 5, 2, *sizes).collect() == []


@given(st.text("ab", max_size=5), st.text("ab", max_size=5))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == (b in edits(a, "ab"))


def counted_words(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def test_op13_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in texts_of(spark, "sf0.01")]
    found = [tuple(r[c] for c in SPELT) for r in queries.op13_spelling(spark, f"{DATA}/sf0.01").collect()]
    same(found, spelt(counted_words(rows)))
    assert sum(r[1] is not None for r in found) > 0


def test_word_counts_of_odd_texts(spark):
    rows = [(1, "Straße ÀÉ×x ABCDEF abcdef"), (None, "abcdef " * 9), (2, None), (3, ""), (3, "ÿ" * 5000), (1, "abcdef")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit("y"))
    found = spelling.word_counts(df, "[a-zÀ-ÿ]+", queries.misspelt, min_chars=6, least=5)
    assert {r["word"]: r["n"] for r in found.collect()} == counted_words(rows)


def test_two_threads_delete_their_own_tables(spark):
    """Blocks of temporary() in two threads overlap in time; each deletes what was written inside it."""
    import threading

    from tessera.llm.common import materialize, temporary

    first, second, kept = threading.Event(), threading.Event(), []

    def run():
        with temporary(spark):
            first.wait(60)
            kept.append(materialize(spark.range(3), "inner"))
        second.set()

    other = threading.Thread(target=run)
    other.start()
    with temporary(spark):
        mine = materialize(spark.range(5), "outer")
        first.set()
        second.wait(60)
        other.join()
        assert mine.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.schema("id long").parquet(kept[0].written_to).count()
