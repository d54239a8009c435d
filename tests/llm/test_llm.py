"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.compare import same_rows
from tests.conftest import DATA
from tessera.llm import bpe, exact_dedup, jaccard, langid, packing, pii, quality, queries, shingles, substrings, topk, url_filter
from tessera.llm.common import text_buffers
from tessera.llm.components import components

SF = f"{DATA}/sf0.001"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts, extra=False):
    """Rows (doc_id, text), with columns that clash with internal names if asked for."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("n", "key", "label", "first", "f1", "bucket", "spans_", "side")}) if extra else df


def passages(seed, n=60):
    """Texts with copies, near copies, shared passages, blanks and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 6))).strip() or "z" for _ in range(120)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared, out = words(30), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = words(rng.randrange(1, 80))
        elif kind == 1:
            t = out[rng.randrange(len(out))].split()
        elif kind == 2:
            t = out[rng.randrange(len(out))].split()
            for _ in range(max(1, len(t) // 25)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind == 3:
            t = words(10) + shared + words(10)
        elif kind == 4:
            t = words(2)
        else:
            t = words(40) + words(3) * 5
        out.append(rng.choice([" ", "\n", "\t"]).join(t))
    return [*out, None, "", "   ", out[0].upper(), "a" * 500, "é" * 120, "ab" * 200]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


# --- URL filter


def test_trie_agrees_with_a_scan():
    rng = random.Random(4)
    labels, segments = ["a", "b", "com", "net"], ["", "x", "xy", "y"]
    rules = list({(rng.choice(["allow", "block"]), ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), "/" + "/".join(rng.choice(segments) for _ in range(rng.randrange(0, 3)))) for _ in range(60)})
    rules = list({(h, p): (a, h, p) for a, h, p in rules}.values())
    trie = url_filter.Trie(rules)
    for _ in range(5000):
        host, path = ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))), "/" + "/".join(rng.choice(segments) for _ in range(rng.randrange(0, 4)))
        fits = [(h.count(".") + 1, len(p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        got = trie.match(host, path)
        assert got == (max(fits, key=lambda r: r[:2]) if fits else None)


def test_url_filter_odd_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "http://net?x", "x://a.net", "http://example.net/english", "http://user@a.org/fr/", "a://b://c.net/"]
    rows = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, labels string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(rows, "url", queries.URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, None, "example.net/en/", None, None, "net/", "org/fr/", None]
    assert got[4]["host"] == "www.example.net" and got[4]["verdict"] == "allow" and got[7]["verdict"] == "block" and got[0]["host"] == "" and got[9]["host"] == "b:"
    assert url_filter.filter_urls(rows.limit(0), "url", queries.URL_RULES).count() == 0
    clash = url_filter.filter_urls(rows.withColumnRenamed("labels", "Host"), "url", queries.URL_RULES)
    assert clash.columns == ["page_id", "url", "_Host", "host", "path", "rule", "verdict"] and {r["_Host"] for r in clash.collect()} == {"c"}
    named = url_filter.filter_urls(rows.select("page_id", F.col("url").alias("path")), "path", queries.URL_RULES)
    assert named.columns == ["page_id", "_path", "host", "path", "rule", "verdict"] and named.where("rule = 'net/'").count() == 1


def test_many_rules_on_one_host():
    """Rules that end in the same segment are not scanned one by one."""
    import time

    trie = url_filter.Trie([("block", "a.com", f"/x{i}") for i in range(50_000)] + [("allow", "a.com", "/x4")])
    began = time.time()
    for i in range(2_000):
        assert trie.match("w.a.com", f"/x{i % 50_000}z/q")[2] == f"a.com/x{i}"
    assert time.time() - began < 1
    assert trie.match("a.com", "/x")is None and trie.match("a.com", "/x499999")[2] == "a.com/x49999"


def test_url_rules_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "http://a.example.net/en/q"), (2, "http://x.net/")], "page_id long, url string")
    whole = sorted(map(tuple, url_filter.filter_urls(rows, "url", queries.URL_RULES).collect()))
    monkeypatch.setattr(url_filter, "MAX_RULES_PER_TRIE", 1)
    assert sorted(map(tuple, url_filter.filter_urls(rows, "url", queries.URL_RULES).collect())) == whole


# --- packing


def test_chunk_encoder_agrees_with_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_FILE)
    texts = [*passages(1), "don't x's <|endoftext|> É́ \x1c 12 3é", "İΣΑΣ ς", "'s 'll\t\r\n 's", "ÿa! abc--def ab12cd;; ##x ß º ª ½", "日本語 テスト русский"]
    coder = packing.ChunkEncoder(WORD_FILE)
    for _ in range(2):
        ids, at = coder.encode(*text_buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def thue_morse(n):
    """Two complementary words of n letters that share every polynomial hash modulo 2^64 from n = 2048 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_built_against_polynomial_hashes(spark, n):
    from tokenizers import Tokenizer

    one, two = thue_morse(n)
    assert one != two
    tokenizer = Tokenizer.from_file(WORD_FILE)
    coder = packing.ChunkEncoder(WORD_FILE)
    ids, at = coder.encode(*text_buffers(pa.array([one, two])))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (one, two)]
    texts = [f"{one} p q r", f"{two} p q r", " ".join(one), " ".join(two)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(frame(spark, texts), 4, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_classes(texts, 4, 85).items()} and got[1] == 1


def test_chunks_with_equal_digests(monkeypatch):
    """Were all digests equal, bytes would still tell chunks apart."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "digests", lambda word, starts, sizes, salts=(0,): [np.full(len(starts), 7, np.uint64)])
    coder, tokenizer = packing.ChunkEncoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    for texts in (["one two three", "three longer-chunk-than-eight-bytes longer-chunk-than-eight-bytez"], ["two", "one"]):
        ids, at = coder.encode(*text_buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_are_the_library_s(spark):
    texts = ["<|endoftext|>", "a<|endoftext|>b c", "<|startoftext|> x <|endof text|> <|ENDOFTEXT|>", "!<|endoftext|><|endoftext|>"]
    check_packed(packing.pack(frame(spark, texts), WORD_FILE, 2).collect(), dict(enumerate(texts)))


def test_closest_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        waiting = {rng.randrange(1, 30): [None] * rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = {0}
        for length, rows in waiting.items():
            for _ in rows:
                sums |= {s + length for s in sums}
        taken = packing.closest(sorted(waiting), waiting, room)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)
        assert all(n <= len(waiting[k]) for k, n in taken.items())


def check_packed(rows, docs, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_FILE)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_sequence


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sequences = check_packed(queries.op2_packing(spark, SF).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    total = sum(r["length"] for s in sequences.values() for r in s)
    assert 4096 * len(sequences) - total <= 0.05 * total + 4096 * 8


def test_packing_odd_texts(spark):
    texts = [*passages(3, 20), "word " * 9000, None, ""]
    df = frame(spark, texts, extra=True).repartition(3)
    check_packed(packing.pack(df, WORD_FILE, 2).collect(), dict(enumerate(texts)))
    assert packing.pack(df.limit(0), WORD_FILE, 2).count() == 0


# --- language


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op3_language(spark, f"{DATA}/sf0.01").join(docs, "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() >= 0.98 * rows.count() > 0
    assert rows.where("score < 0 or score > 1").count() == 0


def test_language_odd_texts_and_spans(spark):
    taught = spark.createDataFrame([("the and of that with the", "en"), ("der die das und nicht ein", "de"), ("и не в на что он", "ru"), (None, "xx"), ("zz", None)], "text string, lang string")
    model = langid.train(taught)
    assert model[0] == ["de", "en", "ru"]
    texts = ["the and that", "nicht und das", "что не он", None, "", "123 !!!", "the that of with the and " * 6 + "nicht und der die das ein " * 6, "★★"]
    got = [tuple(r) for r in langid.identify(frame(spark, texts, extra=True).select("doc_id", "text", "label"), model, spans=True).orderBy("doc_id").collect()]
    assert [g[3] for g in got] == ["en", "de", "ru", "und", "und", "und", got[6][3], "und"]
    assert [s["lang"] for s in got[6][5]] == ["en", "de"] and got[6][5][0]["start"] == 0
    assert all(0 <= g[4] <= 1 for g in got)
    nothing = langid.train(taught.limit(0))
    assert langid.identify(frame(spark, ["abc"]), nothing).first()["lang_pred"] == "und"
    assert langid.identify(frame(spark, ["abc"]).limit(0), model).count() == 0


def test_scripts_are_ranges_of_code_points():
    for text, name in (("नमस्ते", "devanagari"), ("ภาษา", "thai"), ("ქართული", "georgian"), ("አማርኛ", "ethiopic"), ("Tiếng Việt ắ", "latin"), ("русский", "cyrillic"), ("日本", "han"), ("かな", "kana"), ("𠀋", "han"), ("한국", "hangul")):
        bits = set(langid.script_bits(np.frombuffer(text.encode(), np.uint8)).tolist()) - {0}
        assert bits == {1 << list(langid.SCRIPTS).index(name)}, text
    assert not langid.script_bits(np.frombuffer("“ — ” 12 🙂 ★".encode(), np.uint8)).any()
    ranges = sorted(r for rs in langid.SCRIPTS.values() for r in rs)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def brute_language(model, text):
    """Prediction of one text, a word at a time."""
    names, table, scripts = model
    plain = lambda b: b if b >= 128 else b | 32 if 65 <= b & 0xDF <= 90 else 32
    raw = [plain(b) for b in (text or "").encode()]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    words, now = [], []
    for i, b in enumerate([*raw, 32]):
        if b != 32:
            now.append(i)
        elif now:
            words.append(now)
            now = []
    ranges = [(lo, hi, i) for i, rs in enumerate(langid.SCRIPTS.values()) for lo, hi in rs]
    at = [0.0] * len(names)
    back, sizes = [], []
    for n, w in enumerate(words):
        scores = np.zeros(len(names), np.float32)
        for i in w:
            key = (raw[i - 1] if i else 32) << 16 | raw[i] << 8 | (raw[i + 1] if i + 1 < len(raw) else 32)
            scores = scores + table[key * 2654435761 % 2**32 >> 16]
        chars = bytes((text or "").encode()[w[0] : w[-1] + 1]).decode()
        used = {i for c in chars for lo, hi, i in ranges if lo <= ord(c) <= hi}
        fits = [any(int(s) >> i & 1 for i in used) for s in scripts]
        if any(fits):
            scores = scores - np.where(fits, 0, 1e4)
        best = int(np.argmax(at))
        back.append([best if at[best] - langid.SWITCH > at[k] and n else k for k in range(len(names))])
        at = [max(at[k], at[best] - langid.SWITCH if n else at[k]) + float(scores[k]) for k in range(len(names))]
        sizes.append(len(w))
    mass, k = [0] * len(names), int(np.argmax(at))
    for n in range(len(words) - 1, -1, -1):
        mass[k] += sizes[n]
        k = back[n][k]
    return names[int(np.argmax(mass))], max(mass) / sum(mass)


def test_language_of_whole_texts_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.select("text", "lang"))
    texts = [r["text"] for r in docs.limit(40).collect()] + ["und the и не", "नमस्ते the", "", None, "12 — ★", "der " * 30 + "the " * 30]
    got = langid.identify(frame(spark, texts), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        lang, score = brute_language(model, t)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9
    clash = langid.identify(frame(spark, texts[:3]).withColumn("Score", F.lit("mine")), model)
    assert clash.columns == ["doc_id", "text", "_Score", "lang_pred", "score"] and {r["_Score"] for r in clash.collect()} == {"mine"}
    named = langid.identify(frame(spark, ["the and"]).select("doc_id", F.col("text").alias("score")), model, text="score")
    assert named.columns == ["doc_id", "_score", "lang_pred", "score"] and named.count() == 1


def test_viterbi_against_single_texts():
    rng = np.random.default_rng(3)
    sizes = [0, 5, 1, 17, 0, 9]
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32) * 3
    first = np.r_[0, np.cumsum(sizes)]
    got = langid.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            cost = lambda path, a=a: sum(float(scores[a + i, s]) for i, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            best = [[k] for k in range(3)]
            for i in range(1, b - a):
                best = [max((p + [k] for p in best), key=cost) for k in range(3)]
            assert abs(cost(got[a:b].tolist()) - max(map(cost, best))) < 1e-3


# --- top-k


def brute_top(vectors, k=5):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(ok):
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return out


def test_topk_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vectors = {i: [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)] for i in range(160)}
    vectors |= {160: None, 161: [None] * 6, 162: [float("nan")] * 6, 163: [float("inf")] + [0.0] * 5, 164: []}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, score string").repartition(5)
    for most, rows in ((64_000_000, 4096), (100, 7)):
        monkeypatch.setattr(topk, "QUERY_BYTES", most)
        monkeypatch.setattr(topk, "CHUNK_ROWS", rows)
        monkeypatch.setattr(topk, "CELLS", 10 * rows)
        got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(vectors)
    few = df.where("vec_id in (0, 1, 2)")
    assert [r["rank"] for r in topk.top_k(few, "vec_id", "embedding", F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_topk_repeated_rows_and_large_numbers(spark):
    """Repeated candidates each count, of repeated queries the smallest vector is asked; products beyond 2^53 stay exact."""
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    asked = [128, 2304]
    want = sorted(((-sum(int(256 * x) * y for x, y in zip(v, asked, strict=True)), i) for i, v in rows if i))[:5]
    assert got == [(0, n + 1, i, -s) for n, (s, i) in enumerate(want)]
    big = [(i, [float(2**20 + i), float(2**20 - 3 * i), float(i)]) for i in range(0, 120)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") == 50).orderBy("rank").collect()]
    scored = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(v, big[50][1], strict=True)), i) for i, v in big if i != 50)[:5]
    assert got == [(50, n + 1, i, -s) for n, (s, i) in enumerate(scored)]


def test_topk_works_out_few_full_scores(spark):
    vectors = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    resolved = spark.sparkContext.accumulator(0)
    topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0, resolved=resolved).collect()
    assert 0 < resolved.value < 0.15 * vectors.count() ** 2 / 50


# --- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_against_the_expressions():
    rng = random.Random(1)
    for alphabet, n in (("ab0123@@..-+ ()%", 20000), ("0123456789 -", 4000), ("1.+@ é", 4000)):
        for _ in range(n):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            assert pii.base_spans(t) == brute_spans(t)


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" + "(" * 200_000, "a@b.c;" * 50_000, "1 " * 150_000, "a:" * 150_000, "(at)" * 80_000, "x=1.2.3.4" * 30_000):
        next(pii._scan([pa.record_batch({"doc_id": [1], "text": [t]})]))


def test_pii_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    join = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    for r in queries.op5_pii(spark, SF).collect():
        base = brute_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(join(base).split(",")) <= set(r["spans"].split(",")) or not base


def test_bootstrapping_learns_a_context(spark):
    texts = [f"call me at phone: +1 (2{i:02d}) 555-01{i:02d} now" for i in range(20)] + ["see phone: 212-555-0199 ok", "code: 212-555-0199", None, ""]
    got = {r["doc_id"]: r["found"] for r in pii.find(frame(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts) and [tuple(x) for x in got[20]] == [(3, 11, 23, True)] and got[21] == [] and got[22] == []
    assert pii.find(frame(spark, texts).limit(0)).count() == 0


def learned(spark, texts):
    """The learned spans' texts of each row."""
    return {r["doc_id"]: [(pii.KINDS[x["kind"]], texts[r["doc_id"]][x["start"] : x["end"]]) for x in r["found"] if x["learned"]] for r in pii.find(frame(spark, texts)).collect()}


def test_planted_identifiers_of_unlisted_shapes(spark):
    """Each kind taught by base identifiers; the planted ones are written as no base expression or list of shapes has them."""
    seeds = [t for i in range(12) for t in (f"write to contact: user{i}@example.org today", f"the server host={i}.20.30.4{i % 10} answered", f"paid with card no 4111 1111 1111 1111 and {i} coins" if i == 0 else f"ring tel. +44 20 7946 0{i:03d} please")]
    cards = [f"{4000000000000000 + i * 7919:016d}" for i in range(4000)]
    seeds += [f"charge visa {c} at once" for c in [c for c in cards if pii.luhn(c)][:12]]
    bad = next(c for c in cards if not pii.luhn(c))
    good = next(c for c in reversed(cards) if pii.luhn(c))
    planted = ["ask contact: jane#example.org today", "host=2001:db8::7 answered", "or tel. 55 51 23 45 67 please", "tel. 0800/123-4567", f"charge visa {good[:4]}.{good[4:8]}.{good[8:12]}.{good[12:]} now", f"charge visa {bad[:4]}.{bad[4:8]}.{bad[8:]}", "in 2024 about 300 visa and contact: nobody answered", "figure 55 51 23 45 67 stands alone"]
    got = learned(spark, [*seeds, *planted])
    found = [got[len(seeds) + i] for i in range(len(planted))]
    assert found == [[("email", "jane#example.org")], [("ip", "2001:db8::7")], [("phone", "55 51 23 45 67")], [("phone", "0800/123-4567")], [("card", f"{good[:4]}.{good[4:8]}.{good[8:12]}.{good[12:]}")], [], [], []]
    assert not any(got[i] for i in range(len(seeds)))


def test_many_unseen_instances_do_not_spoil_a_cue(spark):
    texts = [f"phone: +1 (2{i % 100:02d}) 555-0{i:03d}" for i in range(100)] + [f"phone: (212) 555-01{i:02d}" for i in range(30)] + [f"plain words phone {i} times" for i in range(50)]
    got = learned(spark, texts)
    assert all(got[100 + i] == [("phone", f"(212) 555-01{i:02d}")] for i in range(30)) and not any(got[130 + i] for i in range(50))


def test_chance_neighbours_teach_nothing(spark):
    """Ordinary words that stand beside identifiers now and then."""
    rng = random.Random(12)
    vocabulary = ["stone", "river", "green", "paper", "walk", "seven", "cloud", "table"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(12)) + rng.choice([" +1 (212) 555-0{:03d} ", " 10.0.{}.1 ", " a{}@b.com "]).format(i) + rng.choice(vocabulary) for i in range(200)]
    texts += [" ".join([rng.choice(vocabulary), f"2024-01-{i:02d}", rng.choice(vocabulary)]) for i in range(28)]
    assert not any(learned(spark, texts).values())


def test_a_second_round_learns_from_the_first(spark):
    texts = [f"phone: +1 (212) 555-0{i:03d} or" for i in range(20)] + [t for i in range(8) for t in (f"phone: 555-77{i:02d}-1", f"mobil: 555-77{i:02d}-1 .")] + ["mobil: 555-9999-1"]
    assert learned(spark, texts)[len(texts) - 1] == [("phone", "555-9999-1")]


# --- exact dedup


def test_exact_dedup_odd_texts(spark):
    texts = [*passages(5), "a b", "ab", " a\tb ", None, "\x0b\x0c"]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, texts, extra=True), capacity=3).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in enumerate(texts)}
    for i, n in norm.items():
        group = [j for j in norm if norm[j] == n]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest())
    assert exact_dedup.exact_dedup(frame(spark, texts).limit(0)).count() == 0


def test_exact_dedup_chains_deceiving_digests(spark, monkeypatch):
    """With a digest that is the same for all texts the bytes still tell them apart."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *a: F.lit("same"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, ["a", "b", "a ", "b", "c"])).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (1, 2), 3: (1, 2), 4: (4, 1)}


def test_directory_splits():
    rng = random.Random(6)
    counts = {p: rng.randrange(0, 40) for p in range(256)}
    points = exact_dedup.directory(counts, 8, 100)
    load = collections.Counter()
    for p, n in counts.items():
        load[points[p * len(points) // 256]] += n
    assert len(points) in (64, 128, 256) and max(load.values()) <= 100 and points == sorted(points) and set(points) == set(range(points[-1] + 1))
    assert exact_dedup.directory({0: 10**6}, 3, 10) == [0, 1, 2, 2, 3, 3, 3, 3]  # one hot prefix ends at the last bit
    assert exact_dedup.directory({}, 2, 10) == [0, 0]


@pytest.mark.parametrize(("hot", "few"), [(0, 10**6), (10**9, 10**6), (0, 0)])
def test_exact_dedup_keeps_one_row_of_each_group(spark, monkeypatch, hot, few):
    """Repeated rows, shared and null ids; with and without hot groups, and with keys told to all tasks or not."""
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(exact_dedup, "TOLD_ROWS", few)
    rows = [(1, "same text")] * 3 + [(None, "sametext")] * 2 + [(None, "x"), (None, "x"), (4, "x "), (9, None), (9, ""), (9, None), (None, " "), (5, "one"), (5, "two"), (6, "one"), (7, "alone")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, bytes string").repartition(3)
    got = exact_dedup.exact_dedup(df, capacity=2).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict()] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["text_sha256"]].append(r)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((i, t))
    assert set(groups) == set(want)
    for sha, found in groups.items():
        keep = min(want[sha], key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        assert sum(r["kept"] for r in found) == 1 and {(r["keep_id"], r["group_size"]) for r in found} == {(keep, len(want[sha]))}
        assert [r["doc_id"] for r in found if r["kept"]] == [keep] and sorted(map(repr, (r["doc_id"] for r in found))) == sorted(repr(i) for i, _ in want[sha])
    stay = exact_dedup.without_copies(df).collect()
    assert len(stay) == len(want) and stay[0].asDict().keys() == {"doc_id", "text", "bytes"}


# --- Jaccard join


def brute_classes(texts, width, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = SPACES.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_against_brute_force(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 3)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    texts = passages(width + 10, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, texts, extra=True), width, percent).collect()}
    assert got == brute_classes(texts, width, percent)


@pytest.mark.parametrize("hot", [0, 10**9])
def test_jaccard_in_large_neighbourhoods(spark, monkeypatch, hot):
    """Near copies of few texts, over many blocks of a few texts, some of them just under the threshold; with and without hot groups."""
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)
    rng = random.Random(77)
    bases, texts = [[f"w{rng.randrange(900)}" for _ in range(70)] for _ in range(3)], []
    bases[1] = bases[0][:35] + bases[1][:35]
    for i in range(240):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(["x", "y", f"z{i}"])
        texts.append(" ".join(t[: rng.choice([70, 70, 60])]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, texts), 4, 85).collect()}
    assert got == brute_classes(texts, 4, 85)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_classes(frame(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(rows).collect()), key=repr)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 1, None), (9, 0, 9)], key=repr)


def test_shingles_of_batches_and_single_texts():
    texts = [t or "" for t in passages(9)]
    data, off = text_buffers(pa.array(texts))
    flat, more, at = shingles.shingle_sets(data, off, 4)
    for i, t in enumerate(texts):
        one, two, _ = shingles.shingle_sets(*text_buffers(pa.array([t])), 4)
        assert one.tolist() == flat[at[i] : at[i + 1]].tolist() and two.tolist() == more[at[i] : at[i + 1]].tolist()


def _swapped(n: int) -> list[str]:
    """Two printable texts whose blocks of eight bytes, each mixed with its number and added up, agree whatever the salt."""
    from tessera.llm.common import mix64

    place = lambda k: int(mix64(np.array([k * 0x9E3779B97F4A7C15 % 2**64], np.uint64))[0])
    rng = random.Random(17)
    for i, j in ((i, j) for i in range(1, n) for j in range(i + 1, n)):
        d = (place(i) ^ place(j)).to_bytes(8, "little")
        if not any(x & 128 for x in d):
            pick = [[c for c in range(33, 127) if 33 <= c ^ x < 127 and not chr(c).isupper() and not chr(c ^ x).isupper()] for x in d]
            if all(pick):
                a, b = (bytes(rng.choice(p) for p in pick) for _ in range(2))
                one = [bytes(rng.choice(b"abcdefgh") for _ in range(8)) for _ in range(j + 1)]
                two = list(one)
                flip = lambda x: bytes(p ^ q for p, q in zip(x, d, strict=True))
                one[i], one[j], two[i], two[j] = a, b, flip(b), flip(a)
                return [b"".join(x).decode() for x in (one, two)]
    raise AssertionError("no such blocks")


def test_built_words_have_sets_of_their_own(spark):
    words = _swapped(400)
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    one, two = (shingles.digests(shingles.eights(r), np.zeros(1, np.int64), np.array([len(r)]), shingles.SALTS) for r in raw)
    assert words[0] != words[1] and [x[0] for x in one] == [x[0] for x in two]  # the digests that bytes must back
    rows = jaccard.jaccard_classes(frame(spark, words), width=4, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(0, 0), (1, 1)]


def test_texts_of_equal_xxhash64_keep_their_bytes(spark):
    pair = ["bushbkirlufjuyuvygfeveafobwnkusqaT?xT+}vqsrnihsikgsmhkthzkcbjqgp", "bushbki>lufjuyuvygfeveafobwnkusqaT?.Pk&Sqsrnihsikgsmhkthzkcbjqgp"]
    hashes = [r[0] for r in frame(spark, pair).select(F.xxhash64("text")).collect()]
    assert hashes[0] == hashes[1]
    assert [r["n_removed"] for r in substrings.remove_repeats(frame(spark, pair), 50).collect()] == [0, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_evaluate_their_edges_once(spark):
    """Edges that come out another way round at each evaluation, as a forest of links may."""

    def turn(batches):
        import os

        for pdf in batches:
            flip = [b % 2 == 1 for b in os.urandom(len(pdf))]
            yield pdf.assign(a=pdf["b"].where(flip, pdf["a"]), b=pdf["a"].where(flip, pdf["b"]))

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").mapInPandas(turn, "a long, b long")
    assert {c for _, c in components(edges).collect()} == {0}


# --- repeated substrings


def brute_repeats(rows, length=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(raw):
        for q in range(len(b) - length + 1):
            first.setdefault(b[q : q + length], i)
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            if first[b[q : q + length]] < i:
                gone[q : q + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1])), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize(("share", "least"), [(0.5, 256), (0.0, 1)])
def test_repeats_against_brute_force(spark, share, least, monkeypatch):
    """Once as it is, once with every repeated anchor dealt out string by string."""
    monkeypatch.setattr(substrings, "HOT_SHARE", share)
    monkeypatch.setattr(substrings, "HOT_LEAST", least)
    monkeypatch.setattr(substrings, "CHUNK_STRETCHES", 500)
    monkeypatch.setattr(substrings, "CHUNK_ANCHORS", 700)
    texts = passages(21, 80)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(frame(spark, texts, extra=True).repartition(3)).collect()}
    assert got == brute_repeats(enumerate(texts))


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    start = np.arange(len(data) - 50)
    order, runs = substrings.multikey(substrings.big_endian(data), start, [0, 8, 16, 24, 32, 40, 42])
    strings = [data[i : i + 50].tobytes() for i in start]
    got = [strings[i] for i in order]
    assert got == sorted(strings) and [got[i] for i in runs] == sorted(set(strings))


def test_splitters_cut_at_weights():
    pack = lambda words, weights: np.array(words, "<u8").tobytes() + np.array(weights, "<u8").tobytes()
    cuts = substrings.splitters([pack([5, 1, 9], [1, 1, 1]), pack([7], [1])], 2)
    assert cuts.tolist() == [5] and substrings.splitters([pack([5, 6], [99, 1])], 4).tolist() == [5] and not len(substrings.splitters([], 4))


def test_repeats_edges(spark):
    assert substrings.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0
    long = "x" * 20 + "the same passage of more than fifty bytes, again and again"
    rows = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long), (5, "short")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(rows).collect()), key=repr)
    assert got == sorted([(None, 0), (1, 0), (1, 0), (2, len(long)), (5, 0)], key=repr)


# --- BPE


def test_bpe_round_trip(spark, monkeypatch):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 50)
    texts = [*passages(7), "a  b   c\n\n d", " x", "日本語 テスト 🙂 e\u0301", "<|endoftext|>", "a b " * 300]
    coder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        assert coder.encode(t or "") == whole.encode_ordinary(t or "")
        assert coder.decode(coder.encode(t or "")) == (t or "").encode()
    df = frame(spark, texts).withColumn("label", F.lit(1))
    rows = bpe.decode(bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN), "ids", RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows) and len(rows) == len(texts)
    assert bpe.round_trip_digest(df.limit(0), "text", RANKS, public_tokenizers.PATTERN).count() == 0
    clash = bpe.encode(df.withColumn("IDS", F.lit(1)), "text", RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "label", "_IDS", "ids"] and {r["_IDS"] for r in clash.collect()} == {1}
    assert bpe.decode(clash.withColumn("Decoded", F.lit(2)), "ids", RANKS, public_tokenizers.PATTERN).columns[-2:] == ["_Decoded", "decoded"]


# --- quality


def test_quality_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    bigrams, rows = quality.shares(docs)
    model = quality.Model(bigrams, [tuple(r)[1:] for r in rows.collect()])
    context = np.frombuffer(b" the", np.uint8).astype(np.uint64)
    head = sum(int(c) << (8 * (3 - i)) for i, c in enumerate(context)) << 8
    total = np.exp(model.log_prob(np.array([head | c for c in range(256)], np.uint64))).sum()
    assert abs(total - 1) < 1e-3
    unseen = np.exp(model.log_prob(np.array([0xFEFEFEFE00 | c for c in range(256)], np.uint64))).sum()
    assert abs(unseen - 1) < 1e-3


def test_quality_with_any_number_of_shards(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    few, many = ({r["doc_id"]: r["perplexity"] for r in quality.classify(docs, labels, shards=n).collect()} for n in (64, 4096))
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-9 for i in few if few[i] is not None)
    assert [quality.shards_for(n) for n in (0, 10**9, 10**10, 10**14)] == [64, 64, 1024, 65536]


def test_quality_keeps_clean_and_drops_junk(spark):
    rows = queries.op7_quality(spark, f"{DATA}/sf0.01")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    assert rows.count() == docs.count()
    judged = rows.join(labels, "doc_id")
    assert judged.where("quality = 1 and not kept").count() <= 0.01 * judged.where("quality = 1").count()
    assert judged.where("quality = 0 and not kept").count() >= 0.7 * judged.where("quality = 0").count()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, None, "en"), (3, "", None), (None, "xyz", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert abs(got[1]["perplexity"] - 256) < 1e-6 and got[1]["kept"] and not got[2]["kept"] and got[3]["perplexity"] is None and got[None]["kept"]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_values_of_hot_keys(spark, monkeypatch):
    from tessera.llm import common

    rows = spark.createDataFrame([("en", i) for i in range(9)] + [("de", 9), (None, 10), ("xx", 11), ("yy", 12), ("yy", 13)], "lang string, i int")
    values = spark.createDataFrame([("en", 1.0), ("de", 2.0)], "lang string, own double")
    want = sorted(map(repr, (tuple(r) for r in rows.join(values, "lang", "left").select("lang", "i", "own").collect())))
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    for told in (10, 0):
        monkeypatch.setattr(quality, "TOLD_ROWS", told)
        assert sorted(map(repr, (tuple(r) for r in quality.by_key(rows, values, "lang").select("lang", "i", "own").collect()))) == want


def brute_kneser_ney(trusted, text, order=5):
    """Perplexity of text's bytes under interpolated modified Kneser-Ney, straight from the definitions."""
    fold = lambda t: bytes(b + 32 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in t.encode())
    counts = {order: collections.Counter()}
    for t in trusted:
        raw = b"\n" * (order - 1) + fold(t)
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def cut(n):
        kinds = collections.Counter(min(c, 5) for c in counts[n].values())
        if not (kinds[1] and kinds[2] and kinds[3]):
            return [0, 0.5, 0.75, 0.75]
        y = kinds[1] / (kinds[1] + 2 * kinds[2])
        raw = [1 - 2 * y * kinds[2] / kinds[1], 2 - 3 * y * kinds[3] / kinds[2], 3 - 4 * y * kinds[4] / kinds[3]]
        return [0, *[min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]]

    d = {n: cut(n) for n in range(2, order + 1)}
    followers = {n: collections.defaultdict(list) for n in range(2, order + 1)}
    for n in followers:
        for g, c in counts[n].items():
            followers[n][g[:-1]].append(c)
    singles = sum(counts[1].values())

    def probability(g):
        if len(g) == 1:
            return (counts[1][g] + 0.5) / (singles + 128)
        n, after = len(g), followers[len(g)][g[:-1]]
        if not after:
            return probability(g[1:])
        c = counts[n][g]
        freed = sum(d[n][min(x, 3)] for x in after) / sum(after)
        return (c - d[n][min(c, 3)]) / sum(after) + freed * probability(g[1:])

    raw = b"\n" * (order - 1) + fold(text)
    logs = [np.log(probability(raw[i : i + order])) for i in range(len(raw) - order + 1)]
    return float(np.exp(-np.mean(logs)))


def test_quality_against_brute_force(spark):
    """Perplexities, thresholds and decisions of a small table, straight from the definitions."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))) for _ in range(70)] + ["qx zz 99 QX", "é ü", "", None]
    langs = ["en" if i % 3 else "de" for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(70)] + [(0, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    half = {r["doc_id"]: r["half"] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()}
    trusted = [i for i in range(70) if i % 2 == 0]
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, quantile=0.5, slack=1.1).collect()}
    want = {i: brute_kneser_ney([texts[j] for j in trusted if half[j] != half[i]], t) for i, t in enumerate(texts) if t}
    assert all(abs(got[i]["perplexity"] / w - 1) < 1e-4 for i, w in want.items()) and got[72]["perplexity"] is None and not got[73]["kept"]

    def middle(ids):
        values = sorted(got[i]["perplexity"] for i in ids)
        return 1.1 * values[(len(values) + 1) // 2 - 1]

    general, own = middle(trusted), {x: middle([i for i in trusted if langs[i] == x]) for x in ("en", "de")}
    for i in want:
        threshold = max(general, own[langs[i]])  # fewer than 50 trusted texts
        assert abs(got[i]["threshold"] - threshold) < 1e-9 and got[i]["kept"] == (got[i]["perplexity"] <= threshold) and got[i]["trusted"] == (i in trusted)


def test_quality_keeps_every_ngram(spark):
    """More distinct n-grams than any bound on a model in memory once was; shards answer as the whole model does."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    texts = [letters[rng.integers(0, 27, 50_000)].tobytes().decode() for _ in range(60)]
    docs = frame(spark, texts).repartition(4)
    bigrams, rows = quality.shares(docs)
    model = quality.Model(bigrams, [tuple(r)[1:] for r in rows.collect()])
    grams = [quality._grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    assert len(model.levels[5][0]) == len(np.unique(np.concatenate(grams))) > 2_000_000
    asked = frame(spark, [*texts[:3], "", None, "Unseen 12 \u00e9"]).withColumn("half", (F.col("doc_id") % 2).cast("int"))
    none = quality.shares(docs.limit(0))
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexity(asked, [(bigrams, rows), none]).collect()}
    for i in (0, 2):
        assert abs(got[i] / np.exp(-model.log_prob(grams[i]).mean()) - 1) < 1e-5
    assert abs(got[1] - 256) < 1e-3 and abs(got[5] - 256) < 1e-3 and got[3] is None and got[4] is None


# --- every operator on long texts, repeated rows, nulls, empty tables and clashing columns

LONG = ["word " * 60_000, "x" * 300_000, "".join(chr(97 + i * i % 26) + (" " if i % 7 == 0 else "") for i in range(200_000)), "1 2 " * 50_000]
OWN_NAMES = ("n", "key", "bucket", "label", "first", "found", "row", "at", "others", "slice", "half", "lang_pred", "ids", "host")


def on_rows(name, df):
    """An operator's result with the id of each row."""
    model_free = {
        "packing": lambda: packing.pack(df, WORD_FILE, 2).groupBy("doc_id").agg(F.countDistinct("doc_tokens").alias("kinds"), F.sum("length").alias("tokens")),
        "language": lambda: langid.identify(df, langid.train(df)).select("doc_id", "lang_pred", "score"),
        "pii": lambda: pii.digest(df),
        "exact": lambda: exact_dedup.exact_dedup(df).drop("kept"),
        "quality": lambda: quality.classify(df, df.select("doc_id", F.lit(1).alias("quality"))),
        "jaccard": lambda: jaccard.jaccard_classes(df),
        "repeats": lambda: substrings.remove_repeats(df),
        "bpe": lambda: bpe.round_trip_digest(df.select("doc_id", "text"), "text", RANKS, public_tokenizers.PATTERN).drop("text"),
    }
    return model_free[name]()


@pytest.mark.parametrize("name", ["packing", "language", "pii", "exact", "quality", "jaccard", "repeats", "bpe"])
def test_long_texts_and_repeated_rows(spark, name):
    """Rows that are repeated get equal results, whole long texts go through, and columns of any name or null values are no hindrance."""
    texts = [*LONG, "a short text of some words", "", None]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], rows[4], (None, "a text without an id", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(None).cast("string") for c in OWN_NAMES}).repartition(3)
    got = on_rows(name, df)
    assert on_rows(name, df.limit(0)).columns == got.columns
    by_id = collections.defaultdict(set)
    counts = collections.Counter()
    for r in got.collect():
        by_id[r["doc_id"]].add(tuple(r))
        counts[r["doc_id"]] += 1
    assert set(by_id) == {*range(len(texts)), None}
    assert all(len(by_id[i]) == 1 for i in range(len(texts)))
    if name == "packing":
        assert all(k == 1 for i, (x,) in ((i, by_id[i]) for i in range(len(texts))) for k in [x[1]])
        return
    assert counts[4] == 3 and counts[0] == 2 and counts[None] == 2
    first = lambda i: next(iter(by_id[i]))
    if name == "bpe":
        assert first(1)[3] == hashlib.sha256(LONG[1].encode()).hexdigest()
    if name == "repeats":
        assert [first(i)[1] for i in range(4)] == [len(t) for t in LONG]
    if name == "exact":
        assert first(1)[3] == hashlib.sha256(LONG[1].encode()).hexdigest() and first(5)[2] == 3
    if name == "jaccard":
        words = [t.split() for t in LONG]
        assert [first(i)[1] for i in range(4)] == [len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) for w in words]


# --- pipeline


def test_pipeline_against_single_steps(spark):
    import corpus_pipeline as P

    texts = ["the first text of them all, with a mail to a.b@example.com in it", "the first text of them all,  with a mail to a.b@example.com in it", None, "12345 !!!", " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(60) if i != 30) + " more", "phone +1 (212) 555-0100 or 10.0.0.1 here"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    sizes = []
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        sizes.append(sorted(r["doc_id"] for r in kept.collect()))
    assert sizes == [[0, 1, 4, 5, 6], [1, 4, 5, 6], sizes[2], sizes[2]]
    classes = brute_classes([texts[i] for i in sizes[1]], 5, 80)
    assert sizes[2] == [i for n, i in enumerate(sizes[1]) if classes[n][1] == n]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert text[1][0] == "the first text of them all,  with a mail to [email] in it" and text[1][1] == len(text[1][0])
    assert text[6][0] == "phone [phone] or [ip] here"
    check_packed(P.STAGES[-1][1](spark, kept, "").collect(), {i: t for i, (t, _) in text.items()})


def test_redaction_is_by_row(spark):
    """Rows without an id lose their personal data too; rows that share one keep to their own spans."""
    import corpus_pipeline as P

    texts = [(None, "write to a.b@example.com now"), (None, "or to 10.0.0.1, please"), (None, None), (7, "mail c@example.org"), (7, "clean text that has nothing in it"), (7, "mail c@example.org"), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.redact(spark, docs, "")
    assert rows.schema == docs.schema
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in rows.collect()))
    clean = ["", "or to [ip], please", "write to [email] now"], ["clean text that has nothing in it", "mail [email]", "mail [email]"], [""]
    assert got == [(i, t, len(t)) for i, ts in zip((0, 7, 8), clean) for t in ts]


def test_pipeline_whole_result_against_brute_force(spark, tmp_path):
    """Every stage of run() by plain Python on a small table: which rows stay, their redacted texts and their tokens."""
    import corpus_pipeline as P

    rng = random.Random(41)
    own = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500").limit(50).collect()]
    texts = [*own, *[t for t in passages(5, 30)], None, "", "12 34", *[own[i] for i in (3, 4)], *[own[i].replace(" ", "  ") for i in (5, 6)]]
    for i in (7, 8, 9):
        w = own[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"mail u{i}@example.org or +1 (212) 555-01{i:02d} or 10.0.0.{i} about {rng.random()}" for i in range(6)]
    docs = spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    groups = collections.defaultdict(list)
    for i in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", texts[i])].append(i)
    kept = sorted(min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values())
    classes = brute_classes([texts[i] for i in kept], 5, 80)
    kept = [i for n, i in enumerate(kept) if classes[n][1] == n]

    def redact(t):
        out, at = "", 0
        for a, b, kind in sorted((a, b, pii.KINDS.index(k)) for k, a, b in brute_spans(t)):
            out += t[at : max(at, a)] + (f"[{pii.KINDS[kind]}]" if a >= at else "")
            at = max(at, b)
        return out + t[at:]

    sequences = check_packed(P.run(spark, str(tmp_path)).collect(), {i: redact(texts[i]) for i in kept})
    assert len(kept) < len(texts) - 8 and sequences


CLASHES = ("found", "kept_id", "gone", "row", "others", "at", "key", "lang_pred", "score", "n", "component", "bytes")


def test_pipeline_stages_on_odd_rows(spark):
    """Null and shared ids, repeated rows, null texts, empty tables and columns of the stages' own names."""
    import corpus_pipeline as P

    long = " ".join(f"word{i}" for i in range(60))
    near = long.replace("word30", "other")
    rows = [(1, long), (1, long), (1, "a text of its own that shares an id"), (None, near), (None, near), (7, "mail a.b@example.com to me"), (None, "mail a.b@example.com to you"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in CLASHES})
    kept = docs
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        assert kept.select(*CLASHES).distinct().count() == 1, name
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect()))
    assert got == [(False, 1, "a text of its own that shares an id"), (False, 1, long), (False, 7, "mail [email] to me"), (True, 0, "mail [email] to you")]
    assert P.STAGES[-1][1](spark, docs.limit(0), "").count() == 0 and P.STAGES[-1][1](spark, docs, "").count() == len(rows)


def test_pipeline_runs_on_documents(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
