"""Containment, vector search and phrases against plain comparison with everything."""

import os
import random
import re
import zlib

import numpy as np
import pytest

from tests.conftest import DATA
from tests.plain import average_linkage, phrase_similarity
from tessera.operators import containment, phrases, vectors
from tessera.plans.dialect import SPARK
from tessera.plans.registry import run_sql


@pytest.mark.parametrize("sizes", [{}, {"told_chars": 0}, {"told_chars": 0, "gram": 2, "shard_names": 3, "block_texts": 4}])
def test_contained_names(spark, sizes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé☃") for _ in range(rng.randrange(1, 4)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "ab" * 3000)]
    names = {" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(150)} | {"a", "b", "ab", "ab ab", "z", "a%", "_b", "nothing like it", texts[3][1]}
    left = spark.createDataFrame([(n,) for n in names] * 2 + [(None,), ("",)], "name string")
    right = spark.createDataFrame(texts, "text_id long, text string")
    got = [tuple(r) for r in containment.contained_names(left, right, **sizes).collect()]
    assert sorted(got) == sorted((n, i) for n in names for i, t in texts if t and n in t)
    assert max(sum(n == name for n, _ in got) for name in names) > 20  # names and texts overlap in many ways
    assert containment.contained_names(left.limit(0), right, **sizes).collect() == []
    assert containment.contained_names(left, right.limit(0), **sizes).collect() == []


def test_names_of_several_automata(spark):
    """Names are told in parts, each an automaton of its own, and every text is read by all of them."""
    names = [f"{a}{b}" for a in "abcd" for b in ("", "x", "yz", "☃")]
    texts = [(i, " ".join(names[i : i + 3])) for i in range(len(names))]
    left, right = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(texts, "text_id long, text string")
    got = sorted(tuple(r) for r in containment.contained_names(left, right, automaton_chars=5).collect())
    assert got == sorted((n, i) for n in names for i, t in texts if n in t)
    parts = containment.slices([*names, "q" * 9], 5)
    assert sorted(sum(parts, [])) == sorted([*names, "q" * 9]) and len(parts) > 5 and all(len("".join(p)) <= 5 or len(p) == 1 for p in parts)
    assert containment.slices([], 5) == [[]]


def made_vectors(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, size))
    x[5] = x[4]  # a tie
    return x


def brute(x, ids, queries, k):
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    at = {i: r for r, i in enumerate(ids)}
    out = {}
    for q in queries:
        scores = sorted(((-round(float(unit[at[q]] @ unit[r]), 6), i) for i, r in at.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def test_vector_search(spark, monkeypatch):
    x = made_vectors(1500, 24, 3)
    ids = list(range(10, 1510))
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    odd = [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0] * 23), (5, [float("nan")] * 24), (6, [None] * 24)]
    df = spark.createDataFrame(rows + odd, "id long, vector array<double>")
    cells = vectors.fit(df)
    indexed = vectors.index(df, cells)
    assert indexed.count() == 1500
    queries = df.where("id % 15 = 0 or id < 7").selectExpr("id AS query_id", "vector")
    want = brute(x, ids, [i for i in ids if i % 15 == 0], 10)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    exact = found(vectors.search(queries, indexed, cells, exact=True))
    assert set(exact) == set(want)
    for q, hits in want.items():
        assert [i for i, _ in exact[q]] == [i for i, _ in hits]
        assert np.allclose([s for _, s in exact[q]], [s for _, s in hits], atol=2e-6)
    near = found(vectors.search(queries, indexed, cells, probes=8, candidates=60))
    recall = np.mean([len({i for i, _ in near[q]} & {i for i, _ in hits}) / 10 for q, hits in want.items()])
    assert recall >= 0.9
    few = found(vectors.search(queries, indexed.where("id < 16"), cells, exact=True))
    assert all(len(h) in (5, 6) for h in few.values())
    assert vectors.search(queries.limit(0), indexed, cells, exact=True).collect() == []
    assert vectors.search(queries, vectors.index(df.limit(0), cells), cells, exact=True).collect() == []


def test_recall_of_the_registered_index(spark):
    """Recall at ten of the index alone, on vectors without clusters: 0.9 at least."""
    everything, queries = vectors._embeddings(spark, f"{DATA}/sf0.1")
    cells = vectors.fit(everything)
    indexed = vectors.index(everything, cells)
    near, exact = found(vectors.search(queries, indexed, cells)), found(vectors.search(queries, indexed, cells, exact=True))
    recall = np.mean([len({i for i, _ in near[q]} & {i for i, _ in h}) / len(h) for q, h in exact.items()])
    print("recall", recall, "of", len(exact))
    assert recall >= 0.9


def test_vector_search_holds_little_at_once():
    """A cell's scores are made and cut in pieces, and a query's vector is handed on with a bounded number of cells at once."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    asked, held = rng.integers(-3, 4, (800, 8)) / 4.0, rng.integers(-3, 4, (20_000, 8)) / 4.0  # many ties
    ids = rng.permutation(20_000) + 100
    queries = pa.table({"query_id": pa.array(np.arange(800) + 100), "unit": pa.array(list(asked), pa.list_(pa.float64()))})
    found = pa.table({"id": pa.array(ids), "unit": pa.array(list(held), pa.list_(pa.float64()))})
    tracemalloc.start()
    got = vectors._meet(None, 5, True)((pa.scalar(0),), queries, found).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores at once are 128 MB, and were copied
    for q in (0, 5, 799):
        scores = sorted(zip(-np.round(held @ asked[q], 6), ids, strict=True))
        mine = got[got.query_id == q + 100].sort_values(["score", "id"], ascending=[False, True])
        assert [(-s, i) for s, i in zip(mine.score, mine.id, strict=True)] == [x for x in scores if x[1] != q + 100][:5]
    pieces = list(vectors._asked(np.arange(90), rng.normal(size=(90, 8)), np.repeat(np.arange(90), 100), np.tile(np.arange(100), 90)))
    assert sum(p.num_rows for p in pieces) == 9000 and max(p.num_rows for p in pieces) <= vectors.HANDED


def made_phrases(n, seed):
    rng = random.Random(seed)
    words = ["window", "windows", "cleaning", "cleaner", "roof", "roofs", "repair", "cost", "price", "best", "near", "me", "gutter", "pressure", "washing", "wash", "the", "of", "ab", "abab"]
    return sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n)})


def sets_of(spark, items):
    spark.createDataFrame([(p,) for p in items], "phrase string").createOrReplaceTempView("made_phrases")
    return run_sql(spark, "", phrases.token_sets(SPARK, "SELECT phrase FROM made_phrases"))


@pytest.mark.parametrize("least", [0.2, 0.3, 0.5, 0.8, 1.0])
def test_similar_phrases_against_all_pairs(spark, least):
    items = [*made_phrases(220, 6), "a", "of the", "zz", "12 34", "x y"]
    got = {(r["a"], r["b"]): round(r["sim"], 12) for r in phrases.similar_phrases(sets_of(spark, [*items, " WINDOW  ", "", None]), least).collect()}
    items = sorted({*items, "window"})
    want = {(a, b): round(phrase_similarity(a, b), 12) for i, a in enumerate(items) for b in items[i + 1 :]}
    assert got == {k: v for k, v in want.items() if v >= least}


def test_clusters_of_all_phrases(spark):
    items = made_phrases(90, 7) + ["aaa aaaa", "aaaa aaa"]
    got = {}
    for r in phrases.linked_clusters(sets_of(spark, items)).collect():
        got.setdefault(r["cluster"], []).append(r["phrase"])
    want = average_linkage(items)
    assert sorted(sorted(c) for c in got.values()) == want and 3 < len(want) < len(items) - 10
    assert all(c == min(v) for c, v in got.items())


@pytest.mark.parametrize("most", [1, 9])
def test_clusters_of_components_taken_apart(spark, monkeypatch, most):
    """Where components are too large for a task, higher levels come first; at one phrase, only nearest pairs are merged."""
    items = made_phrases(14 if most == 1 else 60, 9)
    monkeypatch.setattr(phrases, "COMPONENT_PHRASES", most)
    got = {}
    for r in phrases.linked_clusters(sets_of(spark, items)).collect():
        got.setdefault(r["cluster"], []).append(r["phrase"])
    assert sorted(sorted(c) for c in got.values()) == average_linkage(items)


def test_ties_take_few_rounds(spark, monkeypatch):
    """Phrases that are all equally similar merge one after the other, but not in a round each."""
    rounds = []
    whole = phrases.components
    monkeypatch.setattr(phrases, "components", lambda *a: rounds.append(1) or whole(*a))
    items = [f"tool w{a}x{a}" for a in "bcdfghjklmnpqrst"]
    assert len({r["cluster"] for r in phrases.linked_clusters(sets_of(spark, items)).collect()}) == len(average_linkage(items))
    assert len(rounds) <= 1


def test_rounds_leave_no_tables(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    phrases.linked_clusters(sets_of(spark, made_phrases(25, 8))).count()
    left = [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before]
    assert left.count("edges") <= 1 and left.count("turned") == 0 and left.count("labels") == 1


def test_a_mean_at_the_threshold_merges(spark):
    items = ["aaa bbb ccc", "aaa ddd eee"]
    least = round(phrase_similarity(*items), 12)
    assert len({r["cluster"] for r in phrases.linked_clusters(sets_of(spark, items), least).collect()}) == 1
    assert average_linkage(items, least) == [items]


def test_few_pairs_are_made(spark):
    """Pairs that can't reach the threshold are not made: phrases of made-up words that are similar in small groups only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = sorted({f"best {' '.join(base)} {word()}" for base in ([word(), word()] for _ in range(300)) for _ in range(4)})
    made = phrases.candidates(sets_of(spark, items), 0.3).count()
    assert len(items) * 3 / 2 <= made < len(items) * (len(items) - 1) / 2 / 25


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_shared_trigrams_make_no_pairs(spark, least):
    """Words of few syllables share their trigrams, but pairs without a common word are not made for them."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "re", "ed", "on", "st"]) for _ in range(4))
    items = sorted({f"{word()} {word()}" for _ in range(500)})
    found = {(r["a"], r["b"]) for r in phrases.similar_phrases(sets_of(spark, items), least).select("a", "b").collect()}
    assert found == {(a, b) for i, a in enumerate(items) for b in items[i + 1 :] if round(phrase_similarity(a, b), 12) >= least}
    assert phrases.candidates(sets_of(spark, items), least).count() < len(items) * (len(items) - 1) / 2 / 50


def made_listings(n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    out = []
    for i in range(n):
        key = pick("", "acme window cleaning", "acme windows cleaning", "bright shine", f"roof repair {rng.randrange(40)}", f"{pick('alpha', 'beta')} wash {rng.randrange(9)}", "".join(rng.choice("abcdefg ") for _ in range(9)).strip())
        address = pick(None, "", f"{rng.randrange(60)} Main St", f"{rng.randrange(60)} main street", f"{rng.randrange(900)} Oak Avenue", f"{rng.randrange(30)} Elm Drive Suite {rng.randrange(9)}")
        out.append((i, key, pick(None, None, f"p{rng.randrange(n)}"), pick(None, None, f"d{rng.randrange(n)}"), address))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_business_classes_against_all_pairs(spark, strict):
    from difflib import SequenceMatcher

    from tests.plain import classes
    from tessera.operators import matching

    rows = made_listings(160, 12)
    df = spark.createDataFrame(rows, "id long, key string, phone string, domain string, address string").repartition(4)
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0

    def equal(x, y):
        signals = [bool(x[k] and x[k] == y[k]) for k in (2, 3)] + [ratio(x[1], y[1]) >= 0.85, ratio((x[4] or "").lower(), (y[4] or "").lower()) >= 0.8]
        return sum(signals) >= 2 or (not strict and (signals[0] or signals[1]))

    want = classes([r[0] for r in rows], [(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if equal(x, y)])
    links = [tuple(r) for r in matching.business_links(df, strict=strict).collect()]
    assert classes([r[0] for r in rows], links) == want
    assert all(equal(rows[a], rows[b]) for a, b in links)  # only what the rule links
    got = {r["id"]: r["first"] for r in matching.classes(matching.business_links(df, strict=strict)).collect()}
    assert {i: got.get(i, i) for i in want} == want and 10 < len(set(want.values())) < 150


def test_equal_names_cost_their_number(spark):
    """Links grow with the listings of one name, not with their square."""
    from tessera.operators import matching

    sizes = []
    for n in (100, 400):
        rows = [(i, "acme", None, None, f"{i % 50} Main Street") for i in range(n)]
        sizes.append(matching.business_links(spark.createDataFrame(rows, "id long, key string, phone string, domain string, address string")).count())
    assert sizes[1] <= 5 * sizes[0] and sizes[1] < 1000


def test_scores_follow_from_issues(spark):
    """The scores made of the issue table are those of the rules, page by page."""
    from tessera import catalog

    sf = f"{DATA}/sf0.001"
    by_rule = {r["page_id"]: r for r in catalog.queries()["page_audit"](spark, sf).collect()}
    rows = catalog.queries()["audit_scores"](spark, sf).collect()
    names = ("security", "seo", "accessibility", "performance", "overall")
    assert len(rows) == len(by_rule) and {r["page_id"]: [r[n] for n in names] for r in rows} == {i: [r[n] for n in names] for i, r in by_rule.items()}
    assert len({r["overall"] for r in rows}) > 3 and any(r["security"] == 75 for r in rows)


def test_embeddings_by_topics(spark):
    """Texts of one topic lie nearer to each other than under hashed counts, texts of two topics no nearer; every run gives the same."""
    from tessera.operators import learning

    rng = random.Random(2)
    words = [[f"{chr(97 + t)}{k:02d}x" for k in range(60)] for t in range(6)]
    texts = [" ".join(rng.choice(words[i % 6]) for _ in range(12)) for i in range(600)] + [None, "", "never seen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    model = learning.topics(df.where("doc_id < 600").select("text"), size=6)
    again = learning.topics(df.where("doc_id < 600").select("text").repartition(3), size=6)
    assert np.allclose(model.vectors, again.vectors, atol=1e-8)
    rows = {r["doc_id"]: np.array(r["vector"]) for r in learning.embedded(df, model).collect()}
    assert len(rows) == 603 and not rows[600].any() and not rows[601].any()

    def counted(i):
        out = np.zeros(learning.TERMS)
        columns, weights = learning.term_weights(texts[i])
        out[columns] = weights
        return out / np.sqrt((out * out).sum())

    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(800)]
    same, other = [p for p in pairs if p[0] % 6 == p[1] % 6 and p[0] != p[1]], [p for p in pairs if p[0] % 6 != p[1] % 6]
    mean = lambda of, some: float(np.mean([of(a) @ of(b) for a, b in some]))
    learnt, plain = mean(rows.get, same) - mean(rows.get, other), mean(counted, same) - mean(counted, other)
    print("gap of topics", learnt, "of counts", plain)
    assert learnt > 0.8 > 3 * plain


def test_texts_are_taken_apart_once(spark, monkeypatch, tmp_path):
    """All passes read the terms that one pass wrote, in a bounded number of tasks; rows with and without terms are there."""
    from tessera.operators import learning

    made, sums = [], []
    monkeypatch.setattr(learning, "written", lambda df, name, f=learning.written: made.append(f(df, name)) or made[-1])
    monkeypatch.setattr(learning, "_by_column", lambda rows, *a, f=learning._by_column: sums.append(rows) or f(rows, *a))
    texts = ["One two two", None, "", "...", "\u00c9t\u00e9 one_1 \u4e2d\u6587 \u0130", *(f"word{k % 7} two x{k}" for k in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: np.array(r["vector"]) for r in learning.text_embeddings(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and [i for i, v in rows.items() if not v.any()] and all(not rows[i].any() for i in (1, 2, 3))
    assert len(made) == 1 and len(sums) == 3 and all("text" not in s.columns for s in sums)
    held = {r["doc_id"]: r for r in made[0].collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"\W+", (t or "").lower()) if w]
        want = {}
        for w in words:
            column = zlib.crc32(w.encode()) % learning.TERMS
            want[column] = want.get(column, 0) + 1
        got = zip(np.frombuffer(held[i]["terms"], "<i4").tolist(), np.frombuffer(held[i]["times"], "<i4").tolist(), strict=True)
        assert list(got) == sorted(want.items())
    known = learning.TermColumns()
    known.MOST = 5  # words beyond it are hashed again
    assert known.counts("a b c d e f g a b")[1].sum() == 9 and len(known) <= 5


def test_near_copies_have_near_vectors(spark):
    from tessera.operators import learning

    docs = [r for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect() if r["text"] and len(r["text"]) > 400][:60]
    near = [(r["doc_id"], r["text"]) for r in docs] + [(r["doc_id"] + 10**6, r["text"][: len(r["text"]) * 9 // 10]) for r in docs]
    df = spark.createDataFrame(near, "doc_id long, text string")
    rows = {r["doc_id"]: np.array(r["vector"]) for r in learning.embedded(df, learning.topics(df.select("text"), size=32)).collect()}
    ids = [r["doc_id"] for r in docs]
    copies = [rows[i] @ rows[i + 10**6] for i in ids]
    others = [rows[i] @ rows[j] for i in ids for j in ids if i < j]
    assert np.mean(copies) > 0.95 and np.mean(copies) > np.quantile(others, 0.95)
