"""Which names occur in which texts: a containment join over free text.

Names of bounded size make one Aho-Corasick automaton that is told to all readers of the texts: each text is read once. More names go by
their grams: a name that a text contains shares all its grams with it, so a name is looked up by its rarest gram alone, and a text by
those of its grams that are some name's rarest. Names and texts of a gram meet in a task whose automaton holds the names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import SPARK, Dialect
from ..plans.registry import frame, run_sql
from ..sources import stand_ins as T
from ..sources.scratch import small_batches, told, written

#: Characters of all names that are told to every task at most.
TOLD_CHARS = 8_000_000
#: Characters of the names of one automaton, which takes some hundred bytes for each in every task at a time.
AUTOMATON_CHARS = 1_000_000
#: Pairs that a reader hands on at once.
AT_ONCE = 50_000
#: Characters of a gram; shorter names are looked up by all their characters.
GRAM = 4
#: Names of an automaton, and texts that it reads, in one task.
SHARD_NAMES, BLOCK_TEXTS = 20_000, 50_000


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct pieces of a size, of texts at least so long."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _scan(key, table):
    """The names of a task's automaton in each of its texts."""
    import ahocorasick
    import pyarrow as pa

    automaton, texts, names, ids = ahocorasick.Automaton(), [], [], []
    for name, i, text in zip(table.column("name").to_pylist(), table.column("text_id").to_pylist(), table.column("text").to_pylist(), strict=True):
        if name is None:
            texts.append((i, text))
        else:
            automaton.add_word(name, name)
    if len(automaton):
        automaton.make_automaton()
        for i, text in texts:
            found = {name for _, name in automaton.iter(text)}
            names.extend(found)
            ids.extend([i] * len(found))
    return pa.table({"name": pa.array(names, pa.string()), "text_id": pa.array(ids, pa.int64())})


def _reader(names):
    """Each text's names; names: a broadcast list."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for name in names.value:
            automaton.add_word(name, name)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            found, ids = [], []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                mine = {name for _, name in automaton.iter(text.as_py())} if len(automaton) else ()
                found.extend(mine)
                ids.extend([i.as_py()] * len(mine))
                if len(found) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ids, pa.int64())], names=["name", "text_id"])
                    found, ids = [], []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ids, pa.int64())], names=["name", "text_id"])

    return run


def slices(names: list[str], chars: int) -> list[list[str]]:
    """Names in parts of so many characters, or one name; at least one part. In their order, so that names that begin alike share their nodes."""
    parts, size = [[]], 0
    for name in sorted(names):
        if parts[-1] and size + len(name) > chars:
            parts.append([])
            size = 0
        parts[-1].append(name)
        size += len(name)
    return parts


def contained_names(names: DataFrame, texts: DataFrame, gram: int = GRAM, shard_names: int = SHARD_NAMES, block_texts: int = BLOCK_TEXTS, told_chars: int = TOLD_CHARS, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """name, text_id: the distinct names of names (name) that occur in texts (text_id, text) as runs of characters, as `text LIKE '%name%'` without wildcards.

    By grams: how many texts hold a gram is counted for the names' grams; a name with a gram that no text holds goes no further. A
    gram with more names than a shard or more texts than a block is dealt over several tasks: each part of its names reads all its
    texts, block by block. Null and empty names and texts take no part; text ids are unique.
    """
    spark = texts.sparkSession
    names = written(names.where("name <> ''").select("name").distinct(), "names")
    texts = texts.where("text <> ''").select(F.col("text_id").cast("long").alias("text_id"), "text")
    if (names.agg(F.sum(F.char_length("name"))).first()[0] or 0) <= told_chars:
        small_batches(spark)
        # each text is read by one automaton after the other, so that a task holds a part of the names
        told_names = slices([r["name"] for r in names.collect()], automaton_chars)
        read = [texts.mapInArrow(_reader(spark.sparkContext.broadcast(part)), "name string, text_id long") for part in told_names]
        return functools.reduce(DataFrame.union, read)
    texts = written(texts, "texts")
    sized = names.withColumn("size", F.least(F.char_length("name"), F.lit(gram)))
    of_names = written(sized.select("name", "size", F.explode(_grams(F.col("name"), F.col("size"))).alias("gram")), "name-grams")
    wanted = told(written(of_names.select("gram").distinct(), "wanted"))
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())  # gram of them at most
    held = texts.select("text_id", F.explode(F.flatten(F.array(*(_grams(F.col("text"), s) for s in sizes)))).alias("gram")).join(wanted, "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("texts"))
    known = of_names.join(often, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest"))
    keyed = written(known.where("rarest.texts > 0").select("name", "rarest.gram", "rarest.texts"), "keyed")
    keys = keyed.groupBy("gram").agg(F.count("*").alias("names"), F.first("texts").alias("texts"))
    keys = told(written(keys.select("gram", F.ceil(F.col("names") / shard_names).alias("shards"), F.ceil(F.col("texts") / block_texts).alias("blocks")), "keys"))
    # grams with few names and texts share a task
    tasks = max(math.ceil(keyed.count() / shard_names), int(spark.conf.get("spark.sql.shuffle.partitions")))
    alone = (F.col("shards") > 1) | (F.col("blocks") > 1)
    task = F.when(alone, F.xxhash64("gram", "shard", "block")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(tasks))).alias("task")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    left = keyed.select("name", "gram").join(keys, "gram").withColumn("shard", part("name", "shards")).withColumn("block", every("blocks")).select(task, "name")
    right = held.join(keys, "gram").withColumn("block", part("text_id", "blocks")).withColumn("shard", every("shards")).select(task, "text_id").distinct()
    right = right.join(texts, "text_id").select("task", F.lit(None).cast("string").alias("name"), "text_id", "text")
    rows = right.unionByName(left.select("task", "name", F.lit(None).cast("long").alias("text_id"), F.lit(None).cast("string").alias("text")))
    # a name belongs to one gram and shard, and a text to one block of it; tasks that several grams share may find a pair by chance once more
    return rows.groupBy("task").applyInArrow(_scan, "name string, text_id long").distinct()


def named_companies(d: Dialect) -> str:
    """Companies with names in free text, as they are written there: id, name; a word, two words, or a piece that ends within words."""
    word = lambda k: f"split_part(text, ' ', {k})"
    return f"""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN {word(1)} WHEN 1 THEN {word(2)} || ' ' || {word(3)} WHEN 2 THEN {word(3)} ELSE substr(text, 3, 6) END AS name
  FROM documents WHERE length(text) > 20"""


def search_texts(d: Dialect) -> str:
    """Searches by their text: text_id, query_id, text."""
    return "SELECT conv_id * 1000 + turn AS text_id, conv_id AS query_id, text FROM conversations WHERE text <> ''"


def _captures_sql(d: Dialect) -> str:
    return f"""WITH c AS ({named_companies(d)}), q AS ({search_texts(d)}), s AS ({T.snapshots(d)}),
t AS (SELECT q.text_id, q.text, max(s.captured_at) AS captured_at, count(*) AS captures FROM q JOIN s ON s.query_id = q.query_id GROUP BY q.text_id, q.text),
n AS (SELECT DISTINCT name FROM c WHERE name <> ''),
m AS (SELECT n.name, max(t.captured_at) AS captured_at, sum(t.captures) AS captures FROM n JOIN t ON contains(t.text, n.name) GROUP BY n.name)
SELECT c.id, c.name, m.captured_at, CAST(coalesce(m.captures, 0) AS bigint) AS captures,
  CASE WHEN m.captured_at IS NULL THEN NULL ELSE date_diff('day', CAST(m.captured_at AS date), CAST({T.AS_OF} AS date)) END AS days_since
FROM c LEFT JOIN m ON c.name = m.name"""


@frame("latest_captures", "C8", oracle=_captures_sql)
def latest_captures(spark, sf_dir) -> DataFrame:
    """Every company with the latest capture of a search whose text contains its name, how many there are, and the days since; none: never captured."""
    d = SPARK
    companies = written(run_sql(spark, sf_dir, named_companies(d)), "companies")
    searches = run_sql(spark, sf_dir, f"""WITH q AS ({search_texts(d)}), s AS ({T.snapshots(d)})
SELECT q.text_id, q.text, max(s.captured_at) AS captured_at, count(*) AS captures FROM q JOIN s ON s.query_id = q.query_id GROUP BY q.text_id, q.text""")
    searches = written(searches, "searches")
    pairs = contained_names(companies, searches)
    found = pairs.join(searches.select("text_id", "captured_at", "captures"), "text_id").groupBy("name").agg(F.max("captured_at").alias("captured_at"), F.sum("captures").alias("captures"))
    days = F.datediff(F.expr(T.AS_OF), "captured_at").cast("long")
    return companies.join(found, "name", "left").select("id", "name", "captured_at", F.coalesce("captures", F.lit(0)).cast("long").alias("captures"), days.alias("days_since"))


def _passages_sql(d: Dialect) -> str:
    plain = lambda x: f"trim({d.sub(x, r'\s+', ' ')})"
    return f"""WITH t AS (SELECT doc_id, {plain('text')} AS text FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {plain('text')} AS text FROM benchmark WHERE text IS NOT NULL)
SELECT b.item_id, count(*) AS n, min(t.doc_id) AS first_doc FROM b JOIN t ON contains(t.text, b.text) WHERE b.text <> '' GROUP BY b.item_id"""


@frame("known_passages", "L21 R56", oracle=_passages_sql)
def known_passages(spark, sf_dir) -> DataFrame:
    """Known passages, of any length, and the texts that hold them whole, white space aside."""
    plain = lambda x: f"trim({SPARK.sub(x, r'\s+', ' ')})"
    texts = run_sql(spark, sf_dir, f"SELECT doc_id AS text_id, {plain('text')} AS text FROM documents WHERE text IS NOT NULL")
    items = written(run_sql(spark, sf_dir, f"SELECT item_id, {plain('text')} AS name FROM benchmark WHERE text IS NOT NULL"), "items")
    pairs = contained_names(items, texts)
    found = pairs.groupBy("name").agg(F.count("*").alias("n"), F.min("text_id").alias("first_doc"))
    return items.join(found, "name").select("item_id", "n", "first_doc")
