"""Records in files and in JSON: written, read back and compared with the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as X
from ..plans.dialect import SPARK
from ..plans.registry import frame, query, run_sql
from ..sources import files
from ..sources import stand_ins as T
from ..sources.scratch import shared_path


@frame("category_slugs", "A4", lambda d: "SELECT DISTINCT lower(p_type) AS label, replace(lower(p_type), ' ', '-') AS slug FROM part")
def category_slugs(spark, sf_dir):
    """A CSV of labels and slugs with blanks around them."""
    path = shared_path(spark, "categories")
    rows = run_sql(spark, sf_dir, "SELECT DISTINCT lower(p_type) AS label FROM part").select(F.concat(F.lit(" "), "label", F.lit(" ")).alias("label"), F.concat(F.translate("label", " ", "-"), F.lit(" ")).alias("slug"))
    files.write_csv(rows, path)
    return files.read_categories(spark, path)


def _log_sql(d) -> str:
    return """SELECT user_id AS target_id, count(*) AS events, max(event_id % 50) AS last_page, sum(event_id % 7) AS accepted, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id"""


@frame("replayed_log", "A6 R57", _log_sql)
def replayed_log(spark, sf_dir):
    """A write-ahead log of JSON lines, some of them torn, replayed to the state of each target."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = shared_path(spark, "log")
    lines = e.select(F.col("ts").cast("string").alias("timestamp"), F.lit("w1").alias("worker_id"), "event_type", F.col("user_id").alias("target_id"), (F.col("event_id") % 50).cast("int").alias("page_number"), (F.col("event_id") % 7).cast("int").alias("accepted_count"), F.lit(9).alias("raw_count"))
    files.write_jsonl(lines, path)
    lines.where("page_number = 0").select(F.expr("substr(to_json(struct(*)), 1, 40)").alias("value")).write.mode("append").text(path)
    return files.read_log(spark, path).groupBy("target_id").agg(F.count("*").alias("events"), F.max("page_number").alias("last_page"), F.sum("accepted_count").alias("accepted"), F.count_if(F.col("event_type") == "error").alias("errors"))


def _records_sql(d) -> str:
    return "SELECT l.doc_id AS id, CASE WHEN l.quality = 1 THEN 'provider' ELSE 'directory' END AS label, d.source AS name, d.n_chars AS size, CASE WHEN l.toxic = 1 THEN 'flagged' END AS note FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@frame("labelled_records", "A7 A8", _records_sql)
def labelled_records(spark, sf_dir):
    """Labelled records as JSON lines: nested company data by schema, free-form metadata kept as it is."""
    path = shared_path(spark, "labelled")
    rows = run_sql(spark, sf_dir, _records_sql(SPARK)).select("id", "label", F.struct("name", "size").alias("company_data"), F.to_json(F.struct(F.struct("note").alias("review"))).alias("parse_metadata"))
    files.write_jsonl(rows, path)
    read = files.read_records(spark, path, "id long, label string, company_data struct<name: string, size: long>, parse_metadata string")
    return read.select("id", "label", "company_data.name", "company_data.size", F.get_json_object("parse_metadata", "$.review.note").alias("note"))


def _pairs(d) -> str:
    return "SELECT a.conv_id, a.turn, a.text AS instruction, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND a.text IS NOT NULL AND b.text IS NOT NULL"


def _chat_sql(d) -> str:
    return f"SELECT {d.sha('instruction')} AS instruction, {d.sha('output')} AS output, 'system,user,assistant' AS roles, count(*) AS n FROM ({_pairs(d)}) p GROUP BY 1, 2"


@frame("chat_files", "A11 A10", _chat_sql)
def chat_files(spark, sf_dir):
    """Questions with their answers, written as chat messages and read back."""
    path = shared_path(spark, "chat")
    files.write_chat(run_sql(spark, sf_dir, _pairs(SPARK)), path, "You are helpful.")
    m = files.read_records(spark, path, "messages array<struct<role: string, content: string>>").select("messages")
    rows = m.select(F.sha2(F.col("messages")[1]["content"], 256).alias("instruction"), F.sha2(F.col("messages")[2]["content"], 256).alias("output"), F.array_join(F.col("messages.role"), ",").alias("roles"))
    return rows.groupBy("instruction", "output", "roles").agg(F.count("*").alias("n"))


def _instructions_sql(d) -> str:
    return f"SELECT {d.sha('instruction')} AS instruction, '' AS input, length(output) AS chars, count(*) AS n FROM ({_pairs(d)}) p GROUP BY 1, 3"


@frame("instruction_files", "A12", _instructions_sql)
def instruction_files(spark, sf_dir):
    """The same as instruction records, a missing input written as an empty one."""
    path = shared_path(spark, "instructions")
    files.write_instructions(run_sql(spark, sf_dir, _pairs(SPARK)).withColumn("input", F.lit(None).cast("string")), path)
    read = files.read_records(spark, path, "instruction string, input string, output string")
    return read.groupBy(F.sha2("instruction", 256).alias("instruction"), "input", F.char_length("output").alias("chars")).agg(F.count("*").alias("n"))


def _report_sql(d) -> str:
    return f"""WITH b AS ({T.claims(d)}), k AS (SELECT company_id, {X.name_nap(d, 'name')} AS name, {X.digits(d, 'phone')} AS phone FROM b), g AS (SELECT company_id, count(DISTINCT name) AS names, count(DISTINCT phone) AS phones FROM k GROUP BY company_id)
SELECT company_id, names, phones, CASE WHEN names > 1 AND phones > 1 THEN 'both' WHEN names > 1 THEN 'name' ELSE 'phone' END AS mode FROM g WHERE names > 1 OR phones > 1"""


@frame("conflict_report", "A13", _report_sql)
def conflict_report(spark, sf_dir):
    """Companies whose sources disagree and on what, as a CSV report, read back."""
    path = shared_path(spark, "report")
    files.write_csv(run_sql(spark, sf_dir, _report_sql(SPARK)), path)
    return spark.read.csv(path, header=True, schema="company_id long, names long, phones long, mode string", enforceSchema=False)


def _upserted_sql(d) -> str:
    return "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN label + 200 WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS size, round(CAST(embedding[1] AS double) * CASE WHEN vec_id % 6 = 0 THEN -2 WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END, 5) AS first_value FROM embeddings"


@frame("vectors_upserted", "A21 N3", _upserted_sql)
def vectors_upserted(spark, sf_dir):
    """Vectors with their payload put over those of the same id, twice for some: the last write wins."""
    old = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    write = lambda by, scale, more, at: old.where(f"vec_id % {by} = 0").select("vec_id", F.transform("embedding", lambda x: (x * scale).cast("float")).alias("embedding"), (F.col("label") + more).alias("label"), F.lit(at).alias("at"))
    puts = write(3, -1, 100, 1).unionByName(write(6, -2, 200, 2))
    last = files.first_by_key(puts, ["vec_id"], [F.desc("at")]).drop("at")
    rows = files.upsert(old, last, "vec_id")
    return rows.select("vec_id", "label", F.size("embedding").cast("long").alias("size"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value"))


def _suggested_sql(d) -> str:
    return f"SELECT k.id, n.n AS place, k.keyword || CASE WHEN n.n = 1 THEN ' cost' ELSE ' \"near\" me' END AS suggestion FROM ({T.keywords(d)}) k CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) n"


@frame("suggestion_lists", "R54 K6", _suggested_sql)
def suggestion_lists(spark, sf_dir):
    """Answers of a completion service, ["query", ["first", "second"]], parsed to one row for each suggestion."""
    k = run_sql(spark, sf_dir, T.keywords(SPARK))
    answer = F.concat(F.lit('["'), "keyword", F.lit('",'), F.to_json(F.array(F.concat("keyword", F.lit(" cost")), F.concat("keyword", F.lit(' "near" me')))), F.lit("]"))
    found = F.from_json(F.get_json_object(answer, "$[1]"), "array<string>")
    return k.select("id", F.posexplode(found).alias("place", "suggestion")).withColumn("place", F.col("place") + 1)


@frame("json_contained", "K2", lambda d: "SELECT event_id, json_contains(props, '{\"k\": 7}') AS holds, json_extract_string(props, '$.k') IS NOT NULL AS has_key FROM events")
def json_contained(spark, sf_dir):
    """Whether an object holds all pairs of another one, value by value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pairs = lambda x: F.map_entries(F.from_json(x, "map<string, string>"))
    holds = F.forall(pairs(F.lit('{"k": 7}')), lambda p: F.coalesce(F.array_contains(pairs("props"), p), F.lit(False)))
    return e.select("event_id", holds.alias("holds"), F.get_json_object("props", "$.k").isNotNull().alias("has_key"))


def _reviewed_sql(d) -> str:
    return "SELECT d.doc_id, '{\"lang\":\"' || d.lang || '\",\"human_label\":\"' || CASE WHEN l.quality = 1 THEN 'provider' ELSE 'other' END || '\",\"reviewed\":true}' AS metadata FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL"


@frame("reviewed_metadata", "R63 K4", _reviewed_sql)
def reviewed_metadata(spark, sf_dir):
    """Labels from a CSV of reviews set into each document's JSON metadata, over what was there."""
    path = shared_path(spark, "reviews")
    files.write_csv(run_sql(spark, sf_dir, "SELECT doc_id, CASE WHEN quality = 1 THEN 'provider' ELSE 'other' END AS label FROM labels WHERE quality IS NOT NULL"), path)
    reviews = spark.read.csv(path, header=True, schema="doc_id long, label string", enforceSchema=False)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select("doc_id", F.to_json(F.struct("lang", F.lit("none").alias("human_label"))).alias("metadata"))
    old = F.from_json("metadata", "lang string, human_label string")
    return docs.join(reviews, "doc_id").select("doc_id", F.to_json(F.struct(old["lang"].alias("lang"), F.col("label").alias("human_label"), F.lit(True).alias("reviewed"))).alias("metadata"))


@query("component_confusion", "R62")
def component_confusion(d):
    """For each band of confidence how often a rule, a model and both together agree with the label."""
    rule, model = "n_chars > 400", "doc_id * 37 % 100 >= 30"
    band = f"CASE WHEN ({rule}) = ({model}) THEN 'high' WHEN n_chars BETWEEN 300 AND 500 THEN 'low' ELSE 'medium' END"
    hit = lambda x: f"count(*) FILTER (WHERE ({x}) = (quality = 1))"
    return f"""WITH j AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL)
SELECT {band} AS band, quality = 1 AS label, count(*) AS n, {hit(rule)} AS rule_right, {hit(model)} AS model_right, {hit(f'({rule}) AND ({model})')} AS both_right FROM j GROUP BY 1, 2"""
