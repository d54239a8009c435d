"""Views, joins, aggregations, windows and top-k over companies, claims, conflicts, runs and search snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..plans.dialect import SPARK
from ..plans.registry import frame, query, run_sql
from ..sources import stand_ins as T
from ..sources.scratch import written
from ..sources.stand_ins import AS_OF


@query("nap_conflicts", "C2")
def nap_conflicts(d):
    return f"""WITH c AS ({T.companies(d)}), b AS ({T.claims(d)})
SELECT c.id AS company_id, c.name AS company_name, count(DISTINCT b.source_id) AS source_count, count(DISTINCT b.name) AS unique_names, count(DISTINCT b.phone) AS unique_phones,
  count(DISTINCT b.street) AS unique_streets, count(DISTINCT b.city) AS unique_cities,
  count(DISTINCT b.name) > 1 OR count(DISTINCT b.phone) > 1 OR count(DISTINCT b.street) > 1 AS has_conflict, {d.set_of('b.source_type')} AS sources
FROM c LEFT JOIN b ON c.id = b.company_id GROUP BY c.id, c.name HAVING count(DISTINCT b.source_id) >= 1"""


@query("nap_conflict_summary", "C3")
def nap_conflict_summary(d):
    hint = d.dealt("company_id")
    rows = f"(SELECT {hint}company_id, source_type, name, phone, street FROM b) b" if hint else "b"
    return f"""WITH c AS ({T.companies(d)}), b AS ({T.claims(d)}),
n AS (SELECT company_id, {d.set_of('source_type')} AS source_types, greatest({d.n_distinct('name')}, {d.n_distinct('phone')}, {d.n_distinct('street')}) - 1 AS disagreeing_count
  FROM {rows} WHERE name IS NOT NULL OR phone IS NOT NULL OR street IS NOT NULL GROUP BY company_id)
SELECT c.id AS company_id, c.name, c.domain, c.phone AS canonical_phone, n.source_types, n.disagreeing_count FROM c LEFT JOIN n ON c.id = n.company_id WHERE c.active"""


@query("unresolved_conflicts", "C4")
def unresolved_conflicts(d):
    return f"""WITH c AS ({T.companies(d)}), x AS ({T.conflicts(d)})
SELECT x.conflict_id, x.conflict_type, x.confidence, x.match_score, x.detected_at, a.id AS company1_id, a.name AS company1_name, b.id AS company2_id, b.name AS company2_name
FROM x JOIN c a ON x.company_id_1 = a.id JOIN c b ON x.company_id_2 = b.id WHERE x.status = 'pending'"""


@query("conflicts_for_company", "C5 Q1")
def conflicts_for_company(d, company: int = 7):
    other = f"CASE WHEN x.company_id_1 = {company} THEN x.company_id_2 ELSE x.company_id_1 END"
    return f"""WITH c AS ({T.companies(d)}), x AS ({T.conflicts(d)})
SELECT x.conflict_id, c.id AS other_company_id, c.name AS other_company_name, x.conflict_type, x.confidence, x.match_score, x.status, x.detected_at
FROM x JOIN c ON c.id = {other} WHERE x.company_id_1 = {company} OR x.company_id_2 = {company}"""


@query("question_changes", "C6")
def question_changes(d):
    return f"""WITH s AS ({T.snapshots(d)}), p AS ({T.results(d)}),
r AS (SELECT query_id, snapshot_id, row_number() OVER (PARTITION BY query_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM s),
q AS (SELECT DISTINCT r.query_id, r.rn, p.question FROM p JOIN r ON p.snapshot_id = r.snapshot_id WHERE r.rn <= 2),
new AS (SELECT query_id, question FROM q WHERE rn = 1), old AS (SELECT query_id, question FROM q WHERE rn = 2)
SELECT coalesce(new.query_id, old.query_id) AS query_id, new.question AS current_question, old.question AS previous_question,
  CASE WHEN old.question IS NULL THEN 'added' ELSE 'removed' END AS change_type
FROM new FULL OUTER JOIN old ON new.query_id = old.query_id AND new.question = old.question WHERE new.question IS NULL OR old.question IS NULL"""


@query("position_changes", "C7")
def position_changes(d):
    """For every query the newest snapshot up to an instant against the one before."""
    return f"""WITH s AS ({T.snapshots(d)}), p AS ({T.results(d)}),
r AS (SELECT query_id, snapshot_id, row_number() OVER (PARTITION BY query_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM s WHERE captured_at <= CAST('1998-01-01 00:00:00' AS timestamp)),
q AS (SELECT r.query_id, r.rn, p.domain, min(p.position) AS position FROM p JOIN r ON p.snapshot_id = r.snapshot_id WHERE r.rn <= 2 GROUP BY r.query_id, r.rn, p.domain)
SELECT a.query_id, a.domain, a.position AS current_position, b.position AS previous_position, b.position - a.position AS change
FROM q a LEFT JOIN q b ON a.query_id = b.query_id AND a.domain = b.domain AND b.rn = 2 WHERE a.rn = 1"""


@query("scrape_priorities", "F9 I2")
def scrape_priorities(d):
    """Companies by the days since they were updated last, in bands of priority."""
    days = f"{d.idiv(f'{d.epoch(AS_OF)} - {d.epoch('last_updated')}', '86400')}"
    band = f"CASE WHEN last_updated IS NULL THEN 'never' WHEN {days} < 14 THEN 'skip' WHEN {days} > 60 THEN 'high' WHEN {days} > 30 THEN 'medium' ELSE 'low' END"
    return f"""WITH c AS ({T.companies(d)}) SELECT {band} AS priority, count(*) AS companies, min({days}) AS least_days, max({days}) AS most_days FROM c GROUP BY {band}"""


@query("borderline_queue", "C9")
def borderline_queue(d):
    return f"""WITH c AS ({T.companies(d)}), x AS ({T.conflicts(d)})
SELECT c.id, c.quality_score / 100e0 AS score, CASE WHEN c.quality_score BETWEEN 45 AND 55 THEN 100 WHEN c.quality_score BETWEEN 40 AND 60 THEN 50 ELSE 10 END AS priority
FROM c WHERE c.quality_score BETWEEN 35 AND 65 AND NOT EXISTS (SELECT 1 FROM x WHERE x.company_id_1 = c.id AND x.status = 'pending')"""


@query("profile_flags", "C10 Q4 J3")
def profile_flags(d):
    """Flags and quality score of every company at once."""
    return f"""WITH c AS ({T.companies(d)}), b AS ({T.claims(d)}),
n AS (SELECT company_id, count(*) AS source_count, max(CASE WHEN source_type IN ('google', 'google_business') THEN 1 ELSE 0 END) = 1 AS google, max(CASE WHEN source_type = 'yelp' THEN 1 ELSE 0 END) = 1 AS yelp, avg(score) AS average,
  count(DISTINCT phone) > 1 AS conflict FROM b GROUP BY company_id),
f AS (SELECT c.id, coalesce(n.source_count, 0) AS source_count, coalesce(n.google, false) AS has_google, coalesce(n.yelp, false) AS has_yelp, coalesce(c.website, '') <> '' AS has_website, coalesce(n.conflict, false) AS nap_conflict, n.average
  FROM c LEFT JOIN n ON c.id = n.company_id)
SELECT id, source_count, has_google, has_yelp, has_website, nap_conflict, {S.company_quality('source_count', 'has_website', 'has_google', 'has_yelp', 'nap_conflict', 'average')} AS quality_score FROM f"""


@query("companies_to_audit", "C11 F8 F10")
def companies_to_audit(d):
    """Never audited or audited over a week ago, the oldest first; a keyset page of 50 after id 20."""
    return f"""WITH c AS ({T.companies(d)}), a AS (SELECT company_id_1 AS company_id, max(detected_at) AS audited_at FROM ({T.conflicts(d)}) z GROUP BY company_id_1)
SELECT c.id, c.name, a.audited_at FROM c LEFT JOIN a ON c.id = a.company_id WHERE c.id > 20 AND (a.audited_at IS NULL OR a.audited_at < {AS_OF} - INTERVAL '7' DAY) ORDER BY c.id LIMIT 50"""


@query("targets", "C12 H28 H29 H27")
def targets(d):
    from ..functions import strings as X

    geo = X.geo("n_name", "substr(r_name, 1, 2)")
    return f"""WITH g AS (SELECT n_nationkey, {geo} AS geo, {X.city_slug(d, 'n_name', 'substr(r_name, 1, 2)')} AS slug FROM nation JOIN region ON n_regionkey = r_regionkey), k AS (SELECT DISTINCT p_brand AS label FROM part)
SELECT g.n_nationkey AS city_id, k.label, g.slug, g.geo, {X.search_url(d, 'k.label', 'g.geo')} AS fallback_url FROM g CROSS JOIN k"""


@query("stale_sources", "C13")
def stale_sources(d):
    at = "CAST('1998-09-01 00:00:00' AS timestamp)"
    return f"""WITH c AS ({T.companies(d)}), b AS ({T.claims(d)})
SELECT b.source_id, b.company_id, c.name AS company_name, b.source_type, b.status, {d.idiv(f'{d.epoch(at)} - {d.epoch("b.last_seen")}', '86400')} AS days_since_check
FROM b JOIN c ON b.company_id = c.id WHERE b.last_seen < {at} - INTERVAL '90' DAY"""


@query("run_details", "C14 C15 C16")
def run_details(d):
    """What each query's snapshots in an interval returned; severities in their own order."""
    return f"""WITH s AS ({T.snapshots(d)}), p AS ({T.results(d)})
SELECT s.query_id, count(*) AS pages, count(DISTINCT p.domain) AS domains, max(s.captured_at) AS last_at, CASE WHEN count(*) > 10 THEN 1 WHEN count(*) > 4 THEN 2 ELSE 3 END AS severity
FROM s JOIN p ON s.snapshot_id = p.snapshot_id WHERE s.captured_at BETWEEN CAST('1995-01-01 00:00:00' AS timestamp) AND CAST('1996-06-30 00:00:00' AS timestamp) AND p.position IN (1, 2, 3) GROUP BY s.query_id"""


def _keys(d) -> str:
    from ..functions import strings as X

    return f"SELECT id, CASE WHEN NOT {d.contains_any('lower(website)', X.NOT_WEBSITES)} THEN {X.host(d, 'website')} END AS host, {X.phone_e164(d, 'phone')} AS phone FROM c"


def _pairs_sql(d) -> str:
    return f"""WITH c AS ({T.companies(d)}), k AS ({_keys(d)})
SELECT a.id AS id_1, b.id AS id_2, 'domain' AS matched FROM k a JOIN k b ON a.host = b.host AND a.id < b.id WHERE a.host <> ''
UNION ALL SELECT a.id, b.id, 'phone' FROM k a JOIN k b ON a.phone = b.phone AND a.id < b.id"""


#: Companies of one key that a task takes together, about: more are dealt out, and each part is met by all of the key.
TOGETHER = 1000


@frame("conflict_pairs", "C1 O3", oracle=_pairs_sql)
def conflict_pairs(spark, sf_dir):
    """Pairs of companies with the same host or phone; each ordered, so that it is recorded once for each key.

    The pairs of a key grow with the square of its companies, so a key is dealt out in parts.
    """
    keys = run_sql(spark, sf_dir, f"WITH c AS ({T.companies(SPARK)}), k AS ({_keys(SPARK)}) SELECT id, 'domain' AS matched, host AS key FROM k WHERE host <> '' UNION ALL SELECT id, 'phone', phone FROM k WHERE phone IS NOT NULL")
    keys = written(keys, "keys")
    parts = keys.groupBy("matched", "key").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = keys.join(parts, ["matched", "key"])
    one = rows.select("matched", "key", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("id_1"))
    two = rows.select("matched", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_2"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number: small tables make many pairs
    one, two = (side.repartition(tasks, "matched", "key", "part") for side in (one, two))
    return one.join(two, ["matched", "key", "part"]).where("id_1 < id_2").select("id_1", "id_2", "matched")


@query("task_stats", "D1 D2 D23")
def task_stats(d):
    return f"""WITH t AS ({T.task_logs(d)})
SELECT task_name, count(*) AS total_runs, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'failed') AS failed_count, count(*) FILTER (WHERE status = 'running') AS running_count,
  round(avg(seconds) FILTER (WHERE status = 'success'), 6) AS avg_seconds, max(started_at) AS last_run_at, sum(records) AS total_records,
  round(100e0 * count(*) FILTER (WHERE status = 'success') / nullif(count(*), 0), 2) AS success_rate
FROM t WHERE started_at > {AS_OF} - INTERVAL '20' DAY GROUP BY task_name"""


@query("error_spikes", "D3")
def error_spikes(d):
    return f"""WITH t AS ({T.task_logs(d)}), last AS (SELECT max(started_at) AS newest FROM t)
SELECT task_name, count(*) AS error_count, min(started_at) AS first_error, max(started_at) AS last_error, {d.list_of('error', 'task_id')} AS messages
FROM t CROSS JOIN last WHERE status = 'failed' AND started_at > last.newest - INTERVAL '24' HOUR GROUP BY task_name HAVING count(*) >= 3"""


@query("missing_runs", "D4 I3")
def missing_runs(d):
    hours = f"({d.epoch(AS_OF)} - {d.epoch('max(started_at)')}) / 3600e0"
    return f"WITH t AS ({T.task_logs(d)}) SELECT task_name, max(started_at) AS last_run_at, round({hours}, 2) AS hours_since_run, {hours} > 24 AS is_overdue FROM t GROUP BY task_name"


@query("source_status", "D5")
def source_status(d):
    return f"""WITH b AS ({T.claims(d)}) SELECT source_module, source_type, status, count(*) AS n, count(DISTINCT company_id) AS companies, round(avg(score), 6) AS avg_quality, min(first_seen) AS earliest, max(last_seen) AS latest
FROM b GROUP BY source_module, source_type, status"""


@query("question_frequency", "D6")
def question_frequency(d):
    return f"""WITH s AS ({T.snapshots(d)}), p AS ({T.results(d)}) SELECT s.query_id, p.question, count(DISTINCT p.snapshot_id) AS appearances, round(avg(p.position), 6) AS avg_position, min(p.first_seen) AS earliest, max(p.last_seen) AS latest, {d.set_of('p.source_domain')} AS source_domains
FROM p JOIN s ON p.snapshot_id = s.snapshot_id GROUP BY s.query_id, p.question"""


@query("answer_sources", "D7")
def answer_sources(d):
    return f"""WITH p AS ({T.results(d)}) SELECT source_domain, count(*) AS answers, count(DISTINCT snapshot_id) AS snapshots, round(avg(position), 6) AS avg_position, min(first_seen) AS earliest, max(last_seen) AS latest FROM p WHERE source_domain IS NOT NULL GROUP BY source_domain"""


@query("questions_for_query", "Q2")
def questions_for_query(d, query_id: int = 7, limit: int = 20):
    return f"""WITH s AS ({T.snapshots(d)}), p AS ({T.results(d)}) SELECT p.question, p.source_domain, p.position, count(DISTINCT p.snapshot_id) AS appearances FROM p JOIN s ON p.snapshot_id = s.snapshot_id
WHERE s.query_id = {query_id} GROUP BY p.question, p.source_domain, p.position ORDER BY appearances DESC, p.position, p.question, p.source_domain LIMIT {limit}"""


@query("conflict_stats", "D8")
def conflict_stats(d):
    by = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_count" for s in ("pending", "duplicate", "not_duplicate", "needs_review"))
    return f"WITH x AS ({T.conflicts(d)}) SELECT conflict_type, count(*) AS total, {by}, round(avg(confidence), 6) AS avg_confidence, round(avg(match_score), 6) AS avg_match FROM x GROUP BY conflict_type"


@query("headline_counts", "D10 D12 R69")
def headline_counts(d):
    """All figures from one scan."""
    return f"""WITH c AS ({T.companies(d)}) SELECT count(*) AS total, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE phone IS NULL) AS no_phone, count(*) FILTER (WHERE website IS NULL) AS no_website,
  count(*) FILTER (WHERE last_updated IS NULL OR last_updated < {AS_OF} - INTERVAL '30' DAY) AS stale FROM c"""


@query("progress", "D11 R71")
def progress(d):
    return f"""WITH t AS ({T.task_logs(d)}) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS done, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed,
  CASE WHEN count(*) > 0 THEN round(100e0 * count(*) FILTER (WHERE status = 'success') / count(*), 2) ELSE 0e0 END AS percent FROM t"""


@query("content_stats", "D13 R59")
def content_stats(d):
    """Texts by length band."""
    return """SELECT CASE WHEN n_chars < 300 THEN 'thin' WHEN n_chars < 1500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS band, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1"""


@query("audit_stats", "D14 D15")
def audit_stats(d):
    """Numbers and text from JSON, averaged and counted by group."""
    k = f"CAST({d.json('props', '$.k')} AS int)"
    return f"""SELECT event_type, {k} % 5 AS bucket, count(*) AS n, round(avg({k}), 6) AS mean, count(*) FILTER (WHERE {k} > 50) AS high, max({k}) AS most FROM events GROUP BY event_type, {k} % 5"""


@query("directory_stats", "D16 R75")
def directory_stats(d):
    return f"""WITH b AS ({T.claims(d)}) SELECT coalesce(source_type, 'unknown') AS directory, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS found, round(avg(score), 6) AS avg_score, max(last_seen) AS last_check
FROM b WHERE last_seen >= CAST('1998-01-01 00:00:00' AS timestamp) GROUP BY 1"""


@query("runs_by_minute", "D17")
def runs_by_minute(d):
    return f"""WITH t AS ({T.task_logs(d)}) SELECT {d.minute('started_at')} AS minute, count(*) AS n, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS ok FROM t GROUP BY 1 ORDER BY minute DESC LIMIT 50"""


@query("classifier_metrics", "D18 N9 R62")
def classifier_metrics(d):
    """Confusion counts of a rule against labels, with guarded ratios."""
    return """WITH p AS (SELECT quality = 1 AS truth, toxic = 0 AS predicted FROM labels),
c AS (SELECT count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE NOT truth AND predicted) AS fp, count(*) FILTER (WHERE NOT truth AND NOT predicted) AS tn, count(*) FILTER (WHERE truth AND NOT predicted) AS fn FROM p)
SELECT tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS double) ELSE 0e0 END AS precision_value, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS double) ELSE 0e0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1, (tp + tn) / CAST(greatest(1, tp + fp + tn + fn) AS double) AS accuracy FROM c"""


@query("weighted_consensus", "D19 F1 F2 J36 J37 M7 M8 R74")
def weighted_consensus(d):
    """For every company the phone with most trust behind it; the first seen of equals; null below the threshold."""
    return f"""WITH b AS ({T.claims(d)}), v AS (SELECT company_id, source_id, source_type, lower(trim(phone)) AS value, {S.trust(d, 'source_type')} AS w FROM b WHERE coalesce(trim(phone), '') <> ''),
g AS (SELECT company_id, value, sum(w) AS weight, min(source_id) AS first_id, count(*) AS n FROM v GROUP BY company_id, value),
r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY weight DESC, first_id) AS rn, sum(weight) OVER (PARTITION BY company_id) AS total, count(*) OVER (PARTITION BY company_id) AS values_seen FROM g),
best AS (SELECT company_id, source_type AS best_source, w AS best_weight FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY w DESC, source_id) AS k FROM v) z WHERE k = 1)
SELECT r.company_id, CASE WHEN r.weight / CAST(r.total AS double) >= 0.5e0 THEN r.value END AS canonical, round(r.weight / CAST(r.total AS double), 6) AS agreement, r.values_seen, r.n AS supporting, best.best_source, {S.trust_tier('best.best_weight')} AS best_tier
FROM r JOIN best ON r.company_id = best.company_id WHERE r.rn = 1"""


@query("population_percentiles", "D20 J34")
def population_percentiles(d):
    """The value at place floor(n * p) of each segment's order, and the tier that it gives."""
    at = lambda p: f"max(CASE WHEN rn - 1 = CAST(floor(n * {p}e0) AS bigint) THEN balance END)"
    return f"""WITH c AS ({T.companies(d)}), r AS (SELECT segment, balance, row_number() OVER (PARTITION BY segment ORDER BY balance, id) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM c),
p AS (SELECT segment, {at(0.9)} AS p90, {at(0.5)} AS p50 FROM r GROUP BY segment)
SELECT c.segment, CASE WHEN c.balance >= p.p90 THEN 1 WHEN c.balance >= p.p50 THEN 2 ELSE 3 END AS tier, count(*) AS n, min(p.p90) AS p90, min(p.p50) AS p50 FROM c JOIN p ON c.segment = p.segment GROUP BY 1, 2"""


TREND = """r AS (SELECT *, row_number() OVER (PARTITION BY keyword, domain ORDER BY seen_at DESC, seq DESC) AS back, lead(position) OVER (PARTITION BY keyword, domain ORDER BY seen_at DESC, seq DESC) AS before{edges} FROM k),
t AS (SELECT keyword, domain, max(CASE WHEN back = 1 THEN position END) AS current_position, max(CASE WHEN back = 1 THEN before END) AS previous_position, avg(CASE WHEN seen_at > CAST('2024-01-24 00:00:00' AS timestamp) THEN position END) AS avg_7d,
  avg(position) AS avg_30d, min(position) AS best, max(position) AS worst, {deviation} AS deviation, count(*) AS points, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(DISTINCT CASE WHEN position <= 10 THEN {day} END) AS top_10_days FROM r GROUP BY keyword, domain)"""


def _trend(d) -> str:
    return f"k AS ({T.rankings(d)}), {TREND.format(day=d.day('seen_at'), edges=d.edges('position', 'PARTITION BY keyword, domain'), deviation=d.deviation('position', 'back'))}, a AS (SELECT *, coalesce(previous_position - current_position, 0) AS change FROM t)"


@query("ranking_trends", "E1 E3 E4")
def ranking_trends(d):
    return f"""WITH {_trend(d)} SELECT keyword, domain, current_position, previous_position, change, {S.trend('current_position', 'previous_position', 'change')} AS trend, {S.volatility('points', 'deviation')} AS volatility,
  {d.round6('coalesce(avg_7d, 0)')} AS avg_7d, {d.round6('avg_30d')} AS avg_30d, best, worst, top_10_days, points, first_seen, last_seen FROM a"""


@query("ranking_alerts", "E2 E7")
def ranking_alerts(d):
    """The alert between the last two points of each key, of those types that matter."""
    return f"""WITH {_trend(d)}, w AS (SELECT keyword, domain, previous_position, current_position, {S.alert('current_position', 'previous_position')} AS alert, last_seen FROM a)
SELECT * FROM w WHERE alert IS NOT NULL AND alert <> 'new_ranking'"""


@query("domain_summary", "E5")
def domain_summary(d):
    t = S.trend("current_position", "previous_position", "change")
    return f"""WITH {_trend(d)}, x AS (SELECT *, {t} AS trend FROM a),
m AS (SELECT domain, keyword, change, row_number() OVER (PARTITION BY domain ORDER BY change DESC, keyword) AS up, row_number() OVER (PARTITION BY domain ORDER BY change, keyword) AS down FROM x)
SELECT x.domain, count(*) AS keywords, count(*) FILTER (WHERE trend IN ('up', 'strong_up')) AS improving, count(*) FILTER (WHERE trend IN ('down', 'strong_down')) AS declining, count(*) FILTER (WHERE trend = 'stable') AS stable,
  count(*) FILTER (WHERE trend = 'new') AS new_count, count(*) FILTER (WHERE current_position <= 3) AS top_3, count(*) FILTER (WHERE current_position <= 10) AS top_10, count(*) FILTER (WHERE current_position <= 20) AS top_20,
  round(avg(current_position), 6) AS avg_position, round(avg(x.change), 6) AS avg_change, {d.set_of('m.keyword', 'm.up <= 5 AND m.change > 0')} AS movers, {d.set_of('m.keyword', 'm.down <= 5 AND m.change < 0')} AS drops
FROM x JOIN m ON x.domain = m.domain AND x.keyword = m.keyword GROUP BY x.domain"""


@query("compare_domains", "E6")
def compare_domains(d):
    return f"""WITH {_trend(d)} SELECT keyword, domain, current_position, change, row_number() OVER (PARTITION BY keyword ORDER BY coalesce(current_position, 999), domain) AS rank,
  first_value(domain) OVER (PARTITION BY keyword ORDER BY coalesce(current_position, 999), domain) AS leader, first_value(domain) OVER (PARTITION BY keyword ORDER BY change DESC, domain) AS most_improved FROM a"""


@query("rising_competitors", "E8 E9")
def rising_competitors(d):
    """Classes by change against the mean of a week and a month before; the fifty that rise most."""
    trend = _trend(d).replace(T.rankings(d), T.drifting_rankings(d))
    return f"""WITH {trend}, x AS (SELECT domain, keyword, current_position, current_position - avg_7d AS week, current_position - avg_30d AS month, deviation FROM a),
y AS (SELECT domain, keyword, current_position, round(week, 6) AS week, round(month, 6) AS month, {S.ranking_class('week', 'month', 'deviation')} AS class FROM x)
SELECT * FROM y WHERE class = 'RISING' AND week < -3 ORDER BY week, keyword, domain LIMIT 50"""  # the view's own limit


@query("changed_pages", "E10 H34")
def changed_pages(d):
    """Domains whose last two snapshots' pages differ by hash."""
    return f"""WITH p AS ({T.results(d)}), r AS (SELECT domain, {d.sha('url')} AS hash, row_number() OVER (PARTITION BY domain ORDER BY snapshot_id DESC, position DESC) AS rn FROM p)
SELECT domain, count(DISTINCT hash) AS versions FROM r WHERE rn <= 2 GROUP BY domain HAVING count(DISTINCT hash) > 1"""


@query("recent_rates", "E11")
def recent_rates(d):
    """Success over each task's last hundred runs at every run."""
    return f"""WITH t AS ({T.task_logs(d)}) SELECT task_id, task_name, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER w AS ok_100, count(*) OVER w AS n_100
FROM t WINDOW w AS (PARTITION BY task_name ORDER BY started_at, task_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""


@query("keyword_gap_top", "F3")
def keyword_gap_top(d):
    return f"WITH k AS ({T.keywords(d)}) SELECT id, keyword, position, volume FROM k WHERE position IS NOT NULL ORDER BY volume DESC, id LIMIT 100"


@query("backlink_gap_top", "F4")
def backlink_gap_top(d):
    return f"""WITH p AS ({T.results(d)}), g AS (SELECT source_domain, count(*) AS links, {d.set_of('domain')} AS linked FROM p WHERE source_domain IS NOT NULL GROUP BY source_domain)
SELECT source_domain, links, replace(linked, ',', ', ') AS linked FROM g ORDER BY links DESC, source_domain LIMIT 100"""


@query("to_reembed", "F5 Q3")
def to_reembed(d):
    """Pages without a version or with another one, those without first."""
    return """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'v1' ELSE 'v2' END AS version, url FROM pages WHERE page_id % 3 <> 2 ORDER BY CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END, page_id LIMIT 100"""


@query("stratified_examples", "F6 R66 R67")
def stratified_examples(d):
    """Five texts of each label, by a hash of their id."""
    return f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {d.sha("CAST(doc_id AS string) || '-42'")}, doc_id) AS rn FROM labels) SELECT doc_id, quality FROM r WHERE rn <= 5"""


@query("random_sample", "F7")
def random_sample(d):
    return f"SELECT c_custkey AS id FROM customer ORDER BY {d.sha("CAST(c_custkey AS string) || '-7'")}, c_custkey LIMIT 25"


@query("needs_validation", "I1")
def needs_validation(d):
    status = f"CASE WHEN last_updated IS NULL THEN 'never_validated' WHEN last_updated < {AS_OF} - INTERVAL '30' DAY THEN 'stale' WHEN last_updated < {AS_OF} - INTERVAL '7' DAY THEN 'aging' ELSE 'recent' END"
    return f"WITH c AS ({T.companies(d)}) SELECT id, name, domain, {status} AS validation_status FROM c WHERE last_updated IS NULL OR last_updated < {AS_OF} - INTERVAL '30' DAY"


@query("quality_dashboard", "I5")
def quality_dashboard(d):
    tier = S.tiers("quality_score", ((80, "'high'"), (60, "'medium'"), (40, "'low'")), "'very_low'")
    return f"WITH c AS ({T.companies(d)}) SELECT {tier} AS quality_tier, {d.day('last_updated')} AS day, count(*) AS n, round(avg(quality_score), 6) AS mean FROM c GROUP BY 1, 2"


@query("company_search", "B1 B17 R61 A18")
def company_search(d):
    return f"""WITH c AS ({T.companies(d)}) SELECT id, name, domain, website FROM c WHERE active AND (name ILIKE '%clean%' OR domain ILIKE '%clean%' OR website ILIKE '%site1%') ORDER BY CASE WHEN last_updated IS NULL THEN 1 ELSE 0 END, last_updated DESC, id LIMIT 100"""


@query("stale_or_missing", "B2 B15 B16")
def stale_or_missing(d):
    return f"WITH c AS ({T.companies(d)}) SELECT id, name, last_updated FROM c WHERE active AND (last_updated IS NULL OR last_updated < {AS_OF} - INTERVAL '60' DAY) AND phone IS NULL"


@query("serp_words", "K1 R60")
def serp_words(d):
    """Words unnested from phrases, counted; the top ten."""
    return f"WITH k AS ({T.keywords(d)}), w AS (SELECT {d.unnest(d.split('keyword', ' '))} AS word FROM k) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10"


@query("json_status", "K2")
def json_status(d):
    k = d.json("props", "$.k")
    return f"SELECT event_id, CASE WHEN {k} IS NULL THEN 'missing' WHEN CAST({k} AS int) = 0 THEN 'zero' WHEN CAST({k} AS int) > 50 THEN 'high' ELSE 'low' END AS status FROM events"


@query("resolved_conflicts", "K3 Q7 O6")
def resolved_conflicts(d):
    """Pending pairs of one type become duplicates, with the evidence written as JSON; others stay."""
    return f"""WITH x AS ({T.conflicts(d)}) SELECT conflict_id, CASE WHEN status = 'pending' AND conflict_type = 'domain_match' THEN 'duplicate' ELSE status END AS status,
  CASE WHEN status = 'pending' AND conflict_type = 'domain_match' THEN '{{"resolution":{{"keep_company_id":' || CAST(company_id_1 AS string) || ',"merge_company_id":' || CAST(company_id_2 AS string) || '}}}}' END AS evidence FROM x"""


@query("duplicates_marked", "O7 O8")
def duplicates_marked(d):
    return f"WITH c AS ({T.companies(d)}), x AS (SELECT DISTINCT company_id_2 AS id FROM ({T.conflicts(d)}) z WHERE status = 'duplicate') SELECT c.id, c.active AND x.id IS NULL AS active FROM c LEFT JOIN x ON c.id = x.id"


@query("upserted_companies", "O1 O2 Q5 Q6 Q8 G5 K4 K5")
def upserted_companies(d):
    """Claims folded by company, later ones over earlier where they say something, then over the stored row."""
    last = lambda c: f"max_by({c}, source_id) FILTER (WHERE coalesce({c}, '') <> '')"
    return f"""WITH c AS ({T.companies(d)}), b AS ({T.claims(d)}), n AS (SELECT company_id, {last('name')} AS name, {last('phone')} AS phone, {last('street')} AS street, max(last_seen) AS seen FROM b GROUP BY company_id)
SELECT coalesce(c.id, n.company_id) AS id, coalesce(n.name, c.name) AS name, coalesce(n.phone, c.phone) AS phone, coalesce(n.street, c.street) AS street, n.seen AS updated_at, c.id IS NULL AS is_new FROM c FULL OUTER JOIN n ON c.id = n.company_id"""


@query("applied_changes", "O4 O5 R72 R73")
def applied_changes(d):
    """A change log folded by key: the last approved change wins, a delete removes the row."""
    return """WITH l AS (SELECT o_custkey AS key, o_orderkey AS change_id, CASE WHEN o_orderkey % 7 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op, CAST(floor(o_totalprice) AS bigint) AS value, o_orderstatus AS status FROM orders),
a AS (SELECT key, op, value, row_number() OVER (PARTITION BY key ORDER BY change_id DESC) AS rn FROM l WHERE status = 'F')
SELECT c.c_custkey AS key, coalesce(a.value, 0) AS value FROM customer c LEFT JOIN a ON c.c_custkey = a.key AND a.rn = 1 WHERE coalesce(a.op, 'UPDATE') <> 'DELETE'"""


@query("claimed_targets", "P1")
def claimed_targets(d):
    """Each of four workers' next ten targets, by priority, then id."""
    return """WITH t AS (SELECT o_orderkey AS id, o_custkey % 4 AS worker, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY priority, id) AS rn FROM t) SELECT worker, id, priority FROM r WHERE rn <= 10"""


@query("recovered_targets", "P2 P3 P12 P13 R78")
def recovered_targets(d):
    """In progress with no heartbeat or an old one: planned again, unless tried too often."""
    return f"""WITH t AS (SELECT event_id AS id, user_id AS worker, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS heartbeat, event_id % 5 AS attempts, CASE WHEN value > 50 THEN 'IN_PROGRESS' ELSE 'DONE' END AS status FROM events)
SELECT id, CASE WHEN lower(status) = 'in_progress' AND (heartbeat IS NULL OR heartbeat < {AS_OF} - INTERVAL '60' MINUTE) THEN CASE WHEN attempts >= 4 THEN 'FAILED' ELSE 'PLANNED' END ELSE status END AS status,
  CASE WHEN lower(status) = 'in_progress' AND (heartbeat IS NULL OR heartbeat < {AS_OF} - INTERVAL '60' MINUTE) THEN attempts + 1 ELSE attempts END AS attempts FROM t"""


@query("latest_events", "P4 R76 R79 P5")
def latest_events(d):
    """The latest event of each target."""
    return "SELECT user_id AS target, max(event_id) AS last_event, max_by(event_type, event_id) AS last_type, max_by(ts, event_id) AS last_at, count(*) AS n FROM events GROUP BY user_id"


@query("quarantine", "P8 P9")
def quarantine(d):
    """A third error of a user within sixty minutes opens a quarantine; earlier ones within a day raise its tier."""
    return f"""WITH e AS (SELECT event_id, user_id, {d.epoch('ts')} AS s FROM events WHERE event_type = 'error'), w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour_errors,
  count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_errors FROM e) SELECT event_id, user_id, hour_errors, least(5, day_errors) AS tier, hour_errors >= 3 AS quarantined FROM w"""


@query("provider_status", "R70 R58")
def provider_status(d):
    return """WITH a AS (SELECT 'orders' AS provider, o_orderstatus AS status, o_orderdate AS seen FROM orders UNION ALL SELECT 'lines', l_linestatus, l_shipdate FROM lineitem) SELECT provider, status, count(*) AS n, max(seen) AS latest FROM a GROUP BY provider, status"""
