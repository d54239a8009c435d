"""Business tables derived from the driver's tables, as SQL that either engine reads.

Every value follows from the row's own keys, so results are the same wherever they are computed. The
fixed instant AS_OF takes the place of now.
"""

from __future__ import annotations

from ..plans.dialect import Dialect

AS_OF = "CAST('2024-01-31 00:00:00' AS timestamp)"


def companies(d: Dialect) -> str:
    """id, name, domain, website, phone, street, city, state, zip, address, active, rating counts, last_updated, quality."""
    return f"""SELECT c_custkey AS id,
  CASE c_custkey % 7 WHEN 0 THEN 'The Bright ' || c_mktsegment || ' Co.' WHEN 1 THEN 'ABC  Window Cleaning LLC' WHEN 2 THEN ' Clean & Shine Inc '
    WHEN 3 THEN c_name || ' Enterprises' WHEN 4 THEN 'llc' WHEN 5 THEN 'Joe''s Pressure-Washing, Ltd.' ELSE lower(c_name) || ' supplies' END AS name,
  'shop' || CAST(c_custkey % 40 AS string) || CASE c_custkey % 3 WHEN 0 THEN '.com' WHEN 1 THEN '.org' ELSE '.co.uk' END AS domain,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP://www.Site' || CAST(c_custkey % 40 AS string) || '.com/' WHEN 2 THEN 'example' || CAST(c_custkey % 40 AS string) || '.com/page#frag'
    WHEN 3 THEN 'https://m.site' || CAST(c_custkey % 40 AS string) || '.co.uk/a/b/?utm_source=x&b=2&a=1' WHEN 4 THEN 'https://www.facebook.com/p' || CAST(c_custkey AS string)
    WHEN 5 THEN 'https://joes.myshopify.com/shop/' WHEN 6 THEN 'ftp://files.example.com' WHEN 7 THEN 'localhost' ELSE 'http://site' || CAST(c_custkey % 40 AS string) || '.net/Path/?gclid=9&q=Z' END AS website,
  CASE c_custkey % 8 WHEN 0 THEN '(555) 123-' || lpad(CAST(c_custkey % 50 AS string), 4, '0') WHEN 1 THEN '555.123.4567 ext. 12' WHEN 2 THEN '+1 212 555 ' || lpad(CAST(c_custkey % 50 AS string), 4, '0')
    WHEN 3 THEN '12345' WHEN 4 THEN NULL WHEN 5 THEN '1-312-555-01' || lpad(CAST(c_custkey % 50 AS string), 2, '0') WHEN 6 THEN '155512345678' ELSE '0125550100' END AS phone,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(c_custkey AS string) || ' North Main Street' WHEN 2 THEN CAST(c_custkey AS string) || ' Oak Ave'
    WHEN 3 THEN CAST(c_custkey AS string) || '  Sunset   Boulevard Suite 5' WHEN 4 THEN CAST(c_custkey AS string) || ' Elm Drive' ELSE CAST(c_custkey AS string) || ' West Court' END AS street,
  CASE c_nationkey % 5 WHEN 0 THEN 'St. Louis' WHEN 1 THEN 'O''Fallon' WHEN 2 THEN 'Winston-Salem' WHEN 3 THEN 'Ft Worth' ELSE 'Los  Angeles ' END AS city,
  CASE c_nationkey % 5 WHEN 0 THEN 'MO' WHEN 1 THEN 'IL' WHEN 2 THEN 'NC' WHEN 3 THEN 'TX' ELSE 'ca' END AS state,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN lpad(CAST(c_custkey % 99999 AS string), 5, '0') ELSE lpad(CAST(c_custkey % 99999 AS string), 5, '0') || '-1234' END AS zip,
  c_custkey % 11 <> 0 AS active, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 80 AS int) END AS reviews,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST('2024-01-01 00:00:00' AS timestamp) - INTERVAL '1' DAY * CAST(c_custkey % 120 AS int) END AS last_updated,
  CAST(floor(abs(c_acctbal)) AS int) % 101 AS quality_score, c_nationkey AS nation_id, c_acctbal AS balance, c_mktsegment AS segment
  FROM customer"""


def claims(d: Dialect) -> str:
    """What each source says of a company: source_id, company_id, source_type, name, phone, street, city, status, score, times."""
    return """SELECT l_orderkey * 10 + l_linenumber AS source_id, l_partkey AS company_id,
  CASE l_suppkey % 9 WHEN 0 THEN 'google' WHEN 1 THEN 'yelp' WHEN 2 THEN 'YP' WHEN 3 THEN 'facebook' WHEN 4 THEN 'website' WHEN 5 THEN 'serp' WHEN 6 THEN 'google_business' WHEN 7 THEN 'manta' ELSE NULL END AS source_type,
  CASE l_linenumber % 4 WHEN 0 THEN 'scrape_yp' WHEN 1 THEN 'citation_crawler' WHEN 2 THEN NULL ELSE 'unknown' END AS source_module,
  CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 40 THEN '' WHEN l_quantity > 30 THEN ' Acme ' || CAST(l_partkey AS string) ELSE 'acme ' || CAST(l_partkey AS string) END AS name,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE '212555' || lpad(CAST((l_partkey + CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END) % 10000 AS string), 4, '0') END AS phone,
  CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN CAST(l_partkey % 100 AS string) || ' Main St' ELSE CAST(l_partkey % 100 AS string) || ' Main Street' END AS street,
  CASE l_linestatus WHEN 'O' THEN 'Austin' ELSE 'austin' END AS city,
  CASE l_linenumber % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'gone' END AS status,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_quantity * 2) AS int) END AS score, l_shipdate AS first_seen, l_shipdate + INTERVAL '10' DAY AS last_seen
  FROM lineitem"""


def task_logs(d: Dialect) -> str:
    """Runs of tasks: task_id, task_name, status, started_at, seconds, records, error."""
    return """SELECT event_id AS task_id, event_type AS task_name, CASE WHEN value > 60 THEN 'success' WHEN value > 20 THEN 'failed' ELSE 'running' END AS status,
  ts AS started_at, value AS seconds, CAST(floor(value) AS int) % 50 AS records, CASE WHEN value <= 60 THEN 'error ' || CAST(event_id % 10 AS string) END AS error, user_id
  FROM events"""


def snapshots(d: Dialect) -> str:
    return "SELECT o_orderkey AS snapshot_id, o_custkey AS query_id, o_orderdate AS captured_at, o_totalprice AS total FROM orders"


def results(d: Dialect) -> str:
    """Ranked rows of a snapshot: snapshot_id, position, domain, url, question, source_domain."""
    return """SELECT l_orderkey AS snapshot_id, l_linenumber AS position, 'd' || CAST(l_partkey % 50 AS string) || '.com' AS domain,
  'https://d' || CAST(l_partkey % 50 AS string) || '.com/p' || CAST(l_suppkey AS string) AS url, 'q' || CAST(l_suppkey % 12 AS string) AS question,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE 's' || CAST((l_suppkey * 31 + l_partkey * 7) % 211 AS string) || '.org' END AS source_domain, l_shipdate AS first_seen, l_shipdate + INTERVAL '5' DAY AS last_seen
  FROM lineitem"""


def conflicts(d: Dialect) -> str:
    """Pairs of companies that may be one: conflict_id, company_id_1 < company_id_2, type, scores, status, detected_at."""
    return """SELECT o_orderkey AS conflict_id, least(o_custkey, o_orderkey % 150 + 1) AS company_id_1, greatest(o_custkey, o_orderkey % 150 + 1) AS company_id_2,
  CASE o_orderkey % 3 WHEN 0 THEN 'domain_match' WHEN 1 THEN 'phone_match' ELSE 'fuzzy_name_match' END AS conflict_type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 100) / 100e0 END AS confidence, (o_orderkey % 50) / 50e0 AS match_score,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'duplicate' ELSE 'not_duplicate' END AS status, o_orderdate AS detected_at
  FROM orders WHERE o_custkey <> o_orderkey % 150 + 1"""


def rankings(d: Dialect) -> str:
    """A position of a keyword and domain at an instant: keyword, domain, position, seen_at, seq."""
    return "SELECT user_id AS keyword, event_type AS domain, CAST(floor(value) AS bigint) % 100 + 1 AS position, ts AS seen_at, event_id AS seq FROM events"


def drifting_rankings(d: Dialect) -> str:
    """The same with positions that move slowly: some keywords rise in the last week, some fall, others stay."""
    day = f"({d.day('ts')} % 100)"
    late = f"CASE WHEN {day} > 20 THEN {day} - 20 ELSE 0 END"
    return f"SELECT user_id % 20 AS keyword, event_type AS domain, CAST(40 + user_id % 20 + CASE user_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END * ({late}) AS bigint) AS position, ts AS seen_at, event_id AS seq FROM events"


def keywords(d: Dialect) -> str:
    """Search phrases with a page of results: id, keyword, counts and flags."""
    return """SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'buy ' || lower(p_name) WHEN 1 THEN 'how to use ' || lower(p_name) WHEN 2 THEN 'best ' || lower(p_type) WHEN 3 THEN lower(p_name) || ' near me'
    WHEN 4 THEN lower(p_brand) || ' login' WHEN 5 THEN 'free ' || lower(p_name) || ' tips' WHEN 6 THEN lower(p_brand) || '.com' WHEN 7 THEN 'what is ' || lower(p_type) ELSE lower(p_type) || ' ' || lower(p_name) END AS keyword,
  p_size % 5 AS ad_count, p_size % 2 = 0 AS has_ads, p_size % 3 = 0 AS has_shopping, p_size % 4 = 0 AS has_snippet, p_size % 5 < 3 AS has_paa, p_size % 6 AS paa_count,
  CAST(power(10, p_size % 9) AS bigint) - 1 AS total_results, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 12 + 1 END AS autocomplete, p_size % 10 AS related, p_size % 8 = 0 AS has_panel,
  p_size % 9 = 0 AS has_local, p_size % 11 = 0 AS has_video, p_size % 13 = 0 AS has_images,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 60 + 1 AS int) END AS position, CAST(floor(p_retailprice) AS int) AS volume
  FROM part"""


def domains(d: Dialect) -> str:
    """Domains of all kinds, one for each part: id, domain."""
    return """SELECT p_partkey AS id, CASE p_partkey % 14 WHEN 0 THEN 'www.wikipedia.org' WHEN 1 THEN 'blog' || CAST(p_size AS string) || '.wordpress.com' WHEN 2 THEN 'citydirectory' || CAST(p_size AS string) || '.com'
    WHEN 3 THEN 'daily' || CAST(p_size AS string) || 'news.com' WHEN 4 THEN 'agency.gov' WHEN 5 THEN 'state' || CAST(p_size AS string) || '.edu' WHEN 6 THEN 'abc.io' WHEN 7 THEN 'forum' || CAST(p_size AS string) || '.net'
    WHEN 8 THEN 'www.yelp.com' WHEN 9 THEN 'en.wikipedia.org' WHEN 10 THEN 'averylongdomainname' || CAST(p_size AS string) || '.co' WHEN 11 THEN 'nytimes.com' WHEN 12 THEN 'tools' || CAST(p_size AS string) || '.org' ELSE 'plain' || CAST(p_size AS string) || '.com' END AS domain
  FROM part"""
