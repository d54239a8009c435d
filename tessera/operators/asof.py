"""As-of joins: the latest observation before an instant, and scores made of what was known then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S
from ..plans.dialect import SPARK, Dialect
from ..plans.registry import frame, run_sql
from ..sources import stand_ins as T

#: Seconds of a stretch of time, by which the rows of one key are dealt over tasks.
STRETCH = 90 * 86400


def as_of(asked: DataFrame, seen: DataFrame, on: list[str], at: str, since: str, carry: list[str], stretch: int = STRETCH) -> DataFrame:
    """asked with the columns `carry` of the latest row of seen that agrees in `on` and whose `since` is no later than `at`; nulls where there is none.

    No pair of an instant and an earlier observation is made: the rows of both sides are sorted together by key and stretch of time, and each instant takes the
    last observation before it, in its stretch or, through a row for each key and stretch, in an earlier one. So a key's rows are never in one task,
    whatever their number. Rows with a null key or time match nothing; of observations of one key and time one must have been chosen.
    """
    held, none = F.struct(*carry), F.lit(None).cast(seen.select(F.struct(*carry).alias("x")).schema[0].dataType)
    part = lambda c: F.floor(F.unix_timestamp(c) / stretch)
    rows = asked.withColumns({"_when": F.col(at), "_held": none, "_asks": F.lit(1)})
    known = seen.dropna(subset=[*on, since]).select(*on, F.col(since).alias("_when"), held.alias("_held"), F.lit(0).alias("_asks"))
    both = rows.unionByName(known, allowMissingColumns=True).withColumn("_part", part("_when"))
    here = F.last("_held", ignorenulls=True).over(W.partitionBy(*on, "_part").orderBy("_when", "_asks"))
    # what a stretch starts with
    ends = both.groupBy(*on, "_part").agg(F.max_by("_held", F.when(F.col("_asks") == 0, F.col("_when"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*on).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*on, "_part", before.alias("_before")).where("_before is not null")
    found = both.withColumn("_here", here).where("_asks = 1").drop("_held", "_asks", "_when")
    found = found.join(ends, [*on, "_part"], "left").withColumn("_found", F.coalesce("_here", "_before"))
    return found.select(*asked.columns, *[F.col("_found")[c].alias(c) for c in carry])


def as_of_each(asked: DataFrame, seen: DataFrame, on: list[str], kind: str, kinds: list[str], at: str, since: str, carry: list[str], stretch: int = STRETCH) -> DataFrame:
    """asked, a row for each of kinds, with the columns `carry` of the latest row of seen of that kind, as as_of gives them for asked times kinds on on and kind.

    An instant is sorted among its key's observations once, not once for each kind: it takes the last of every kind there, and becomes a row for each at the end.
    """
    held = F.struct(*carry)
    none = F.lit(None).cast(seen.select(held.alias("x")).schema[0].dataType)
    part = lambda c: F.floor(F.unix_timestamp(c) / stretch)
    rows = asked.withColumns({"_when": F.col(at), "_held": none, "_kind": F.lit(None).cast("int"), "_asks": F.lit(1)})
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)).cast("int")
    known = seen.dropna(subset=[*on, since]).select(*on, F.col(since).alias("_when"), held.alias("_held"), place.alias("_kind"), F.lit(0).alias("_asks")).where("_kind > 0")
    both = rows.unionByName(known, allowMissingColumns=True).withColumn("_part", part("_when"))
    mine = lambda k: F.when(F.col("_kind") == k, F.col("_held"))
    each = range(1, len(kinds) + 1)
    in_part = W.partitionBy(*on, "_part").orderBy("_when", "_asks")
    ends = both.groupBy(*on, "_part").agg(*[F.max_by("_held", F.when(F.col("_kind") == k, F.col("_when"))).alias(f"_end{k}") for k in each])
    earlier = W.partitionBy(*on).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*on, "_part", *[F.last(f"_end{k}", ignorenulls=True).over(earlier).alias(f"_before{k}") for k in each])
    found = both.select("*", *[F.last(mine(k), ignorenulls=True).over(in_part).alias(f"_here{k}") for k in each]).where("_asks = 1")
    found = found.join(ends, [*on, "_part"], "left")
    one = lambda k, name: F.struct(F.lit(name).alias(kind), F.coalesce(f"_here{k}", f"_before{k}").alias("_found"))
    found = found.select(*asked.columns, F.explode(F.array(*[one(k, name) for k, name in zip(each, kinds, strict=True)])).alias("_x"))
    return found.select(*asked.columns, F.col("_x")[kind].alias(kind), *[F.col("_x")["_found"][c].alias(c) for c in carry])


#: Directories and their points, and those that count together.
KEY_DIRECTORIES = {"google_business": 25, "yelp": 15, "yellowpages": 10, "bbb": 10, "facebook": 10}
SECONDARY_DIRECTORIES = ("angies_list", "thumbtack", "homeadvisor", "mapquest", "manta")


def observations(d: Dialect) -> str:
    """What a directory was seen to say of a company: company_id, directory, seen, present, nap, reviews; the last of each instant.

    nap: how far name, phone and street agree with the company's own record, 0.4, 0.3 and 0.3.
    """
    kind = "CASE source_type WHEN 'google' THEN 'google_business' WHEN 'YP' THEN 'yellowpages' WHEN 'serp' THEN 'bbb' WHEN 'website' THEN 'mapquest' ELSE source_type END"
    street = d.sub("street", "Street$", "St")
    nap = f"""CASE WHEN trim(lower(name)) = 'acme ' || CAST(company_id AS string) THEN 0.4e0 ELSE 0e0 END + CASE WHEN phone = '212555' || lpad(CAST(company_id % 10000 AS string), 4, '0') THEN 0.3e0 ELSE 0e0 END
    + CASE WHEN {street} = CAST(company_id % 100 AS string) || ' Main St' THEN 0.3e0 ELSE 0e0 END"""
    return f"""SELECT company_id, directory, seen, present, nap, reviews FROM (SELECT *, row_number() OVER (PARTITION BY company_id, directory, seen ORDER BY source_id DESC) AS r FROM (
    SELECT company_id, {kind} AS directory, CAST(first_seen AS timestamp) AS seen, source_id, status = 'ok' AS present, {nap} AS nap, score AS reviews FROM ({T.claims(d)}) c WHERE source_type IS NOT NULL) o) p WHERE r = 1"""


def link_totals(d: Dialect) -> str:
    """Of each domain at each day with a new link: domain, seen, links, domains, followed, authority (sum over linking domains), up to then."""
    return f"""WITH l AS (SELECT domain, source_domain, CAST(min(first_seen) AS timestamp) AS seen, count(*) AS links, count(*) FILTER (WHERE position <= 4) AS followed FROM ({T.results(d)}) r WHERE source_domain IS NOT NULL GROUP BY domain, source_domain),
  g AS (SELECT domain, seen, sum(links) AS links, count(*) AS domains, sum(followed) AS followed, sum({S.link_authority(d, 'source_domain')}) AS authority FROM l GROUP BY domain, seen)
  SELECT domain, seen, {', '.join(f'sum({c}) OVER (PARTITION BY domain ORDER BY seen) AS {c}' for c in ('links', 'domains', 'followed', 'authority'))} FROM g"""


def audits(d: Dialect) -> str:
    """When each company is looked at: company_id, audited_at, domain (null: it has none)."""
    return "SELECT DISTINCT o_custkey AS company_id, CAST(o_orderdate AS timestamp) AS audited_at, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'd' || CAST(o_custkey % 50 AS string) || '.com' END AS domain FROM orders"


def _scores(d: Dialect, listed: str, linked: str) -> str:
    """listed: company_id, audited_at, directory and its observation; linked: company_id, audited_at, domain and its link totals."""
    of = lambda name: f"directory = '{name}' AND present"
    points = " + ".join(f"coalesce(max(CASE WHEN {of(name)} THEN {w} * (0.6e0 + 0.4e0 * nap) END), 0e0)" for name, w in KEY_DIRECTORIES.items())
    second = f"least(30, 3 * count(*) FILTER (WHERE present AND directory IN ({', '.join(repr(x) for x in SECONDARY_DIRECTORIES)})))"
    volume = S.tiers("coalesce(sum(CASE WHEN present THEN reviews END), 0)", ((51, 50), (26, 35), (11, 25), (1, 15)), 0)
    # the mean of ratings, which are twentieths: sums of whole numbers are the same in any order
    rated = "CASE WHEN present AND reviews > 0 THEN reviews END"
    rating = f"(sum({rated}) / (20e0 * count({rated})))"
    stars = f"CASE WHEN count({rated}) = 0 THEN 0 ELSE {S.tiers(rating, (('4.5e0', 50), ('4.0e0', 40), ('3.5e0', 30), ('3.0e0', 20)), 10)} END"
    shown = "count(*) FILTER (WHERE present)"
    google = f"coalesce(max(CASE WHEN {of('google_business')} THEN 30 + CASE WHEN nap >= 0.8e0 THEN 20 ELSE 0 END END), 0)"
    links = f"""CASE WHEN domain IS NULL OR coalesce(links, 0) = 0 THEN 0e0 ELSE {S.tiers('domains', ((21, 40), (11, 30), (6, 20), (1, 10)), 0)} + 30e0 * followed / links + {S.tiers('authority * 1e0 / domains', ((41, 30), (21, 20), (1, 10)), 0)} END"""
    return f"""SELECT company_id, audited_at, round(citation, 6) AS citation, round(link, 6) AS link, review, complete, round(total, 6) AS total, {S.grade('round(total, 6)')} AS grade FROM (
  SELECT *, citation * 0.4e0 + link * 0.3e0 + review * 0.2e0 + complete * 0.1e0 AS total FROM (
    SELECT c.company_id, c.audited_at, citation, least(100e0, {links}) AS link, review, least(100, google + CASE WHEN domain IS NULL THEN 0 ELSE 30 END + CASE WHEN shown >= 5 THEN 20 WHEN shown >= 3 THEN 10 ELSE 0 END) AS complete FROM (
      SELECT company_id, audited_at, least(100e0, {points} + {second}) AS citation, least(100, {volume} + {stars}) AS review, {google} AS google, {shown} AS shown FROM {listed} o GROUP BY company_id, audited_at) c
    JOIN {linked} l ON c.company_id = l.company_id AND c.audited_at = l.audited_at) t) s"""


def _authority_sql(d: Dialect) -> str:
    names = ", ".join(f"('{x}')" for x in (*KEY_DIRECTORIES, *SECONDARY_DIRECTORIES))
    return f"""WITH a AS ({audits(d)}), obs AS ({observations(d)}), tot AS ({link_totals(d)}), names(directory) AS (VALUES {names}),
listed AS (SELECT q.company_id, q.audited_at, q.directory, o.present, o.nap, o.reviews FROM (SELECT a.company_id, a.audited_at, names.directory FROM a CROSS JOIN names) q
  ASOF LEFT JOIN obs o ON q.company_id = o.company_id AND q.directory = o.directory AND q.audited_at >= o.seen),
linked AS (SELECT a.company_id, a.audited_at, a.domain, t.links, t.domains, t.followed, t.authority FROM a ASOF LEFT JOIN tot t ON a.domain = t.domain AND a.audited_at >= t.seen)
{_scores(d, 'listed', 'linked')}"""


@frame("local_authority", "J4 J5 J6 J7 J8", oracle=_authority_sql)
def local_authority(spark, sf_dir) -> DataFrame:
    """Citations 0.4, links 0.3, reviews 0.2, completeness 0.1 and a grade of each company whenever it is looked at, from what each directory and each linking domain had last been seen to say by then."""
    d = SPARK
    asked = run_sql(spark, sf_dir, audits(d))
    directories = [*KEY_DIRECTORIES, *SECONDARY_DIRECTORIES]
    listed = as_of_each(asked.select("company_id", "audited_at"), run_sql(spark, sf_dir, observations(d)), ["company_id"], "directory", directories, "audited_at", "seen", ["present", "nap", "reviews"])
    linked = as_of(asked, run_sql(spark, sf_dir, link_totals(d)), ["domain"], "audited_at", "seen", ["links", "domains", "followed", "authority"])
    return spark.sql(_scores(d, "{listed}", "{linked}"), listed=listed, linked=linked)
