"""Pages written from tables and parsed back: what the parsers find is what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..plans.dialect import SPARK
from ..plans.registry import frame, query, run_sql
from ..sources import stand_ins as T


#: Pieces of a page at most, where a key's pieces are numbered: a key with more has several pages.
PER_PAGE = 200


def pages_of(rows: DataFrame, key: str, order: str, numbered: bool = False, around: tuple[str, str] = ("<html><body>", "</body></html>")) -> DataFrame:
    """Pages of each key: the pieces (key, order, piece) in order. numbered: order is a number of the piece's own, by which pages are cut."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"])
    page = F.floor(F.col(order) / PER_PAGE) if numbered else F.lit(0)
    return rows.groupBy(key, page.alias("page")).agg(F.concat(F.lit(around[0]), F.array_join(parts, ""), F.lit(around[1])).alias("html")).withColumn("base", F.lit("https://host.example/"))


def parsed(pages: DataFrame, key: str, parser) -> DataFrame:
    return pages.select(key, F.explode(parser("html", "base")).alias("x")).select(key, "x.*")


def _results_sql(d) -> str:
    return f"SELECT snapshot_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY position, url, question, domain) AS int) AS position, 'Result ' || question AS title, url, domain FROM ({T.results(d)}) r"


@frame("page_results", "L9 R55", _results_sql)
def page_results(spark, sf_dir):
    """Ranked results from stored pages of results; every other one is behind a redirect, and links without text are none."""
    rows = run_sql(spark, sf_dir, T.results(SPARK))
    link = F.when(F.col("position") % 2 == 0, F.concat(F.lit("/url?q="), "url", F.lit("&amp;sa=U"))).otherwise(F.col("url"))
    piece = F.concat(F.lit('<div><a href="'), link, F.lit('"><h3>Result '), "question", F.lit('</h3></a><a href="/settings">Tools</a><a href="https://ad.example/"></a></div>'))
    placed = rows.select("snapshot_id", F.struct("position", "url", "question", "domain").alias("place"), piece.alias("piece"))
    return parsed(pages_of(placed, "snapshot_id", "place"), "snapshot_id", H.results_udf)


def _listings_sql(d) -> str:
    return f"SELECT nation_id, 'Shop ' || CAST(id AS string) AS name, phone, {d.sub('street', ' +', ' ')} AS address, segment AS tag FROM ({T.companies(d)}) c"


@frame("page_listings", "L12", _listings_sql)
def page_listings(spark, sf_dir):
    """Listings of a directory's pages, by nation."""
    rows = run_sql(spark, sf_dir, T.companies(SPARK))
    given = lambda kind, c: F.coalesce(F.concat(F.lit(f'<div class="{kind}">'), c, F.lit("</div>")), F.lit(""))
    piece = F.concat(F.lit('<div class="result"><a class="business-name">Shop '), F.col("id").cast("string"), F.lit("</a>"), given("phones phone", F.col("phone")), given("adr", F.col("street")), F.lit('<div class="categories"><a>'), "segment", F.lit('</a></div></div><div class="result"><p>no name</p></div>'))
    found = parsed(pages_of(rows.select("nation_id", "id", piece.alias("piece")), "nation_id", "id", numbered=True), "nation_id", H.cards_udf)
    return found.select("nation_id", "name", "phone", "address", F.col("tags")[0].alias("tag"))


def _reviews_sql(d) -> str:
    return "SELECT user_id, CAST(event_id % 9 AS double) / 2 AS rating, 'user ' || event_type AS author, 'Visit ' || CAST(event_id AS string) AS text FROM events"


@frame("page_reviews", "L22", _reviews_sql)
def page_reviews(spark, sf_dir):
    """Ratings, authors and texts of the reviews on each user's pages."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    piece = F.concat(F.lit('<div itemprop="review"><span itemprop="ratingValue" content="'), (F.col("event_id") % 9 / 2).cast("string"), F.lit('"></span><b itemprop="author">user '), "event_type", F.lit('</b><p itemprop="reviewBody">Visit '), F.col("event_id").cast("string"), F.lit("</p></div>"))
    return parsed(pages_of(e.select("user_id", "event_id", piece.alias("piece")), "user_id", "event_id", numbered=True), "user_id", H.reviews_udf)


_PLACES = {0: ("<nav>", "</nav>", "navigation"), 1: ("<footer>", "</footer>", "footer"), 2: ("<aside>", "</aside>", "sidebar"), 3: ('<div class="comments">', "</div>", "comments"), 4: ("<article>", "</article>", "content")}


def _backlinks_sql(d) -> str:
    kind = d.lookup("position % 5", {k: f"'{v[2]}'" for k, v in _PLACES.items()}, "NULL")
    return f"SELECT snapshot_id, domain, url, 'to ' || domain AS anchor, position % 2 = 0 AS nofollow, {kind} AS placement FROM ({T.results(d)}) r WHERE domain IN ('d7.com', 'd8.com')"


@frame("page_backlinks", "R48 R49 R42 L13", _backlinks_sql)
def page_backlinks(spark, sf_dir, targets=("d7.com", "d8.com")):
    """Links to the targets' domains among all links of each page: anchor, rel and the place on the page."""
    rows = run_sql(spark, sf_dir, T.results(SPARK))
    wrap = lambda n: F.coalesce(*[F.when(F.col("position") % 5 == k, F.lit(v[n])) for k, v in _PLACES.items()])
    rel = F.when(F.col("position") % 2 == 0, F.lit(' rel="nofollow ugc"')).otherwise(F.lit(""))
    piece = F.concat(wrap(0), F.lit('<a href="'), "url", F.lit('"'), rel, F.lit(">to "), "domain", F.lit('</a><a href="#top">up</a>'), wrap(1))
    found = parsed(pages_of(rows.select("snapshot_id", "position", piece.alias("piece")), "snapshot_id", "position"), "snapshot_id", H.links_udf)
    return found.where(F.col("domain").isin(*targets)).select("snapshot_id", "domain", "url", "anchor", "nofollow", "placement")


def _schemas_sql(d) -> str:
    return f"""SELECT nation_id, {d.set_of("CASE WHEN id % 3 = 0 THEN 'LocalBusiness' WHEN id % 3 = 1 THEN 'Organization' ELSE 'FAQPage' END")} AS types,
  coalesce(max(CASE WHEN id % 3 = 0 THEN CAST(floor(70e0 * (1 + CASE WHEN street IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 1 END) / 3) AS int) END), 0) AS business FROM ({T.companies(d)}) c GROUP BY nation_id"""


@frame("page_schemas", "L2 K6 R41 R43", _schemas_sql)
def page_schemas(spark, sf_dir):
    """Types of the JSON-LD blocks of each nation's pages, broken ones left out, and how complete the most complete business block is."""
    rows = run_sql(spark, sf_dir, T.companies(SPARK))
    kind = F.when(F.col("id") % 3 == 0, "LocalBusiness").when(F.col("id") % 3 == 1, "Organization").otherwise("FAQPage")
    block = F.to_json(F.struct(F.col("name"), F.col("street").alias("address"), F.col("phone").alias("telephone"), kind.alias("@type")))
    piece = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit('</script><script type="application/ld+json">{"@type": "Broken"</script>'))
    pages = pages_of(rows.select("nation_id", "id", piece.alias("piece")), "nation_id", "id", numbered=True).select("nation_id", H.summary_udf("html", "base").alias("x"))
    kinds = pages.select("nation_id", F.explode_outer("x.types").alias("kind")).groupBy("nation_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"))
    return kinds.join(pages.groupBy("nation_id").agg(F.max("x.business").alias("business")), "nation_id")


@query("page_headings", "R17 L11")
def page_headings(d):
    """Every heading of a page: level and text."""
    levels = " UNION ALL ".join(f"SELECT page_id, {n} AS level, {d.unnest(d.find_all('html', f'(?is)<h{n}[^>]*>(.*?)</h{n}>', 1))} AS inner_html FROM pages" for n in range(1, 7))
    text = f"trim({d.sub(d.sub('inner_html', '(?s)<[^>]*>', ' '), '[ ]+', ' ')})"
    return f"WITH h AS ({levels}) SELECT page_id, level, {text} AS heading FROM h WHERE {text} <> ''"


@query("page_topics", "L19 R15")
def page_topics(d):
    """How far a page covers each word of its own title: ten points for a mention, twenty for one in a heading, a hundred at most."""
    words = d.distinct(d.keep(d.find_all(f"lower({d.find('html', '(?is)<title[^>]*>(.*?)</title>', 1)})", "[a-z]+"), lambda e: f"length({e}) > 2"))
    times = lambda x: f"CAST((length({x}) - length(replace({x}, topic, ''))) / length(topic) AS int)"
    heads = d.join(d.find_all("lower(html)", "(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), "\n")
    body = d.sub(d.sub("lower(html)", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    return f"""WITH p AS (SELECT page_id, {body} AS body, {heads} AS heads, {d.unnest(words)} AS topic FROM pages)
SELECT page_id, topic, {times('body')} AS mentions, {times('heads')} AS in_headings, least(100, 10 * {times('body')} + 20 * {times('heads')}) AS coverage FROM p"""
