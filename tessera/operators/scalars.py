"""Row-wise functions and scores applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import strings as X
from ..plans.dialect import SPARK
from ..plans.registry import frame, query, run_sql
from ..sources import stand_ins as T
from ..sources.scratch import ranked


@query("url_functions", "H1 H2 H3 H4 H5 H13 H14")
def url_functions(d):
    return f"""WITH c AS ({T.companies(d)}) SELECT id, {X.canonical_url(d, 'website')} AS canonical, {X.tracked_url(d, 'website')} AS tracked, {d.sha(f'coalesce({X.tracked_url(d, "website")}, website)')} AS hash, {X.registered_domain(d, 'website')} AS registered,
  {X.host(d, 'website')} AS host, {X.valid_url(d, 'website')} AS valid, {X.is_website(d, 'website')} AS is_website FROM c"""


@query("page_urls", "H1 H2 H5")
def page_urls(d):
    return f"SELECT page_id, {X.canonical_url(d, 'url')} AS canonical, {X.tracked_url(d, 'url')} AS tracked, {X.host(d, 'url')} AS host, {X.registered_domain(d, 'url')} AS registered FROM pages"


@query("phone_functions", "H6 H7 H8 H9 H11")
def phone_functions(d):
    return f"WITH c AS ({T.companies(d)}) SELECT id, {X.phone_dashed(d, 'phone')} AS dashed, {X.phone_us(d, 'phone')} AS us, {X.phone_e164(d, 'phone')} AS e164, {X.digits(d, 'phone')} AS digits, {X.first_phone(d, "'call ' || phone || ' now'")} AS first_phone FROM c"


@query("email_functions", "H10 H12")
def email_functions(d):
    return f"""WITH c AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '  John.Doe@Example.COM ' WHEN 1 THEN 'no mail' WHEN 2 THEN 'Write to Info' || CAST(s_suppkey AS string) || '@Mail.example.org.' ELSE 'a@b' END AS raw FROM supplier)
SELECT id, {X.email(d, 'raw')} AS email, {X.first_email(d, 'raw')} AS first_email FROM c"""


@query("address_functions", "H15 H16 H17 H18 H24 H25 H26")
def address_functions(d):
    line = "street || ', ' || trim(city) || ', ' || state || ' ' || zip"
    city, state, zipped = X.place(d, "trim(city) || ', ' || state || ' ' || coalesce(zip, '')")
    a, b, c, e = X.address_parts(d, "line")
    return f"""WITH c AS ({T.companies(d)}), l AS (SELECT *, {line} AS line FROM c)
SELECT id, {X.address_long(d, 'street')} AS long_form, {X.address_short(d, 'street')} AS short_form, {X.address_joined(d, 'street', 'city', 'state', 'zip')} AS joined, {X.address_plain(d, 'street')} AS plain, {X.zip_code(d, 'zip')} AS zip5,
  {city} AS place_city, {state} AS place_state, {zipped} AS place_zip, {a} AS part_street, {b} AS part_city, {c} AS part_state, {e} AS part_zip FROM l"""


@query("name_functions", "H19 H20 H21 H22 H23")
def name_functions(d):
    return f"WITH c AS ({T.companies(d)}) SELECT id, {X.name_key(d, 'name')} AS name_key, {X.name_entity(d, 'name')} AS entity, {X.name_nap(d, 'name')} AS nap, {X.name_citation(d, 'name')} AS citation, {X.business_name(d, 'name')} AS cleaned FROM c"


@query("edit_distances", "H30")
def edit_distances(d):
    return "SELECT p_partkey AS id, CAST(levenshtein(lower(p_name), lower(p_type)) AS int) AS distance FROM part"


@query("content_hashes", "H32 L7")
def content_hashes(d):
    """SHA-256 of the visible text: comments, scripts and styles out, tags out, blanks squeezed."""
    text = d.sub(d.sub(d.sub("html", "(?is)<!--.*?-->", " "), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    return f"SELECT page_id, {d.sha(X.squeeze(d, text))} AS content_hash FROM pages"


@query("intents", "H35 H36 H37 R26")
def intents(d):
    return f"WITH k AS ({T.keywords(d)}) SELECT id, keyword, {S.intent(d, 'keyword', S.GAP_INTENT)} AS gap_intent, {S.intent(d, 'keyword', S.OPPORTUNITY_INTENT)} AS opportunity_intent, {S.traffic_quality(d, 'keyword')} AS quality FROM k"


@query("intent_clusters", "H36")
def intent_clusters(d):
    return f"WITH k AS ({T.keywords(d)}), i AS (SELECT keyword, {S.intent(d, 'keyword', S.GAP_INTENT)} AS intent FROM k) SELECT intent, count(*) AS n, {d.set_of('keyword')} AS keywords FROM i GROUP BY intent"


@query("link_types", "H38 R2 R3 R4 J31 R1 R5")
def link_types(d):
    return f"""WITH k AS ({T.domains(d)}), a AS (SELECT id, domain, {S.link_type(d, 'domain')} AS kind, {S.link_authority(d, 'domain')} AS authority, CAST(id % 5 + 1 AS int) AS n FROM k),
b AS (SELECT *, {S.contact_likelihood(d, 'domain', 'kind')} AS likelihood, {S.link_opportunity('n', '5', 'authority', 'kind')} AS score FROM a),
c AS (SELECT *, {S.outreach_priority('score', 'likelihood', 'authority')} AS priority FROM b)
SELECT id, domain, kind, authority, likelihood, round(score, 6) AS score, priority, likelihood >= 0.5e0 AND authority >= 30 AS quick_win FROM c"""


@query("completeness_scores", "J1 J2")
def completeness_scores(d):
    return f"WITH c AS ({T.companies(d)}) SELECT id, {S.completeness('name', 'phone', 'street', 'city', 'state', 'zip', 'website', 'active', 'reviews')} AS score FROM c"


@query("combined_scores", "J9 J10 J13")
def combined_scores(d):
    c = S.combined_score("google", "listing", "web", "legit", "llm", "coalesce(reviews, 0)", d)
    return f"""WITH c AS (SELECT *, CASE WHEN id % 3 = 0 THEN 0e0 ELSE (id % 10) / 10e0 END AS google, (id % 7) / 10e0 AS listing, quality_score / 100e0 AS web, id % 4 = 0 AS legit, CAST(id % 100 AS int) AS llm, CASE WHEN id % 6 = 0 THEN NULL ELSE (id % 20) / 20e0 END AS p, CAST(id % 5 AS int) AS flags FROM ({T.companies(d)}) z),
s AS (SELECT id, {c} AS combined, p, legit, flags FROM c)
SELECT id, round(combined, 6) AS combined, round({S.final_score('combined', 'p')}, 6) AS final, CASE WHEN combined >= 0.65e0 AND flags = 0 THEN 'passed' WHEN combined <= 0.35e0 OR (NOT legit AND flags >= 3) THEN 'failed' ELSE 'unknown' END AS status FROM s"""


@query("service_scores", "J11 J12")
def service_scores(d):
    return f"""WITH c AS (SELECT id, CAST(id % 4 AS int) AS full_n, CAST(id % 5 AS int) AS any_n, CAST(id % 9 AS int) AS provider, CAST(id % 6 AS int) AS cta, phone IS NOT NULL AS p, id % 3 = 0 AS e, street IS NOT NULL AS a, id % 7 = 0 AS nav, id % 11 = 0 AS sch, CAST(id % 13 AS int) AS info, CAST(id % 3 AS int) AS neg FROM ({T.companies(d)}) z),
t AS (SELECT *, {S.service_tier('full_n', 'any_n')} AS tier FROM c) SELECT id, tier, {S.rule_score('tier', 'provider', 'cta', 'p', 'e', 'a', 'nav', 'sch', 'info', 'neg')} AS score FROM t"""


@query("keyword_opportunities", "J14 J15 J16 J17 R12 R13 R14 R24 R25 R11 R53")
def keyword_opportunities(d):
    low, high = S.volume_range("category")
    ctr = d.lookup("3", {k: S.num(v) for k, v in S.POSITION_CTR.items()}, "0.01e0")
    return f"""WITH k AS (SELECT *, CAST(id % 7 AS int) AS brands FROM ({T.keywords(d)}) z), v AS (SELECT *, {S.volume_score()} AS vs, {S.serp_feature_score()} AS difficulty FROM k),
c AS (SELECT *, {S.volume_category('vs')} AS category, least(100e0, greatest(0e0, vs * (1 - difficulty / 100e0) * {S.position_bonus('position')})) AS score FROM v)
SELECT id, keyword, round(vs, 2) AS volume_score, category, {low} AS low, {high} AS high, difficulty, round(score, 6) AS score, {S.opportunity_tier('score')} AS tier, {S.keyword_opportunity('CAST(id % 5 + 1 AS int)', 'difficulty', 'position')} AS stored_score,
  {d.trunc(f'{d.idiv(f"({low}) + ({high})", "2")} * {ctr}')} AS traffic FROM c"""


@query("domain_authorities", "J20 J19 R23")
def domain_authorities(d):
    """Authority of each domain; by group of ten the plain mean and the mean weighted by 1/place."""
    return f"""WITH k AS ({T.domains(d)}), a AS (SELECT id, {S.domain_authority(d, 'domain')} AS da FROM k), g AS (SELECT {d.idiv('id', '10')} AS page, id % 10 + 1 AS place, da FROM a)
SELECT page, round(sum(da / place) / sum(1e0 / place), 6) AS weighted, round(avg(da), 6) AS mean, min(da) AS least, max(da) AS most FROM g GROUP BY page"""


@query("difficulty_scores", "J18 R20 R21 R22 I4")
def difficulty_scores(d):
    """Six weighted factors of a page of results to a level and a time."""
    words = S.tiers("words", ((3000, 90), (2000, 70), (1500, 55), (1000, 40), (500, 25)), 15)
    titles = S.tiers("titles", ((8, 90), (6, 70), (4, 50), (2, 30)), 15)
    fresh = S.tiers("fresh", (("0.8e0", 80), ("0.6e0", 60), ("0.4e0", 40), ("0.2e0", 25)), 15)
    level = S.tiers("total", ((80, "'very_hard'"), (60, "'hard'"), (40, "'moderate'"), (20, "'easy'")), "'very_easy'")
    return f"""WITH k AS (SELECT *, CAST(volume * 2 AS int) AS words, (id % 19) / 2e0 AS titles, (id % 11) / 10e0 AS fresh, 30e0 + id % 60 AS authority, 25e0 + id % 50 AS links FROM ({T.keywords(d)}) z),
f AS (SELECT id, authority, least(100, {words} + CASE WHEN has_panel THEN 10 ELSE 0 END) AS depth, {S.serp_feature_score()} AS features, {titles} AS title, links, {fresh} AS freshness FROM k),
t AS (SELECT *, authority * 0.30e0 + depth * 0.20e0 + features * 0.15e0 + title * 0.15e0 + links * 0.15e0 + freshness * 0.05e0 AS total FROM f)
SELECT id, depth, features, title, freshness, round(total, 2) AS difficulty, {level} AS level, CASE {level} WHEN 'very_easy' THEN '1-3 months' WHEN 'easy' THEN '3-6 months' WHEN 'moderate' THEN '6-12 months' WHEN 'hard' THEN '12-18 months' ELSE '18+ months' END AS time_to_rank FROM t"""


@query("keyword_traffic", "J21 J24 J25 R27 R28")
def keyword_traffic(d):
    value = d.lookup("quality", {k: S.num(v) for k, v in S.CLICK_VALUE.items()}, "0.5e0")
    factor = S.feature_factor({"featured_snippet": "has_snippet", "knowledge_panel": "has_panel", "local_pack": "has_local", "people_also_ask": "has_paa"})
    scored = "CASE WHEN ad_count * 20 < 20 THEN ad_count * 20 * 5 WHEN ad_count * 20 < 40 THEN 100 + (ad_count * 20 - 20) * 45 WHEN ad_count * 20 < 60 THEN 1000 + (ad_count * 20 - 40) * 200 WHEN ad_count * 20 < 80 THEN 5000 + (ad_count * 20 - 60) * 750 ELSE 20000 + (ad_count * 20 - 80) * 4000 END"
    return f"""WITH k AS ({T.keywords(d)}), q AS (SELECT *, {S.blended_ctr(d, 'position')} * {factor} AS ctr, {S.blended_ctr(d, '1')} * {factor} AS top_ctr, {S.traffic_quality(d, 'keyword')} AS quality FROM k WHERE position IS NOT NULL),
c AS (SELECT *, {d.trunc('volume * ctr')} AS clicks, {d.trunc('volume * top_ctr')} AS top_clicks FROM q)
SELECT id, position, round(ctr, 4) AS ctr, clicks, round(clicks * {value}, 2) AS value, quality, top_clicks - clicks AS gain, {scored} AS volume_from_score FROM c"""


def _domain_traffic(d) -> str:
    return f"""WITH k AS ({T.keywords(d)}), b AS (SELECT id % 12 AS domain, position, {d.trunc(f'volume * {S.blended_ctr(d, "position")}')} AS clicks FROM k)
SELECT domain, count(*) AS keywords, count(*) FILTER (WHERE position <= 3) AS top_3, count(*) FILTER (WHERE position <= 10) AS top_10, coalesce(sum(clicks), 0) AS traffic FROM b GROUP BY domain"""


@frame("domain_traffic", "J22 J23", lambda d: f"SELECT *, row_number() OVER (ORDER BY traffic DESC, domain) AS rank, round(traffic * 100e0 / nullif(sum(traffic) OVER (), 0), 6) AS share FROM ({_domain_traffic(d)}) g")
def domain_traffic(spark, sf_dir):
    """Traffic of each brand's keywords, rank and share of all."""
    rows = ranked(run_sql(spark, sf_dir, _domain_traffic(SPARK)), [F.desc("traffic"), F.asc("domain")], "rank")
    total = rows.agg(F.nullif(F.sum("traffic"), F.lit(0)).alias("total"))  # one row
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("traffic") * 100.0 / F.col("total"), 6)).drop("total")


@query("vitals", "J26 J27 J28 J29 R18 R19")
def vitals(d):
    m = {"lcp": "lcp", "cls": "cls", "fid": "fid", "fcp": "fcp"}
    return f"""WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 60e0 END AS lcp, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 300e0 END AS cls, value * 4e0 AS fid, CASE WHEN event_id % 3 = 0 THEN value * 40e0 END AS fcp FROM events),
r AS (SELECT *, {S.vital_rating('lcp', 'lcp')} AS r1, {S.vital_rating('cls', 'cls')} AS r2, {S.vital_rating('fid', 'fid')} AS r3 FROM v)
SELECT id, r1 AS lcp_rating, r2 AS cls_rating, r3 AS fid_rating, {S.vitals_score(m, 6)} AS score, {S.vitals_assessment(['r1', 'r2', 'r3'])} AS assessment,
  (CASE WHEN coalesce(r1, 'GOOD') <> 'GOOD' THEN 1 ELSE 0 END + CASE WHEN coalesce(r2, 'GOOD') <> 'GOOD' THEN 1 ELSE 0 END + CASE WHEN r3 <> 'GOOD' THEN 1 ELSE 0 END) AS issues FROM r"""


NAP_SCORES = """SELECT source_id, n1 <> '' AND n2 <> '' AND (contains(n1, n2) OR contains(n2, n1)) AS name_match, coalesce(p1 <> '' AND p2 <> '' AND right(p1, 10) = right(p2, 10), false) AS phone_match FROM j)
SELECT source_id, name_match, phone_match, CASE WHEN name_match THEN 0.4e0 ELSE 0e0 END + CASE WHEN phone_match THEN 0.3e0 ELSE 0e0 END AS score FROM m"""


def _nap_scores_sql(d) -> str:
    a, b = X.name_citation(d, "c.name"), X.name_citation(d, "b.name")
    return f"""WITH c AS ({T.companies(d)}), b AS ({T.claims(d)}), j AS (SELECT b.source_id, {a} AS n1, {b} AS n2, {X.digits(d, 'c.phone')} AS p1, {X.digits(d, 'b.phone')} AS p2 FROM b JOIN c ON b.company_id = c.id),
m AS ({NAP_SCORES}"""


@frame("nap_scores", "J33", _nap_scores_sql)
def nap_scores(spark, sf_dir):
    """Stored against claimed name and phone: containment of names, last ten digits of phones. A company's are read once, not for each of its claims."""
    d = SPARK
    companies = X.name_citations(d, f"SELECT id, name, {X.digits(d, 'phone')} AS p1 FROM ({T.companies(d)}) z", "name", "n1")
    claimed = f"SELECT b.source_id, b.name, c.n1, c.p1, {X.digits(d, 'b.phone')} AS p2 FROM b JOIN c ON b.company_id = c.id"
    return run_sql(spark, sf_dir, f"""WITH c AS ({companies}), b AS ({T.claims(d)}), j AS ({X.name_citations(d, claimed, 'name', 'n2')}),
m AS ({NAP_SCORES}""")


@query("html_signals", "L6 L2 R37 R38 R39 R40 R42 R45 R46 R47 R55")
def html_signals(d):
    h = "html"
    n = {"paragraphs": "(?i)<p[^>]*>", "headings": "(?i)<h[1-6][^>]*>", "h1": "(?i)<h1[^>]*>", "images": "(?i)<img[^>]*>", "links": "(?i)<a[^>]*href=[\"']([^\"']*)[\"']", "outside_links": "(?i)<a[^>]*href=[\"']http[^\"']*[\"']",
         "forms": "(?i)<form[^>]*>", "lists": "(?i)<(?:ul|ol)[^>]*>", "tables": "(?i)<table[^>]*>", "code_blocks": "(?i)<(?:pre|code)[^>]*>", "json_ld": "(?i)application/ld\\+json", "og": "(?i)<meta[^>]*property=[\"']og:", "nofollow": "(?i)rel=[\"']nofollow"}
    title = d.find(h, "(?is)<title[^>]*>(.*?)</title>", 1)
    return f"""SELECT page_id, {', '.join(f'{d.count(h, p)} AS {k}' for k, p in n.items())}, length({title}) AS title_length, {title} = '' AS no_title, NOT {d.match(h, '(?i)<meta[^>]*name=["' + "']description")} AS no_description, {d.find(h, '(?i)<html[^>]*lang=["' + "']([a-z-]+)", 1)} AS lang FROM pages"""


@query("captcha_and_blocks", "B13 B14")
def captcha_and_blocks(d):
    pairs = (("recaptcha", "'reCAPTCHA'"), ("hcaptcha", "'hCaptcha'"), ("h-captcha", "'hCaptcha'"), ("cf-challenge", "'Cloudflare Challenge'"), ("challenge-form", "'Cloudflare Challenge'"), ("cloudflare", "'Cloudflare'"), ("captcha", "'Generic CAPTCHA'"),
             ("verify you are human", "'Human Verification'"), ("prove you are not a robot", "'Bot Check'"), ("security check", "'Security Check'"), ("unusual traffic", "'Rate Limit Warning'"))
    blocks = tuple((w, f"'Content indicates: {w}'") for w in ("access denied", "blocked", "banned", "too many requests", "rate limit", "temporarily unavailable"))
    page = "CASE page_id % 6 WHEN 0 THEN lower(html) WHEN 1 THEN 'please solve the hCaptcha' WHEN 2 THEN 'access denied' WHEN 3 THEN 'security check' WHEN 4 THEN 'rate limit' ELSE '' END"
    status = "CAST(page_id % 5 * 100 + CASE WHEN page_id % 5 = 4 THEN 29 WHEN page_id % 5 = 3 THEN 103 ELSE 3 END AS int)"
    return f"""WITH p AS (SELECT page_id, lower({page}) AS h, {status} AS status FROM pages) SELECT page_id, {d.first_hit('h', pairs, "''")} AS captcha,
  CASE WHEN status = 403 THEN '403 Forbidden' WHEN status = 429 THEN '429 Too Many Requests' WHEN status IN (503, 504) THEN CAST(status AS string) || ' Service Unavailable' ELSE {d.first_hit('h', blocks, "''")} END AS block FROM p"""


# Fixed values.
STORE_DOMAINS = (".myshopify.com", ".bigcartel.com", ".square.site", ".ecwid.com", ".shoplightspeed.com", ".shoplo.com", ".3dcart.com", ".squarespace.com/commerce", ".wixsite.com/shop")
STORE_PATHS = ("/shop/", "/shop", "/store/", "/store", "/products/", "/product/", "/cart/", "/cart", "/checkout/", "/checkout", "/collections/", "/buy-now", "/order-online", "/merchandise", "/merch", "/add-to-cart")
STORE_WORDS = ("onlinestore", "webstore", "webshop", "eshop")
BLOCKED_DOMAINS = (
    "amazon.com", "ebay.com", "walmart.com", "target.com", "homedepot.com", "lowes.com", "menards.com", "acehardware.com", "northerntool.com", "harborfreight.com", "tractorsupply.com", "etsy.com", "alibaba.com", "aliexpress.com",
    "yelp.com", "yellowpages.com", "whitepages.com", "superpages.com", "mapquest.com", "angieslist.com", "thumbtack.com", "porch.com", "houzz.com", "bbb.org", "manta.com",
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "youtube.com", "tiktok.com", "example.com", "test.com", "placeholder.com",
)
STORE_INDICATORS = ("shop", "store", "cart", "checkout", "buy", "order", "ecommerce", "e-commerce", "online-store", "webstore")


def store_url(d, x: str) -> str:
    """Why a URL is a shop's: platform, path or domain word; empty if it isn't."""
    u = f"lower({x})"
    host = f"replace(replace(replace({d.find(u, '^[a-z]+://([^/?#]*)', 1)}, 'www.', ''), '-', ''), '_', '')"
    return d.first_hit(u, [(w, f"'e-commerce platform: {w}'") for w in STORE_DOMAINS] + [(w, f"'e-commerce path: {w}'") for w in STORE_PATHS], d.first_hit(host, [(w, f"'e-commerce domain keyword: {w}'") for w in STORE_WORDS], "''"))


@query("listing_filter", "B3 B4 B5 B6 B7 J35 B12")
def listing_filter(d, allow=("AUTOMOBILE", "BUILDING", "equipment"), block=("MACHINERY",), anti=("supplies", "parts"), hints=("clean", "washing"), least: float = 40.0):
    """The first rule that fails is the reason; the rest are scored, and low scores rejected."""
    allowed = " + ".join(f"CASE WHEN segment = '{a}' OR second = '{a}' THEN 1 ELSE 0 END" for a in allow)
    blocked = " OR ".join(f"segment = '{b}'" for b in block)
    text = "lower(name || ' ' || coalesce(street, ''))"
    score = f"""greatest(0e0, least(100e0, 50e0 + least(10 * allowed, 50) + least(5 * hints, 25) - CASE WHEN second = 'equipment' AND allowed = 1 THEN 10 ELSE 0 END + 5 + CASE WHEN reviews > 0 THEN 3 ELSE 0 END - least(10 * anti_text, 30)))"""
    return f"""WITH c AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'equipment' ELSE 'none' END AS second, id % 17 = 0 AS sponsored FROM ({T.companies(d)}) z),
f AS (SELECT *, {allowed} AS allowed, {blocked} AS is_blocked, {d.hits('lower(name)', anti)} AS anti_name, {d.hits("lower(coalesce(street, ''))", anti)} AS anti_text, {d.hits(text, hints)} AS hints, {store_url(d, "coalesce(website, '')")} AS store FROM c),
r AS (SELECT *, CASE WHEN sponsored THEN 'sponsored' WHEN allowed = 0 THEN 'mismatch_category' WHEN is_blocked THEN 'blocked_category' WHEN anti_name > 0 THEN 'anti_keyword' WHEN second = 'equipment' AND allowed = 1 AND hints = 0 THEN 'equipment_only'
  WHEN store <> '' THEN 'ecommerce_url' WHEN coalesce(website, '') = '' THEN 'no_website' ELSE 'accepted' END AS reason FROM f), s AS (SELECT *, CASE WHEN reason = 'accepted' THEN {score} ELSE 0e0 END AS score FROM r)
SELECT id, CASE WHEN reason = 'accepted' AND score < {least} THEN 'low_score' ELSE reason END AS reason, score, reason = 'accepted' AND score >= {least} AS passed FROM s"""


@query("business_filter", "B8 B9 B10 B11")
def business_filter(d, anti=("supplies",), hints=("clean", "washing")):
    """Anti-keyword, then blocked host, then hint; the other directory's list leaves its own host out."""
    host = d.sub(d.find("lower(coalesce(website, ''))", "^[a-z]+://([^/?#]*)", 1), "^www[.]", "")
    inside = lambda names: " OR ".join(f"host = '{b}' OR {d.ends('host', '.' + b)}" for b in names)
    words = d.contains_any("host", STORE_INDICATORS)
    reason = lambda names: f"CASE WHEN {d.contains_any('lower(name)', anti)} THEN 'anti_keyword' WHEN {inside(names)} OR {words} THEN 'blocked_domain' WHEN {d.contains_any('lower(name)', hints)} THEN 'hint' ELSE 'neutral' END"
    other = tuple(b for b in BLOCKED_DOMAINS if b != "yelp.com")
    confidence = "CASE {0} WHEN 'anti_keyword' THEN 0.2e0 WHEN 'blocked_domain' THEN 0.1e0 WHEN 'hint' THEN 0.8e0 ELSE 0.6e0 END"
    return f"""WITH c AS (SELECT id, name, {host} AS host FROM ({T.companies(d)}) z), r AS (SELECT id, {reason(BLOCKED_DOMAINS)} AS reason, {reason(other)} AS other_reason FROM c)
SELECT id, reason, {confidence.format('reason')} AS confidence, reason IN ('hint', 'neutral') AS passed, {confidence.format('other_reason')} AS other_confidence FROM r"""


@query("health_status", "R77")
def health_status(d):
    issues = "CASE WHEN ok < 50 THEN 1 WHEN ok < 75 THEN 1 ELSE 0 END + CASE WHEN bad > 5 THEN 1 ELSE 0 END + CASE WHEN n > 50 AND ok = 0 THEN 1 ELSE 0 END"
    return f"""WITH t AS ({T.task_logs(d)}), g AS (SELECT user_id, count(*) AS n, 100e0 * count(*) FILTER (WHERE status = 'success') / count(*) AS ok, 100e0 * count(*) FILTER (WHERE status = 'running') / count(*) AS bad FROM t GROUP BY user_id)
SELECT user_id, round(ok, 6) AS ok, round(bad, 6) AS bad, CASE {issues} WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS status FROM g"""
