"""Row validation, page audits, reports on keywords and components, phrase seeds and evidence."""

from __future__ import annotations

import pandas as pd

from ..functions import html as H
from ..functions import scores as S
from ..functions import strings as X
from ..functions.lazy import vectorized
from ..plans.registry import frame, query
from ..sources import stand_ins as T
from .analytics import FORMATS, words_of
from .pages import pages

# Fixed values.
QUESTION_STARTERS = ("what", "how", "why", "when", "where", "who", "which", "can", "does", "is", "are", "should", "will", "do")
LOCATIONS = ("near me", "nearby", "in ", "near ", "around ", "local", "closest", " city", " state", " county")
MODIFIERS = ("best", "top", "cheap", "free", "online", "professional", "near me", "reviews", "cost", "price", "services", "tips", "guide", "vs", "versus", "alternative", "comparison")
SEVERITY = {"critical": 25, "high": 15, "medium": 8, "low": 3}


def issue_list(d, rules) -> str:
    """Comma-joined names of the rules (condition, name) that hold, in their order."""
    return d.join(d.keep(d.array(*[f"CASE WHEN {c} THEN '{n}' ELSE '' END" for c, n in rules]), lambda e: f"{e} <> ''"), ",")


@query("row_validation", "B12")
def row_validation(d):
    bare = "replace(replace(replace(replace(phone, '-', ''), ' ', ''), '(', ''), ')', '')"
    rules = (
        ("coalesce(trim(name), '') = ''", "missing_name"),
        ("coalesce(website, '') = ''", "missing_website"),
        ("coalesce(phone, '') = ''", "missing_phone"),
        ("length(name) < 3", "short_name"),
        (f"length({bare}) < 10", "bad_phone"),
        (d.contains_any("lower(name)", ("test", "sample", "example", "placeholder")), "placeholder"),
    )
    rules = tuple((f"coalesce({c}, false)", n) for c, n in rules)
    return f"WITH c AS ({T.companies(d)}), i AS (SELECT id, {issue_list(d, rules)} AS issues FROM c) SELECT id, issues, issues = '' AS valid FROM i"


PAGE_RULES = (
    ("no_title", "missing_title", "critical", "seo"),
    ("NOT no_title AND title_chars < 30", "title_too_short", "medium", "seo"),
    ("title_chars > 60", "title_too_long", "low", "seo"),
    ("NOT has_description", "missing_meta_description", "high", "seo"),
    ("has_description AND description_chars < 120", "meta_desc_too_short", "medium", "seo"),
    ("description_chars > 160", "meta_desc_too_long", "low", "seo"),
    ("NOT has_canonical", "missing_canonical", "medium", "seo"),
    ("NOT has_viewport", "missing_viewport", "high", "mobile"),
    ("h1 = 0", "missing_h1", "high", "seo"),
    ("h1 > 1", "multiple_h1", "low", "seo"),
    ("h2 = 0", "missing_h2", "low", "seo"),
    ("no_alt > 0", "images_missing_alt", "medium", "accessibility"),
    ("empty_links > 0", "empty_link_text", "medium", "accessibility"),
    ("no_https", "no_ssl", "critical", "security"),
    ("schemas = 0", "missing_schema", "medium", "seo"),
    ("blocking > 3", "render_blocking_scripts", "medium", "performance"),
    ("html_chars > 500000", "large_html", "medium", "performance"),
    ("raw_words > 0 AND words > 1.5e0 * raw_words", "js_dependent_content", "medium", "seo"),
    ("links - raw_links > 20", "js_loaded_links", "low", "seo"),
)
#: What each category counts in the whole.
CATEGORY_WEIGHTS = {"security": "0.15e0", "seo": "0.40e0", "accessibility": "0.20e0", "performance": "0.25e0"}


def page_facts(d) -> str:
    """What the rules look at, of every page; its raw form is the page without what scripts and templates put in."""
    h, q = "html", "[\"']"
    title = f"trim({d.find(h, '(?is)<title[^>]*>(.*?)</title>', 1)})"
    description = d.find(h, f"(?is)<meta[^>]*name={q}description{q}[^>]*content={q}([^\"']*){q}", 1)
    text = lambda x: X.squeeze(d, d.sub(d.sub(x, "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " "), "(?s)<[^>]*>", " "))
    words = lambda x: d.size(d.keep(d.split(text(x), " "), lambda e: f"{e} <> ''"))
    raw = d.sub(h, "(?is)<(article|main)[^>]*>.*?</(article|main)>", " ")
    facts = {
        "no_title": f"NOT {d.match(h, '(?is)<title')}", "title_chars": f"length({title})", "has_description": d.match(h, f"(?i)<meta[^>]*name={q}description"), "description_chars": f"length({description})",
        "has_canonical": d.match(h, f"(?i)<link[^>]*rel={q}canonical"), "has_viewport": d.match(h, f"(?i)<meta[^>]*name={q}viewport"), "h1": d.count(h, "(?i)<h1[^>]*>"), "h2": d.count(h, "(?i)<h2[^>]*>"),
        "no_alt": f"{d.count(h, '(?i)<img[^>]*>')} - {d.count(h, '(?i)<img[^>]*alt=[^>]*>')}", "empty_links": d.count(h, "(?i)<a[^>]*href=[^>]*>[ ]*</a>"), "no_https": f"NOT {d.match('url', '^https://')}",
        "schemas": d.count(h, "(?i)<script[^>]*ld[+]json"), "blocking": f"{d.count(h, '(?i)<script[^>]*src=[^>]*>')} - {d.count(h, '(?i)<script[^>]*(async|defer)[^>]*src=[^>]*>')} - {d.count(h, '(?i)<script[^>]*src=[^>]*(async|defer)[^>]*>')}",
        "html_chars": f"length({h})", "words": words(h), "raw_words": words(raw), "links": d.count(h, "(?i)<a[^>]*href="), "raw_links": d.count(raw, "(?i)<a[^>]*href="),
    }
    return f"SELECT page_id, {', '.join(f'{x} AS {n}' for n, x in facts.items())} FROM pages"


@query("page_audit", "R37 R38 R39 R40")
def page_audit(d):
    """Issues of every page by rule and the scores that their severities leave; mobile issues count half for two categories."""
    off = lambda kind: " + ".join(f"CASE WHEN {c} THEN {SEVERITY[s]} ELSE 0 END" for c, _, s, k in PAGE_RULES if k == kind)
    score = {k: f"greatest(0e0, 100 - ({off(k)})" + (f" - ({off('mobile')}) / 2e0)" if k in ("seo", "accessibility") else ")") for k in CATEGORY_WEIGHTS}
    return f"""WITH f AS ({page_facts(d)}), s AS (SELECT page_id, {issue_list(d, [(c, n) for c, n, _, _ in PAGE_RULES])} AS issues, {', '.join(f'{x} AS {k}' for k, x in score.items())} FROM f)
SELECT page_id, issues, {', '.join(CATEGORY_WEIGHTS)}, round({' + '.join(f'{k} * {w}' for k, w in CATEGORY_WEIGHTS.items())}, 6) AS overall FROM s"""


def page_issue_rows(d) -> str:
    items = d.array(*[d.struct(issue=f"CASE WHEN coalesce({c}, false) THEN '{n}' ELSE '' END", severity=f"'{s}'", category=f"'{k}'") for c, n, s, k in PAGE_RULES])
    return f"SELECT page_id, x.issue AS issue, x.severity AS severity, x.category AS category FROM (SELECT page_id, {d.unnest(d.keep(items, lambda e: f'{e}.issue <> {chr(39) * 2}'))} AS x FROM ({page_facts(d)}) f) y"


@query("page_issues", "R36 R37 R38 R39 R40 R41")
def page_issues(d):
    """One row for each issue of a page, with its severity and category."""
    return page_issue_rows(d)


@query("audit_scores", "R35")
def audit_scores(d):
    """Scores of every page from its issues: each category from 100 by severity, not below 0, mobile issues half for two of them; then weighted."""
    off = f"CASE severity {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {n}' for s, n in SEVERITY.items())} ELSE 0 END"
    share = lambda k: f"CASE WHEN category = '{k}' THEN {off} * 1e0" + (f" WHEN category = 'mobile' THEN {off} / 2e0" if k in ("seo", "accessibility") else "") + " ELSE 0e0 END"
    lost = ", ".join(f"sum({share(k)}) AS {k}" for k in CATEGORY_WEIGHTS)
    left = ", ".join(f"greatest(0e0, 100 - coalesce(g.{k}, 0e0)) AS {k}" for k in CATEGORY_WEIGHTS)
    return f"""WITH i AS ({page_issue_rows(d)}), g AS (SELECT page_id, count(*) AS issues, count(*) FILTER (WHERE severity = 'critical') AS critical, {lost} FROM i GROUP BY page_id),
s AS (SELECT p.page_id, coalesce(g.issues, 0) AS issues, coalesce(g.critical, 0) AS critical, {left} FROM pages p LEFT JOIN g ON p.page_id = g.page_id)
SELECT page_id, issues, critical, {', '.join(CATEGORY_WEIGHTS)}, round({' + '.join(f'{k} * {w}' for k, w in CATEGORY_WEIGHTS.items())}, 6) AS overall FROM s"""


@query("rendering_change", "R36")
def rendering_change(d):
    """Words and links of a page without and with its script parts: a page is script-dependent over half a change."""
    text = lambda x: X.squeeze(d, d.sub(d.sub(x, "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " "), "(?s)<[^>]*>", " "))
    raw = d.sub("html", "(?is)<(article|main)[^>]*>.*?</(article|main)>", " ")
    return f"""WITH p AS (SELECT page_id, {d.size(d.split(text(raw), ' '))} AS raw_words, {d.size(d.split(text('html'), ' '))} AS words, {d.count(raw, '(?i)<a[^>]*href=')} AS raw_links, {d.count('html', '(?i)<a[^>]*href=')} AS links FROM pages),
c AS (SELECT *, abs(words - raw_words) * 100e0 / greatest(1, raw_words) AS change, words * 1e0 / greatest(1, raw_words) AS ratio FROM p)
SELECT page_id, raw_words, words, round(change, 6) AS change, greatest(0, links - raw_links) AS added_links, change > 50 OR ratio > 1.5e0 AS dependent FROM c"""


@query("page_metadata", "R44 R45 R46 R47 L10")
def page_metadata(d):
    """Open Graph values, language links, robots, conversion points and page type of every page."""
    h, q = "html", "[\"']"
    og = lambda name: d.find(h, f"(?is)<meta[^>]*property={q}og:{name}{q}[^>]*content={q}([^\"']*){q}", 1)
    path = f"lower({d.find('url', '^[a-z]+://[^/]*(/[^?#]*)', 1)})"
    title = f"lower({d.find(h, '(?is)<title[^>]*>(.*?)</title>', 1)})"
    kind = f"CASE WHEN contains({path}, 'service') THEN 'services' WHEN contains({path}, 'about') THEN 'about' WHEN contains({path}, 'contact') THEN 'contact' WHEN contains({path}, 'blog') OR contains({path}, 'news') THEN 'blog' WHEN contains({title}, 'service') THEN 'services' WHEN contains({title}, 'about') THEN 'about' WHEN contains({title}, 'contact') THEN 'contact' WHEN contains({title}, 'blog') OR contains({title}, 'news') THEN 'blog' ELSE 'other' END"
    return f"""SELECT page_id, {og('title')} AS og_title, {og('type')} AS og_type, {og('image')} AS og_image, {d.join(d.sort(d.find_all(h, f'(?i)hreflang={q}([a-z-]+){q}', 1)), ',')} AS languages, {d.find(h, f'(?i)<meta[^>]*name={q}robots{q}[^>]*content={q}([^"]*){q}', 1)} AS robots,
  {d.count(h, f'(?i)href={q}tel:')} + {d.count(h, '(?i)<form[^>]*>')} AS conversion_points, {d.match(h, '(?i)(calendly|acuity|booksy)')} AS booking, {d.match(h, '(?i)(intercom|drift|tawk)')} AS chat, {kind} AS kind FROM pages"""


@query("serp_features", "R55")
def serp_features(d):
    marks = {"featured_snippet": "xpdopen|kp-blk|FeaturedSnippet", "knowledge_panel": "kp-wholepage|knowledge-panel", "local_pack": "local-pack|map-results", "images": "image-pack|carousel", "video": "video-results|youtube", "people_also_ask": "related-question|people also ask", "related": "related-searches|related searches"}
    return f"SELECT page_id, {issue_list(d, [(d.match('html', f'(?i)({p})'), n) for n, p in marks.items()])} AS features FROM pages"


@query("brand_mentions", "R56 L21")
def brand_mentions(d, terms=("example", "thnt", "ouaux"), around: int = 20):
    """Terms of three letters or more in the texts, case aside, with up to three snippets; sources of the brand's own are left out."""
    parts = [f"SELECT doc_id, '{t}' AS term, {d.find_all('text', f'(?is).{{0,{around}}}{t}.{{0,{around}}}')} AS found FROM documents WHERE contains(lower(text), '{t}') AND source <> 'src7'" for t in terms]
    at = {"spark": "try_element_at(found, {})", "duckdb": "list_extract(found, {})"}[d.name]
    snippets = " || '|' || ".join(f"coalesce({at.format(n)}, '')" for n in (1, 2, 3))
    return f"WITH m AS ({' UNION ALL '.join(parts)}) SELECT doc_id, term, {d.size('found')} AS mentions, {d.sha(snippets)} AS snippets FROM m"


@query("text_freshness", "I4")
def text_freshness(d, year: int = 2024):
    """The latest year that a text names, fresh if it is last year's or later; the share of fresh texts by source, as points."""
    years = d.find_all("text", r"\b(20[0-9]{2})\b", 1)
    top = f"CAST(array_max({years}) AS int)" if d.name == "spark" else f"CAST(list_max({years}) AS int)"
    points = S.tiers("ratio", (("0.8e0", 80), ("0.6e0", 60), ("0.4e0", 40), ("0.2e0", 25)), 15)
    return f"""WITH y AS (SELECT source, CASE WHEN {d.size(years)} > 0 THEN {top} END AS latest FROM documents), g AS (SELECT source, count(latest) AS dated, count(*) FILTER (WHERE latest >= {year - 1}) AS fresh FROM y GROUP BY source),
r AS (SELECT *, fresh * 1e0 / greatest(1, dated) AS ratio FROM g) SELECT source, dated, fresh, CASE WHEN dated = 0 THEN 40 ELSE {points} END AS points FROM r"""


@query("vital_issues", "R19")
def vital_issues(d):
    """One row for each metric of a page that isn't good, with its severity."""
    rows = " UNION ALL ".join(f"SELECT id, '{m}' AS metric, {x} AS value, {S.vital_rating(m, x)} AS rating FROM v WHERE {x} IS NOT NULL" for m, x in (("lcp", "lcp"), ("cls", "cls"), ("fid", "fid")))
    return f"""WITH v AS (SELECT event_id AS id, value * 60e0 AS lcp, value / 300e0 AS cls, value * 4e0 AS fid FROM events), r AS ({rows})
SELECT id, metric, round(value, 6) AS value, rating, CASE WHEN rating = 'POOR' THEN 'high' ELSE 'medium' END AS severity FROM r WHERE rating <> 'GOOD'"""


@query("opportunity_report", "R13 R12 R11")
def opportunity_report(d):
    """Counts by tier and intent, quick wins, mean difficulty, among keywords up to a difficulty."""
    return f"""WITH k AS (SELECT *, CAST(id % 7 AS int) AS brands FROM ({T.keywords(d)}) z), s AS (SELECT keyword, {S.volume_score()} AS vs, {S.serp_feature_score()} AS difficulty, position FROM k),
o AS (SELECT *, {S.intent(d, 'keyword', S.OPPORTUNITY_INTENT)} AS intent, least(100e0, greatest(0e0, vs * (1 - difficulty / 100e0) * {S.position_bonus('position')})) AS score FROM s), t AS (SELECT *, {S.opportunity_tier('score')} AS tier FROM o)
SELECT tier, intent, count(*) AS n, round(avg(difficulty), 6) AS difficulty, round(max(score), 6) AS best, count(*) FILTER (WHERE difficulty < 40) AS easy FROM t GROUP BY tier, intent"""


@query("component_agreement", "R62")
def component_agreement(d):
    """Bands of rule, model and combined scores, and where the parts agree or override each other."""
    band = lambda x: S.tiers(x, ((70, "'high'"), (40, "'medium'")), "'low'")
    agree = """CASE WHEN status = 'unknown' THEN 'uncertain' WHEN status = 'passed' AND rule >= 60 AND model >= 60 THEN 'all_agree_pass' WHEN status = 'passed' AND rule < 40 AND model >= 60 THEN 'model_overrides_rules'
      WHEN status = 'failed' AND rule < 40 AND model < 40 THEN 'all_agree_fail' WHEN status = 'failed' AND rule < 40 AND model >= 60 THEN 'rules_override_model' ELSE 'other' END"""
    return f"""WITH v AS (SELECT id, quality_score AS rule, CAST((id * 37) % 101 AS int) AS model, CASE WHEN quality_score + (id * 37) % 101 > 120 THEN 'passed' WHEN quality_score + (id * 37) % 101 < 80 THEN 'failed' ELSE 'unknown' END AS status FROM ({T.companies(d)}) z)
SELECT {band('rule')} AS rule_band, {band('model')} AS model_band, {agree} AS agreement, count(*) AS n FROM v GROUP BY 1, 2, 3"""


@query("phrase_topics", "R29 R30")
def phrase_topics(d):
    """A phrase's core topic without starters, modifiers and places, and its score as the head of a cluster."""
    core = "lower(keyword)"
    for s in QUESTION_STARTERS:
        core = d.sub(core, f"^{s} ", "")
    for m in (*MODIFIERS, *LOCATIONS):
        core = f"trim(replace({core}, '{m}', ''))"
    core = d.sub(core, r"\s+", " ")
    question = " OR ".join(d.starts("lower(keyword)", s + " ") for s in QUESTION_STARTERS)
    score = f"-10 * {d.size(d.split('keyword', ' '))} - CASE WHEN {question} THEN 20 ELSE 0 END - CASE WHEN {d.contains_any('lower(keyword)', LOCATIONS)} THEN 10 ELSE 0 END - 5 * {d.hits('lower(keyword)', MODIFIERS)}"
    return f"WITH k AS ({T.keywords(d)}) SELECT id, keyword, CASE WHEN {core} = '' THEN lower(keyword) ELSE {core} END AS topic, {score} AS pillar_score FROM k"


@query("seed_phrases", "R64")
def seed_phrases(d, service: str = "window cleaning"):
    """Ten templates of name and city at most, one a row."""
    t = d.array("n", "n || ' reviews'", f"c || ' {service}'", f"'{service} near ' || c", f"'best {service} ' || c", f"'{service} near me'", f"'{service} prices'")
    return f"WITH s AS (SELECT id, trim(name) AS n, trim(split_part(city, ',', 1)) AS c FROM ({T.companies(d)}) z WHERE name IS NOT NULL) SELECT id, {d.unnest(t)} AS phrase FROM s"


@query("example_diversity", "R66 R67")
def example_diversity(d):
    """A score for how much an example adds; kept over the threshold, or while half of its class isn't filled."""
    score = "least(1e0, 0.5e0 + CASE WHEN id % 3 > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN id % 4 = 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN reviews > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN quality_score BETWEEN 40 AND 60 THEN 0.2e0 ELSE 0e0 END)"
    return f"""WITH s AS (SELECT id, segment, {score} AS score FROM ({T.companies(d)}) z), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM s) SELECT id, segment, round(score, 6) AS score FROM r WHERE score >= 0.7e0 OR rn <= n * 0.5e0"""


@query("trust_explanations", "R74 M9")
def trust_explanations(d):
    """For every company a line on its phone's consensus, and whether the sources conflict below seven tenths."""
    return f"""WITH v AS (SELECT company_id, source_id, lower(trim(phone)) AS value, {S.trust(d, 'source_type')} AS w FROM ({T.claims(d)}) b WHERE coalesce(trim(phone), '') <> ''), g AS (SELECT company_id, value, sum(w) AS weight, min(source_id) AS first_id FROM v GROUP BY company_id, value),
r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY weight DESC, first_id) AS rn, sum(weight) OVER (PARTITION BY company_id) AS total FROM g)
SELECT company_id, CASE WHEN weight * 2 >= total THEN 'Consensus value for phone: ' || value ELSE 'No consensus reached for phone. Best candidate ' || value END || ' (' || CAST(weight AS string) || '/' || CAST(total AS string) || ' weighted)' AS explanation, weight * 10 < total * 7 AS nap_conflict FROM r WHERE rn = 1"""


@query("readability_by_source", "D9 D22")
def readability_by_source(d):
    """Means by source, with the longest and shortest text of each."""
    words = words_of(d, "text")
    return f"""WITH t AS (SELECT doc_id, source, {d.size(words)} AS words, {d.size(d.distinct(words))} AS distinct_words, n_chars FROM documents WHERE lang = 'en')
SELECT source, count(*) AS pages, round(avg(words), 6) AS mean_words, round(avg(distinct_words * 1e0 / greatest(1, words)), 6) AS variety, max_by(doc_id, n_chars * 1000000 + doc_id) AS longest, min_by(doc_id, n_chars * 1000000 + doc_id) AS shortest FROM t GROUP BY source"""


@query("topic_depth", "R15")
def topic_depth(d):
    """One source's texts against the means of the others."""
    kinds = " + ".join(f"CASE WHEN {d.contains_any('t', w)} THEN 1 ELSE 0 END" for w in FORMATS.values())
    return f"""WITH p AS (SELECT source, n_chars, lower(text) AS t FROM documents), m AS (SELECT source, avg(n_chars) AS chars, avg({kinds}) AS formats FROM p GROUP BY source), o AS (SELECT avg(chars) AS chars, avg(formats) AS formats FROM m WHERE source <> 'src0')
SELECT m.source, round(m.chars, 4) AS chars, round(m.chars / o.chars, 6) AS depth_ratio, m.formats < o.formats AS fewer_formats FROM m CROSS JOIN o"""


@query("merged_metadata", "K4 K5 K3")
def merged_metadata(d):
    """Only what is there, as sorted key=value pairs, later values over earlier ones."""
    pair = lambda k, x: f"CASE WHEN {x} IS NULL THEN '' ELSE '{k}=' || CAST({x} AS string) END"
    items = d.array(pair("city", "trim(city)"), pair("phone", "phone"), pair("reviews", "reviews"), pair("reviewed", "CASE WHEN active THEN 'yes' END"))
    return f"WITH c AS ({T.companies(d)}) SELECT id, {d.join(d.keep(items, lambda e: f"{e} <> ''"), ';')} AS metadata FROM c"


@query("proposed_changes", "O4 O6 R73")
def proposed_changes(d):
    """Corrections of phones as proposals, named by record; those that change nothing aren't proposed."""
    new = X.phone_us(d, "phone")
    return f"WITH c AS ({T.companies(d)}), p AS (SELECT id, phone AS old_value, {new} AS new_value FROM c WHERE {new} IS NOT NULL AND {new} <> phone) SELECT 'phone-' || CAST(id AS string) AS change_id, id AS record_id, 'UPDATE' AS operation, old_value, new_value, 'pending' AS status FROM p"


@frame("schema_completeness", "R41 R43")
def schema_completeness(spark, sf_dir):
    """Completeness of a page's business markup: seven tenths for required fields, three for optional ones."""
    @vectorized("struct<types:array<string>,business_score:int,organization_score:int>")
    def score(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([H.schema_summary(h) for h in html], columns=["types", "business_score", "organization_score"])

    return pages(spark, sf_dir).select("page_id", score("html").alias("x")).select("page_id", "x.*")
