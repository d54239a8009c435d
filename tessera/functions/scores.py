"""Scores and classes, as SQL of either dialect."""

from __future__ import annotations

from ..plans.dialect import Dialect

# Fixed values.
TRUST = {
    "website": 100, "verified_website": 100, "google": 90, "google_business": 90, "google_maps": 90, "yelp": 80, "bbb": 80, "angi": 80, "angies_list": 80, "trustpilot": 80,
    "yp": 60, "yellowpages": 60, "thumbtack": 60, "homeadvisor": 60, "porch": 60, "houzz": 60, "facebook": 50, "linkedin": 50, "instagram": 50,
    "mapquest": 40, "manta": 40, "superpages": 40, "whitepages": 40, "serp": 30, "aggregator": 30,
}
UNKNOWN_TRUST = 20
DESKTOP_CTR = {1: 0.319, 2: 0.158, 3: 0.107, 4: 0.078, 5: 0.058, 6: 0.043, 7: 0.033, 8: 0.026, 9: 0.021, 10: 0.017, 11: 0.010, 12: 0.009, 13: 0.008, 14: 0.007, 15: 0.006, 16: 0.005, 17: 0.005, 18: 0.004, 19: 0.004, 20: 0.003}
MOBILE_CTR = {1: 0.287, 2: 0.144, 3: 0.098, 4: 0.072, 5: 0.054, 6: 0.041, 7: 0.032, 8: 0.025, 9: 0.020, 10: 0.016, 11: 0.008, 12: 0.007, 13: 0.006, 14: 0.005, 15: 0.005, 16: 0.004, 17: 0.004, 18: 0.003, 19: 0.003, 20: 0.002}
DESKTOP_SHARE, MOBILE_SHARE, TABLET_SHARE = 0.55, 0.42, 0.03
FEATURE_FACTORS = {"featured_snippet": 0.85, "knowledge_panel": 0.90, "local_pack": 0.80, "shopping_ads": 0.85, "paid_ads_top": 0.75, "video_results": 0.95, "images": 0.95, "people_also_ask": 0.90}
CLICK_VALUE = {"high_intent": 2.50, "medium_intent": 1.00, "low_intent": 0.30, "branded": 0.50}
HIGH_INTENT = ("buy", "purchase", "order", "price", "cost", "cheap", "best", "top", "review", "vs", "compare", "near me", "quote", "hire", "service", "booking", "appointment")
LOW_INTENT = ("what is", "how to", "why", "when", "where", "who", "definition", "meaning", "tutorial", "guide", "learn", "free", "diy", "tips", "ideas")
BRANDED = (".com", ".net", ".org", "login", "sign in", "account")
GAP_INTENT = {
    "transactional": ("buy", "purchase", "order", "price", "cost", "cheap", "deal", "discount", "coupon", "sale", "shop", "store"),
    "commercial": ("best", "top", "review", "reviews", "comparison", "vs", "versus", "alternative", "compare", "rated"),
    "informational": ("what is", "what are", "how to", "how do", "why", "when", "where", "who", "guide", "tutorial", "learn"),
    "navigational": ("login", "sign in", "website", "official", "portal"),
    "local": ("near me", "nearby", "local", "closest", "directions"),
}
OPPORTUNITY_INTENT = {
    "transactional": ("buy", "purchase", "order", "price", "cost", "cheap", "deal", "discount", "coupon", "sale", "shop", "store", "best price", "for sale", "free shipping"),
    "commercial": ("best", "top", "review", "reviews", "comparison", "vs", "versus", "alternative", "alternatives", "compare", "which", "recommendation", "rated"),
    "informational": ("what is", "what are", "how to", "how do", "why", "when", "where", "who", "guide", "tutorial", "learn", "tips", "ideas", "examples", "definition"),
    "navigational": ("login", "sign in", "website", "official", "portal", "account", "contact", "support", "customer service"),
    "local": ("near me", "nearby", "in", "local", "closest", "directions", "hours", "open now", "address"),
}
POSITION_CTR = {1: 0.285, 2: 0.157, 3: 0.110, 4: 0.080, 5: 0.072, 6: 0.051, 7: 0.044, 8: 0.038, 9: 0.034, 10: 0.031}
LINK_TYPES = {
    "directory": ("yelp", "yellowpages", "manta", "bbb", "foursquare", "mapquest", "superpages", "whitepages", "citysearch", "local", "directory", "listings", "bizjournals"),
    "news": ("news", "times", "post", "herald", "tribune", "journal", "gazette", "daily", "press", "cnn", "bbc", "npr", "forbes", "bloomberg", "reuters", "ap", "techcrunch"),
    "blog": ("blog", "wordpress", "medium", "blogger", "tumblr", "substack", "ghost", "hashnode", "dev.to"),
    "forum": ("forum", "reddit", "quora", "stackexchange", "stackoverflow", "community", "discuss", "boards", "answers"),
    "social": ("facebook", "twitter", "linkedin", "instagram", "pinterest", "youtube", "tiktok", "snapchat"),
    "resource": ("resources", "tools", "guide", "wiki", "edu", "gov", "library", "reference", "links"),
}
LINK_LIKELIHOOD = {"directory": 0.8, "citation": 0.9, "resource": 0.5, "blog": 0.4, "guest_post": 0.3, "news": 0.2, "forum": 0.6, "social": 0.7, "general": 0.3, "competitor": 0.1}
KNOWN_LINK_DA = {
    "wikipedia.org": 95, "forbes.com": 94, "nytimes.com": 95, "bbc.com": 95, "cnn.com": 94, "linkedin.com": 98, "facebook.com": 96, "twitter.com": 94,
    "youtube.com": 98, "reddit.com": 91, "quora.com": 93, "medium.com": 95, "github.com": 96, "yelp.com": 93, "tripadvisor.com": 90,
}
KNOWN_DA = {
    "wikipedia.org": 95, "amazon.com": 96, "facebook.com": 96, "youtube.com": 98, "twitter.com": 94, "instagram.com": 93, "linkedin.com": 98, "apple.com": 97, "microsoft.com": 97,
    "google.com": 98, "nytimes.com": 95, "bbc.com": 95, "cnn.com": 94, "forbes.com": 94, "theguardian.com": 94, "washingtonpost.com": 93, "reddit.com": 91, "quora.com": 93,
    "yelp.com": 93, "tripadvisor.com": 90, "imdb.com": 92, "healthline.com": 89, "webmd.com": 92, "mayoclinic.org": 89, "indeed.com": 91, "glassdoor.com": 89, "zillow.com": 90,
    "etsy.com": 87, "shopify.com": 86, "wix.com": 85, "medium.com": 95, "wordpress.com": 92, "blogspot.com": 90, "github.com": 96, "stackoverflow.com": 93,
    "homedepot.com": 85, "lowes.com": 83, "walmart.com": 92, "target.com": 88, "bestbuy.com": 85, "costco.com": 82,
}
TLD_DA = {".gov": 15, ".edu": 12, ".org": 5, ".com": 0, ".net": 0, ".io": -2, ".co": -3}
VITALS = {"lcp": (2500, 4000), "cls": (0.1, 0.25), "fid": (100, 300), "fcp": (1800, 3000), "tti": (3800, 7300), "ttfb": (800, 1800)}
VITAL_WEIGHTS = {"lcp": 0.35, "cls": 0.25, "fid": 0.25, "fcp": 0.05, "tti": 0.05, "ttfb": 0.05}
VOLUME_WEIGHTS = {"ads_present": 0.15, "ad_count": 0.10, "shopping_present": 0.12, "featured_snippet": 0.08, "people_also_ask": 0.08, "result_count": 0.12, "brand_results": 0.10, "autocomplete_position": 0.10, "related_searches": 0.08, "knowledge_panel": 0.07}


def tiers(x: str, steps, other, op: str = ">=") -> str:
    """The value of the first of steps (limit, value) that x reaches."""
    return "CASE " + " ".join(f"WHEN {x} {op} {limit} THEN {value}" for limit, value in steps) + f" ELSE {other} END"


def num(value: float) -> str:
    return f"{value!r}e0" if "e" not in repr(value) else repr(value)


def completeness(name, phone, street, city, state, zip_code, website, verified, ratings) -> str:
    """0 to 100: 15, 15, 10, 10, 5, 5, 10 for what is there, 10 for ratings, 20 if verified."""
    parts = [f"CASE WHEN coalesce({x}, '') <> '' THEN {n} ELSE 0 END" for x, n in ((name, 15), (phone, 15), (street, 10), (city, 10), (state, 5), (zip_code, 5), (website, 10))]
    return f"({' + '.join(parts)} + CASE WHEN coalesce({ratings}, 0) > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce({verified}, false) THEN 20 ELSE 0 END)"


def company_quality(sources, website, google, yelp, conflict, average) -> str:
    """Coverage, profiles, the sources' average score and consistency, held between 0 and 100."""
    score = f"""{tiers(sources, ((5, 40), (3, 30), (2, 20), (1, 10)), 0)} + CASE WHEN {website} THEN 10 ELSE 0 END + CASE WHEN {google} THEN 10 ELSE 0 END + CASE WHEN {yelp} THEN 10 ELSE 0 END
      + coalesce(CAST(floor({average} / 5 + 0.5e0) AS int), 0) + CASE WHEN {conflict} THEN -10 WHEN {sources} > 1 THEN 10 ELSE 0 END"""
    return f"greatest(0, least(100, {score}))"


def trust(d: Dialect, source: str) -> str:
    return d.lookup(f"lower(coalesce({source}, 'unknown'))", TRUST, str(UNKNOWN_TRUST))


def trust_tier(weight: str) -> str:
    return tiers(weight, ((90, "'very_high'"), (70, "'high'"), (50, "'medium'"), (30, "'low'")), "'very_low'")


def ctr(d: Dialect, position: str, table: dict) -> str:
    """By table to 20, a decay of 0.8 a place to 50, then a ten-thousandth."""
    listed = d.lookup(position, {k: num(v) for k, v in table.items()}, "0e0")
    return f"CASE WHEN {position} < 1 THEN 0e0 WHEN {position} <= 20 THEN {listed} WHEN {position} <= 50 THEN 0.003e0 * power(0.8e0, {position} - 20) ELSE 0.0001e0 END"


def blended_ctr(d: Dialect, position: str) -> str:
    return f"(({ctr(d, position, DESKTOP_CTR)}) * {num(DESKTOP_SHARE)} + ({ctr(d, position, MOBILE_CTR)}) * {num(MOBILE_SHARE)} + ({ctr(d, position, MOBILE_CTR)}) * {num(TABLET_SHARE)})"


def feature_factor(flags: dict[str, str]) -> str:
    """The product of the factors of the features that are there."""
    return " * ".join(f"CASE WHEN {on} THEN {num(FEATURE_FACTORS[name])} ELSE 1e0 END" for name, on in flags.items())


def traffic_quality(d: Dialect, keyword: str) -> str:
    k = f"lower({keyword})"
    return f"CASE WHEN {d.contains_any(k, BRANDED)} THEN 'branded' WHEN {d.contains_any(k, HIGH_INTENT)} THEN 'high_intent' WHEN {d.contains_any(k, LOW_INTENT)} THEN 'low_intent' ELSE 'medium_intent' END"


def intent(d: Dialect, keyword: str, table: dict) -> str:
    k = f"lower({keyword})"
    return "CASE " + " ".join(f"WHEN {d.contains_any(k, words)} THEN '{name}'" for name, words in table.items()) + " ELSE 'informational' END"


def link_type(d: Dialect, domain: str) -> str:
    k = f"lower({domain})"
    return "CASE " + " ".join(f"WHEN {d.contains_any(k, words)} THEN '{name}'" for name, words in LINK_TYPES.items()) + " ELSE 'general' END"


def link_authority(d: Dialect, domain: str) -> str:
    """A known domain's figure, 70 for .gov, .edu and .org, else 30 and bonuses."""
    k = f"lower({domain})"
    first = f"split_part(replace({domain}, 'www.', ''), '.', 1)"
    rest = f"least(100, 30 + CASE WHEN length({first}) <= 6 THEN 10 ELSE 0 END + CASE WHEN {d.contains_any(k, ('news', 'media', 'press'))} THEN 15 ELSE 0 END + CASE WHEN {d.contains_any(k, ('directory', 'listings'))} THEN 10 ELSE 0 END)"
    high = " OR ".join(d.ends(k, t) for t in (".gov", ".edu", ".org"))
    return d.first_hit(k, KNOWN_LINK_DA.items(), f"CASE WHEN {high} THEN 70 ELSE {rest} END")


def contact_likelihood(d: Dialect, domain: str, kind: str) -> str:
    k = f"lower({domain})"
    base = d.lookup(kind, {n: num(v) for n, v in LINK_LIKELIHOOD.items()}, "0.3e0")
    return f"CASE WHEN {d.contains_any(k, ('nytimes', 'forbes', 'bbc'))} THEN 0.1e0 WHEN {d.contains_any(k, ('yelp', 'yellowpages', 'foursquare'))} THEN 0.9e0 ELSE {base} END"


def link_opportunity(count: str, total: str, authority: str, kind: str) -> str:
    bonus = f"CASE WHEN {kind} IN ('resource', 'directory') THEN 15 WHEN {kind} = 'blog' THEN 10 WHEN {kind} = 'news' THEN 5 ELSE 0 END"
    return f"least(100e0, {count} * 40e0 / greatest(1, {total}) + {authority} / 100e0 * 40e0 + {bonus})"


def outreach_priority(score: str, likelihood: str, authority: str) -> str:
    combined = f"({score} * 0.4e0 + {likelihood} * 100 * 0.3e0 + {authority} * 0.3e0)"
    return tiers(combined, ((70, "'high'"), (50, "'medium'"), (30, "'low'")), "'skip'")


def domain_authority(d: Dialect, domain: str) -> str:
    """A known domain's figure, 0.7 of it for its subdomains, else 30 with modifiers for the ending and the length of the name."""
    k = d.sub(f"lower(trim({domain}))", "^www[.]", "")
    known = " ".join(f"WHEN {k} = '{n}' THEN {v}e0" for n, v in KNOWN_DA.items())
    below = " ".join(f"WHEN {d.ends(k, '.' + n)} THEN {v}e0 * 0.7e0" for n, v in KNOWN_DA.items())
    tld = "CASE " + " ".join(f"WHEN {d.ends(k, t)} THEN {v}" for t, v in TLD_DA.items()) + " ELSE 0 END"
    name = d.find(k, "([^.]*)[.][^.]*$", 1)
    length = f"CASE WHEN NOT contains({k}, '.') THEN 0 WHEN length({name}) <= 5 THEN 10 WHEN length({name}) <= 10 THEN 5 ELSE 0 END"
    return f"CASE {known} {below} ELSE CAST(greatest(0, least(100, 30 + {tld} + {length})) AS double) END"


def gap_score(own: str, average: str, count: str, total: str, volume: str) -> str:
    return f"""least(100e0, CASE WHEN {own} IS NULL THEN 40 WHEN {own} > 10 THEN 30 WHEN {own} > 3 THEN 15 ELSE 0 END + {count} * 25e0 / greatest(1, {total})
      + CASE WHEN {average} <= 5 THEN 10 WHEN {average} <= 10 THEN 20 ELSE 25 END + CASE WHEN {volume} >= 1000 THEN 15 WHEN {volume} >= 100 THEN 10 WHEN {volume} >= 10 THEN 5 ELSE 0 END)"""


def gap_category(own: str, average: str) -> str:
    return f"CASE WHEN {own} IS NULL THEN 'missing' WHEN {own} > {average} + 10 THEN 'underperforming' ELSE 'opportunity' END"


def gap_priority(score: str, category: str, coverage: str) -> str:
    return f"""CASE WHEN {category} = 'missing' AND {coverage} >= 0.8e0 THEN 'critical' WHEN {score} >= 70 THEN CASE WHEN {coverage} >= 0.5e0 THEN 'critical' ELSE 'high' END
      WHEN {score} >= 50 THEN CASE WHEN {coverage} >= 0.5e0 THEN 'high' ELSE 'medium' END WHEN {score} >= 30 THEN 'medium' ELSE 'low' END"""


def vital_rating(metric: str, x: str) -> str:
    good, fair = VITALS[metric]
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {good} THEN 'GOOD' WHEN {x} <= {fair} THEN 'NEEDS_IMPROVEMENT' ELSE 'POOR' END"


def vital_score(metric: str, x: str) -> str:
    good, fair = (num(float(v)) for v in VITALS[metric])
    return f"""CASE WHEN {x} <= {good} THEN greatest(70e0, least(100e0, 100 - {x} / {good} * 30)) WHEN {x} <= {fair} THEN greatest(40e0, least(69e0, 70 - ({x} - {good}) / ({fair} - {good}) * 30))
      ELSE greatest(0e0, least(39e0, 40 - ({x} - {fair}) / {fair} * 40)) END"""


def vitals_score(values: dict[str, str], places: int = 2) -> str:
    """Weighted mean over the metrics that are there; 0 if none is."""
    top = " + ".join(f"CASE WHEN {x} IS NULL THEN 0e0 ELSE ({vital_score(m, x)}) * {num(VITAL_WEIGHTS[m])} END" for m, x in values.items())
    bottom = " + ".join(f"CASE WHEN {x} IS NULL THEN 0e0 ELSE {num(VITAL_WEIGHTS[m])} END" for m, x in values.items())
    return f"coalesce(round(({top}) / nullif({bottom}, 0e0), {places}), 0e0)"


def vitals_assessment(ratings: list[str]) -> str:
    some = " AND ".join(f"{r} IS NULL" for r in ratings)
    poor = " OR ".join(f"coalesce({r} = 'POOR', false)" for r in ratings)
    good = " AND ".join(f"coalesce({r} = 'GOOD', true)" for r in ratings)
    return f"CASE WHEN {some} THEN 'UNKNOWN' WHEN {poor} THEN 'FAILED' WHEN {good} THEN 'PASSED' ELSE 'NEEDS_IMPROVEMENT' END"


def volume_signals(k: str = "") -> dict[str, str]:
    """The scores of the signals of a page of results, from the columns of stand_ins.keywords and brands."""
    c = lambda n: k + n
    return {
        "ads_present": f"CASE WHEN {c('has_ads')} THEN 100e0 ELSE 0e0 END",
        "ad_count": tiers(c("ad_count"), ((4, "100e0"), (3, "80e0"), (2, "60e0"), (1, "40e0")), "0e0"),
        "shopping_present": f"CASE WHEN {c('has_shopping')} THEN 100e0 ELSE 0e0 END",
        "featured_snippet": f"CASE WHEN {c('has_snippet')} THEN 100e0 ELSE 30e0 END",
        "people_also_ask": f"CASE WHEN NOT {c('has_paa')} THEN 20e0 WHEN {c('paa_count')} >= 4 THEN 100e0 WHEN {c('paa_count')} >= 2 THEN 75e0 ELSE 50e0 END",
        "result_count": f"CASE WHEN {c('total_results')} = 0 THEN 0e0 ELSE {tiers(c('total_results'), ((10_000_000, '100e0'), (1_000_000, '80e0'), (100_000, '60e0'), (10_000, '40e0'), (1_000, '20e0')), '10e0')} END",
        "brand_results": tiers(c("brands"), ((5, "100e0"), (3, "75e0"), (1, "50e0")), "25e0"),
        "autocomplete_position": f"CASE WHEN {c('autocomplete')} IS NULL THEN 50e0 ELSE greatest(0e0, 100e0 - ({c('autocomplete')} - 1) * 10) END",
        "related_searches": tiers(c("related"), ((8, "100e0"), (6, "80e0"), (4, "60e0"), (2, "40e0"), (1, "20e0")), "0e0"),
        "knowledge_panel": f"CASE WHEN {c('has_panel')} THEN 100e0 ELSE 30e0 END",
    }


def volume_score(k: str = "") -> str:
    return "(" + " + ".join(f"({x}) * {num(VOLUME_WEIGHTS[n])}" for n, x in volume_signals(k).items()) + ")"


def volume_category(score: str) -> str:
    return tiers(score, ((80, "'very_high'"), (60, "'high'"), (40, "'medium'"), (20, "'low'")), "'very_low'")


def volume_range(category: str) -> tuple[str, str]:
    low = f"CASE {category} WHEN 'very_high' THEN 10000 WHEN 'high' THEN 1000 WHEN 'medium' THEN 100 WHEN 'low' THEN 10 ELSE 0 END"
    high = f"CASE {category} WHEN 'very_high' THEN 100000 WHEN 'high' THEN 10000 WHEN 'medium' THEN 1000 WHEN 'low' THEN 100 ELSE 10 END"
    return low, high


def serp_feature_score(k: str = "") -> str:
    flags = (("has_shopping", 15), ("has_snippet", 10), ("has_panel", 10), ("has_paa", 5), ("has_local", 10), ("has_video", 5), ("has_images", 5))
    ads = f"CASE WHEN {k}has_ads THEN 15 + least(15, {k}ad_count * 5) ELSE 0 END"
    return f"least(100, {ads} + {' + '.join(f'CASE WHEN {k}{f} THEN {n} ELSE 0 END' for f, n in flags)})"


def combined_score(google, listing, web, legitimate, llm, reviews, d: Dialect) -> str:
    review = f"least({d.log1p(f'CAST({reviews} AS double)')} / 5e0, 1e0)"
    found = f"CASE WHEN {google} > 0 THEN {google} ELSE {listing} END"
    return f"CASE WHEN {legitimate} AND {llm} >= 70 THEN 0.9e0 * {web} + 0.1e0 * {review} WHEN {found} > 0 THEN 0.3e0 * ({found}) + 0.5e0 * {web} + 0.2e0 * {review} ELSE 0.8e0 * {web} + 0.2e0 * {review} END"


def final_score(combined: str, probability: str, weight: str = "0.5e0") -> str:
    return f"CASE WHEN {probability} IS NULL THEN {combined} ELSE (1 - {weight}) * {combined} + {weight} * {probability} END"


def service_tier(full: str, some: str) -> str:
    return f"CASE WHEN {full} >= 3 THEN 'A' WHEN {full} >= 2 THEN 'B' WHEN {full} >= 1 THEN 'C' WHEN {some} >= 1 THEN 'D' ELSE 'E' END"


def rule_score(tier, provider, cta, phone, email, address, nav, schema, informational, negatives) -> str:
    flag = lambda x: f"CASE WHEN {x} THEN 5 ELSE 0 END"
    score = f"""CASE {tier} WHEN 'A' THEN 40 WHEN 'B' THEN 30 WHEN 'C' THEN 20 WHEN 'D' THEN 15 ELSE 5 END + least({provider} * 4, 20) + least({cta} * 3, 10) + {' + '.join(map(flag, (phone, email, address, nav, schema)))}
      - CASE WHEN {informational} > 5 AND {provider} < {informational} / 2e0 THEN 5 ELSE 0 END - {negatives} * 5"""
    return f"greatest(0e0, least(({score}) / 100e0, 1e0))"


def grade(x: str) -> str:
    return tiers(x, ((90, "'A'"), (80, "'B'"), (70, "'C'"), (60, "'D'")), "'F'")


def trend(current: str, previous: str, change: str) -> str:
    return f"CASE WHEN {current} IS NULL AND {previous} IS NOT NULL THEN 'lost' WHEN {previous} IS NULL THEN 'new' WHEN {change} >= 10 THEN 'strong_up' WHEN {change} >= 3 THEN 'up' WHEN {change} <= -10 THEN 'strong_down' WHEN {change} <= -3 THEN 'down' ELSE 'stable' END"


def volatility(n: str, deviation: str) -> str:
    return f"CASE WHEN {n} < 2 OR {deviation} < 2 THEN 'stable' WHEN {deviation} < 5 THEN 'low' WHEN {deviation} < 10 THEN 'moderate' WHEN {deviation} < 20 THEN 'high' ELSE 'extreme' END"


def alert(new: str, old: str) -> str:
    return f"""CASE WHEN {old} IS NULL THEN 'new_ranking' WHEN {new} > 100 AND {old} <= 100 THEN 'lost_ranking' WHEN {new} <= 3 AND {old} > 3 THEN 'entered_top_3' WHEN {new} <= 10 AND {old} > 10 THEN 'entered_top_10'
      WHEN {new} > 10 AND {old} <= 10 THEN 'left_top_10' WHEN {new} > 20 AND {old} <= 20 THEN 'left_top_20' WHEN {old} - {new} >= 10 THEN 'big_jump' WHEN {old} - {new} <= -10 THEN 'big_drop' END"""


def ranking_class(week: str, month: str, deviation: str) -> str:
    return f"CASE WHEN {deviation} > 5 THEN 'VOLATILE' WHEN {week} < -3 OR {month} < -5 THEN 'RISING' WHEN {week} > 3 OR {month} > 5 THEN 'FALLING' ELSE 'STABLE' END"


def keyword_opportunity(tier: str, difficulty: str, position: str) -> str:
    """Two-place decimals at each step, held between 0 and 100."""
    dec = lambda x: f"CAST({x} AS decimal(5,2))"
    bonus = f"CASE WHEN {position} IS NULL THEN 0 WHEN {position} <= 10 THEN 30 WHEN {position} <= 20 THEN 20 WHEN {position} <= 50 THEN 10 ELSE 5 END"
    total = f"{dec(f'{tier} * 20')} * 0.35 + {dec(f'100 - {difficulty}')} * 0.45 + {dec(bonus)} * 0.20"
    return f"CAST(least(100e0, greatest(0e0, CAST({dec(f'round({total}, 2)')} AS double))) AS double)"


def position_bonus(position: str) -> str:
    return f"CASE WHEN {position} IS NULL THEN 1e0 WHEN {position} <= 10 THEN 1.3e0 WHEN {position} <= 20 THEN 1.2e0 WHEN {position} <= 50 THEN 1.1e0 ELSE 1e0 END"


def opportunity_tier(score: str) -> str:
    return tiers(score, ((75, "'quick_win'"), (55, "'high_value'"), (35, "'moderate'"), (15, "'long_term'")), "'low_priority'")
