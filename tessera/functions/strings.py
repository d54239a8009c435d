"""String functions on URLs, phones, addresses and names, as SQL of either dialect.

Each takes a dialect and a SQL expression and returns a SQL expression; null and empty inputs
give null, or the empty string where that is said.
"""

from __future__ import annotations

from ..plans.dialect import Dialect

# Fixed values.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "gclid", "gclsrc", "gbraid", "wbraid", "fbclid", "fb_action_ids", "fb_action_types", "fb_ref", "fb_source", "twclid", "tw_source", "tw_campaign", "li_fat_id", "lipi",
    "msclkid", "mc_cid", "mc_eid", "mkt_tok", "_hsenc", "_hsmi", "vero_id", "vero_conv", "ref", "referrer", "source", "campaign", "medium",
    "sessionid", "session_id", "jsessionid", "phpsessid", "aspsessionid", "click_id", "clickid", "cid", "sid", "tid", "pid", "aid", "_ga", "_gid", "_gac", "_gl",
)
NOT_WEBSITES = ("yellowpages.com", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "yelp.com", "google.com", "apple.com/maps", "mapquest.com")
EXPANDED = {"St": "Street", "Ave": "Avenue", "Blvd": "Boulevard", "Rd": "Road", "Dr": "Drive", "Ln": "Lane", "Ct": "Court", "Pl": "Place", "Pkwy": "Parkway", "Cir": "Circle"}
CONTRACTED = {"street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct", "place": "pl", "suite": "ste", "apartment": "apt"}
COMPASS = {"north": "n", "south": "s", "east": "e", "west": "w"}
LEGAL_ANYWHERE = ("llc", "llp", "inc", "incorporated", "corp", "corporation", "ltd", "limited", "co", "company", "enterprises")
LEGAL_LAST = "llc|inc|corp|corporation|ltd|limited|co|company|enterprises|group"
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "com.au", "net.au", "co.nz", "com.br", "co.jp", "co.in")


def _null_if_blank(x: str) -> str:
    return f"nullif({x}, '')"


def with_scheme(d: Dialect, x: str) -> str:
    return f"CASE WHEN {d.starts(x, 'http://')} OR {d.starts(x, 'https://')} THEN {x} ELSE 'https://' || {x} END"


def canonical_url(d: Dialect, x: str) -> str:
    """Scheme added, host in lower case without www., no trailing slash and no fragment; scheme and query stay."""
    u = f"({with_scheme(d, f'trim({x})')})"
    scheme, host = d.find(u, "^(https?)://", 1), f"lower({d.find(u, '^https?://([^/?#]*)', 1)})"
    path, query = d.find(u, "^https?://[^/?#]*([^?#]*)", 1), d.find(u, r"^[^?#]*(\?[^#]+)", 1)
    cut = f"CASE WHEN length({path}) > 1 THEN {d.sub(path, '/+$', '')} ELSE {path} END"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {scheme} || '://' || {d.sub(host, '^www[.]', '')} || ({cut}) || {query} END"


def clean_query(d: Dialect, q: str) -> str:
    """Tracking keys dropped, the rest in order of key and then of value, blank values kept."""
    banned = ", ".join(f"'{k}'" for k in TRACKING)
    kept = d.keep(d.split(q, "&"), lambda e: f"{e} <> '' AND contains({e}, '=') AND lower(split_part({e}, '=', 1)) NOT IN ({banned})")
    return d.join(d.sort(kept), "&")


def tracked_url(d: Dialect, x: str) -> str:
    """https, host in lower case without www., no trailing slash, clean query, no fragment; null without a scheme or host."""
    scheme = f"lower({d.find(x, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)})"
    host = d.sub(f"lower({d.find(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)})", "^www[.]", "")
    path = d.find(x, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE {d.sub(path, '/+$', '')} END"
    query = clean_query(d, d.find(x, r"^[^?#]*\?([^#]*)", 1))
    return f"CASE WHEN {scheme} = '' OR {host} = '' THEN NULL ELSE CASE WHEN {scheme} = 'http' THEN 'https' ELSE {scheme} END || '://' || {host} || ({path}) || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


def host(d: Dialect, x: str) -> str:
    """Host with subdomains, without scheme, www., path and query."""
    h = d.sub(d.sub(f"lower({x})", "^https?://", ""), "^www[.]", "")
    return _null_if_blank(d.sub(h, "[/?].*$", ""))


def registered_domain(d: Dialect, x: str) -> str:
    """The last two labels of the host, or three after a two-part public suffix."""
    h = d.sub(d.sub(d.sub(f"lower({x})", "^[a-z]+://", ""), "[/?#].*$", ""), ":[0-9]+$", "")
    two = "|".join(s.replace(".", "[.]") for s in TWO_PART_SUFFIXES)
    long = d.find(h, f"([^.]+[.](?:{two}))$", 1)
    return f"CASE WHEN {long} <> '' THEN {long} ELSE {_null_if_blank(d.find(h, '([^.]+[.][^.]+)$', 1))} END"


def digits(d: Dialect, x: str) -> str:
    return d.sub(x, "[^0-9]", "")


def phone_dashed(d: Dialect, x: str) -> str:
    """XXX-XXX-XXXX of ten digits, or of eleven after 1; other long ones as digits; then the extension. Its digits count too."""
    n = digits(d, x)
    ext = d.find(x, r"(?i)(?:ext|extension|x)[:\s]*([0-9]+)", 1)
    dashed = lambda at: f"substr({n}, {at}, 3) || '-' || substr({n}, {at + 3}, 3) || '-' || substr({n}, {at + 6}, 4)"
    body = f"CASE WHEN length({n}) = 10 THEN {dashed(1)} WHEN length({n}) = 11 AND {d.starts(n, '1')} THEN {dashed(2)} ELSE {n} END"
    return f"CASE WHEN {x} IS NULL OR length({n}) < 10 THEN NULL ELSE ({body}) || CASE WHEN {ext} <> '' THEN ' ext. ' || {ext} ELSE '' END END"


def phone_us(d: Dialect, x: str) -> str:
    """+1-XXX-XXX-XXXX of exactly ten digits after a leading 1; an area code that starts with 0 or 1 is no number."""
    n = d.sub(x, "[^0-9]", "")
    ten = f"CASE WHEN length({n}) = 11 AND {d.starts(n, '1')} THEN substr({n}, 2) ELSE {n} END"
    return f"CASE WHEN length({ten}) = 10 AND substr({ten}, 1, 1) NOT IN ('0', '1') THEN '+1-' || substr({ten}, 1, 3) || '-' || substr({ten}, 4, 3) || '-' || substr({ten}, 7, 4) END"


def phone_e164(d: Dialect, x: str) -> str:
    """+1 and ten digits when area code and exchange start with 2 to 9: the numbering plan's rule."""
    n = digits(d, x)
    ten = d.find(n, "^1?([2-9][0-9]{2}[2-9][0-9]{6})$", 1)
    return f"CASE WHEN {ten} <> '' THEN '+1' || {ten} END"


def first_phone(d: Dialect, x: str) -> str:
    """The first of three patterns' first match that is a US number."""
    patterns = (r"\+?1?\s*\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}", r"[0-9]{3}[\s.-][0-9]{3}[\s.-][0-9]{4}", "[0-9]{10}")
    return f"coalesce({', '.join(phone_us(d, d.find(x, p)) for p in patterns)})"


def email(d: Dialect, x: str) -> str:
    e = f"lower(trim({x}))"
    return f"CASE WHEN {d.match(e, '^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$')} THEN {e} END"


def first_email(d: Dialect, x: str) -> str:
    return _null_if_blank(f"lower({d.find(x, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z|]{2,}')})")


def valid_url(d: Dialect, x: str) -> str:
    """The URL with a lower-case host and no fragment if its scheme is http or https and its host has a dot."""
    u = f"({with_scheme(d, x)})"
    h = d.find(u, "^https?://([^/?#]*)", 1)
    return f"CASE WHEN contains({h}, '.') THEN {d.find(u, '^(https?://)', 1)} || lower({h}) || {d.find(u, '^https?://[^/?#]*([^#]*)', 1)} END"


def is_website(d: Dialect, x: str) -> str:
    v = f"lower({valid_url(d, x)})"
    return f"coalesce(NOT {d.contains_any(v, NOT_WEBSITES)}, false)"


def squeeze(d: Dialect, x: str) -> str:
    return d.sub(f"trim({x})", r"\s+", " ")


def _words(d: Dialect, x: str, table: dict, flags: str = "") -> str:
    for word, by in table.items():
        x = d.sub(x, rf"{flags}\b{word}\b", by)
    return x


def address_long(d: Dialect, x: str) -> str:
    """Abbreviations spelled out, blanks squeezed; case as it comes (title case: functions.udfs.title)."""
    return _words(d, squeeze(d, x), EXPANDED, "(?i)")


def address_short(d: Dialect, x: str) -> str:
    """Lower case, street words contracted; boulevard stays as it is in this variant."""
    return _words(d, squeeze(d, f"lower({x})"), {k: v for k, v in CONTRACTED.items() if k != "boulevard"})


def address_joined(d: Dialect, street: str, city: str, state: str, zip_code: str) -> str:
    """Street, city, state and five-digit ZIP, contracted, with compass words; null without a street."""
    tail = "".join(f" || CASE WHEN coalesce({p}, '') = '' THEN '' ELSE ', ' || {v} END" for p, v in ((city, city), (state, state), (zip_code, f"substr({zip_code}, 1, 5)")))
    joined = squeeze(d, f"lower({street}{tail})")
    return f"CASE WHEN coalesce({street}, '') = '' THEN NULL ELSE {_words(d, joined, CONTRACTED | COMPASS)} END"


def address_plain(d: Dialect, x: str) -> str:
    """Words replaced wherever they stand, also within others; marks but # dropped; empty for null."""
    y = f"lower(trim(coalesce({x}, '')))"
    for word, by in (CONTRACTED | {"circle": "cir"} | COMPASS | {"unit": "#"}).items():
        y = f"replace({y}, '{word}', '{by}')"
    return f"trim({d.sub(d.sub(y, r'[^A-Za-z0-9_\s#]', ''), r'\s+', ' ')})"


def name_key(d: Dialect, x: str) -> str:
    """Lower case, legal words dropped anywhere, marks as blanks; empty for null."""
    y = f"lower(coalesce({x}, ''))"
    for word in LEGAL_ANYWHERE:
        y = d.sub(y, rf"\b{word}\b", "")
    return f"trim({d.sub(d.sub(y, r'[^a-z0-9\s]', ' '), r'\s+', ' ')})"


def name_entity(d: Dialect, x: str) -> str:
    """Lower case, one legal word at the end dropped, articles dropped."""
    y = d.sub(squeeze(d, f"lower({x})"), rf"\s+({LEGAL_LAST})\s*[.]?$", "")
    for word in ("the", "a", "an"):
        y = d.sub(y, rf"\b{word}\b", "")
    return _null_if_blank(f"trim({d.sub(y, r'\s+', ' ')})")


def name_nap(d: Dialect, x: str) -> str:
    return _null_if_blank(f"trim({d.sub(squeeze(d, f'lower({x})'), rf'\s+({LEGAL_LAST})\s*[.]?$', '')})")


LEGAL_ENDINGS = ("llc", "inc", "corp", "co", "company", "ltd", "l.l.c.", "inc.")


def _without_legal(d: Dialect, y: str) -> str:
    for word in LEGAL_ENDINGS:
        y = d.sub(y, rf"\s+{word}[.]?$", "")
    return y


def _without_marks(d: Dialect, y: str) -> str:
    return f"trim({d.sub(d.sub(y, r'[^A-Za-z0-9_\s]', ''), r'\s+', ' ')})"


def name_citation(d: Dialect, x: str) -> str:
    """Legal words at the end dropped one after another, marks dropped; empty for null."""
    return _without_marks(d, _without_legal(d, f"lower(trim(coalesce({x}, '')))"))


def name_citations(d: Dialect, rows: str, x: str, name: str) -> str:
    """rows with name_citation of x as a column: a name is taken apart only where one look finds a legal word at its end, or a mark or several blanks."""
    legal = d.match("_low", rf"\s(?:{'|'.join(LEGAL_ENDINGS)})[.]?$")
    odd = d.match("_cut", "[^A-Za-z0-9_ ]|  ")
    return f"""SELECT * EXCEPT (_low, _cut), CASE WHEN {odd} THEN {_without_marks(d, '_cut')} ELSE trim(_cut) END AS {name} FROM (
  SELECT *, CASE WHEN {legal} THEN {_without_legal(d, '_low')} ELSE _low END AS _cut FROM (SELECT *, lower(trim(coalesce({x}, ''))) AS _low FROM ({rows}) _r) _l) _c"""


def business_name(d: Dialect, x: str) -> str:
    """Squeezed; null if it is a legal word alone or shorter than two characters."""
    y = squeeze(d, x)
    return f"CASE WHEN lower({y}) IN ('inc', 'llc', 'ltd', 'corp', 'company') OR length({y}) < 2 THEN NULL ELSE {y} END"


def zip_code(d: Dialect, x: str) -> str:
    return _null_if_blank(d.find(x, r"\b[0-9]{5}(?:-[0-9]{4})?\b"))


def place(d: Dialect, x: str) -> tuple[str, str, str]:
    """City, state and ZIP of a line such as 'Providence, RI 02903'."""
    z = zip_code(d, x)
    rest = f"trim(replace({x}, coalesce({z}, '~'), ''))"
    parts = d.keep(d.each(d.split(d.sub(rest, r",|\s{2,}", "|"), "|"), lambda e: f"trim({e})"), lambda e: f"{e} <> ''")
    joined = d.join(parts, "|")
    two = f"{d.size(parts)} >= 2"
    words = f"split_part({joined}, '|', 1)"
    city = f"CASE WHEN {two} THEN {words} WHEN contains({words}, ' ') THEN {d.sub(words, r'\s+\S+$', '')} END"
    state = f"CASE WHEN {two} THEN split_part({joined}, '|', 2) WHEN contains({words}, ' ') THEN {d.find(words, r'(\S+)$', 1)} END"
    return city, state, z


def address_parts(d: Dialect, x: str) -> tuple[str, str, str, str]:
    """Street, city, state and ZIP by commas; the third part is 'ST ZIP'."""
    part = lambda n: f"trim(split_part({x}, ',', {n}))"
    has = lambda n: f"{d.size(d.split(x, ','))} >= {n}"
    last = part(3)
    one = f"NOT contains({last}, ' ')"
    state = f"CASE WHEN NOT ({has(3)}) OR {last} = '' THEN NULL WHEN {one} THEN CASE WHEN {d.match(last, '^[0-9]+$')} THEN NULL ELSE {last} END ELSE {d.find(last, r'^(\S+)', 1)} END"
    zipped = f"CASE WHEN NOT ({has(3)}) OR {last} = '' THEN NULL WHEN {one} THEN CASE WHEN {d.match(last, '^[0-9]+$')} THEN {last} END ELSE {d.find(last, r'^\S+\s+(\S+)', 1)} END"
    blank = f"coalesce({x}, '') = ''"
    return (f"CASE WHEN {blank} THEN NULL ELSE {part(1)} END", f"CASE WHEN {blank} OR NOT ({has(2)}) THEN NULL ELSE {part(2)} END", f"CASE WHEN {blank} THEN NULL ELSE {state} END", f"CASE WHEN {blank} THEN NULL ELSE {zipped} END")


def city_slug(d: Dialect, city: str, state: str) -> str:
    """los-angeles-ca; a first word st, ft or mt is spelled out."""
    y = f"replace(lower(trim({city})), '.', '')"
    for short, long in (("st", "saint"), ("ft", "fort"), ("mt", "mount")):
        y = d.sub(y, rf"^{short}(\s|$)", long + "{1}")
    y = d.sub(d.sub(y, "[^a-z0-9-]+", "-"), "-+", "-")
    return f"{d.sub(y, '^-+|-+$', '')} || '-' || lower(trim({state}))"


def geo(city: str, state: str) -> str:
    return f"trim({city}) || ', ' || upper(trim({state}))"


def search_url(d: Dialect, label: str, where: str) -> str:
    return f"'https://www.yellowpages.com/search?search_terms=' || {d.form(label)} || '&geo_location_terms=' || {d.form(where)}"
