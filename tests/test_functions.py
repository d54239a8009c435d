"""String and score functions on the examples that define them."""

import random
import re

import pytest

from tessera.functions import scores as S
from tessera.functions import strings as X
from tessera.plans.dialect import ANSI, SPARK, text
from tests.conftest import DATA


def both(spark, duck, build):
    """The value of build(dialect) on both engines, which must agree."""
    a = spark.sql(f"SELECT {build(SPARK)} AS v").first()["v"]
    b = duck.execute(f"SELECT {build(ANSI)} AS v").fetchone()[0]
    assert a == b
    return a


def arg(value):
    return "CAST(NULL AS string)" if value is None else text(value)


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (X.canonical_url, "example.com", "https://example.com"),
        (X.canonical_url, "http://www.example.com/", "http://example.com/"),
        (X.canonical_url, "https://example.com/page#section", "https://example.com/page"),
        (X.canonical_url, "https://WWW.Example.com/a/b/?q=1", "https://example.com/a/b?q=1"),
        (X.canonical_url, None, None),
        (X.tracked_url, "HTTP://www.Ex.com/a/?utm_source=x&b=2&a=1#f", "https://ex.com/a?a=1&b=2"),
        (X.tracked_url, "no-scheme.com", None),
        (X.registered_domain, "http://subdomain.example.co.uk", "example.co.uk"),
        (X.registered_domain, "https://www.example.com/path", "example.com"),
        (X.host, "https://www.example.com/page?x", "example.com"),
        (X.host, "www.example.com", "example.com"),
        (X.phone_dashed, "(555) 123-4567", "555-123-4567"),
        (X.phone_dashed, "555.123.4567 ext. 123", "5551234567123"),
        (X.phone_dashed, "(555) 123-4567 x 9", "55512345679 ext. 9"),
        (X.phone_dashed, "12345", None),
        (X.phone_us, "1-555-123-4567", "+1-555-123-4567"),
        (X.phone_us, "0551234567", None),
        (X.phone_e164, "+1 212 555 0100", "+12125550100"),
        (X.email, "  John.Doe@Example.COM  ", "john.doe@example.com"),
        (X.email, "a@b", None),
        (X.valid_url, "Example.com/x#y", "https://example.com/x"),
        (X.valid_url, "localhost", None),
        (X.address_short, "12 Main  Street Suite 5", "12 main st ste 5"),
        (X.address_short, "1 Sunset Boulevard", "1 sunset boulevard"),
        (X.name_key, "Clean Windows, LLC", "clean windows"),
        (X.name_entity, "The Bright Company", "bright"),
        (X.business_name, " llc ", None),
        (X.zip_code, "Austin, TX 78701-1234", "78701-1234"),
    ],
)
def test_strings(spark, duck, function, value, expected):
    assert both(spark, duck, lambda d: function(d, arg(value))) == expected


@pytest.mark.parametrize(("city", "state", "slug"), [("St. Louis", "MO", "saint-louis-mo"), ("O'Fallon", "IL", "o-fallon-il"), ("Winston-Salem", "NC", "winston-salem-nc"), ("Fort Worth", "TX", "fort-worth-tx")])
def test_city_slug(spark, duck, city, state, slug):
    assert both(spark, duck, lambda d: X.city_slug(d, text(city), text(state))) == slug


@pytest.mark.parametrize(("a", "b", "n"), [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("book", "back", 2), ("test", "test", 0)])
def test_levenshtein(spark, duck, a, b, n):
    assert both(spark, duck, lambda d: f"levenshtein('{a}', '{b}')") == n


def test_trust_and_tiers(spark, duck):
    assert both(spark, duck, lambda d: S.trust(d, "'Google'")) == 90
    assert both(spark, duck, lambda d: S.trust(d, "CAST(NULL AS string)")) == 20
    assert both(spark, duck, lambda d: S.trust_tier("80")) == "high"


@pytest.mark.parametrize(("new", "old", "kind"), [("5", "NULL", "new_ranking"), ("2", "8", "entered_top_3"), ("9", "15", "entered_top_10"), ("12", "4", "left_top_10"), ("25", "15", "left_top_20"), ("40", "60", "big_jump"), ("60", "40", "big_drop"), ("41", "40", None)])
def test_alerts(spark, duck, new, old, kind):
    from tessera.streaming.state import alert_type

    assert both(spark, duck, lambda d: S.alert(new, f"CAST({old} AS int)")) == kind
    assert alert_type(int(new), None if old == "NULL" else int(old)) == kind


def test_vitals(spark, duck):
    assert both(spark, duck, lambda d: S.vital_rating("lcp", "2500")) == "GOOD"
    assert both(spark, duck, lambda d: S.vitals_assessment(["'GOOD'", "CAST(NULL AS string)", "'POOR'"])) == "FAILED"


def test_intent_takes_the_first_class(spark, duck):
    assert both(spark, duck, lambda d: S.intent(d, "'Best price shop'", S.GAP_INTENT)) == "transactional"
    assert both(spark, duck, lambda d: S.intent(d, "'zzz'", S.GAP_INTENT)) == "informational"


def test_syllables(spark, duck):
    from tessera.operators.analytics import syllables

    for word, n in (("cake", 1), ("table", 2), ("wanted", 2), ("jumped", 1), ("boxes", 2), ("family", 3), ("a", 1)):
        assert both(spark, duck, lambda d, w=word: syllables(d, f"'{w}'", d.count(f"'{w}'", "[aeiouy]+"))) == n


def test_readability_of_odd_texts(spark, duck, tmp_path):
    """The look-up of words and the list of words with their endings agree, whatever the words and marks."""
    from tessera.operators import analytics
    from tests.compare import same_rows

    words = [*analytics.SYLLABLES, "table", "Boxes", "wanted", "jumped", "ES", "ed", "e", "42", "4e2", "--", "it's", "_", "x_1", "\u212aelvin", "Stra\u00dfe", "\u0130de", "caf\u00e9", "Dr.", "e.g.", "U.S.", "Corp. ", "end. ", "what?! ", "a|b", "| | ", "\t", "\n"]
    rng = random.Random(8)
    texts = [None, "", " ", ". ", "42 7", *words, *(rng.choice((" ", "", "-")).join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(300)), "word. " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same_rows(analytics.readability(spark, str(tmp_path)), con, analytics._readability_sql(ANSI)) > 300
    known = analytics.WordCounts()
    known.MOST = 50  # words beyond it are worked out again
    many = [f"word{k}e" for k in range(120)]
    assert known.of(" ".join(many * 2)) == [240, 2 * sum(map(len, many)), 240, 0] and len(known) <= 50


def test_citation_names_by_one_look(spark, duck):
    """Names taken apart only where something is to be dropped equal those that go through every expression."""
    ends = ["llc", "inc", "corp", "co", "company", "ltd", "l.l.c.", "inc.", "LLC.", "lxlxcx", "incx", "co."]
    rng = random.Random(5)
    names = [None, "", " ", "llc", " LLC", "acme 12", " Acme 12 ", "a  b", "a\tb", "caf\u00e9 co", "Joe's, Ltd.", "x_1-2", "acme l l co", "a\nco", "a - b", *ends]
    names += [rng.choice(("Acme", "A&B  C", "", "d e")) + "".join(rng.choice((" ", "  ", "")) + rng.choice(ends) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r["id"]: r["n"] for r in spark.sql(X.name_citations(SPARK, "SELECT id, name FROM {rows}", "name", "n"), rows=rows).collect()}
    want = {r["id"]: r["n"] for r in rows.selectExpr("id", f"{X.name_citation(SPARK, 'name')} AS n").collect()}
    assert got == want and len(set(got.values())) > 20
    for i, name in enumerate(names):
        found = duck.execute(f"SELECT {X.name_citation(ANSI, 'x')} FROM (SELECT CAST(? AS VARCHAR) AS x)", [name]).fetchone()[0]
        assert got[i] == found


def test_names_of_claims_are_read_in_compiled_code(spark):
    """A company's name is read before the join, and no generated method is too long for the JVM to compile (8,000 bytes)."""
    from tessera.operators import scalars

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scalars.nap_scores(spark, f"{DATA}/sf0.001")._jdf.queryExecution()
        said = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert sizes and max(sizes) < 8000
