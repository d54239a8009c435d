"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import html as H
from tests.plain import average_linkage
from tests.test_operators import detect
from tessera.streaming.state import alert_type


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abh2 p=\"'!-&;\n", max_size=80))
def test_any_page_is_read(page):
    H.links(page, "https://x.com/")
    H.schema_types(page)
    H.search_results(page)
    H.listing_cards(page)
    H.reviews(page)
    assert all(s["words"] == len(s["content"].split()) or len(s["content"]) == 2000 for s in H.sections(page))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=8), max_size=9))
def test_clusters_partition_the_phrases(phrases):
    found = average_linkage(phrases)
    assert sorted(p for c in found for p in c) == sorted(set(phrases))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "p", "q"]), st.sampled_from([None, "d", "e"])), max_size=12))
def test_duplicates_point_to_kept_rows(rows):
    out = detect([{"id": i, "phone": p, "domain": d, "key": "", "address": None} for i, (p, d) in enumerate(rows)])
    kept = {i for i, of in out if of is None}
    assert all(of in kept and of < i for i, of in out if of is not None)


@given(st.integers(1, 150), st.integers(1, 150))
def test_alerts_are_exclusive_and_complete(new, old):
    kind = alert_type(new, old)
    if abs(new - old) >= 10:
        assert kind is not None
    if new == old:
        assert kind is None
