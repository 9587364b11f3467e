import copy
import json

from pyspark.sql import functions as F

from trustframe.operators.registries import claim_issues, directory_issues
from trustframe.sources.readers import read_registry

CLAIM = {"id": "a", "country": "NZ", "locale": "ko", "category": "fee", "label": "Fee", "value": 900, "unit": "NZD", "status": "official", "verifiedAt": "2026-06-04",
         "effectiveFrom": "2026-01-01", "sourceUrl": "https://www.immigration.govt.nz/x", "pages": ["nz/index.html"], "severity": "critical"}
ENTRY = {"id": "nz-acme", "country": "NZ", "name": "Acme", "location": {"label": "Te Puke", "region": "Bay of Plenty", "lat": -37.7, "lng": 176.3, "precision": "town"},
         "workTypes": ["packhouse"], "source": {"kind": "industry-association", "url": "https://www.nzkgi.org.nz/list", "checkedAt": "2026-07-19"}, "contact": {"kind": "none"},
         "status": "active", "nextReviewAt": "2026-08-18", "vacancyStatus": "directory-only",
         "eligibility": {"scheme": "nz-whv-extension", "classification": "conditional", "requiresRoleCheck": True, "requiresLocationCheck": False}}
DAY = "2026-07-19"


def changed(base, **changes):
    out = copy.deepcopy(base)
    for key, value in changes.items():
        node, *rest = key.split("__")
        if rest:
            out[node][rest[0]] = value
        else:
            out[node] = value
    return out


def codes(df):
    return sorted((r.entity_id, r.code, r.field) for r in df.collect())


def test_claim_mutations(spark, tmp_path):
    claims = [CLAIM, changed(CLAIM, id="b", verifiedAt="2026-06-03"), changed(CLAIM, id="c", sourceUrl="https://immigration.govt.nz.evil.com"),
              changed(CLAIM, id="d", currentAsOf="2026-01-01", effectiveFromUnknownReason="none given"), changed(CLAIM, id="e", value=[1]), changed(CLAIM, id="a", pages=["nz/other.html"]),
              changed(CLAIM, id="p", parityKey="k"), changed(CLAIM, id="q", parityKey="k", value=901), changed(CLAIM, id="r", parityKey="k", value=902, parityExemptReason="law"),
              changed(CLAIM, id="s", parityKey="k", value=900.0), changed(CLAIM, id="t", country="ZZ", parityExemptReason="x")]
    (tmp_path / "c.json").write_text(json.dumps({"claims": claims}))
    rows = read_registry(spark, str(tmp_path), "claims")
    ids = [c["id"] for c in claims]
    markers = spark.createDataFrame([("nz/index.html", i) for i in ids], "page string, marker string")
    assert codes(claim_issues(rows, markers, F.lit(DAY).cast("date"))) == sorted([
        ("b", "STALE", "verifiedAt"), ("c", "HOST", "sourceUrl"), ("d", "DATE_MODE", "effectiveFrom"), ("e", "VALUE", "value"), ("a", "DUPLICATE_ID", "id"), ("a", "NO_MARKER", "pages"),
        ("q", "PARITY", "parityKey"), ("t", "COUNTRY", "country"), ("t", "EXEMPT_WITHOUT_KEY", "parityExemptReason")])


def test_directory_mutations(spark, tmp_path):
    entries = [ENTRY, changed(ENTRY, id="x1", location__lat=-10.0), changed(ENTRY, id="x2", status="expired"), changed(ENTRY, id="x3", source__kind="unverified"),
               changed(ENTRY, id="x4", name="Acme hiring now"), changed(ENTRY, id="x5", contact={"kind": "none", "url": "https://a.nz"}), changed(ENTRY, id="nz-acme"),
               changed(ENTRY, id="x6", eligibility__requiresLocationCheck=True), changed(ENTRY, id="x7", source__kind="government-register")]
    (tmp_path / "e.json").write_text(json.dumps({"employers": entries}))
    got = codes(directory_issues(read_registry(spark, str(tmp_path), "employers"), F.lit(DAY).cast("date")))
    assert got == sorted([("x1", "BOX", "lat/lng"), ("x2", "LIFECYCLE", "status"), ("x3", "LIFECYCLE", "status"), ("x4", "VACANCY_TEXT", "text"), ("x5", "CONTACT", "contact"),
                          ("nz-acme", "DUPLICATE_ID", "id"), ("x6", "ELIGIBILITY", "eligibility"), ("x7", "SOURCE_HOST", "source.url")])


def test_nested_keys_and_optional_text(spark, tmp_path):
    entries = [changed(ENTRY, id="y1", location__zip="1"), changed(ENTRY, id="y2", location__address="  "), changed(ENTRY, id="y3", location__postcode="12"),
               changed(ENTRY, id="y4", contact=[]), changed(ENTRY, id="y5", source__note=1), changed(ENTRY, id="y6", location__lng=True), changed(ENTRY, id="y7", eligibility__extra=0),
               changed(ENTRY, id="y8", location__address=None)]
    del entries[4]["source"]["checkedAt"]
    (tmp_path / "e.json").write_text(json.dumps({"employers": entries}))
    got = codes(directory_issues(read_registry(spark, str(tmp_path), "employers"), F.lit(DAY).cast("date")))
    want = {("y1", "LOCATION_KEYS", "location"), ("y2", "TEXT", "address"), ("y3", "POSTCODE", "postcode"), ("y4", "CONTACT_KEYS", "contact"), ("y4", "CONTACT", "contact"),
            ("y5", "SOURCE_KEYS", "source"), ("y6", "NUMBER", "lng"), ("y7", "ELIGIBILITY_KEYS", "eligibility"), ("y8", "TEXT", "address")}
    assert want <= set(got) and {e for e, _, _ in got} == {f"y{i}" for i in range(1, 9)}
