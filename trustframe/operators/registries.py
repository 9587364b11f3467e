"""Whole-registry checks: the rules of a claim registry and of an entity directory in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import dates, urls
from trustframe.functions.variants import json_type, scalar_text
from trustframe.operators import rules as R
from trustframe.operators.issues import Rule, issue_rows, run_rules, union_issues
from trustframe.operators.ranking import deviating_rows, duplicate_rows
from trustframe.operators.reconcile import unmatched


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("row", f"$.{name}", kind)


def _whole(name: str) -> Column:
    return F.try_variant_get("row", f"$.{name}", "variant")


def claim_issues(rows: DataFrame, markers: DataFrame, as_of: Column) -> DataFrame:
    """All problems of claim rows (ord, row VARIANT, row_json) against page markers (page, marker).

    Rules per row, then duplicate ids, declared pages without a marker, and parity groups.
    """
    text_fields = {n: _field(n) for n in {*P.CLAIM_REQUIRED_TEXT, *P.CLAIM_OPTIONAL_TEXT}}
    flat = rows.select(
        "ord", "row", "row_json", *[v.alias(n) for n, v in text_fields.items()],
        _field("pages", "array<string>").alias("pages"), _whole("value").alias("value"), F.when(~R.not_finite_scalar(_whole("value")), scalar_text(_whole("value"))).alias("value_text"),
    ).withColumn("claim", F.coalesce(F.when(~R.blank(F.col("id")), F.col("id")), F.concat(F.lit("#"), F.col("ord") + 1)))
    day = {n: dates.strict_date(F.col(n)) for n in ("verifiedAt", "effectiveFrom", "effectiveTo", "currentAsOf")}
    url, country = F.col("sourceUrl"), F.col("country")
    known = country.isin(*P.OFFICIAL_DOMAINS, "COMMON")
    host_bad = R.host_not_allowed(urls.host(url), country, P.OFFICIAL_DOMAINS, P.COMMON_DOMAINS)
    unknown_start = F.col("currentAsOf").isNotNull() & ~R.blank(F.col("effectiveFromUnknownReason"))
    checks = [
        Rule("MISSING_FIELD", "keys", F.size(R.missing_keys(F.col("row_json"), P.CLAIM_REQUIRED)) > 0, F.array_join(R.missing_keys(F.col("row_json"), P.CLAIM_REQUIRED), ",")),
        *[Rule("TEXT", n, _whole(n).isNotNull() & R.not_text(_whole(n)), F.col(n), "non-empty text") for n in (*P.CLAIM_REQUIRED_TEXT, *P.CLAIM_OPTIONAL_TEXT)],
        Rule("VALUE", "value", F.col("value").isNotNull() & R.not_finite_scalar(F.col("value")), None, "finite scalar"),
        Rule("STATUS", "status", F.col("status").isNotNull() & R.not_in(F.col("status"), P.CLAIM_STATUSES), F.col("status")),
        Rule("SEVERITY", "severity", F.col("severity").isNotNull() & R.not_in(F.col("severity"), P.CLAIM_SEVERITIES), F.col("severity")),
        *[Rule("DATE", n, R.not_iso_date(F.col(n)), F.col(n), "YYYY-MM-DD") for n in day],
        Rule("FUTURE", "verifiedAt", R.in_future(day["verifiedAt"], as_of), F.col("verifiedAt")),
        Rule("STALE", "verifiedAt", R.stale(day["verifiedAt"], as_of, F.col("severity")), F.col("verifiedAt")),
        Rule("FUTURE", "currentAsOf", R.in_future(day["currentAsOf"], as_of), F.col("currentAsOf")),
        Rule("ORDER", "currentAsOf", R.out_of_order(day["currentAsOf"], day["verifiedAt"]), F.col("currentAsOf")),
        Rule("DATE_MODE", "effectiveFrom", R.date_mode_conflict(F.col("effectiveFrom"), F.col("currentAsOf"), F.col("effectiveFromUnknownReason"))),
        Rule("END_WITHOUT_START", "effectiveTo", R.forbidden_when(unknown_start, F.col("effectiveTo")), F.col("effectiveTo")),
        Rule("ORDER", "effectiveTo", R.out_of_order(day["effectiveFrom"], day["effectiveTo"]), F.col("effectiveTo")),
        Rule("COUNTRY", "country", country.isNotNull() & ~known, country),
        Rule("URL", "sourceUrl", known & url.isNotNull() & ~urls.is_web_url(url), url),
        Rule("HOST", "sourceUrl", known & urls.is_web_url(url) & host_bad, url),
        Rule("PAGES", "pages", F.coalesce(F.size("pages") < 1, F.lit(True)) & _whole("pages").isNotNull()),
        Rule("PAGE_PATH", "pages", F.exists("pages", lambda p: R.path_escapes(p) | R.blank(p))),
        Rule("EXEMPT_WITHOUT_KEY", "parityExemptReason", R.forbidden_when(F.col("parityKey").isNull(), F.col("parityExemptReason"))),
    ]
    found = run_rules(flat, "claims", F.col("claim"), checks)
    named = flat.filter(~R.blank(F.col("id")))
    again = issue_rows(duplicate_rows(named.select("ord", "id"), ["id"], "ord"), "claims", "DUPLICATE_ID", F.col("id"), "id", F.col("first_ord"))
    declared = named.select(F.explode("pages").alias("page"), F.col("id").alias("marker"))
    gaps = issue_rows(unmatched(declared, markers, ["page", "marker"]), "claims", "NO_MARKER", F.col("marker"), "pages", F.col("page"))
    comparable = F.col("status").isin(*P.PARITY_STATUSES) & F.col("parityKey").isNotNull() & R.blank(F.col("parityExemptReason")) & F.col("value_text").isNotNull()
    off = deviating_rows(named.select("ord", "id", "status", "parityKey", "parityExemptReason", "value_text", "unit"), ["parityKey"], "ord", ["value_text", "unit"], comparable)
    parity = issue_rows(off, "claims", "PARITY", F.col("id"), "parityKey", F.col("value_text"), F.col("base_value_text"))
    return union_issues([found, again, gaps, parity])


def directory_issues(rows: DataFrame, as_of: Column) -> DataFrame:
    """All problems of directory rows (ord, row VARIANT, row_json)."""
    d = {
        "id": _field("id"), "country": _field("country"), "name": _field("name"), "label": _field("location.label"), "address": _field("location.address"),
        "region": _field("location.region"), "state": _field("location.state"), "postcode": _field("location.postcode"), "lat": _field("location.lat", "double"),
        "lng": _field("location.lng", "double"), "precision": _field("location.precision"), "types": _field("workTypes", "array<string>"), "kind": _field("source.kind"),
        "url": _field("source.url"), "checked": _field("source.checkedAt"), "until": _field("source.effectiveTo"), "c_kind": _field("contact.kind"), "c_url": _field("contact.url"),
        "status": _field("status"), "review": _field("nextReviewAt"), "vacancy": _field("vacancyStatus"), "scheme": _field("eligibility.scheme"),
        "class": _field("eligibility.classification"), "role": _field("eligibility.requiresRoleCheck", "boolean"), "loc": _field("eligibility.requiresLocationCheck", "boolean"),
    }
    parts = {
        "location": (P.LOCATION_KEYS, P.LOCATION_OPTIONAL_KEYS), "source": (P.SOURCE_KEYS, P.SOURCE_OPTIONAL_KEYS),
        "contact": (P.CONTACT_KEYS, P.CONTACT_OPTIONAL_KEYS), "eligibility": (P.ELIGIBILITY_KEYS, ()),
    }
    nested = [F.to_json(_whole(n)).alias(f"{n}_json") for n in parts]
    numbers = [json_type(_whole(f"location.{n}")).alias(f"{n}_type") for n in ("lat", "lng")]
    present = [_whole(f"location.{n}").isNotNull().alias(f"has_{n}") for n in ("address", "state", "postcode")]
    flat = rows.select("ord", "row_json", *nested, *numbers, *present, *[v.alias(n) for n, v in d.items()]).withColumn("entry", F.coalesce("id", F.concat(F.lit("#"), F.col("ord") + 1)))
    c = F.col
    checked, until, review = (dates.strict_date(c(n)) for n in ("checked", "until", "review"))
    au, nz = c("country") == "AU", c("country") == "NZ"
    web = c("c_kind").isin("company", "recruitment")
    problems = R.lifecycle_problems(c("status"), until, review, c("kind"), as_of)
    checks = [
        Rule("KEYS", "entry", R.keys_not_exact(c("row_json"), P.ENTRY_KEYS)), Rule("ID", "id", R.not_matching(c("id"), P.ID_PATTERN) | (F.length("id") > 100), c("id")),
        Rule("COUNTRY", "country", R.not_in(c("country"), P.COUNTRIES), c("country")),
        # a part that is lacking or no object is a broken key of the entry, too
        *[Rule(f"{n.upper()}_KEYS", n, R.keys_not_exact(c(f"{n}_json"), *keys), c(f"{n}_json")) for n, keys in parts.items()],
        *[Rule("TEXT", n, R.unsafe_text(c(n)), c(n)) for n in ("name", "label", "region")],
        *[Rule("TEXT", n, c(f"has_{n}") & R.unsafe_text(c(n)), c(n)) for n in ("address", "state", "postcode")],
        *[Rule("NUMBER", n, ~F.coalesce(c(f"{n}_type") == "number", F.lit(False)), c(n), "finite number") for n in ("lat", "lng")],
        Rule("PRECISION", "precision", R.not_in(c("precision"), P.PRECISIONS), c("precision")), Rule("BOX", "lat/lng", R.outside_box(c("country"), c("lat"), c("lng"))),
        Rule("ADDRESS", "address", R.required_when(c("precision") == "exact", c("address"))), Rule("POSTCODE", "postcode", R.required_when(c("precision") == "postcode", c("postcode"))),
        Rule("STATE", "state", R.forbidden_when(nz, c("state")) | (au & R.not_in(c("state"), list(P.POSTCODE_RANGES))), c("state")),
        Rule("POSTCODE", "postcode", (au | c("postcode").isNotNull()) & R.not_matching(c("postcode"), r"\d{4}"), c("postcode")),
        Rule("STATE_POSTCODE", "postcode", au & R.postcode_outside_state(c("state"), c("postcode")), c("postcode")),
        Rule("CONTACT", "contact", R.not_in(c("c_kind"), P.CONTACT_KINDS) | R.forbidden_when(c("c_kind") == "none", c("c_url")) | R.required_when(c("c_kind") != "none", c("c_url")), c("c_kind")),
        Rule("CONTACT_URL", "contact.url", c("c_url").isNotNull() & ((web & R.not_https(c("c_url"))) | ((c("c_kind") == "email") & R.not_mailto(c("c_url")))), c("c_url")),
        Rule("SOURCE_KIND", "source.kind", R.not_in(c("kind"), P.SOURCE_KINDS), c("kind")), Rule("SOURCE_URL", "source.url", R.not_https(c("url")), c("url")),
        Rule("SOURCE_HOST", "source.url", R.source_host_conflict(c("kind"), c("country"), urls.host(c("url"))), c("url")),
        Rule("OTHER_SITE", "contact.url", (c("kind") == "employer-official") & c("c_kind").isin("company", "email") & R.other_registrable_host(c("url"), c("c_url")), c("c_url")),
        *[Rule("DATE", n, R.not_iso_date(c(n)), c(n)) for n in ("checked", "until", "review")],
        Rule("FUTURE", "checked", R.in_future(checked, as_of), c("checked")), Rule("ORDER", "review", R.out_of_order(checked, review), c("review")),
        Rule("STATUS", "status", R.not_in(c("status"), P.DIRECTORY_STATUSES), c("status")), *[Rule("LIFECYCLE", "status", broken, F.lit(code)) for code, broken in problems.items()],
        Rule("TYPES", "workTypes", R.bad_enum_array(c("types"), P.WORK_TYPES)), Rule("VACANCY", "vacancyStatus", R.not_in(c("vacancy"), P.VACANCY_STATUSES), c("vacancy")),
        Rule("VACANCY_TEXT", "text", R.banned_phrase([c("name"), c("label"), c("address")])),
        Rule("ELIGIBILITY", "eligibility", R.eligibility_conflict(c("country"), c("scheme"), c("class"), c("role"), c("loc"))),
    ]
    found = run_rules(flat, "directory", c("entry"), checks)
    again = issue_rows(duplicate_rows(flat.filter("id is not null").select("ord", "id"), ["id"], "ord"), "directory", "DUPLICATE_ID", c("id"), "id", c("first_ord"))
    return found.unionByName(again)
