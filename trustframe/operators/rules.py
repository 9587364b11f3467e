"""Row rules: each returns a Column that is true where the row violates the rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import dates, urls
from trustframe.functions.variants import json_type


#: White space is what Unicode calls so, not only the blank.
NOT_SPACE = r"(?U)\S"
EDGE_SPACE = r"(?U)\A\s|\s\z"


def missing_keys(json_text: Column, keys: Sequence[str]) -> Column:
    """Required keys that are absent (not merely null)."""
    return F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(json_text))


def unexpected_keys(json_text: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.json_object_keys(json_text), F.array(*map(F.lit, allowed)))


def keys_not_exact(json_text: Column, required: Sequence[str], optional: Sequence[str] = ()) -> Column:
    missing = F.size(missing_keys(json_text, required)) > 0
    extra = F.size(unexpected_keys(json_text, [*required, *optional])) > 0
    return F.coalesce(missing | extra, F.lit(True))


def blank(col: Column) -> Column:
    """NULL or white space only."""
    return ~F.coalesce(col.rlike(NOT_SPACE), F.lit(False))


def not_text(value: Column, required: bool = True) -> Column:
    """Variant field that is not a non-blank string; an absent optional field is fine."""
    ok = (json_type(value) == "string") & F.try_variant_get(value, "$", "string").rlike(NOT_SPACE)
    bad = ~F.coalesce(ok, F.lit(False))
    return bad if required else value.isNotNull() & bad


def not_finite_scalar(value: Column) -> Column:
    """Variant that is null, an array or an object (a parsed variant is never NaN or infinite)."""
    return ~F.coalesce(json_type(value).isin("string", "number", "boolean"), F.lit(False))


def not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def not_in(col: Column, values: Sequence) -> Column:
    return ~F.coalesce(col.isin(*values), F.lit(False))


def not_iso_date(text: Column) -> Column:
    return text.isNotNull() & dates.strict_date(text).isNull()


def in_future(day: Column, as_of: Column) -> Column:
    return day > as_of


def stale(day: Column, as_of: Column, severity: Column, limits: Mapping[str, int] = P.STALE_AFTER_DAYS) -> Column:
    """Older than the limit of its severity; exactly at the limit still passes. Unknown severity: no limit."""
    limit = F.try_element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), severity)
    return F.datediff(as_of, day) > limit


def review_overdue(verified: Column, days: Column, as_of: Column) -> Column:
    return as_of > dates.review_due(verified, days)


def date_mode_conflict(effective_from: Column, current_as_of: Column, unknown_reason: Column) -> Column:
    """Exactly one mode is allowed: a known start, or an observation day with a reason."""
    return effective_from.isNotNull() == (current_as_of.isNotNull() & ~blank(unknown_reason))


def out_of_order(earlier: Column, later: Column) -> Column:
    return earlier > later


def forbidden_when(condition: Column, col: Column) -> Column:
    return condition & col.isNotNull()


def required_when(condition: Column, col: Column) -> Column:
    return condition & col.isNull()


def lifecycle_problems(status: Column, effective_to: Column, next_review: Column, source_kind: Column,
                       as_of: Column) -> dict[str, Column]:
    """Lifecycle rules by code; they are independent, so one row can break several."""
    return {
        "ELAPSED_NOT_EXPIRED": (effective_to < as_of) & (status != "expired"),
        "EXPIRED_NOT_ELAPSED": (status == "expired") & F.coalesce(effective_to >= as_of, F.lit(True)),
        "REVIEW_PASSED": status.isin("active", "uncertain") & (next_review < as_of),
        "UNVERIFIED_PROMOTED": (source_kind == "unverified") & (status != "uncertain"),
    }


def outside_box(country: Column, lat: Column, lng: Column,
                boxes: Mapping[str, tuple[float, float, float, float]] = P.BOUNDING_BOXES) -> Column:
    inside = F.lit(False)
    for code, (lat0, lat1, lng0, lng1) in boxes.items():
        inside = inside | ((country == code) & lat.between(lat0, lat1) & lng.between(lng0, lng1))
    return ~F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def postcode_outside_state(state: Column, postcode: Column,
                           ranges: Mapping[str, Sequence[tuple[int, int]]] = P.POSTCODE_RANGES) -> Column:
    """Four-digit code outside every range of its known state."""
    code = F.when(postcode.rlike(r"\A\d{4}\z"), postcode.cast("int"))
    inside = F.lit(False)
    for name, spans in ranges.items():
        for low, high in spans:
            inside = inside | ((state == name) & code.between(low, high))
    return state.isin(*ranges) & code.isNotNull() & ~inside


def not_matching(col: Column, pattern: str) -> Column:
    r"""Whole-value regular expression test (``\z``: a final newline is no match)."""
    return ~F.coalesce(col.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def unsafe_text(col: Column, max_length: int = 500) -> Column:
    ok = col.rlike(NOT_SPACE) & ~col.rlike(EDGE_SPACE) & (F.length(col) <= max_length) & ~col.rlike(r"[\x00-\x1f]")
    return ~F.coalesce(ok, F.lit(False))


def banned_phrase(cols: Sequence[Column], pattern: str = P.VACANCY_PATTERN) -> Column:
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(col.rlike(pattern), F.lit(False))
    return hit


def bad_enum_array(col: Column, values: Sequence[str], low: int = 1, high: int = 8) -> Column:
    ok = (
        F.size(col).between(low, high)
        & (F.size(F.array_distinct(col)) == F.size(col))
        & (F.size(F.array_except(col, F.array(*map(F.lit, values)))) == 0)
    )
    return ~F.coalesce(ok, F.lit(False))


def not_https(url: Column) -> Column:
    return ~urls.is_https(url)


def not_mailto(url: Column) -> Column:
    return ~urls.is_mailto(url)


def host_not_allowed(host: Column, key: Column, domains: Mapping[str, Sequence[str]],
                     common: Sequence[str] = ()) -> Column:
    """Host outside the domains of its key (country); true subdomains pass, look-alikes do not."""
    ok = urls.host_under(host, common) if common else F.lit(False)
    for name, allowed in domains.items():
        ok = ok | ((key == name) & urls.host_under(host, allowed))
    return ~ok


def source_host_conflict(kind: Column, country: Column, host: Column) -> Column:
    """Host does not fit the declared kind of evidence."""
    government = F.lit(False)
    for code, suffix in P.GOVERNMENT_SUFFIX.items():
        government = government | ((country == code) & urls.host_under(host, [suffix]))
    industry = urls.host_under(host, P.INDUSTRY_HOSTS)
    return F.coalesce(
        F.when(kind.isin("government-register", "government-job-gateway"), ~government)
        .when(kind == "industry-association", ~industry)
        .when(kind == "verified-local-producer", ~(industry | government))
        .when(kind == "employer-official", industry | government),
        F.lit(False),
    )


def other_registrable_host(url_a: Column, url_b: Column) -> Column:
    """Two addresses that do not share a registrable host (mail addresses use their domain)."""
    def site(url: Column) -> Column:
        mail = F.lower(F.regexp_extract(url, r"^mailto:[^@]*@(.+)\z", 1))
        return urls.registrable_host(F.when(mail != "", mail).otherwise(urls.host(url)))

    return site(url_a) != site(url_b)


def eligibility_conflict(country: Column, scheme: Column, classification: Column, role_check: Column,
                         location_check: Column) -> Column:
    """Eligibility differs from the one allowed tuple of its country, or from none/not-applicable."""
    given = F.struct(scheme.alias("a"), classification.alias("b"), role_check.alias("c"), location_check.alias("d"))

    def tuple_of(a, b, c, d):
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), d.alias("d"))

    ok = (scheme == "none") & given.eqNullSafe(tuple_of("none", "not-applicable", True, location_check))
    for code, (a, b, c, d) in P.ELIGIBILITY_BY_COUNTRY.items():
        ok = ok | ((scheme != "none") & (country == code) & given.eqNullSafe(tuple_of(a, b, c, F.lit(d))))
    return ~F.coalesce(ok, F.lit(False)) | role_check.isNull() | location_check.isNull()


def path_escapes(path: Column) -> Column:
    """Absolute, or climbs above its root once ``.`` and ``..`` segments are resolved."""
    step = F.transform(
        F.split(path, "/"),
        lambda s: F.when(s.isin("", "."), F.lit(0)).when(s == "..", F.lit(-1)).otherwise(F.lit(1)),
    )
    lowest = F.aggregate(
        step,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.least(acc["low"], acc["at"] + s).alias("low")),
        lambda acc: acc["low"],
    )
    return F.startswith(path, F.lit("/")) | (lowest < 0)


def page_contract_breaks(html: Column, language: Column, title: Column) -> Column:
    """Codes of broken page rules: doctype in the first 100, language in the first 300, exact title."""
    head = F.lower(F.substring(html, 1, 100))
    tag = F.concat(F.lit('<html lang="'), language, F.lit('">'))
    name = F.concat(F.lit("<title>"), title, F.lit("</title>"))
    return F.array_compact(
        F.array(
            F.when(~F.contains(head, F.lit("<!doctype html>")), F.lit("DOCTYPE")),
            F.when(~F.contains(F.substring(html, 1, 300), tag), F.lit("LANGUAGE")),
            F.when(~F.contains(html, name), F.lit("TITLE")),
        )
    )


def state_contract_breaks(streak: Column, first_seen: Column, last_seen: Column, recovered_at: Column,
                          last_status: Column, last_observation: Column, events: Column) -> Column:
    """Codes of broken trend-state rules. ``events`` is array<struct<observation_id,status,observed_at>>."""
    n = F.size(events)
    last = F.try_element_at(events, F.lit(-1))
    ids = F.transform(events, lambda e: e["observation_id"])
    times = F.transform(events, lambda e: e["observed_at"])
    recovered = (streak == 0) & (
        recovered_at.isNull() | (last_status == "transient") | ~recovered_at.eqNullSafe(last_seen)
    )
    checks = {
        "STREAK_RANGE": ~streak.between(0, 1_000_000),
        "SEEN_ORDER": first_seen > last_seen,
        "STATUS": not_in(last_status, P.REQUEST_STATUSES),
        "EVENT_COUNT": ~n.between(1, P.MAX_TREND_EVENTS),
        "EVENT_ORDER": ~times.eqNullSafe(F.array_sort(times)),
        "EVENT_UNIQUE": F.size(F.array_distinct(ids)) != n,
        "LAST_OBSERVATION": ~last["observation_id"].eqNullSafe(last_observation),
        "LAST_STATUS": ~last["status"].eqNullSafe(last_status),
        "LAST_TIME": ~last["observed_at"].eqNullSafe(last_seen),
        "ACTIVE_STATUS": (streak > 0) & (last_status != "transient"),
        "ACTIVE_RECOVERED": (streak > 0) & recovered_at.isNotNull(),
        "RECOVERY": recovered,
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()])
    )


def tokens_missing(normalized_text: Column, normalized_tokens: Sequence[str]) -> Column:
    """Some reviewed token does not occur in the normalised text."""
    present = F.lit(True)
    for token in normalized_tokens:
        present = present & F.contains(normalized_text, F.lit(token))
    return ~F.coalesce(present, F.lit(False))


def invalid_numeric_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\b(?:NaN|undefined|Infinity)\b"), F.lit(False))


def constants_inconsistent(rate: Column, base: Column, additional: Column, low: Column, high: Column) -> Column:
    """Rate is not base + additional within 1e-12, or the thresholds are not ordered."""
    return F.coalesce((F.abs(rate - base - additional) > 1e-12) | ~(low < high), F.lit(True))
