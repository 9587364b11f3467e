"""Classifiers: latency, responses, challenge pages, text categories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustframe import policies as P


def latency_bucket(milliseconds: Column) -> Column:
    ms = F.greatest(milliseconds, F.lit(0))
    return (
        F.when(ms < 250, F.lit("lt250ms"))
        .when(ms < 1000, F.lit("250ms-999ms"))
        .when(ms < 5000, F.lit("1s-4.999s"))
        .when(ms < 15000, F.lit("5s-14.999s"))
        .when(ms.isNotNull(), F.lit("15s-plus"))
    )


def media_type(raw: Column) -> Column:
    return F.lower(F.trim(F.split_part(raw, F.lit(";"), F.lit(1))))


def media_allowed(mode: Column, raw_media: Column) -> Column:
    """Whether a media type fits the extractor family named by ``mode``."""
    media = media_type(raw_media)
    html = (
        F.startswith(mode, F.lit("html-")) | F.startswith(mode, F.lit("ato-"))
        | mode.isin("cra-t4127-version", "cra-t4127-bc-annual-rate", "cra-t4032-on")
    )
    ok = (
        F.when(html, media.isin(*P.HTML_MEDIA))
        .when(mode == "cra-t4127-csv", media.isin(*P.CSV_MEDIA))
        .when(mode == "iec-quota-xml", media.isin(*P.XML_MEDIA))
        .when(mode == "pdf-table", media.isin(*P.PDF_MEDIA))
        .otherwise(media.isin(*P.JSON_MEDIA) | F.endswith(media, F.lit("+json")))
    )
    return F.coalesce(ok, F.lit(False))


def challenge_page(raw_media: Column, body: Column) -> Column:
    """Login form or bot challenge anywhere in the whole body."""
    text = F.lower(body)
    password = F.contains(text, F.lit('type="password"')) | F.contains(text, F.lit("type='password'"))
    sign_in = F.contains(text, F.lit("sign in")) | F.contains(text, F.lit("log in")) | F.contains(text, F.lit("login"))
    hit = (
        F.contains(text, F.lit("verify you are human"))
        | F.contains(text, F.lit("cf-chl-"))
        | text.rlike(r"<title[^>]*>\s*just a moment(?:\.\.\.)?\s*</title>")
        | (F.contains(text, F.lit("<form")) & password & sign_in)
    )
    return F.coalesce(media_type(raw_media).isin(*P.HTML_MEDIA) & hit, F.lit(False))


def link_challenge(body: Column) -> Column:
    text = F.lower(body)
    return F.coalesce(
        F.contains(text, F.lit("verify you are human"))
        | (F.contains(text, F.lit("<input")) & F.contains(text, F.lit('type="password"'))),
        F.lit(False),
    )


def _blank(body: Column) -> Column:
    return F.coalesce(~body.rlike(r"\S"), F.lit(True))


def response_class(
    profile: str,
    *,
    error: Column,
    host_ok: Column,
    status: Column,
    body: Column,
    media: Column,
    too_large: Column,
    mode: Column | None = None,
    fingerprint_ok: Column | None = None,
    extracted: Column | None = None,
    value_ok: Column | None = None,
) -> Column:
    """Outcome of one response. The three profiles differ in precedence on purpose.

    ``request``: is the response usable; ``result``: does it still carry the reviewed value;
    ``link``: does a directory link still resolve within its own site.
    """
    code = F.coalesce(status, F.lit(0))
    busy = (code == 429) | code.between(500, 599)
    denied = code.isin(401, 403)
    not_ok = (code < 200) | (code >= 300)
    blocked_body = challenge_page(media, body)
    if profile == "request":
        return (
            F.when(error.isNotNull(), F.lit("transient"))
            .when(~host_ok, F.lit("unsupported"))
            .when(busy, F.lit("transient"))
            .when(denied, F.lit("blocked"))
            .when(not_ok | _blank(body), F.lit("changed"))
            .when(blocked_body, F.lit("blocked"))
            .when(too_large, F.lit("unsupported"))
            .otherwise(F.lit("ready"))
        )
    if profile == "result":
        out = (
            F.when(error.isNotNull(), F.lit("transient"))
            .when(~host_ok, F.lit("unsupported"))
            .when(denied | blocked_body, F.lit("blocked"))
            .when(busy, F.lit("transient"))
            .when(too_large, F.lit("unsupported"))
            .when(not_ok | _blank(body), F.lit("changed"))
        )
        if mode is not None:
            out = out.when(~media_allowed(mode, media), F.lit("unsupported"))
        for check in (fingerprint_ok, extracted, value_ok):
            if check is not None:
                out = out.when(~F.coalesce(check, F.lit(False)), F.lit("changed"))
        return out.otherwise(F.lit("match"))
    if profile == "link":
        return (
            F.when(error.isNotNull(), F.lit("transient"))
            .when(denied, F.lit("blocked"))
            .when((code == 429) | (code >= 500), F.lit("transient"))
            .when(not_ok, F.lit("changed"))
            .when(~host_ok, F.lit("unsupported"))  # only an answer that succeeded is held to its site
            .when(_blank(body), F.lit("changed"))
            .when(link_challenge(body), F.lit("blocked"))
            .otherwise(F.lit("match"))
        )
    raise ValueError(f"unknown response profile {profile!r}")


def _has_any(lowered: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(lowered, F.lit(word)) for word in words])


def _wording(text: Column, lowered: Column) -> dict[str, Column]:
    """Whether a text has the wording of a category: ``CATEGORY_PATTERNS``, by words, which are found in less time than by a pattern."""
    has = {name: _has_any(lowered, words) for name, words in P.CATEGORY_WORDS.items()}
    for name, (words, pattern) in P.CATEGORY_FORMS.items():
        has[name] = has[name] | (_has_any(lowered, words) & text.rlike(pattern))
    return has


def _lowered(text: Column, work: Callable[[Column], Column]) -> Column:
    """What ``work`` makes of the text in lower case, which is made once."""
    return F.transform(F.array(F.lower(text)), work)[0]


def text_categories(text: Column) -> Column:
    """Categories whose wording occurs in the text, in fixed order."""
    def found(lowered: Column) -> Column:
        has = _wording(text, lowered)
        timed = text.rlike(P.TIME_UNIT) & text.rlike(P.IMMIGRATION_WORDS)
        has["duration"] = has["duration"] & ~has["processing"] & timed
        return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in has.items()]))

    return _lowered(text, found)


def id_categories(claim_id: Column) -> Column:
    lowered = F.lower(claim_id)
    return F.array_compact(
        F.array(*[F.when(lowered.rlike(p), F.lit(name)) for name, p in P.CATEGORY_BY_ID.items()])
    )


def _of_category(category: Column, rules: dict[str, Column]) -> Column:
    """The rule of one category; the others are not evaluated."""
    cases = F
    for name, rule in rules.items():
        cases = cases.when(category == name, rule)
    return cases.otherwise(F.lit(False))


def clause_categories(clause: Column, categories: Column) -> Column:
    """Those of ``categories`` that a clause gives its numbers: its own wording, or a price next to a visa word (fee)."""
    def found(lowered: Column) -> Column:
        has = _wording(clause, lowered)
        has["fee"] = has["fee"] | (_has_any(lowered, P.CURRENCY_WORDS) & clause.rlike(P.IMMIGRATION_WORDS))
        return F.filter(categories, lambda c: _of_category(c, has))

    return _lowered(clause, found)


def countable(value: Column, in_date: Column) -> Column:
    """Numbers that can be facts at all: no dates or years, no visa subclass, fewer than eight digits."""
    whole = value == F.floor(value)
    special = whole & (value.between(2000, 2099) | value.isin(*map(float, P.VISA_IDENTIFIERS)))
    return F.coalesce(~in_date & ~special & (value < 10_000_000), F.lit(False))


def fits_category(category: Column, value: Column, left: Column, right: Column) -> Column:
    """Whether a number passes the unit and size rules of a category in its neighbourhood (8 left, 12 right)."""
    near = F.concat_ws("#", left, right)
    points = right.rlike(r"(?i)\A\s*(?:점|points?\b)")
    age = (value <= 100) & near.rlike(r"(?i)(?:세|歳|years?\s*old|age|연령|나이)") & ~points
    timed = near.rlike(P.TIME_UNIT)
    span = right.rlike(r"(?i)\A\s*(?:h(?:ours?)?\b|시간|개월|か月|ヶ月|년|年|주|週|일|日)") & ~right.rlike(
        r"(?i)\A\s*/\s*h\b"
    )
    large = value >= 100
    rules = {
        "fee": F.lit(True), "age": age, "quota": large, "wage": ~span & ~points, "tax": F.lit(True),
        "funds": large, "processing": timed | F.contains(near, F.lit("%")), "duration": timed,
    }
    return _of_category(category, rules)


def evidence_level(source_class: Column) -> Column:
    """machine-extracted, hybrid, reviewed-snapshot or limited-candidate."""
    return (
        F.when(source_class.isin("register", "industry-list"), F.lit("machine-extracted"))
        .when(source_class == "membership", F.lit("hybrid"))
        .when(source_class == "unverified", F.lit("limited-candidate"))
        .otherwise(F.lit("reviewed-snapshot"))
    )


def evidence_scopes(source_class: Column, contact: Column) -> Column:
    with_contact = F.array(F.lit("contact"), F.lit("entity"), F.lit("location"))
    without = F.array(F.lit("entity"), F.lit("location"))
    return (
        F.when(source_class == "register", F.array(F.lit("entity"), F.lit("expiry"), F.lit("location")))
        .when(contact == "none", without)
        .otherwise(with_contact)
    )


def location_scope(source_class: Column, precision: Column) -> Column:
    return (
        F.when(source_class == "register", F.lit("registered-address"))
        .when(source_class == "industry-list", F.lit("listed-operating-area"))
        .when(precision == "region", F.lit("reviewed-service-area"))
        .otherwise(F.lit("reviewed-worksite"))
    )


def limitations(country: Column, source_class: Column) -> Column:
    snapshot = ~source_class.isin("register", "industry-list", "membership")
    return F.array_compact(
        F.array(
            F.lit("directory-not-current-vacancy"),
            F.when(country == "NZ", F.lit("role-eligibility-unverified")).otherwise(
                F.lit("role-and-postcode-eligibility-unverified")
            ),
            F.when(source_class == "register", F.lit("registered-address-not-worksite")),
            F.when(source_class == "membership", F.lit("membership-does-not-prove-worksite")),
            F.when(source_class == "membership", F.lit("location-reviewed-snapshot-not-live-extracted")),
            F.when(snapshot, F.lit("reviewed-snapshot-not-live-extracted")),
            F.when(source_class == "unverified", F.lit("official-status-unverified")),
            F.when(source_class == "government-job-gateway", F.lit("gateway-not-employer")),
        )
    )
