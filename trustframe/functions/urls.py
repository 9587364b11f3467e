"""URL parts, canonical forms and host suffixes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe import policies as P

# scheme, authority, path, ?query, #fragment
URL_SHAPE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#[\s\S]*)?\z"


def _idna(values: pd.Series) -> pd.Series:
    def one(host):
        if host is None:
            return None
        try:
            return host.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return values.map(one)


_IDNA = F.pandas_udf(_idna, T.StringType())


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_SHAPE, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL_SHAPE, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_SHAPE, 3)


def query(url: Column) -> Column:
    """Query including its ``?``; empty when absent."""
    return F.regexp_extract(url, URL_SHAPE, 4)


def fragment(url: Column) -> Column:
    """Fragment including its ``#``; empty when absent."""
    return F.regexp_extract(url, URL_SHAPE, 5)


def raw_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)


def host(url: Column) -> Column:
    return F.lower(raw_host(url))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":(\d+)\z", 1)


def has_userinfo(url: Column) -> Column:
    return F.contains(authority(url), F.lit("@"))


def idna_host(url: Column) -> Column:
    """Host in ASCII; only non-ASCII hosts pass through Python."""
    h = host(url)
    plain = h.rlike(r"\A\p{ASCII}*+\z")
    return F.rtrim(F.when(plain, h).otherwise(_IDNA(F.when(~plain, h))), F.lit("."))


def is_https(url: Column, max_length: int = 2048) -> Column:
    """Bounded https URL without userinfo or fragment and with a lower-case host."""
    ok = (
        (F.length(url) <= max_length)
        & (scheme(url) == "https")
        & (raw_host(url) != "")
        & (raw_host(url) == host(url))
        & ~has_userinfo(url)
        & (F.length(fragment(url)) <= 1)
    )
    return F.coalesce(ok, F.lit(False))


def is_web_url(url: Column) -> Column:
    """Absolute http or https URL without embedded credentials."""
    ok = scheme(url).isin("http", "https") & (raw_host(url) != "") & ~has_userinfo(url)
    return F.coalesce(ok, F.lit(False))


def is_mailto(url: Column) -> Column:
    ok = (
        (F.length(url) <= 320)
        & url.rlike(r"\A(?:" + P.MAILTO_PATTERN + r")\z")
        & ~F.contains(url, F.lit(".."))
    )
    return F.coalesce(ok, F.lit(False))


def canonical_contact(kind: Column, url: Column) -> Column:
    """Key for comparing contacts: mail folded, web as https + host + path + query."""
    trimmed = F.rtrim(path(url), F.lit("/"))
    web = F.concat(
        F.lit("https://"), host(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed),
        F.when(F.length(query(url)) > 1, query(url)).otherwise(F.lit("")),
    )
    return (
        F.when((kind == "none") | url.isNull(), F.lit(""))
        .when(F.startswith(url, F.lit("mailto:")), F.lower(url))
        .otherwise(web)
    )


def registrable_host(host_col: Column, suffixes: Sequence[str] = P.PUBLIC_SUFFIXES) -> Column:
    """Label below the public suffix; two labels when no listed suffix fits."""
    out = None
    for suffix in suffixes:
        escaped = suffix.replace(".", r"\.")
        hit = F.when(host_col == suffix, host_col).when(
            F.endswith(host_col, F.lit("." + suffix)),
            F.regexp_extract(host_col, rf"([^.]+\.{escaped})\z", 1),
        )
        out = hit if out is None else F.coalesce(out, hit)
    last_two = F.regexp_extract(host_col, r"([^.]*\.[^.]*)\z", 1)
    fallback = F.when(last_two == "", host_col).otherwise(last_two)
    return fallback if out is None else F.coalesce(out, fallback)


def host_suffixes(host_col: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: turns a suffix test into an equi join."""
    labels = F.split(F.rtrim(F.lower(host_col), F.lit(".")), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def host_under(host_col: Column, domains: Sequence[str]) -> Column:
    """Host equals, or is a true subdomain of, one of a few fixed domains."""
    h = F.rtrim(F.lower(host_col), F.lit("."))
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (h == domain) | F.endswith(h, F.lit("." + domain))
    return F.coalesce(hit, F.lit(False))


def normalize_source_url(url: Column) -> Column:
    """Lower scheme and host, drop the default port, keep path, query and fragment; NULL if not web."""
    p = port(url)
    s = scheme(url)
    keep_port = (p != "") & ~((s == "http") & (p == "80")) & ~((s == "https") & (p == "443"))
    built = F.concat(
        s, F.lit("://"), idna_host(url),
        F.when(keep_port, F.concat(F.lit(":"), p)).otherwise(F.lit("")),
        path(url),
        F.when(F.length(query(url)) > 1, query(url)).otherwise(F.lit("")),
        F.when(F.length(fragment(url)) > 1, fragment(url)).otherwise(F.lit("")),
    )
    return F.when(is_web_url(url), built)


def request_key(url: Column, method: Column, body: Column) -> Column:
    """Public key of a request: digest of url, method and canonical body."""
    sent = F.when(method == "POST", F.coalesce(body, F.lit(""))).otherwise(F.lit(""))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\0", url, method, sent), 256))
