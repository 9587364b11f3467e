"""Text normalisation, slugs and small label mappings."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe import policies as P

ASCII_ONLY = r"\A\p{ASCII}*+\z"


def _fold_series(form: str, fold: bool, strip_marks: bool):
    def apply(values: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            text = unicodedata.normalize(form, text)
            if strip_marks:
                text = "".join(ch for ch in text if not 0x300 <= ord(ch) <= 0x36F)
            return text.casefold() if fold else text

        return values.map(one)

    return apply


_NFKC = F.pandas_udf(_fold_series("NFKC", False, False), T.StringType())
_NFKC_FOLD = F.pandas_udf(_fold_series("NFKC", True, False), T.StringType())
_NFKD_STRIP = F.pandas_udf(_fold_series("NFKD", False, True), T.StringType())


def _non_ascii_through(udf, col: Column, ascii_value: Column) -> Column:
    # ASCII rows reach Python as NULL, so only text that needs Unicode tables is shipped.
    plain = col.rlike(ASCII_ONLY)
    return F.when(plain, ascii_value).otherwise(udf(F.when(~plain, col)))


def nfkc(col: Column) -> Column:
    return _non_ascii_through(_NFKC, col, col)


def nfkc_casefold(col: Column) -> Column:
    return _non_ascii_through(_NFKC_FOLD, col, F.lower(col))


def strip_marks(col: Column) -> Column:
    return _non_ascii_through(_NFKD_STRIP, col, col)


def collapse_ws(col: Column) -> Column:
    """Single spaces, no leading or trailing white space (Unicode spaces included)."""
    return F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", " "), r"^ | \z", "")


def norm_name(col: Column) -> Column:
    """Directory name key: folded, ``&`` spelled out, runs of non-word characters to one space."""
    spelled = F.replace(nfkc_casefold(col), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{N}_]+", " "))


def norm_key(col: Column) -> Column:
    """Evidence key: lower case ``[a-z0-9]`` only, ``&`` spelled out."""
    spelled = F.replace(F.lower(nfkc(col)), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(spelled, r"[^a-z0-9]+", "")


def norm_key_hangul(col: Column) -> Column:
    """Asset-audit key: as ``norm_key`` but Hangul syllables stay and ``&`` is dropped."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(col, F.lit("")))), r"[^a-z0-9가-힣]", "")


def slug(col: Column, length: int = 48) -> Column:
    spelled = F.replace(F.lower(strip_marks(col)), F.lit("&"), F.lit(" and "))
    kebab = F.regexp_replace(F.regexp_replace(spelled, r"[^a-z0-9]+", "-"), r"^-|-\z", "")
    cut = F.substring(kebab, 1, length)
    return F.when(cut == "", F.lit("entry")).otherwise(cut)


def contact_kind(url: Column) -> Column:
    return (
        F.when(url.isNull() | (url == ""), F.lit("none"))
        .when(F.startswith(url, F.lit("mailto:")), F.lit("email"))
        .when(url.rlike(P.RECRUITMENT_PATTERN), F.lit("recruitment"))
        .otherwise(F.lit("company"))
    )


def precision_of(country: Column, place: Column, register_source: Column | None = None) -> Column:
    """Town or region; rows of the register are never better than town."""
    place = F.coalesce(place, F.lit(""))
    nz = F.when(place.rlike(P.TOWN_OR_REGION_NZ), F.lit("region")).otherwise(F.lit("town"))
    if register_source is not None:
        nz = F.when(register_source, F.lit("town")).otherwise(nz)
    au = F.when(place.rlike(P.TOWN_OR_REGION_AU), F.lit("region")).otherwise(F.lit("town"))
    return F.when(country == "NZ", nz).otherwise(au)


def literal_map(values: Mapping[str, str]) -> Column:
    """Small fixed dictionary as a map literal; it is part of the plan, nothing is shipped per task."""
    items: list[Column] = []
    for key, value in values.items():
        items += [F.lit(key), F.lit(value)]
    return F.create_map(*items)


def map_label(col: Column, values: Mapping[str, str]) -> Column:
    """Dictionary lookup with identity fallback."""
    return F.coalesce(F.try_element_at(literal_map(values), col), col)


def work_type(label: Column) -> Column:
    return map_label(label, P.LEGACY_WORK_TYPES)
