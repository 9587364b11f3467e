"""Fill-in-middle documents by one counted match per row.

``regexp_count`` gives the number n of units of a text. A row's own pattern, ``(unit{a}+)(unit{b-a}+)(rest)`` with
possessive counts, then captures prefix, middle and suffix in a single match; possessive groups are matched by a loop,
so texts of any length need no stack. The parts are laid out by form and parted by markers, which no split text holds,
so a document is rebuilt from its output and form alone. All of it is DataFrame expressions; nothing is shuffled.

Defined cases: a NULL or empty text is plain, has no unit and an empty output; a text that holds a marker is plain; a
NULL id is hashed as an empty one; rows with the same id and text get the same output; columns that clash with the new
ones are kept and the new ones get a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import fresh
from trustframe.session import load_table

#: A unit is a run of letters or any other single code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
_ATOMIC = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
NAMES = ("n", "form", "prefix", "middle", "suffix", "output")


def draws(identity: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(df: DataFrame, text: str = "text", identity: str = "doc_id", seed: int = 1) -> DataFrame:
    """``df`` with n, form (plain, psm or spm), prefix, middle, suffix (NULL if plain) and output, in this order last."""
    n, form, prefix, middle, suffix, output = fresh(df, *NAMES)
    whole, cut, low, high, parts = fresh(df.select("*", *[F.lit(0).alias(c) for c in (n, form, prefix, middle, suffix, output)]),
                                         "whole", "cut", "low", "high", "parts")
    h1, h2, h3, h4 = draws(F.col(identity), seed)
    out = df.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(n, F.regexp_count(whole, F.lit(UNIT)).cast("long"))
    plain = (F.col(whole) == "") | (h3 % 100 >= PLAIN_FROM)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(F.col(whole), F.lit(marker))
    out = out.withColumns({
        form: F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm"),
        low: F.least(h1 % (F.col(n) + 1), h2 % (F.col(n) + 1)), high: F.greatest(h1 % (F.col(n) + 1), h2 % (F.col(n) + 1)),
    })
    counted = lambda k: F.concat(F.lit(f"({_ATOMIC}{{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.col(low)), counted(F.col(high) - F.col(low)), F.lit(r"(.*+)\z"))
    # one match; a text with parts holds no marker, so it can part them
    out = out.withColumn(cut, F.when(F.col(form) != "plain", F.regexp_replace(F.col(whole), pattern, F.lit(f"$1{MIDDLE}$2{MIDDLE}$3"))))
    out = out.withColumn(parts, F.split(cut, MIDDLE, -1))
    out = out.withColumns({prefix: F.get(parts, F.lit(0)), middle: F.get(parts, F.lit(1)), suffix: F.get(parts, F.lit(2))})
    laid = F.when(F.col(form) == "plain", F.col(whole)).when(
        F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    out = out.withColumn(output, laid)
    return out.select(*[F.col(c) for c in df.columns], n, form, prefix, middle, suffix, output)


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form alone."""
    read = lambda first, second, order: F.regexp_replace(
        output, F.lit(rf"(?s)\A{first}(.*?){second}(.*?){MIDDLE}(.*+)\z"), F.lit(order))
    return F.when(form == "plain", output).when(form == "psm", read(PREFIX, SUFFIX, "$1$3$2")).otherwise(read(SUFFIX, PREFIX, "$2$3$1"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and laid out, with digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS whole, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), units AS (
  SELECT *, regexp_extract_all(whole, '[A-Za-z]+|[^A-Za-z]') AS u,
    CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM base
), formed AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
    CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), cut AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(whole) AS restored_sha256
FROM cut
"""
