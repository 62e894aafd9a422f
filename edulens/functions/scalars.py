"""Column functions: normalisation, identity, rounding, dates, maps, JSON."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DASHES = "‐‑‒–—−"
# Aliases of exam subjects.
SUBJECT_ALIASES = {
    "математика профиль": "математика",
    "профильная математика": "математика",
    "математика профильная": "математика",
    "информатика и икт": "информатика",
    "икт": "информатика",
}


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalize_name(col: Column, unicode_fold: bool = False) -> Column:
    """Spaces collapsed, lower case. ``unicode_fold`` adds NFKC and case
    folding, for which Spark has no function (one Arrow UDF)."""
    flat = F.translate(col, " ", " ")
    flat = _folded(flat) if unicode_fold else F.lower(flat)
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def classification_name(col: Column, unicode_fold: bool = False) -> Column:
    return F.translate(normalize_name(col, unicode_fold), "ё" + DASHES, "е" + "-" * len(DASHES))


def discipline_id(col: Column) -> Column:
    return F.concat(F.lit("discipline:"), F.substring(F.sha2(col, 256), 1, 16))


def subject_key(col: Column, unicode_fold: bool = False) -> Column:
    """Canonical exam subject: words only, aliases resolved."""
    words = F.regexp_replace(F.translate(normalize_name(col, unicode_fold), "ё", "е"), r"[^\p{L}\p{N}_]+", " ")
    plain = F.trim(words)
    aliases = F.create_map(*[F.lit(x) for pair in SUBJECT_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, plain), plain)


def query_tokens(col: Column) -> Column:
    """Distinct words of a query, cut at spaces and at ``: . -``."""
    return F.array_distinct(F.filter(F.split(normalize_name(col), r"[\s:.\-]+"), lambda x: x != ""))


def university_of(col: Column) -> Column:
    """``university:x`` of a ``direction:x:…`` or ``program:x:…`` id."""
    parts = F.split(col, ":")
    return F.when(F.size(parts) >= 3, F.concat(F.lit("university:"), F.get(parts, F.lit(1))))


def scoped_program_id(col: Column, university: Column) -> Column:
    """A ``program:code`` id gets its university; scoped ones stay."""
    parts = F.split(col, ":")
    return F.when(
        F.size(parts) == 2,
        F.concat_ws(":", F.get(parts, F.lit(0)), university, F.get(parts, F.lit(1)))
    ).otherwise(col)


def code_from_id(col: Column) -> Column:
    return F.regexp_replace(col, r"^.*:", "")


def settled(col: Column, places: int) -> Column:
    """Rounded so that the order of a sum cannot turn a tie: to 9 places first,
    and ties go up however they are represented."""
    return F.round(F.round(col, 9) + 1e-11, places)


def shares_with_residual(df: DataFrame, keys: list[str], value: str, item: str, out: str = "share") -> DataFrame:
    """Positive values over their sum; what rounding to 4 places leaves goes to
    the last item in string order, so that the shares of a key sum to 1."""
    own = Window.partitionBy(*keys)
    rank = Window.partitionBy(*keys).orderBy(F.col(item).cast("string").desc())
    raw = settled(F.col(value) / F.sum(value).over(own), 4)
    df = df.where(F.col(value) > 0).withColumn("_raw", raw).withColumn("_last", F.row_number().over(rank))
    rest = 1 - F.sum("_raw").over(own)
    share = F.round(F.col("_raw") + F.when(F.col("_last") == 1, rest).otherwise(0), 4)
    return df.withColumn(out, share).drop("_raw", "_last")


def quantize(col: Column, places: int, half_even: bool = False) -> Column:
    exact = col.cast("decimal(30,12)")
    return F.bround(exact, places) if half_even else F.round(exact, places)


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def normalize_currency(col: Column) -> Column:
    code = F.upper(F.trim(col))
    return F.when(code.isin("RUB", "RUR", "₽", "РУБ", "РУБ."), "RUB").otherwise(code)


def normalize_form(col: Column) -> Column:
    x = normalize_name(col)
    return (
        F.when(x.rlike("очно-заочн|part.?time|evening"), "part_time")
        .when(x.rlike("заочн|distance|extramural"), "extramural")
        .when(x.rlike("очн|full.?time"), "full_time")
    )


def normalize_funding(col: Column) -> Column:
    x = normalize_name(col)
    return F.when(x.rlike("бюджет|budget"), "budget").when(x.rlike("плат|договор|paid|contract"), "paid")


def normalize_location(col: Column) -> Column:
    return F.regexp_replace(F.translate(normalize_name(col), "ё", "е"), r"^(г\.?|город)\s+", "")


def assessment_types(col: Column) -> Column:
    """Assessment kinds named in a mark; a graded credit is not a plain one."""
    x = normalize_name(col)
    graded = x.rlike("дифф|зачет с оценкой|graded")
    return F.array_compact(
        F.array(
            F.when(x.rlike("экзамен|exam"), "exam"),
            F.when(graded, "graded_credit"),
            F.when(x.rlike("зачет|зачёт|credit") & ~graded, "credit"),
        )
    )


def decimal_comma(col: Column, kind: str = "decimal(6,2)") -> Column:
    return F.regexp_replace(F.trim(col), ",", ".").try_cast(kind)


def policy_stage(col: Column) -> Column:
    """Stage a sentence claims for a rule; the first rule that fits wins."""
    x = F.lower(col)
    return (
        F.when(x.rlike(r"предполага|возможно|hypothes|might|may be"), "hypothesis")
        .when(x.rlike(r"проект|предлага|propos|draft"), "proposal")
        .when(x.rlike(r"утвержд|принят|adopted|approved"), "adopted")
        .when(x.rlike(r"опубликован|published"), "published")
        .otherwise("unknown")
    )


def digest_of(*cols: str, prefix: str = "") -> Column:
    """sha256 of the named columns as JSON in name order; nulls are left out."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*sorted(cols))), 256))


def in_window(at: Column, start: Column, end: Column) -> Column:
    return at.between(start, end)


def in_interval(at: Column, start: Column, end: Column) -> Column:
    """Half-open and open where a bound is null."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def validity(result_year: Column, year: Column, low: Column, high: Column, max_age: Column) -> Column:
    """True, false, or null where the year of the result is unknown."""
    return (
        F.when(result_year.isNull(), F.lit(None).cast("boolean"))
        .when(low.isNotNull() & (result_year < low), False)
        .when(high.isNotNull() & (result_year > high), False)
        .when(max_age.isNotNull() & (year - result_year > max_age), False)
        .otherwise(True)
    )


def json_field(col: Column, path: str, kind: str) -> Column:
    """A field of a JSON text, null where it is absent or of another type."""
    raw = F.get_json_object(col, path)
    return raw if kind == "string" else raw.try_cast(kind)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the keys of ``a``; keys missing in ``b`` count 0."""
    return F.aggregate(
        F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0))
    )


def holdout(col: Column, parts: int, seed: int = 17) -> Column:
    """One part in ``parts``, by a hash that other systems have too."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), col.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts == 0


def bounded_union(limit: int, *arrays: Column) -> Column:
    """Distinct values in order of first appearance, ``limit`` at most."""
    return F.slice(F.array_distinct(F.flatten(F.array(*arrays))), 1, limit)
