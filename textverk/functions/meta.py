"""Columns read from file names and labels (null in, null out, unless stated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_year(name: Column) -> Column:
    """The first free-standing year 2000-2029 in a file name, else null."""
    return F.nullif(F.regexp_extract(name, r"(?U)\b(20[0-2][0-9])\b", 1), F.lit("")).try_cast("int")


_RSA = r"(?iU)^RSA\s+(.+?)\s+(?:19|20)\d{2}(?:\s+(?:Maskad|Maskerad))?\s*\.pdf$"
_OTHER = r"(?iU)^\w+\s+(.+?)\s+(?:19|20)\d{2}(?:\s+Maskad)?\s*\.pdf$"


def extract_entity(name: Column) -> Column:
    """The entity of a file name of either form, else 'unknown'."""
    got = [F.nullif(F.trim(F.regexp_extract(name, p, 1)), F.lit("")) for p in (_RSA, _OTHER)]
    return F.coalesce(*got, F.lit("unknown"))


def parse_filename(name: Column) -> Column:
    """struct(municipality, year, maskad); the strict form first, then what can be found."""
    strict = r"(?iU)^RSA\s+(.+?)\s+((?:19|20)\d{2})(\s+Maskad)?\s*\.pdf$"
    ok = name.rlike(strict)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    base = F.regexp_replace(F.regexp_replace(stem, r"(?U)^RSA\s*", ""), r"(?U)\s*[Mm]askad\s*$", "")
    year = F.nullif(F.regexp_extract(base, r"(?U)\b((?:19|20)\d{2})\b", 1), F.lit(""))
    rest = F.nullif(F.trim(F.regexp_replace(base, r"(?U)\b(?:19|20)\d{2}\b", "")), F.lit(""))
    return F.struct(
        F.when(ok, F.trim(F.regexp_extract(name, strict, 1))).otherwise(F.coalesce(rest, F.lit("unknown"))).alias("municipality"),
        F.when(ok, F.regexp_extract(name, strict, 2)).otherwise(F.coalesce(year, F.lit("unknown"))).alias("year"),
        F.when(ok, F.regexp_extract(name, strict, 3) != "").otherwise(F.lower(stem).contains("maskad")).alias("maskad"),
    )


def wave_of(year: Column) -> Column:
    """Survey wave of a year. A null year has no wave (a missing year is never the last wave)."""
    return F.when(year.isNull(), None).when(year < 2015, 0).when(year <= 2018, 1).when(year <= 2022, 2).otherwise(3)


def normalise_actor(actor: Column) -> Column:
    x = F.lower(F.trim(actor))
    return (
        F.when(x.isNull() | (x == ""), "unknown")
        .when(x.isin("kommun", "kommuner"), "kommun")
        .when(x.isin("länsstyrelse", "länsstyrelsen", "länsstyrelser", "lansstyrelse"), "lansstyrelse")
        .when(x.isin("mcf", "msb", "myndighet"), "MCF")
        .otherwise(x)
    )


def translate(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value) if pairs else value


def period_of(year: Column, periods: tuple[tuple[int, int], ...] = ((2011, 2015), (2016, 2019), (2020, 2024))) -> Column:
    """'lo-hi' of the closed period that holds the year, else null."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(periods):
        out = F.when(year.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out
