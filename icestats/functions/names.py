"""Person-name expressions: search, accents, locales, canonical form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Latin letters with a mark or stroke and the letter in their Unicode name."""
    named = re.compile(r"LATIN SMALL LETTER (?:DOTLESS )?([A-Z])(?: WITH .*)?$")
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        m = named.match(unicodedata.name(chr(code), ""))
        if m:
            found[chr(code)] = m[1].lower()
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _plain_letters()


def name_contains(name: Column, term: str) -> Column:
    """Case-insensitive substring test; a null name is false."""
    return F.coalesce(F.contains(F.lower(name), F.lit(term.lower())), F.lit(False))


def strip_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def same_name(a: Column, b: Column) -> Column:
    """Equal apart from case and accents."""
    return strip_accents(a) == strip_accents(b)


def first_filled(*names: Column) -> Column:
    """First name in the given order that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def display_name(default: Column, locales: Mapping[str, Column], lang: str = "EN") -> Column:
    """Localised name; French first where the language is French."""
    rest = [c for k, c in locales.items() if k != "fr"]
    french = [locales["fr"]] if "fr" in locales else []
    return first_filled(*(french + [default] + rest if lang == "FR" else rest + french + [default]))


def repair_names(
    rows: DataFrame, reference: DataFrame, *, key: str, name: str, overrides: Mapping[int, str] | None = None
) -> DataFrame:
    """Take the accented spelling of a reference list where the accent-free forms agree.

    `reference` is (key, ref_name, priority); per key the highest priority wins.
    """
    best = reference.groupBy(key).agg(F.max_by("ref_name", F.struct("priority", "ref_name")).alias("_ref"))
    out = rows.join(best, key, "left").withColumn(
        name, F.when(same_name(F.col(name), F.col("_ref")), F.col("_ref")).otherwise(F.col(name))
    )
    if overrides:
        pairs = [x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))]
        out = out.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.col(name)))
    return out.drop("_ref")


def drop_columns_like(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose name matches the pattern."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c) and c not in keep])
