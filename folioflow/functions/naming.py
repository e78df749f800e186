"""Names: folding text to ``[a-z0-9-]``, deriving a file name, splitting extensions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest stem in bytes, and the name of a document that has none.
MOST_STEM = 120
LAST_RESORT = "document"


@cache
def fold_table() -> tuple[str, str]:
    """Arguments of ``translate``: characters whose canonical decomposition is one ASCII letter
    or digit and marks, what they become, and then all marks, which go."""
    froms, tos, marks = [], [], []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
        elif code > 127 and unicodedata.decomposition(char) and not unicodedata.decomposition(char).startswith("<"):
            bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
            if len(bare) == 1 and bare.isascii() and bare.isalnum():
                froms.append(char)
                tos.append(bare)
    return "".join(froms + marks), "".join(tos)


def sanitised(x: Column) -> Column:
    """Accents folded, lower case, all else to single hyphens, none at the ends, at most 120
    bytes. Empty for null and for what has no ASCII letter or digit."""
    froms, tos = fold_table()
    plain = F.translate(F.coalesce(x, F.lit("")), froms, tos)
    joined = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), r"\A-|-\z", "")
    return F.regexp_replace(F.substring(joined, 1, MOST_STEM), r"-\z", "")


def sanitised_model(x: str | None) -> str:
    """The same in Python, for tests."""
    folded = "".join(c for c in unicodedata.normalize("NFD", x or "") if unicodedata.category(c) != "Mn")
    out = "".join(c if c.isascii() and (c.islower() or c.isdigit()) else "-" for c in unicodedata.normalize("NFC", folded).lower())
    out = "-".join(p for p in out.split("-") if p)
    return out[:MOST_STEM].rstrip("-")


def stem_of(own: Column, original: Column) -> Column:
    """A proposal's sanitised form, or the original's if that is empty."""
    return F.when(own != "", own).otherwise(sanitised(original))


def named(stem: Column, ext: Column, date_prefix: Column) -> Column:
    """A stem after the date, which is not put twice; the extension as it is."""
    prefix = F.coalesce(date_prefix, F.lit(""))
    base = (
        F.when((prefix == "") & (stem == ""), F.lit(LAST_RESORT))
        .when(prefix == "", stem)
        .when(stem == "", prefix)
        .when(stem.startswith(prefix), stem)
        .otherwise(F.concat(prefix, F.lit("-"), stem))
    )
    return F.concat(base, F.coalesce(ext, F.lit("")))


def with_name(rows: DataFrame, proposal: Column, original: Column, ext: Column, date_prefix: Column, name: str = "name") -> DataFrame:
    """Add the struct ``name`` (base, from_proposal). Own and stem are columns on the way, so
    that sanitising is done once a row however often they are used."""
    rows = rows.withColumn("_own", sanitised(proposal))
    rows = rows.withColumn("_stem", stem_of(F.col("_own"), original))
    whole = F.struct(named(F.col("_stem"), ext, date_prefix).alias("base"), (F.col("_own") != "").alias("from_proposal"))
    return rows.withColumn(name, whole).drop("_own", "_stem")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows it; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*\z", "")
