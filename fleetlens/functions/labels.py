"""Text expressions: display labels and normalised names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_label(*columns: str, separator: str = " ") -> Column:
    """Parts joined with a separator; a NULL part counts as empty text."""
    parts: list[Column] = []
    for name in columns:
        if parts:
            parts.append(F.lit(separator))
        parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts)


def short_label(column: str | Column, length: int = 15) -> Column:
    """First characters and an ellipsis, also for names that are already short."""
    text = F.col(column) if isinstance(column, str) else column
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def host_name(column: str | Column, domain: str, length: int = 15) -> Column:
    """A host name as stored: cut to the name limit, with the domain added."""
    text = F.col(column) if isinstance(column, str) else column
    return F.concat(F.substring(text, 1, length), F.lit(domain))


def user_name(column: str | Column, prefix: str) -> Column:
    """A user name as stored: with the prefix, unless it is already part of the name."""
    text = F.col(column) if isinstance(column, str) else column
    return F.when(F.contains(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def host_part(column: str | Column) -> Column:
    """The host in front of the first dot of a system id."""
    text = F.col(column) if isinstance(column, str) else column
    return F.split_part(text, F.lit("."), F.lit(1))


def city_label(remark: str, country: str) -> Column:
    """``part-CITY-...`` and a country as ``CITY,country``; NULL without a second part."""
    city = F.get(F.split(F.col(remark), "-"), F.lit(1))
    return F.concat(city, F.lit(","), F.col(country))


def file_key(name: str) -> str:
    """A sensor name as part of a file name."""
    return name.replace(" ", "_")


def is_pair(name: str) -> bool:
    """Names of two sensors that fire together are written ``A:B``."""
    return ":" in name
