"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(text, 256)


def nonempty(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def extension(name: Column) -> Column:
    """Last suffix in lower case with its dot, or an empty string."""
    return F.regexp_extract(F.lower(name), r"(\.[^./]+)$", 1)


def truncated(text: Column, most: int = 500) -> Column:
    """At most so many characters; null for none."""
    return nonempty(F.substring(text, 1, most))


def slug(name: Column, key: Column) -> Column:
    """Lower case, blanks to dashes, 50 characters, and eight characters of the key's digest."""
    return F.concat(F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("-")), 1, 50), F.lit("-"), F.substring(F.md5(key.cast("string")), 1, 8))


def label(name: Column, key: Column) -> Column:
    """A file-safe label, or one made of the key."""
    given = F.coalesce(nonempty(F.trim(name)), F.concat(F.lit("Person_"), F.substring(key.cast("string"), 1, 8)))
    return F.coalesce(nonempty(F.substring(F.trim(F.regexp_replace(given, r"[^A-Za-z0-9\-_ ]", "_")), 1, 80)), F.lit("Person"))
