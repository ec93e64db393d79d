"""Text helpers: suffixes, file names, short digests, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_suffix(text: Column, suffix: str) -> Column:
    """Without one suffix, if it is there."""
    return F.when(F.lit(suffix != "") & text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def url_file_name(url: Column) -> Column:
    """What follows the last slash of the path; query and fragment do not count."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/", -1)


def append_to_file_name(name: Column, suffix: str) -> Column:
    """suffix before the extension."""
    return F.concat(F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.lit(suffix), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2))


def short_md5(text: Column) -> Column:
    """The first eight upper-case hexadecimal digits of the MD5."""
    return F.upper(F.substring(F.md5(text), 1, 8))


def fixed(v: Column, decimals: int = 3) -> Column:
    return F.format_string(f"%.{decimals}f", v)
