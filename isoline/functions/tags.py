"""Tag predicates over array<struct<key,value>>: tags are ordered and keys may repeat, so they are no map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_tags(**pairs: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()))


def has_tag(tags: str, key: str) -> Column:
    return F.exists(tags, lambda t: t["key"] == key)


def tag(tags: str, key: str) -> Column:
    """The first value of the key, or null."""
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]


def tag_eq(tags: str, key: str, value: str) -> Column:
    return F.coalesce(tag(tags, key) == value, F.lit(False))


def tag_ne(tags: str, key: str, value: str) -> Column:
    """True also where the tag is missing."""
    return ~tag(tags, key).eqNullSafe(value)


def tag_in(tags: str, key: str, values: list[str]) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def any_tag(tags: str, *wanted: tuple[str, str | None]) -> Column:
    """Any of the (key, value) pairs; a value of None accepts every value of its key."""
    def one(t):
        out = F.lit(False)
        for k, v in wanted:
            out = out | ((t["key"] == k) if v is None else ((t["key"] == k) & (t["value"] == v)))
        return out

    return F.exists(tags, one)


def overpass_ql(kind: str, filters: list[list[tuple]], bbox: tuple | None = None, take: int | None = None, timeout: int | None = None) -> str:
    """Query text: kind is node, way or nwr; filters are alternatives of conditions (key,), (key, value) or (key, value, '!='); bbox is xmin, xmax, ymin, ymax."""
    def one(c):
        return f'["{c[0]}"]' if len(c) == 1 else f'["{c[0]}"{c[2] if len(c) > 2 else "="}"{c[1]}"]'

    sets = ["".join(map(one, f)) for f in filters]
    box = "" if bbox is None else "({:g},{:g},{:g},{:g})".format(bbox[2], bbox[0], bbox[3], bbox[1])
    body = f"{kind}{sets[0] if sets else ''}{box};" if len(sets) < 2 else f"{kind}(\n" + "".join(f"  {s}{box};\n" for s in sets) + "  );"
    return f"[out:xml]{f'[timeout:{timeout}]' if timeout else ''};\n{body}\nout body{f' {take}' if take else ''};"


def contains_pair(tags: str, key: str, value: str) -> Column:
    """The exact pair, also where the key comes again with another value."""
    return F.exists(tags, lambda t: (t["key"] == key) & (t["value"] == value))
