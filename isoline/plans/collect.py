"""What registered queries share: the register, and SQL of the features that are derived from the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

BOX = ("xmin", "xmax", "ymin", "ymax")
STOPS = [(0.0, (0.6, 1.0, 0.3)), (0.2, (0.9, 1.0, 0.1)), (0.4, (1.0, 0.6, 0.1)), (0.9, (0.9, 0.9, 0.9)), (1.0, (0.8, 0.9, 1.0))]

PTS = "pts AS (SELECT event_id, (event_id*7919 % 36000)/CAST(100 AS DOUBLE) - 180 AS lon, (event_id*15487 % 17000)/CAST(100 AS DOUBLE) - 85 AS lat, event_type, user_id, value FROM events)"
BXS = "bxs AS (SELECT p_partkey, CAST(p_partkey*37 % 360 - 180 AS DOUBLE) AS xmin, CAST(p_partkey*37 % 360 - 180 + p_size AS DOUBLE) AS xmax, CAST(p_partkey*53 % 170 - 85 AS DOUBLE) AS ymin, p_partkey*53 % 170 - 85 + p_size/CAST(2 AS DOUBLE) AS ymax FROM part)"
LNS = "v AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y) AS n, x, y FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber*10 + l_partkey % 10 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y FROM lineitem))"
CELLS = "cells AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value AS v FROM events)"

#: name to (query, SQL or None)
QUERIES: dict[str, tuple[Callable, str | None]] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def gradient_sql(k: int) -> str:
    v, out = "t", f"{STOPS[-1][1][k]}::DOUBLE"
    for (p, a), (q, b) in reversed(list(zip(STOPS, STOPS[1:]))):
        out = f"CASE WHEN {v} < {q}::DOUBLE THEN {a[k]}::DOUBLE + ({v} - {p}::DOUBLE) * {(b[k] - a[k]) / (q - p)!r}::DOUBLE ELSE {out} END"
    return f"round(CASE WHEN {v} <= 0 THEN {STOPS[0][1][k]}::DOUBLE ELSE {out} END, 6)"
