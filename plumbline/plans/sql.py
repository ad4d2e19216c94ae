"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

from plumbline.functions.geo import INCLUSIVE_WEST, PLACE_BOXES, PLACE_ELSE, REGION_CIRCLES, USAGE_BOXES

from .fixtures import AS_OF

H6, H24, D7, D14, D30 = (AS_OF - h * 3_600_000 for h in (6, 24, 168, 336, 720))
NOISE = "NOT (fix_rate = 0 AND duration >= 0 AND duration < 60)"
STATION = "station IS NOT NULL AND station <> ''"
POSITION = "latitude IS NOT NULL AND abs(latitude) > 0.1"
NONZERO = "latitude <> 0 AND longitude <> 0"


def rnd(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * 1e{digits} + 5000001e-7) / 1e{digits})"


def km(a: str, b: str, c: str, d: str) -> str:
    return (f"(12742e0 * asin(sqrt(least(1e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
            f"* pow(sin(radians({d} - {b}) / 2), 2)))))")


def circle(lat: str, lon: str) -> str:
    names = ", ".join(f"({i}, '{n}', {la}e0, {lo}e0, {r}e0)" for i, (n, la, lo, r) in enumerate(REGION_CIRCLES))
    return (f"coalesce((SELECT arg_min(c.name, struct_pack(d := {km(lat, lon, 'c.la', 'c.lo')}, i := c.i)) FROM (VALUES {names}) c(i, name, la, lo, r) "
            f"WHERE {km(lat, lon, 'c.la', 'c.lo')} < c.r), 'Other')")


def box(lat: str, lon: str, boxes=USAGE_BOXES, other: str = "Other") -> str:
    cases = " ".join(f"WHEN {lat} > {s} AND {lat} < {n} AND {lon} > {w} AND {lon} < {e} THEN '{name}'" for name, s, n, w, e in boxes)
    return f"CASE {cases} ELSE '{other}' END"


def place(lat: str, lon: str, scheme: str) -> str:
    cases = " ".join(f"WHEN {lat} > {s} AND {lat} <= {90 if n is None else n} AND {lon} {'>=' if name in INCLUSIVE_WEST else '>'} {w} AND {lon} < {e} THEN '{name}'"
                     for name, s, n, w, e in PLACE_BOXES[scheme])
    return f"CASE {cases} ELSE printf('{PLACE_ELSE[scheme]}', CAST(CAST(floor({lat} + 5e-1) AS bigint) AS varchar), CAST(CAST(floor({lon} + 5e-1) AS bigint) AS varchar)) END"
