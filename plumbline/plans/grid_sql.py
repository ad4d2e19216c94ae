"""The geodesic grid in DuckDB SQL, for the twins of queries on cells."""

from __future__ import annotations

from plumbline.functions import geodesic as g

RESOLUTION = g.DEFAULT_RESOLUTION
_M, _N = g.edge_step(RESOLUTION)
_T = g.triangles(RESOLUTION)


def _list(values, kind: str) -> str:
    return f"([{', '.join(map(str, values))}]::{kind}[])"


_CORNERS = [_list([float(g.CORNERS[f[k]][axis]) for f in g.FACES for k in range(3)], "DOUBLE") for axis in range(3)]
_FACES = _list([v for f in g.FACES for v in f], "BIGINT")
_BEYOND, _SOURCE, _HOME = _list(g.BEYOND.ravel(), "BIGINT"), _list(g.SOURCES.ravel(), "BIGINT"), _list(g.HOME, "BIGINT")


def _over(f: str, w: str, k: str) -> str:
    """Weights beyond the edge opposite to corner ``k`` (from 0)."""
    source = lambda j: f"{_SOURCE}[({f} * 3 + {k}) * 3 + {j + 1}]"
    return "[" + ", ".join(f"CASE WHEN {source(j)} = 3 THEN -{w}[{k} + 1] ELSE {w}[{source(j)} + 1] + {w}[{k} + 1] END" for j in range(3)) + "]"


def named(rows: str, scale: int = 1) -> str:
    """``rows`` (with ``f, q, r``: a face and lattice coordinates on it) and the id ``cell``."""
    at = f"{_BEYOND}[f * 3 + fold + 1]"
    low = "list_position(w, list_min(w)) - 1"
    folded = f"""
SELECT * EXCLUDE (w, f, fold), CASE WHEN list_min(w) < 0 THEN {_over("f", "w", "fold")} ELSE w END AS w, CASE WHEN list_min(w) < 0 THEN {at} ELSE f END AS f
FROM (SELECT *, {low} AS fold FROM (
  SELECT *, [{scale * _T} - b - c, b, c]::BIGINT[] AS w FROM (SELECT *, (q * {_M + _N} + r * {_N})::BIGINT AS b, (r * {_M} - q * {_N})::BIGINT AS c FROM {rows})))"""
    corner = f"{_FACES}[f * 3 + list_position(w, list_max(w))]"
    settled = f"""
SELECT * EXCLUDE (w, f, fold, v, zeros),
       CASE WHEN zeros = 2 THEN {_HOME}[v + 1] WHEN zeros = 1 THEN least(f, {at}) ELSE f END AS f,
       CASE WHEN zeros = 2 THEN list_transform([1, 2, 3], lambda j: CASE WHEN {_FACES}[{_HOME}[v + 1] * 3 + j] = v THEN list_sum(w)::BIGINT ELSE 0 END)
            WHEN zeros = 1 AND {at} < f THEN {_over("f", "w", "fold")} ELSE w END AS w
FROM (SELECT *, {low} AS fold, {corner} AS v, len(list_filter(w, lambda x: x = 0)) AS zeros FROM ({folded}))"""
    return f"""(
SELECT * EXCLUDE (w, f, q, r, b, c), {RESOLUTION << 58} + f * {1 << 53} + (({_M} * w[2] - {_N} * w[3]) // {_T} + {1 << 25}) * {1 << 26}
       + ({_M} * w[3] + {_N} * (w[2] + w[3])) // {_T} + {1 << 25} AS cell
FROM ({settled}))"""


def located(rows: str, lat: str, lon: str) -> str:
    """``rows`` and the id ``cell`` of the cell that holds each point."""
    rounded = """
SELECT * EXCLUDE (x, y, s), CASE WHEN abs(rx - x) > abs(ry - y) AND abs(rx - x) > abs(rs - s) THEN -ry - rs ELSE rx END AS q,
       CASE WHEN NOT (abs(rx - x) > abs(ry - y) AND abs(rx - x) > abs(rs - s)) AND abs(ry - y) > abs(rs - s) THEN -rx - rs ELSE ry END AS r
FROM (SELECT *, floor(x + 5e-1) AS rx, floor(y + 5e-1) AS ry, floor(s + 5e-1) AS rs FROM (SELECT *, -x - y AS s FROM """
    towards = ", ".join(f"px * {x!r}::DOUBLE + py * {y!r}::DOUBLE + pz * {z!r}::DOUBLE" for x, y, z in g.CENTRES.tolist())
    part = lambda k: " + ".join(f"p{a} * {_list(g.INVERSES[:, k, j].tolist(), 'DOUBLE')}[f + 1]" for j, a in enumerate("xyz"))
    real = f"""(
SELECT * EXCLUDE (u, v, w), (v * {_M} - w * {_N}) / (u + v + w) AS x, (v * {_N} + w * {_M + _N}) / (u + v + w) AS y
FROM (SELECT * EXCLUDE (px, py, pz), {part(0)} AS u, {part(1)} AS v, {part(2)} AS w
      FROM (SELECT *, list_position(d, list_max(d))::BIGINT - 1 AS f FROM (SELECT *, [{towards}] AS d
            FROM (SELECT *, cos(radians({lat})) * cos(radians({lon})) AS px, cos(radians({lat})) * sin(radians({lon})) AS py, sin(radians({lat})) AS pz
                  FROM {rows})))))"""
    return f"(SELECT * EXCLUDE (d, rx, ry, rs) FROM {named(f'({rounded}{real})))')})"


def neighbours(rows: str) -> str:
    """``cell, near``: each cell of ``rows`` and the cells around it."""
    steps = ", ".join(map(str, g.STEPS))
    five = ", ".join(f"({k}::BIGINT, {n}::BIGINT)" for k, (near, _) in g.pentagons(RESOLUTION).items() for n in near)
    unpacked = f"""(
SELECT cell AS own, (own >> 53) & 31 AS f, ((own >> 26) & {(1 << 26) - 1}) - {1 << 25} + d.a AS q, (own & {(1 << 26) - 1}) - {1 << 25} + d.b AS r
FROM (SELECT DISTINCT cell FROM {rows}), (VALUES {steps}) d(a, b))"""
    return f"""(
SELECT own AS cell, cell AS near FROM {named(unpacked)} WHERE own NOT IN (SELECT k FROM (VALUES {five}) p(k, n))
UNION ALL SELECT k, n FROM (VALUES {five}) p(k, n) WHERE k IN (SELECT cell FROM {rows}))"""


def centred(rows: str) -> str:
    """``rows`` and the position ``lat, lon`` of the centre of their ``cell``."""
    weights = f"""(
SELECT *, {_T} - b - c AS a FROM (
  SELECT *, q * {_M + _N} + r * {_N} AS b, r * {_M} - q * {_N} AS c FROM (
    SELECT *, (cell >> 53) & 31 AS f, ((cell >> 26) & {(1 << 26) - 1}) - {1 << 25} AS q, (cell & {(1 << 26) - 1}) - {1 << 25} AS r FROM {rows})))"""
    part = lambda axis: " + ".join(f"{w} * {_CORNERS[axis]}[f * 3 + {k + 1}]" for k, w in enumerate("abc"))
    return f"""(
SELECT * EXCLUDE (a, b, c, f, q, r, x, y, z), degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lon
FROM (SELECT *, {part(0)} AS x, {part(1)} AS y, {part(2)} AS z FROM {weights}))"""


def _point(vector: list[str]) -> tuple[str, str]:
    x, y, z = vector
    return f"degrees(atan2({z}, sqrt(({x}) * ({x}) + ({y}) * ({y}))))", f"degrees(atan2({y}, {x}))"


def sides(rows: str) -> str:
    """``cell, k, a, b, lat, lon, bend_lat, bend_lon``: the sides of each cell of ``rows`` (none of them a pentagon)."""
    turns = ", ".join(f"({k}, {g.STEPS[k][0] + g.STEPS[(k + 1) % 6][0]}, {g.STEPS[k][1] + g.STEPS[(k + 1) % 6][1]})" for k in range(6))
    mask = (1 << 26) - 1
    raw = f"""(
SELECT *, f AS home, q * {_M + _N} + r * {_N} AS wb, r * {_M} - q * {_N} AS wc FROM (
  SELECT cell AS own, k, (cell >> 53) & 31 AS f, 3 * (((cell >> 26) & {mask}) - {1 << 25}) + d.x AS q, 3 * ((cell & {mask}) - {1 << 25}) + d.y AS r
  FROM (SELECT DISTINCT cell FROM {rows}), (VALUES {turns}) d(k, x, y)))"""
    named_ = f"(SELECT own, k, home, [{3 * _T} - wb - wc, wb, wc] AS w, cell AS id, (cell >> 53) & 31 AS f, ((cell >> 26) & {mask}) - {1 << 25} AS q, (cell & {mask}) - {1 << 25} AS r FROM {named(raw, 3)})"
    at = f"(SELECT *, q * {_M + _N} + r * {_N} AS vb, r * {_M} - q * {_N} AS vc FROM {named_})"
    own = [f"({3 * _T} - vb - vc) * {_CORNERS[axis]}[f * 3 + 1] + vb * {_CORNERS[axis]}[f * 3 + 2] + vc * {_CORNERS[axis]}[f * 3 + 3]" for axis in range(3)]
    cut = [" + ".join(f"(w[{i + 1}] + (w2[{i + 1}] - w[{i + 1}]) * t) * {_CORNERS[axis]}[home * 3 + {i + 1}]" for i in range(3)) for axis in range(3)]
    lat, lon = _point(["vx", "vy", "vz"])
    b_lat, b_lon = _point(["ex", "ey", "ez"])
    return f"""(
WITH corner AS MATERIALIZED (SELECT own, k, home, w, id, {own[0]} AS vx, {own[1]} AS vy, {own[2]} AS vz FROM {at}),
pair AS (SELECT x.*, y.id AS id2, y.w AS w2, list_position(list_transform([1, 2, 3], lambda i: (x.w[i] > 0 AND y.w[i] < 0) OR (x.w[i] < 0 AND y.w[i] > 0)), true) AS j
         FROM corner x JOIN corner y ON y.own = x.own AND y.k = (x.k + 1) % 6),
bent AS (SELECT *, w[nullif(j, 0)] / (w[nullif(j, 0)] - w2[nullif(j, 0)])::DOUBLE AS t FROM pair),
placed AS (SELECT *, {cut[0]} AS ex, {cut[1]} AS ey, {cut[2]} AS ez FROM bent)
SELECT own AS cell, k, id AS a, id2 AS b, {lat} AS lat, {lon} AS lon, {b_lat} AS bend_lat, {b_lon} AS bend_lon FROM placed)"""


def excess(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    """Signed area of a spherical triangle."""
    part = lambda p: (f"cos(radians({p[0]})) * cos(radians({p[1]}))", f"cos(radians({p[0]})) * sin(radians({p[1]}))", f"sin(radians({p[0]}))")
    a, b, c = part(a), part(b), part(c)
    dot = lambda u, v: " + ".join(f"{x} * {y}" for x, y in zip(u, v))
    triple = " + ".join(f"{a[i]} * ({b[(i + 1) % 3]} * {c[(i + 2) % 3]} - {b[(i + 2) % 3]} * {c[(i + 1) % 3]})" for i in range(3))
    return f"2 * atan2({triple}, 1 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"
