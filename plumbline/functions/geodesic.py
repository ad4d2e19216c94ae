"""A geodesic grid of hexagons, and twelve pentagons, as column functions.

The globe is projected from its centre onto the faces of an icosahedron. A triangular lattice lies on each face and meets
that of the next face along their common edge; a cell is what lies nearest to one lattice point. Each resolution divides
cells in about seven: its lattice is the coarser one multiplied by a number of norm 7, so the coarser points are points of the
finer lattice too. A lattice point is written by its weights on the three corners of its face, whole numbers that add up to
the number of triangles on a face. A point outside a face has one negative weight, and folding it over that edge gives its
weights on the neighbouring face; points on edges and corners are written on the lowest of their faces. So every cell has
one id, whichever face it was found from.

All functions work on numpy arrays; those for columns pass Arrow batches to them. Ids are long integers: resolution, face and the two lattice coordinates on it. They are not ids of any other cell system.
Resolution 5 has 2,016,842 cells of about 253 square kilometres, at most one and a half times as large as that.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import EARTH_KM

#: Turns of the icosahedron about the three axes (radians), so that no parallel or meridian of whole degrees is an edge.
TURNS = (0.31, 0.73, 1.13)
FINEST = 10
DEFAULT_RESOLUTION = 5
#: Unit steps of the lattice, counter-clockwise; coordinates count steps east and steps 60 degrees north of east.
STEPS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
_OFFSET = 1 << 25


def _corners() -> np.ndarray:
    golden = (1 + 5**0.5) / 2
    flat = [(0.0, s, t * golden) for s in (1, -1) for t in (1, -1)]
    points = np.array([p[k:] + p[:k] for k in range(3) for p in flat]) / (1 + golden**2) ** 0.5
    for axis, angle in enumerate(TURNS):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        turn = np.eye(3)
        turn[[i, j], [i, j]] = np.cos(angle)
        turn[i, j], turn[j, i] = -np.sin(angle), np.sin(angle)
        points = points @ turn.T
    return points


#: Unit vectors of the twelve corners, and the corners of each face, counter-clockwise as seen from outside.
CORNERS = _corners()
FACES = [f if np.linalg.det(CORNERS[list(f)]) > 0 else (f[0], f[2], f[1])
         for f in combinations(range(12), 3) if all(CORNERS[a] @ CORNERS[b] > 0.4 for a, b in combinations(f, 2))]
CENTRES = np.array([CORNERS[list(f)].sum(0) for f in FACES])
#: From a direction to its weights on the corners of a face.
INVERSES = np.array([np.linalg.inv(CORNERS[list(f)].T) for f in FACES])


def _folds() -> list[tuple[int, tuple[int, int, int]]]:
    """For each face and corner: the face beyond the opposite edge, and where each of its weights comes from: the number of
    the corner on this side, or 3 for the corner that is new."""
    out = []
    for f, face in enumerate(FACES):
        for k in range(3):
            edge = set(face) - {face[k]}
            g = next(g for g, other in enumerate(FACES) if g != f and edge < set(other))
            out.append((g, tuple(face.index(v) if v in edge else 3 for v in FACES[g])))
    return out


FOLDS = _folds()
BEYOND = np.array([g for g, _ in FOLDS]).reshape(20, 3)
SOURCES = np.array([s for _, s in FOLDS]).reshape(20, 3, 3)
_FACE_CORNERS = np.array(FACES)
#: For each corner the lowest face that has it.
HOME = np.array([min(f for f, face in enumerate(FACES) if v in face) for v in range(12)])


@cache
def edge_step(resolution: int) -> tuple[int, int]:
    """Lattice coordinates of the way from the first corner of a face to the second; its norm is the number of triangles."""
    a, b = 2, 2
    for k in range(1, resolution + 1):
        a, b = _times((a, b), grow(k))
    return a, b


def grow(resolution: int) -> tuple[int, int]:
    """What the coarser lattice is multiplied by: turned one way and the other in turn."""
    return (2, 1) if resolution % 2 else (3, -1)


def _times(x: tuple, y: tuple) -> tuple:
    return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0] + x[1] * y[1]


def triangles(resolution: int) -> int:
    return 12 * 7**resolution


def cell_count(resolution: int) -> int:
    return 10 * triangles(resolution) + 2


# ---- lattice points on faces ----------------------------------------------------------------------------------------

def _weights(resolution: int, q: np.ndarray, r: np.ndarray, scale: int = 1) -> np.ndarray:
    """The weights of lattice points (coordinates ``scale`` times finer), one row each."""
    m, n = edge_step(resolution)
    b, c = q * (m + n) + r * n, r * m - q * n
    return np.stack([scale * triangles(resolution) - b - c, b, c], axis=-1)


def _over(face: np.ndarray, w: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same points on the faces beyond the edges opposite to corners ``k``."""
    source, back = SOURCES[face, k], np.take_along_axis(w, k[:, None], axis=1)
    return BEYOND[face, k], np.where(source == 3, -back, np.take_along_axis(w, np.minimum(source, 2), axis=1) + back)


def _canonical(face: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The face and weights that each point is known by: folded back onto a face, and on edges and corners the lowest."""
    face, w = face.copy(), w.copy()
    out = np.flatnonzero(w.min(1) < 0)
    face[out], w[out] = _over(face[out], w[out], w[out].argmin(1))
    zeros = (w == 0).sum(1)
    at = np.flatnonzero(zeros == 2)
    if len(at):
        corner = _FACE_CORNERS[face[at], w[at].argmax(1)]
        face[at], w[at] = HOME[corner], np.where(_FACE_CORNERS[HOME[corner]] == corner[:, None], w[at].sum(1, keepdims=True), 0)
    at = np.flatnonzero(zeros == 1)
    if len(at):
        other, moved = _over(face[at], w[at], w[at].argmin(1))
        lower = other < face[at]
        face[at[lower]], w[at[lower]] = other[lower], moved[lower]
    return face, w


def _pack(resolution: int, face: np.ndarray, w: np.ndarray) -> np.ndarray:
    (m, n), t = edge_step(resolution), triangles(resolution)
    q, r = (m * w[:, 1] - n * w[:, 2]) // t, (m * w[:, 2] + n * (w[:, 1] + w[:, 2])) // t
    return (np.int64(resolution) << 58) + (face.astype(np.int64) << 53) + ((q + _OFFSET) << 26) + r + _OFFSET


def _unpack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << 26) - 1
    return (ids >> 53) & 31, ((ids >> 26) & mask) - _OFFSET, (ids & mask) - _OFFSET


def _known(resolution: int, face: np.ndarray, q: np.ndarray, r: np.ndarray, scale: int = 1) -> np.ndarray:
    return _pack(resolution, *_canonical(face, _weights(resolution, q, r, scale)))


def _rounded(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lattice points of real coordinates."""
    s = -q - r
    rq, rr, rs = (np.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = np.abs(rq - q), np.abs(rr - r), np.abs(rs - s)
    first = (dq > dr) & (dq > ds)
    second = ~first & (dr > ds)
    return np.where(first, -rr - rs, rq).astype(np.int64), np.where(second, -rq - rs, rr).astype(np.int64)


def _directions(face: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Vectors (not of unit length) of points on faces."""
    return np.einsum("nk,nkx->nx", w.astype(float), CORNERS[_FACE_CORNERS[face]])


def _positions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(v[..., 2], np.hypot(v[..., 0], v[..., 1]))), np.degrees(np.arctan2(v[..., 1], v[..., 0]))


# ---- cells as arrays ------------------------------------------------------------------------------------------------

def locate(lat: np.ndarray, lon: np.ndarray, resolution: int) -> np.ndarray:
    """The ids of the cells that hold the points."""
    a, o = np.radians(lat), np.radians(lon)
    p = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=-1)
    face = (p @ CENTRES.T).argmax(1)
    u = np.einsum("nkx,nx->nk", INVERSES[face], p)
    b, c = (u[:, 1:] / u.sum(1, keepdims=True)).T
    m, n = edge_step(resolution)
    return _known(resolution, face, *_rounded(b * m - c * n, b * n + c * (m + n)))


def around(ids: np.ndarray, resolution: int) -> np.ndarray:
    """The neighbours of each cell, counter-clockwise; a pentagon has five, and -1 in the last place."""
    face, q, r = _unpack(ids)
    out = np.stack([_known(resolution, face, q + a, r + b) for a, b in STEPS], axis=1)
    for k in np.flatnonzero(np.isin(ids, list(pentagons(resolution)))).tolist():
        out[k] = [*pentagons(resolution)[int(ids[k])][0], -1]
    return out


def coarser(ids: np.ndarray, resolution: int) -> np.ndarray:
    a, b = grow(resolution)
    face, q, r = _unpack(ids)
    # Division by a number of norm 7: times its conjugate, by 7.
    return _known(resolution - 1, face, *_rounded((q * (a + b) + r * b) / 7, (r * a - q * b) / 7))


def finer(ids: np.ndarray, resolution: int) -> np.ndarray:
    a, b = grow(resolution + 1)
    face, q, r = _unpack(ids)
    middle = _known(resolution + 1, face, q * a - r * b, q * b + r * (a + b))
    return np.concatenate([middle[:, None], around(middle, resolution + 1)], axis=1)


def sides(ids: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Corner ids of each cell, counter-clockwise (-1 fills the last place of a pentagon), and the vectors of the bends
    between each and the next (NaN: none)."""
    face, q, r = _unpack(ids)
    turns = [(STEPS[k][0] + STEPS[(k + 1) % 6][0], STEPS[k][1] + STEPS[(k + 1) % 6][1]) for k in range(6)]
    raw = [_weights(resolution, 3 * q + a, 3 * r + b, 3) for a, b in turns]
    corners = np.stack([_pack(resolution, *_canonical(face, w)) for w in raw], axis=1)
    bends = np.full((len(ids), 6, 3), np.nan)
    for k in range(6):
        x, y = raw[k], raw[(k + 1) % 6]
        through = x * np.sign(y) < 0  # the side changes to the other side of an edge
        cut = np.flatnonzero(through.any(1))
        j = through[cut].argmax(1)[:, None]
        p, s = np.take_along_axis(x[cut], j, 1), np.take_along_axis(y[cut], j, 1)
        bends[cut, k] = _directions(face[cut], x[cut] + (y[cut] - x[cut]) * (p / (p - s)))
    for k in np.flatnonzero(np.isin(ids, list(pentagons(resolution)))).tolist():
        five = pentagons(resolution)[int(ids[k])][1]
        corners[k], bends[k] = [*five, -1], np.nan
        bends[k, :5] = [_pentagon_bend(resolution, a, b, int(ids[k])) for a, b in zip(five, five[1:] + five[:1])]
    return corners, bends


def _pentagon_bend(resolution: int, a: int, b: int, cell: int) -> np.ndarray:
    """Where the side of a pentagon meets the edge of the icosahedron between its two faces: halfway, for both ends are
    equally far from that edge when it is laid flat."""
    ends = [_directions(f, _weights(resolution, q, r, 3))[0] for f, q, r in (_unpack(np.array([c])) for c in (a, b))]
    centre = _directions(*_face_weights(resolution, np.array([cell])))[0] * 3
    corner = centre / np.linalg.norm(centre)
    near = [u for u in range(12) if 0.4 < CORNERS[u] @ corner < 0.9]
    along = CORNERS[max(near, key=lambda u: CORNERS[u] @ (ends[0] + ends[1]))] * np.linalg.norm(centre) - centre
    unit = along / np.linalg.norm(along)
    x, y = zip(*(((e - centre) @ unit, np.sqrt(max(0.0, (e - centre) @ (e - centre) - ((e - centre) @ unit) ** 2))) for e in ends))
    share = (x[0] * y[1] + x[1] * y[0]) / (y[0] + y[1]) if y[0] + y[1] > 1e-9 * np.linalg.norm(along) else x[0]
    return centre + unit * share


def _face_weights(resolution: int, ids: np.ndarray, scale: int = 1) -> tuple[np.ndarray, np.ndarray]:
    face, q, r = _unpack(ids)
    return face, _weights(resolution, q, r, scale)


@cache
def pentagons(resolution: int) -> dict[int, tuple[list[int], list[int]]]:
    """For each pentagon its neighbours and its corners, both counter-clockwise, the first corner after the first neighbour."""
    out = {}
    for v in range(12):
        steps, turns = [], []
        for f in np.flatnonzero((_FACE_CORNERS == v).any(1)):
            home = np.where(_FACE_CORNERS[f] == v, triangles(resolution), 0)[None]
            face, q, r = np.array([f]), *(x for x in _unpack(_pack(resolution, np.array([f]), home))[1:])
            for k, (a, b) in enumerate(STEPS):
                c, d = STEPS[(k + 1) % 6]
                near, corner = _weights(resolution, q + a, r + b), _weights(resolution, 3 * q + a + c, 3 * r + b + d, 3)
                if near.min() >= 0:
                    steps.append(_canonical(face, near))
                if corner.min() >= 0:
                    turns.append(_canonical(face, corner))
        east = np.cross([0.0, 0.0, 1.0], CORNERS[v])
        north = np.cross(CORNERS[v], east)

        def ordered(points: list, start: float, east: np.ndarray = east, north: np.ndarray = north) -> tuple[list[int], float]:
            angles = {int(_pack(resolution, *p)[0]): float(np.arctan2(_directions(*p)[0] @ north, _directions(*p)[0] @ east) - start) % (2 * np.pi) for p in points}
            ids = sorted(angles, key=angles.__getitem__)
            return ids, angles[ids[0]]

        cells, first = ordered(steps, 0.0)
        cell = int(_known(resolution, np.array([HOME[v]]), *_unpack(_pack(resolution, np.array([HOME[v]]), np.where(_FACE_CORNERS[HOME[v]] == v, triangles(resolution), 0)[None]))[1:])[0])
        out[cell] = cells, ordered(turns, first)[0]
    return out


# ---- columns --------------------------------------------------------------------------------------------------------

POINT = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
SIDE = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bend", POINT)])


def _over_rows(compute, *columns: pa.Array):
    """The rows without a null, as numpy arrays, and a function that puts results (an Arrow array) back in their places."""
    valid = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    found = compute(*(c.filter(pa.array(valid)).to_numpy(zero_copy_only=False) for c in columns))
    return found.take(pa.array(np.where(valid, np.cumsum(valid) - 1, 0), mask=~valid)) if not valid.all() else found


def _lists(values: pa.Array, keep: np.ndarray) -> pa.Array:
    """One list per row of ``keep`` from the values at its true places, in order."""
    ends = np.cumsum(keep.sum(1), dtype=np.int32)
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), values.filter(pa.array(keep.reshape(-1))))


def _points(lat: np.ndarray, lon: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(lat), pa.array(lon)], fields=list(POINT), mask=pa.array(np.isnan(lat)))


def cell_of(lat: Column, lon: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """The id of the cell that holds a point; null without coordinates."""

    @F.arrow_udf("long")
    def cells(lat: pa.Array, lon: pa.Array) -> pa.Array:
        return _over_rows(lambda a, o: pa.array(locate(a, o, resolution)), lat, lon)

    return cells(lat.cast("double"), lon.cast("double"))


def cell_centre(cell: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Struct ``lat, lon`` of the centre of a cell; the longitude lies between -180 and 180."""

    @F.arrow_udf("struct<lat: double, lon: double>")
    def centres(ids: pa.Array) -> pa.Array:
        return _over_rows(lambda x: _points(*_positions(_directions(*_face_weights(resolution, x)))), ids)

    return centres(cell)


def corner_position(corner: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Struct ``lat, lon`` of a corner (see :func:`cell_edges`)."""

    @F.arrow_udf("struct<lat: double, lon: double>")
    def corners(ids: pa.Array) -> pa.Array:
        return _over_rows(lambda x: _points(*_positions(_directions(*_face_weights(resolution, x, 3)))), ids)

    return corners(corner)


def neighbours(cell: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """The ids of the six (of a pentagon five) cells around a cell, counter-clockwise."""

    @F.arrow_udf("array<long>")
    def near(ids: pa.Array) -> pa.Array:
        def found(x: np.ndarray) -> pa.Array:
            out = around(x, resolution)
            return _lists(pa.array(out.reshape(-1)), out >= 0)

        return _over_rows(found, ids)

    return near(cell)


def cell_disk(cell: Column, k: int, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """The ids of all cells within ``k`` steps: ``3 k (k + 1) + 1``, fewer around a pentagon; in ascending order."""

    @F.arrow_udf("array<long>")
    def disk(ids: pa.Array) -> pa.Array:
        def found(x: np.ndarray) -> pa.Array:
            reach = x[:, None]
            for _ in range(k):
                every = around(np.maximum(reach, 0).reshape(-1), resolution).reshape(len(x), -1)
                every[np.repeat(reach < 0, 6, axis=1)] = -1
                reach = np.sort(np.concatenate([reach, every], axis=1), axis=1)
                reach[:, 1:][reach[:, 1:] == reach[:, :-1]] = -1
                reach = np.sort(reach, axis=1)[:, -(3 * (_ + 1) * (_ + 2) + 1):]
            return _lists(pa.array(np.ascontiguousarray(reach).reshape(-1)), reach >= 0)

        return _over_rows(found, ids)

    return disk(cell)


def parent(cell: Column, resolution: int) -> Column:
    """The cell of the next coarser resolution whose centre lies nearest on the lattice; ``resolution`` is that of ``cell``."""
    return F.arrow_udf(lambda ids: _over_rows(lambda x: pa.array(coarser(x, resolution)), ids), "long")(cell)


def children(cell: Column, resolution: int) -> Column:
    """The seven (of a pentagon six) cells of the next finer resolution that have this parent."""

    @F.arrow_udf("array<long>")
    def below(ids: pa.Array) -> pa.Array:
        def found(x: np.ndarray) -> pa.Array:
            out = finer(x, resolution)
            return _lists(pa.array(out.reshape(-1)), out >= 0)

        return _over_rows(found, ids)

    return below(cell)


def cell_edges(cell: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """The sides of a cell, counter-clockwise, as an array of ``a, b, bend``.

    ``a`` and ``b`` are ids of corners, the same for all three cells that meet there, so the cell beyond a side has it from
    ``b`` to ``a``. Sides are great-circle arcs, but for those that cross an edge of the icosahedron: these are bent at
    ``bend`` (``lat, lon``, else null).
    """

    @F.arrow_udf("array<struct<a: long, b: long, bend: struct<lat: double, lon: double>>>")
    def edges(ids: pa.Array) -> pa.Array:
        def found(x: np.ndarray) -> pa.Array:
            corners, bends = sides(x, resolution)
            after = np.roll(corners, -1, axis=1)
            after[:, 4] = np.where(corners[:, 5] < 0, corners[:, 0], after[:, 4])
            rows = pa.StructArray.from_arrays([pa.array(corners.reshape(-1)), pa.array(after.reshape(-1)), _points(*_positions(bends.reshape(-1, 3)))], fields=list(SIDE))
            return _lists(rows, corners >= 0)

        return _over_rows(found, ids)

    return edges(cell)


def outlines(ids: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners and bends of cells as vectors, counter-clockwise in twelve places, and which of them are filled."""
    corners, bends = sides(ids, resolution)
    at = _directions(*_face_weights(resolution, np.maximum(corners, 0).reshape(-1), 3)).reshape(len(ids), 6, 3)
    ring = np.stack([at, bends], axis=2).reshape(len(ids), 12, 3)
    filled = np.stack([corners >= 0, ~np.isnan(bends[..., 0])], axis=2).reshape(len(ids), 12)
    return ring, filled


def cell_outline(cell: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """The corners and bends of a cell, counter-clockwise, as an array of ``lat, lon``."""

    @F.arrow_udf("array<struct<lat: double, lon: double>>")
    def rings(ids: pa.Array) -> pa.Array:
        def found(x: np.ndarray) -> pa.Array:
            ring, filled = outlines(x, resolution)
            return _lists(_points(*_positions(ring.reshape(-1, 3))), filled)

        return _over_rows(found, ids)

    return rings(cell)


def areas_km2(ids: np.ndarray, resolution: int) -> np.ndarray:
    """Areas on the sphere: the excess of the triangles from the centre to the sides."""
    ring, filled = outlines(ids, resolution)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre, total = unit(_directions(*_face_weights(resolution, ids))), np.zeros(len(ids))
    last = np.array([np.flatnonzero(f)[-1] for f in filled]) if len(ids) else np.zeros(0, int)
    before = unit(ring[np.arange(len(ids)), last])
    for k in range(12):
        now = np.where(filled[:, k, None], unit(np.nan_to_num(ring[:, k], nan=1.0)), before)
        triple = (centre * np.cross(before, now)).sum(1)
        total += 2 * np.arctan2(triple, 1 + (centre * before).sum(1) + (before * now).sum(1) + (now * centre).sum(1))
        before = now
    return total * EARTH_KM**2


def cell_area_km2(cell: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Area of a cell on the sphere."""
    return F.arrow_udf(lambda ids: _over_rows(lambda x: pa.array(areas_km2(x, resolution)), ids), "double")(cell)
