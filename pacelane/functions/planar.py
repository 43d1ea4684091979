"""Planar geometry of one frame, as Arrow-batched helpers over packed coordinates.

A frame holds one row per object (duplicates are removed before packing), so the
arrays are as long as a line-up.  Each helper works on the frames of one Arrow
batch; Spark does the grouping and the shuffle.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

EDGE = 1e-9


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DOUBLES, INTEGERS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
RING = T.ArrayType(_struct(x=T.DoubleType(), y=T.DoubleType()))


def _ring(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def around(points: np.ndarray) -> np.ndarray:
    """Points of a convex outline in counter-clockwise order, lowest-left first."""
    centre = points.mean(axis=0)
    order = np.argsort(np.arctan2(points[:, 1] - centre[1], points[:, 0] - centre[0]), kind="stable")
    ordered = points[order]
    first = int(np.lexsort((ordered[:, 1], ordered[:, 0]))[0])
    return np.roll(ordered, -first, axis=0)


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull: a directed pair is an edge when nothing lies to its right."""
    points = np.unique(points, axis=0)
    if len(points) <= 2:
        return points
    d = points[None, :, :] - points[:, None, :]  # d[a, b] = b - a
    cross = d[:, :, None, 0] * d[:, None, :, 1] - d[:, :, None, 1] * d[:, None, :, 0]  # cross[a, b, c]
    back = points[None, :, None, :] - points[None, None, :, :]  # b - c
    inside = np.einsum("acd,abcd->abc", d, np.broadcast_to(back, cross.shape + (2,))) >= 0
    edge = np.all((cross > 0) | ((cross == 0) & inside), axis=2) & ~np.eye(len(points), dtype=bool)
    corners = points[edge.any(axis=1)]
    return around(corners) if len(corners) > 2 else corners


@pandas_udf(_struct(area=T.DoubleType(), polygon=RING))
def hull_of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    rings = [hull(np.column_stack((x, y))) for x, y in zip(xs, ys)]
    return pd.DataFrame({"area": [ring_area(r) for r in rings], "polygon": [_ring(r) for r in rings]})


def overlap_ring(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corners of the intersection of two convex rings.

    They are the corners of either ring inside the other and the crossings of edges.
    """
    if len(a) < 3 or len(b) < 3:
        return np.empty((0, 2))

    def within(points, ring):
        e = np.roll(ring, -1, axis=0) - ring
        side = e[None, :, 0] * (points[:, None, 1] - ring[None, :, 1]) - e[None, :, 1] * (points[:, None, 0] - ring[None, :, 0])
        return points[np.all(side >= -1e-12, axis=1)]

    p, r = a[:, None, :], (np.roll(a, -1, axis=0) - a)[:, None, :]
    q, s = b[None, :, :], (np.roll(b, -1, axis=0) - b)[None, :, :]
    turn = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    gap = q - p
    divisor = np.where(turn == 0, 1.0, turn)
    t = (gap[..., 0] * s[..., 1] - gap[..., 1] * s[..., 0]) / divisor
    u = (gap[..., 0] * r[..., 1] - gap[..., 1] * r[..., 0]) / divisor
    meet = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossings = (p + t[..., None] * r)[meet]
    found = np.vstack((within(a, b), within(b, a), crossings))
    return around(found) if len(found) >= 3 else np.empty((0, 2))


@pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    as_ring = lambda ring: np.array([(p["x"], p["y"]) for p in ring], dtype=float).reshape(-1, 2)
    return pd.Series([ring_area(overlap_ring(as_ring(x), as_ring(y))) for x, y in zip(a, b)])


def triangulate(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles as index triples: those whose circle holds no other point.

    When a further point lies exactly on the circle, the point with the smallest
    index counts as slightly inside every circle through it, so a tied polygon is
    split by a fan from its smallest index.  Points must be distinct.
    """
    return triangulate_all(np.asarray(points, dtype=float)[None])[0]


def triangulate_all(points: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Triangles of many frames of equally many points, (frames, points, 2), at once."""
    frames, n = points.shape[:2]
    if n < 3:
        return [[] for _ in range(frames)]
    triples = np.array(list(combinations(range(n), 3)))
    a, b, c = (points[:, triples[:, i]] for i in range(3))
    area = (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])

    def offset(corner):
        x, y = (corner[:, :, None, k] - points[:, None, :, k] for k in range(2))
        return x, y, x**2 + y**2

    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = offset(a), offset(b), offset(c)
    inside = (ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)) * np.sign(area)[..., None]
    index = np.arange(n)[None, :]
    corner = (index == triples[:, 0:1]) | (index == triples[:, 1:2]) | (index == triples[:, 2:3])
    blocked, tied = inside > 0, (inside == 0) & ~corner
    if tied.any():
        # Share of the smallest corner in the tied point's position; negative means beyond the opposite side.
        share = (bx * cy - by * cx) / np.where(area == 0, 1.0, area)[..., None]
        blocked |= tied & ((index < triples[:, 0:1]) | (share < 0))
    blocked &= ~corner
    keep = (area != 0) & ~blocked.any(axis=2)
    listed = [tuple(t) for t in triples.tolist()]
    found: list[list] = [[] for _ in range(frames)]
    for frame, triple in zip(*(k.tolist() for k in np.nonzero(keep))):
        found[frame].append(listed[triple])
    return found


TOGETHER = 15_000
"""Pairs of a triple and a point that are looked at together: arrays of 120 KB, which stay in the cache and are reused."""


@pandas_udf(T.ArrayType(_struct(a=T.IntegerType(), b=T.IntegerType(), c=T.IntegerType())))
def delaunay_of(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Frames of equally many points are triangulated together."""
    sizes = xs.map(len).to_numpy()
    out: list = [None] * len(xs)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        some = max(1, TOGETHER // max(1, n * comb(n, 3)))
        for part in np.split(rows, range(some, len(rows), some)):
            points = np.stack([np.column_stack((xs.iat[r], ys.iat[r])) for r in part]).astype(float).reshape(len(part), n, 2)
            for row, triangles in zip(part, triangulate_all(points)):
                out[row] = [{"a": i, "b": j, "c": k} for i, j, k in triangles]
    return pd.Series(out)


@pandas_udf(_struct(inside=T.IntegerType(), nearest=T.IntegerType(), own_m=T.DoubleType(), other_m=T.DoubleType()))
def players_about(
    ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, turn: pd.Series, xs: pd.Series, ys: pd.Series, own_from: pd.Series, own: pd.Series
) -> pd.DataFrame:
    """Opponents inside each triangle, place of the player nearest to its centroid, and the least distance of either side.

    A frame's players come ordered by group and id, so the first smallest distance is the tie rule and a team is ``own`` places from ``own_from`` on.
    Corners are turned already, players are turned here.
    """
    sizes = xs.map(len).to_numpy()
    place = np.arange(max(sizes.max(initial=0), 1))[None, :]
    present = place < sizes[:, None]
    column = lambda s: s.to_numpy(dtype=float)[:, None]
    x, y = np.zeros(present.shape), np.zeros(present.shape)
    if sizes.sum():
        x[present], y[present] = np.concatenate(xs.to_list()), np.concatenate(ys.to_list())
    x, y = x * column(turn), y * column(turn)
    a, b, c = [(column(p), column(q)) for p, q in ((ax, ay), (bx, by), (cx, cy))]
    sides = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for p, q in ((a, b), (b, c), (c, a))]
    within = (np.minimum.reduce(sides) >= -1e-10) | (np.maximum.reduce(sides) <= 1e-10)
    far = np.where(present, np.hypot(x - (a[0] + b[0] + c[0]) / 3, y - (a[1] + b[1] + c[1]) / 3), np.inf)
    start = own_from.to_numpy()[:, None]
    mates = (place >= start) & (place < start + own.to_numpy()[:, None])
    least = lambda some: [None if np.isinf(m) else m for m in np.where(some, far, np.inf).min(axis=1).tolist()]
    return pd.DataFrame({"inside": (within & present & ~mates).sum(axis=1), "nearest": far.argmin(axis=1), "own_m": least(mates), "other_m": least(~mates)})


def left_of(rings: np.ndarray, cut: float) -> np.ndarray:
    """Area of convex rings left of a vertical line, from y dx along their clipped edges."""
    x1, y1 = rings[..., 0], rings[..., 1]
    x2, y2 = np.roll(x1, -1, axis=-1), np.roll(y1, -1, axis=-1)
    u1, u2 = np.minimum(x1, cut), np.minimum(x2, cut)
    run = np.where(x2 == x1, 1.0, x2 - x1)
    at = lambda u: y1 + (y2 - y1) * (u - x1) / run
    return np.abs(np.sum((at(u1) + at(u2)) / 2 * (u2 - u1), axis=-1))


def cut_rings(rings: np.ndarray, count: np.ndarray, normal: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep the part of each convex ring where normal.p <= bound, for many rings at once.

    Corners outside form one stretch.  Each ring is turned so that the stretch comes
    first; two crossings replace it, and spare places repeat the last corner.
    """
    many, places = rings.shape[:2]
    row, place, last = np.arange(many), np.arange(places), (count - 1)[:, None]
    over = rings[..., 0] * normal[:, None, 0] + rings[..., 1] * normal[:, None, 1] - bound[:, None]
    out = (over > 0) & (place <= last)
    hit = out.any(axis=1)
    if not hit.any():
        return rings, count
    before = np.where(place == 0, last, place - 1)
    first = np.argmax(out & ~np.take_along_axis(out, before, axis=1), axis=1)
    turned = (first[:, None] + place) % (last + 1)
    rings_t, over_t = np.take_along_axis(rings, turned[..., None], axis=1), np.take_along_axis(over, turned, axis=1)
    gone = np.where(hit, out.sum(axis=1), 0)

    def crossing(inner, outer):
        a, b = over_t[row, inner], over_t[row, outer]
        t = np.where(a == b, 0.0, a / np.where(a == b, 1.0, a - b))
        return rings_t[row, inner] + t[:, None] * (rings_t[row, outer] - rings_t[row, inner])

    entry, leave = crossing(count - 1, np.zeros(many, dtype=int)), crossing(np.minimum(gone, count - 1), np.maximum(gone - 1, 0))
    source = np.minimum(gone[:, None] + np.arange(places - 1), last)
    cut = np.concatenate((entry[:, None], leave[:, None], np.take_along_axis(rings_t, source[..., None], axis=1)), axis=1)
    same = np.concatenate((rings, rings[:, -1:]), axis=1)
    count = np.where(hit, count - gone + 2, count)
    return np.where(hit[:, None, None], cut, same)[:, : int(count.max())], count


def cell_rings(points: np.ndarray, present: np.ndarray, length: float, width: float) -> np.ndarray:
    """Parts of the pitch closer to each point than to any other distinct point.

    ``points`` is (frames, places, 2) and ``present`` says which places are used.
    All cells of all frames are cut together, one rival place at a time.  Returns
    (frames, places, corners, 2); spare corners repeat another one.
    """
    frames, places = present.shape
    corner = np.array([[-length / 2, -width / 2], [length / 2, -width / 2], [length / 2, width / 2], [-length / 2, width / 2]])
    rings = np.broadcast_to(corner, (frames * places, 4, 2)).copy()
    count = np.full(frames * places, 4)
    square = (points * points).sum(axis=2)
    for rival in range(places):
        d = points[:, rival : rival + 1] - points
        cuts = present[:, rival : rival + 1] & (np.abs(d).max(axis=2) >= 1e-12)
        normal = np.where(cuts[..., None], 2 * d, 0.0).reshape(-1, 2)
        bound = np.where(cuts, square[:, rival : rival + 1] - square, 1.0).reshape(-1)
        rings, count = cut_rings(rings, count, normal, bound)
    return rings.reshape(frames, places, -1, 2)


def rings_area(rings: np.ndarray) -> np.ndarray:
    x, y = rings[..., 0], rings[..., 1]
    return np.abs(np.sum(x * np.roll(y, -1, axis=-1) - np.roll(x, -1, axis=-1) * y, axis=-1)) / 2


def cells_of(length: float, width: float, outline: bool = True):
    """Cell area, area per frame-axis third and outline of every object of a frame, ids ascending.

    Objects on the same spot share it: the smallest id owns the cell.
    """
    fields = dict(area=DOUBLES, third_0=DOUBLES, third_1=DOUBLES, third_2=DOUBLES)
    if outline:
        fields["polygon"] = T.ArrayType(RING)

    @pandas_udf(_struct(**fields))
    def cells(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        sizes = xs.map(len).to_numpy()
        present = np.arange(max(sizes.max(initial=0), 1))[None, :] < sizes[:, None]
        points = np.zeros((*present.shape, 2))
        if sizes.sum():
            points[present] = np.column_stack((np.concatenate(xs.to_list()), np.concatenate(ys.to_list())))
        points = np.clip(points, [-length / 2, -width / 2], [length / 2, width / 2])
        rings = cell_rings(points, present, length, width)
        same = (points[:, :, None, :] == points[:, None, :, :]).all(axis=3) & present[:, None, :]
        owner = same.argmax(axis=2) == np.arange(present.shape[1])[None, :]
        area = np.where(owner, rings_area(rings), 0.0)
        one, two = (np.where(owner, left_of(rings, c), 0.0) for c in (-length / 6, length / 6))
        columns = [area, one, two - one, area - two]
        out = {n: [row[:k] for row, k in zip(c, sizes)] for n, c in zip(fields, columns)}
        if outline:
            out["polygon"] = [[_ring(_corners(r)) if a > 0 else [] for r, a in zip(rs[:k], ar[:k])] for rs, ar, k in zip(rings, area, sizes)]
        return pd.DataFrame(out, columns=list(fields))

    return cells


def _corners(ring: np.ndarray) -> np.ndarray:
    """A ring without repeated neighbours, lowest-left corner first."""
    kept = ring[np.abs(ring - np.roll(ring, 1, axis=0)).max(axis=1) > EDGE]
    return np.roll(kept, -int(np.lexsort((kept[:, 1], kept[:, 0]))[0]), axis=0) if len(kept) else kept


def arrival(px, py, vx, vy, tx, ty, reaction: float, top_speed: float, top_accel: float) -> np.ndarray:
    """Array form of ``functions.scalar.arrival_time_s``."""
    raw = np.hypot(vx, vy)
    shrink = np.where(raw > top_speed, top_speed / np.where(raw == 0, 1.0, raw), 1.0)
    gap = np.hypot(tx - (px + vx * shrink * reaction), ty - (py + vy * shrink * reaction))
    entry = np.minimum(top_speed, np.minimum(raw, top_speed) + top_accel * reaction)
    if top_accel <= 0:
        run = gap / max(top_speed, 1e-12)
    else:
        ramp = np.maximum(0.0, (top_speed * top_speed - entry * entry) / (2.0 * top_accel))
        inside = (np.sqrt(entry * entry + 2.0 * top_accel * gap) - entry) / top_accel
        beyond = (top_speed - entry) / top_accel + (gap - ramp) / top_speed
        run = np.where(gap <= ramp, inside, beyond)
    return reaction + np.where(gap <= 0, 0.0, run)


def influence_of(length: float, width: float, grid_x: int, grid_y: int, reaction: float, top_speed: float, top_accel: float):
    """Grid owners, cells per object, fastest opponent and time to the ball for a frame.

    Objects come ordered by group and id, so the first smallest time is the tie rule.
    Owners and times per cell are only returned for frames marked as sampled.
    """
    columns, rows = np.divmod(np.arange(grid_x * grid_y), grid_y)
    gx, gy = -length / 2 + (columns + 0.5) * length / grid_x, -width / 2 + (rows + 0.5) * width / grid_y

    @pandas_udf(_struct(cells=INTEGERS, opponent=DOUBLES, ball=DOUBLES, owner=INTEGERS, time=DOUBLES))
    def influence(xs: pd.Series, ys: pd.Series, vxs: pd.Series, vys: pd.Series, groups: pd.Series, ball_x: pd.Series, ball_y: pd.Series, sampled: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, vx, vy, group, bx, by, due in zip(xs, ys, vxs, vys, groups, ball_x, ball_y, sampled):
            me = [np.asarray(c, dtype=float)[:, None] for c in (x, y, vx, vy)]
            times = arrival(*me, gx[None, :], gy[None, :], reaction, top_speed, top_accel)
            owner = times.argmin(axis=0)
            between = arrival(*me, np.asarray(x)[None, :], np.asarray(y)[None, :], reaction, top_speed, top_accel)
            names = np.asarray(group)
            foes = np.where(names[:, None] != names[None, :], between, np.inf).min(axis=0)
            to_ball = [None] * len(names) if bx is None or np.isnan(bx) else arrival(*[m[:, 0] for m in me], bx, by, reaction, top_speed, top_accel).tolist()
            out.append(
                (
                    np.bincount(owner, minlength=len(names)).tolist(),
                    [None if np.isinf(f) else float(f) for f in foes],
                    to_ball,
                    owner.tolist() if due else [],
                    times.min(axis=0).tolist() if due else [],
                )
            )
        return pd.DataFrame(out, columns=["cells", "opponent", "ball", "owner", "time"])

    return influence


