"""General polygons as WKB: codec, measures, validity, simplification and clipping, as Arrow-batched UDFs.

The kernels work on rings as numpy arrays of points. Clipping is against convex areas (Sutherland-Hodgman), which bounds and
most areas of interest are.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Polygon = list  # rings, the outer one first, each an (n, 2) array that ends where it begins


def read_wkb(data: bytes) -> list[Polygon]:
    """Polygons of a WKB Polygon or MultiPolygon, either byte order, an SRID or more than two dimensions skipped; else none."""

    def geometry(at: int) -> tuple[list[Polygon], int]:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        extra = bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}.get((kind & 0x0FFFFFFF) // 1000, 0)
        base = (kind & 0x0FFFFFFF) % 1000
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if base == 3:
            rings = []
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", data, at)
                points = np.frombuffer(data, dtype=order + "f8", count=m * (2 + extra), offset=at + 4).reshape(m, 2 + extra)
                rings.append(points[:, :2].astype(float))
                at += 4 + points.nbytes
            return [rings] if rings else [], at
        if base in (6, 7):
            out = []
            for _ in range(n):
                part, at = geometry(at)
                out += part
            return out, at
        return [], len(data)

    return geometry(0)[0] if data else []


def write_wkb(parts: list[Polygon]) -> bytes | None:
    """Little-endian WKB: a Polygon for one part, a MultiPolygon for more, None for none."""

    def one(rings: Polygon) -> bytes:
        out = struct.pack("<BII", 1, 3, len(rings))
        for r in rings:
            out += struct.pack("<I", len(r)) + np.ascontiguousarray(r, dtype="<f8").tobytes()
        return out

    if not parts:
        return None
    return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(one, parts))


def read_wkt(text: str) -> list[Polygon]:
    """Polygons of POLYGON or MULTIPOLYGON text."""
    head, _, body = text.strip().partition("(")
    kind = head.split(";")[-1].split()[0].upper() if head.strip() else ""
    if kind not in ("POLYGON", "MULTIPOLYGON") or not body:
        return []
    points = lambda t: np.array([[float(v) for v in p.split()[:2]] for p in t.split(",")])
    polygon = lambda t: [points(r) for r in t.replace(") ,", "),").replace("), ", "),").strip().strip("()").split("),(")]
    inner = body.rstrip()[:-1].replace("( ", "(").replace(" )", ")").replace(", (", ",(")
    if kind == "POLYGON":
        return [polygon(inner)]
    return [polygon(p) for p in inner.split(")),((")]


def ring_area(r: np.ndarray) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2


def area(parts: list[Polygon]) -> float:
    return sum(abs(ring_area(r)) * (1 if k == 0 else -1) for p in parts for k, r in enumerate(p))


def length(parts: list[Polygon]) -> float:
    return float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for p in parts for r in p))


def centroid(parts: list[Polygon]) -> tuple[float, float]:
    """Area-weighted centre; of points, if there is no area."""
    total, cx, cy = 0.0, 0.0, 0.0
    for p in parts:
        for k, r in enumerate(p):
            base = r[0]
            x, y = (r - base).T
            cross = x[:-1] * y[1:] - x[1:] * y[:-1]
            a = cross.sum() / 2
            sign = (1 if a >= 0 else -1) * (1 if k == 0 else -1)
            total += sign * a
            cx += sign * (((x[:-1] + x[1:]) * cross).sum() / 6 + base[0] * a)
            cy += sign * (((y[:-1] + y[1:]) * cross).sum() / 6 + base[1] * a)
    if total:
        return cx / total, cy / total
    points = np.concatenate([r for p in parts for r in p])
    return float(points[:, 0].mean()), float(points[:, 1].mean())


def _crossing(r: np.ndarray) -> bool:
    """Whether two edges of a closed ring that aren't neighbours meet."""
    a, b = r[:-1], r[1:]
    n = len(a)
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    side = lambda p, q, s: (q[:, 0] - p[:, 0]) * (s[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (s[:, 0] - p[:, 0])
    d1, d2, d3, d4 = side(a[i], b[i], a[j]), side(a[i], b[i], b[j]), side(a[j], b[j], a[i]), side(a[j], b[j], b[i])
    return bool(((d1 * d2 < 0) & (d3 * d4 < 0)).any())


def valid(parts: list[Polygon]) -> bool:
    """Closed rings of three corners at least, with area, without edges that cross."""
    return bool(parts) and all(len(r) >= 4 and np.isfinite(r).all() and (r[0] == r[-1]).all() and ring_area(r) != 0 and not _crossing(r) for p in parts for r in p)


def _peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = points[a], points[b] - points[a]
        mid = points[a + 1 : b] - p
        n2 = float(d @ d)
        t = np.clip(mid @ d / n2, 0, 1) if n2 else np.zeros(len(mid))
        gap = np.hypot(*(mid - t[:, None] * d).T)
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplified(parts: list[Polygon], tolerance: float) -> list[Polygon]:
    """Rings by Douglas and Peucker, split at their farthest point; a ring that would fall apart stays as it is, a small hole goes."""
    out = []
    for p in parts:
        rings = []
        for k, r in enumerate(p):
            far = int(np.hypot(*(r - r[0]).T).argmax())
            new = np.concatenate([_peucker(r[: far + 1], tolerance)[:-1], _peucker(r[far:], tolerance)])
            if len(new) >= 4 and ring_area(new) and not _crossing(new):
                rings.append(new)
            elif k == 0:
                rings.append(r)
        out.append(rings)
    return out


def clipped_ring(r: np.ndarray, convex: np.ndarray) -> np.ndarray | None:
    """A ring cut to a convex ring; None if nothing with area is left."""
    if ring_area(convex) < 0:
        convex = convex[::-1]
    points = list(map(tuple, r[:-1]))
    for (ax, ay), (bx, by) in zip(convex[:-1], convex[1:], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in points]
        out = []
        for k, (p, s) in enumerate(zip(points, side, strict=True)):
            q, t = points[k - 1], side[k - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        points = out
        if len(points) < 3:
            return None
    ring = np.array([*points, points[0]])
    return ring if ring_area(ring) else None


def clipped(parts: list[Polygon], convex: np.ndarray) -> list[Polygon]:
    out = []
    for p in parts:
        rings = [clipped_ring(r, convex) for r in p]
        if rings[0] is not None:
            out.append([r for r in rings if r is not None])
    return out


def _convex(r: np.ndarray) -> bool:
    """Whether a closed ring turns one way only, and once around."""
    d = np.diff(r, axis=0)
    d = d[(d != 0).any(axis=1)]
    after = np.roll(d, -1, axis=0)
    turn = d[:, 0] * after[:, 1] - d[:, 1] * after[:, 0]
    bends = np.arctan2(turn, (d * after).sum(axis=1))
    return bool((turn >= 0).all() or (turn <= 0).all()) and abs(abs(bends.sum()) - 2 * np.pi) < 1e-6


def _crossing_heights(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> list[float]:
    """Heights at which edges of different parts cross."""
    out = []
    for i in range(len(a)):
        j = np.flatnonzero(part > part[i])
        p, q = b[i] - a[i], b[j] - a[j]
        det = p[0] * q[:, 1] - p[1] * q[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = a[j] - a[i]
            t, u = (gap[:, 0] * q[:, 1] - gap[:, 1] * q[:, 0]) / det, (gap[:, 0] * p[1] - gap[:, 1] * p[0]) / det
        t = t[(det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)]
        out += (a[i, 1] + t * p[1]).tolist()
    return out


def convex_pieces(parts: list[Polygon]) -> list[np.ndarray]:
    """Convex closed rings that cover the polygons, holes left out, without overlap: a convex polygon itself, otherwise trapezoids.

    The plane is cut at the height of every corner (and where parts cross); between two cuts the edges run side by
    side, and each part's edges bound its inside in turn."""
    if len(parts) == 1 and len(parts[0]) == 1 and _convex(parts[0][0]):
        return [parts[0][0]]
    a = np.concatenate([r[:-1] for p in parts for r in p])
    b = np.concatenate([r[1:] for p in parts for r in p])
    part = np.concatenate([np.full(len(r) - 1, k) for k, p in enumerate(parts) for r in p])
    heights = np.unique([*a[:, 1], *(_crossing_heights(a, b, part) if len(parts) > 1 else [])])
    slant = a[:, 1] != b[:, 1]
    a, b, part = a[slant], b[slant], part[slant]
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    out = []
    for y0, y1 in zip(heights[:-1], heights[1:], strict=True):
        middle = (y0 + y1) / 2
        at = np.flatnonzero((low < middle) & (high > middle))
        x = lambda y, k: a[k, 0] + (y - a[k, 1]) / (b[k, 1] - a[k, 1]) * (b[k, 0] - a[k, 0])  # noqa: B023, E731
        inside = []
        for k in np.unique(part[at]):
            own = at[part[at] == k]
            own = own[np.argsort(x(middle, own))]
            inside += list(zip(own[::2], own[1::2], strict=False))
        merged: list[list] = []
        for left, right in sorted(inside, key=lambda e: x(middle, e[0])):
            if merged and x(middle, left) <= x(middle, merged[-1][1]):
                merged[-1][1] = max(merged[-1][1], right, key=lambda e: x(middle, e))
            else:
                merged.append([left, right])
        for left, right in merged:
            ring = np.array([(x(y0, left), y0), (x(y0, right), y0), (x(y1, right), y1), (x(y1, left), y1), (x(y0, left), y0)], dtype=float)
            if ring_area(ring):
                out.append(ring)
    return out


class Table(NamedTuple):
    """The rings of many polygons: whose they are, the part in it, their place in it, and where their points are."""

    row: np.ndarray
    part: np.ndarray
    nth: np.ndarray
    start: np.ndarray
    size: np.ndarray
    points: np.ndarray


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start, size) + np.arange(size.sum())


def _bytes_at(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return data[at[:, None] + np.arange(n)].view(kind)[:, 0]


def read_table(column: pa.Array) -> Table:
    """The rings of a column of WKB in order of rows. Plain polygons (little-endian, two dimensions) are read together, others one by one."""
    column = column.cast(pa.large_binary())
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    begin, end = ends[:-1], ends[1:]
    some = np.asarray(column.is_valid()) & (end > begin)
    plain = some & (end - begin >= 9)
    at = np.flatnonzero(plain)
    plain[at] = (data[begin[at]] == 1) & (_bytes_at(data, begin[at] + 1, "<u4") == 3)
    at = np.flatnonzero(plain)
    left, place, found, nth = _bytes_at(data, begin[at] + 5, "<u4").astype(np.int64), begin[at] + 9, [], 0
    while (go := left > nth).any():
        rows, here = at[go], place[go]
        fits = here + 4 <= end[rows]
        n = np.zeros(len(rows), dtype=np.int64)
        n[fits] = _bytes_at(data, here[fits], "<u4")
        fits &= here + 4 + 16 * n <= end[rows]
        plain[rows[~fits]] = False  # cut off: the reader of single ones says so
        found.append((rows[fits], np.full(fits.sum(), nth), here[fits] + 4, n[fits]))
        at, left, place = at[go][fits], left[go][fits], (here + 4 + 16 * n)[fits]
        nth += 1
    row, ring, place, size = (np.concatenate(x) if found else np.empty(0, dtype=np.int64) for x in (zip(*found, strict=True) if found else [()] * 4))
    keep = plain[row]
    row, ring, place, size = row[keep], ring[keep], place[keep], size[keep]
    points = _bytes_at(data, (np.repeat(place, 2 * size) + 8 * _spread(np.zeros(len(size), dtype=np.int64), 2 * size)), "<f8").reshape(-1, 2)
    part, start = np.zeros(len(row), dtype=np.int64), np.cumsum(size) - size
    more: list[tuple[int, int, int, np.ndarray]] = []
    for k in np.flatnonzero(some & ~plain):
        more += [(k, i, j, r) for i, p in enumerate(read_wkb(data[begin[k] : end[k]].tobytes())) for j, r in enumerate(p)]
    if more:
        own = np.array([len(r) for *_, r in more], dtype=np.int64)
        start = np.concatenate([start, len(points) + np.cumsum(own) - own])
        points = np.concatenate([points, *(r for *_, r in more)])
        row, part, ring = (np.concatenate([x, [m[i] for m in more]]) for i, x in enumerate((row, part, ring)))
        size = np.concatenate([size, own])
    order = np.lexsort((ring, part, row))
    return Table(row[order], part[order], ring[order], start[order], size[order], points)


def write_table(t: Table, rows: int, there: np.ndarray | None = None) -> pa.Array:
    """A column of ``rows`` WKB polygons from their rings, which are in order; null where there are none (or where not ``there``: a polygon may have no rings)."""
    multi = np.zeros(rows, dtype=bool)
    multi[t.row[t.part > 0]] = True
    many = {k: [] for k in np.flatnonzero(multi)}
    for row, part, start, size in zip(*(x[multi[t.row]] for x in (t.row, t.part, t.start, t.size)), strict=True):
        if not many[row] or many[row][-1][0] != part:
            many[row].append((part, []))
        many[row][-1][1].append(t.points[start : start + size])
    many = {k: np.frombuffer(write_wkb([rings for _, rings in parts]), dtype=np.uint8) for k, parts in many.items()}
    one = ~multi[t.row]
    row, start, size = t.row[one], t.start[one], t.size[one]
    rings = np.bincount(row, minlength=rows)
    there = rings > 0 if there is None else there
    length = np.bincount(row, weights=4 + 16 * size, minlength=rows).astype(np.int64) + 9 * there
    length[list(many)] = [len(x) for x in many.values()]
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(ends[-1], dtype=np.uint8)
    put = lambda at, values, kind: out.__setitem__(at[:, None] + np.arange(np.dtype(kind).itemsize), np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(len(at), np.dtype(kind).itemsize))
    for k, x in many.items():
        out[ends[k] : ends[k + 1]] = x
    at = np.flatnonzero(there)
    out[ends[at]] = 1
    put(ends[at] + 1, np.full(len(at), 3), "<u4")
    put(ends[at] + 5, rings[at], "<u4")
    # A ring begins behind its row's head and the rings before it.
    before = np.cumsum(4 + 16 * size) - (4 + 16 * size)
    first = np.searchsorted(row, row)
    place = ends[row] + 9 + before - before[first] if len(row) else ends[:0]
    put(place, size, "<u4")
    put(np.repeat(place + 4, 2 * size) + 8 * _spread(np.zeros(len(size), dtype=np.int64), 2 * size), t.points[_spread(start, size)].ravel(), "<f8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [pa.array(length > 0).buffers()[1], pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _alike(t: Table):
    """Rings of equally many points, together: their numbers and an array of rings by points by two."""
    for n in np.unique(t.size):
        at = np.flatnonzero(t.size == n)
        for some in np.array_split(at, -(-len(at) * int(n) // 1_000_000) or 1):
            yield some, t.points[t.start[some][:, None] + np.arange(n)]


def _any_crossing(r: np.ndarray) -> np.ndarray:
    """``_crossing`` of each of several rings of equally many points."""
    n = r.shape[1] - 1
    if n < 4:
        return np.zeros(len(r), dtype=bool)
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    side = lambda p, q, s: (q[..., 0] - p[..., 0]) * (s[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (s[..., 0] - p[..., 0])
    out = []
    for x in np.array_split(r, min(len(r), -(-len(r) * len(i) // 500_000))):
        a, b = x[:, :-1], x[:, 1:]
        d1, d2, d3, d4 = side(a[:, i], b[:, i], a[:, j]), side(a[:, i], b[:, i], b[:, j]), side(a[:, j], b[:, j], a[:, i]), side(a[:, j], b[:, j], b[:, i])
        out.append(((d1 * d2 < 0) & (d3 * d4 < 0)).any(axis=1))
    return np.concatenate(out)


def _cross(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several rings of equally many points: x and y from the first point, and every edge's cross product."""
    x, y = r[..., 0] - r[:, :1, 0], r[..., 1] - r[:, :1, 1]
    return x, y, x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]


def to_wkb(rings: Column) -> Column:
    """WKB of one polygon from its array of rings of (x, y), a batch of rows at a time."""

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        rows = pc.list_parent_indices(column).to_numpy()
        each = column.flatten()
        size = pc.fill_null(pc.list_value_length(each), 0).to_numpy().astype(np.int64)
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        xy = each.flatten()
        points = np.stack([xy.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in (0, 1)], axis=1) if len(xy) else np.empty((0, 2))
        return write_table(Table(rows, np.zeros(len(rows), dtype=np.int64), nth, np.cumsum(size) - size, size, points), len(column), np.asarray(column.is_valid()))

    return encode(rings)


def measures(geom: str | Column) -> Column:
    """Struct of area, length, centre, bounds, vertices and validity; nulls for null or no polygons."""
    names = ("area", "length", "cx", "cy", "xmin", "ymin", "xmax", "ymax")

    @F.arrow_udf(", ".join(f"{n} double" for n in names) + ", vertices long, valid boolean")
    def measure(column: pa.Array) -> pa.Array:
        t, rows = read_table(column), len(column)
        signed, round_, mx, my = np.zeros((4, len(t.row)))
        low, high, fine = np.full((len(t.row), 2), np.inf), np.full((len(t.row), 2), -np.inf), np.zeros(len(t.row), dtype=bool)
        for at, r in _alike(t):
            if not r.shape[1]:
                continue
            with np.errstate(all="ignore"):
                x, y, cross = _cross(r)
                signed[at] = a = cross.sum(axis=1) / 2
                round_[at] = np.hypot(np.diff(r[..., 0], axis=1), np.diff(r[..., 1], axis=1)).sum(axis=1)
                mx[at] = ((x[:, :-1] + x[:, 1:]) * cross).sum(axis=1) / 6 + r[:, 0, 0] * a
                my[at] = ((y[:, :-1] + y[:, 1:]) * cross).sum(axis=1) / 6 + r[:, 0, 1] * a
                low[at], high[at] = r.min(axis=1), r.max(axis=1)
                if r.shape[1] >= 4:
                    fine[at] = np.isfinite(r).all(axis=(1, 2)) & (r[:, 0] == r[:, -1]).all(axis=1) & (a != 0) & ~_any_crossing(r)
        outer = np.where(t.nth == 0, 1.0, -1.0)
        sign = outer * np.where(signed >= 0, 1.0, -1.0)
        total = lambda v: np.bincount(t.row, weights=v, minlength=rows)
        vertices = total(t.size).astype(np.int64)
        some, weight = vertices > 0, total(sign * signed)
        at = np.flatnonzero(some)
        edge = lambda f, v, empty: _reduced(f, v, t.row, rows, empty)
        x0, y0, x1, y1 = edge(np.minimum, low[:, 0], np.inf), edge(np.minimum, low[:, 1], np.inf), edge(np.maximum, high[:, 0], -np.inf), edge(np.maximum, high[:, 1], -np.inf)
        with np.errstate(all="ignore"):
            cx, cy = total(sign * mx) / weight, total(sign * my) / weight
        for k in at[weight[at] == 0]:  # no area: the centre of the points
            own = np.concatenate([t.points[t.start[i] : t.start[i] + t.size[i]] for i in np.flatnonzero(t.row == k)])
            cx[k], cy[k] = own.mean(axis=0)
        valid_ = edge(np.minimum, fine.astype(np.int64), 1) > 0
        columns = [total(outer * np.abs(signed)), total(round_), cx, cy, x0, y0, x1, y1, vertices, valid_]
        return pa.StructArray.from_arrays([pa.array(c, mask=~some) for c in columns], names=[*names, "vertices", "valid"])

    return measure(geom)


def _reduced(f: np.ufunc, values: np.ndarray, row: np.ndarray, rows: int, empty) -> np.ndarray:
    out = np.full(rows, empty, dtype=values.dtype)
    f.at(out, row, values)
    return out


def _kept(t: Table, tolerance: float) -> np.ndarray:
    """Which points of all rings Douglas and Peucker's rule keeps, every ring split at its farthest point; all rings take their steps together."""
    keep = np.zeros(len(t.points), dtype=bool)
    ends = [], []
    for at, r in _alike(t):
        if r.shape[1]:
            far = np.hypot(*np.moveaxis(r - r[:, :1], 2, 0)).argmax(axis=1)
            for i, j in ((t.start[at], t.start[at] + far), (t.start[at] + far, t.start[at] + r.shape[1] - 1)):
                ends[0].append(i), ends[1].append(j)
    a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in ends)
    keep[a], keep[b] = True, True
    while len(a):
        a, b = a[b - a >= 2], b[b - a >= 2]
        if not len(a):
            break
        n = b - a - 1
        at, of = _spread(a + 1, n), np.repeat(np.arange(len(a)), n)
        with np.errstate(all="ignore"):
            d = (t.points[b] - t.points[a])[of]
            mid, n2 = t.points[at] - t.points[a][of], (d * d).sum(axis=1)
            along = np.where(n2 != 0, np.clip((mid * d).sum(axis=1) / n2, 0, 1), 0.0)
            gap = np.hypot(*(mid - along[:, None] * d).T)
        first = np.cumsum(n) - n
        most = np.maximum.reduceat(gap, first)
        k = np.minimum.reduceat(np.where(gap == most[of], at, len(t.points)), first)
        cut = most > tolerance
        a, b, k = a[cut], b[cut], k[cut]
        keep[k] = True
        a, b = np.concatenate([a, k]), np.concatenate([k, b])
    return keep


def simplify(geom: str | Column, tolerance: float) -> Column:
    """``simplified`` of every row, a batch of rows at a time."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        t = read_table(column)
        keep = _kept(t, tolerance)
        before = np.concatenate([[0], np.cumsum(keep)])
        start, size = before[t.start], before[t.start + t.size] - before[t.start]
        new = Table(t.row, t.part, t.nth, start, size, t.points[keep])
        fine = np.zeros(len(t.row), dtype=bool)
        for at, r in _alike(new):
            if r.shape[1] >= 4:
                fine[at] = (_cross(r)[2].sum(axis=1) != 0) & ~_any_crossing(r)
        # A ring that would fall apart stays as it is if it is an outer one; a hole goes.
        old = ~fine & (t.nth == 0)
        points = np.concatenate([new.points, t.points]) if old.any() else new.points
        some = fine | old
        start, size = np.where(old, len(new.points) + t.start, start)[some], np.where(old, t.size, size)[some]
        return write_table(Table(t.row[some], t.part[some], t.nth[some], start, size, points), len(column))

    return run(geom)


def clip_to(geom: str | Column, pieces: list[np.ndarray]) -> Column:
    """The polygons cut to the convex pieces of an area, one part for each piece that they meet; null where nothing with area is left."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda data: None if data is None else write_wkb([x for parts in [read_wkb(data)] for piece in pieces for x in clipped(parts, piece)]))

    return run(geom)


def clip(geom: str | Column, convex: list[tuple[float, float]]) -> Column:
    """The polygons cut to a convex area; null where nothing with area is left."""
    ring = np.array([*convex, convex[0]] if tuple(convex[0]) != tuple(convex[-1]) else convex, dtype=float)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda data: None if data is None else write_wkb(clipped(read_wkb(data), ring)))

    return run(geom)
