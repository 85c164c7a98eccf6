"""Plane geometry in numpy for what has no Column expression."""

from __future__ import annotations

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise, by Andrew's monotone chain."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def ring_area(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, float).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def centroid(ring: np.ndarray) -> tuple[float, float]:
    x, y = np.asarray(ring, float).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if abs(cross.sum()) < 1e-300:
        return float(x.mean()), float(y.mean())
    return tuple(float(((v + np.roll(v, -1)) * cross).sum() / (3 * cross.sum())) for v in (x, y))


def clip(ring: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a convex or simple ring with a x + b y <= c (Sutherland-Hodgman)."""
    ring = np.asarray(ring, float)
    if not len(ring):
        return ring
    side = ring @ np.array([a, b]) - c
    out = []
    for p, q, s, t in zip(ring, np.roll(ring, -1, 0), side, np.roll(side, -1), strict=True):
        if s <= 0:
            out.append(p)
        if (s < 0 < t) or (t < 0 < s):
            out.append(p + (q - p) * (s / (s - t)))
    return np.array(out).reshape(-1, 2)


def clip_to(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Overlap of a simple ring with a convex one given counter-clockwise."""
    for (ax, ay), (bx, by) in zip(convex, np.roll(convex, -1, 0), strict=True):
        a, b = by - ay, ax - bx
        ring = clip(ring, a, b, a * ax + b * ay)
    return ring


def voronoi_cell(i: int, points: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Cell of point i clipped to a ring: half-planes taken from the nearest point on, until no other can reach the cell."""
    p = points[i]
    d = np.hypot(*(points - p).T)
    cell = np.asarray(region, float)
    for j in np.argsort(d, kind="stable"):
        if d[j] == 0:
            continue
        if not len(cell) or d[j] > 2 * np.hypot(*(cell - p).T).max():
            break
        normal = points[j] - p
        cell = clip(cell, *normal, float(normal @ (points[j] + p) / 2))
    return cell


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) by Bowyer and Watson's insertion."""
    points = np.asarray(points, float)
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    middle, span = points.mean(0), max(np.ptp(points, axis=0).max(), 1e-9) * 1e4
    p = np.vstack([points, middle + [[-span, -span], [span, -span], [0, span]]])

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = p[t[0]], p[t[1]], p[t[2]]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-300:
            return ax, ay, np.inf
        ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    triangles, circles = [(n, n + 1, n + 2)], [circle((n, n + 1, n + 2))]
    for i in np.lexsort((points[:, 1], points[:, 0])):
        c = np.array(circles)
        bad = np.flatnonzero((c[:, 0] - p[i, 0]) ** 2 + (c[:, 1] - p[i, 1]) ** 2 < c[:, 2] * (1 - 1e-12))
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            a, b, d = triangles[t]
            for e in ((a, b), (b, d), (d, a)):
                key = (min(e), max(e))
                edges[key] = edges.get(key, 0) + 1
        gone = set(bad.tolist())
        triangles = [t for k, t in enumerate(triangles) if k not in gone]
        circles = [x for k, x in enumerate(circles) if k not in gone]
        for (a, b), times in edges.items():
            if times == 1:
                triangles.append((a, b, int(i)))
                circles.append(circle(triangles[-1]))
    return np.array([t for t in triangles if max(t) < n], int).reshape(-1, 3)


class Mesh:
    """A Delaunay triangulation of which single triangles are found, in a search index of distinct places (``pairs.Index``).

    Corners beyond all rows close it, as in ``delaunay``. Rows on one circle are cut
    into triangles from the one of the smallest id, whichever of them is asked.
    """

    def __init__(self, index):
        self.index, self.n = index, index.n
        p = np.column_stack([index.x[: self.n], index.y[: self.n]])
        middle, span = (p.mean(0), max(np.ptp(p, axis=0).max(), 1e-9) * 1e4) if self.n else (np.zeros(2), 1.0)
        self.p = np.vstack([p, middle + [[-span, -span], [span, -span], [0, span]]])
        self.outer = np.arange(self.n, self.n + 3)

    def left_of(self, a: int, b: int, near: np.ndarray) -> int:
        """The third corner of the triangle left of the edge from a to b; ``near`` are rows to begin with."""
        p, q = self.p[a], self.p[b]
        cand, found = np.concatenate([near, self.outer]), None
        while True:
            u, v = self.p[cand] - p, self.p[cand] - q
            cross = (q[0] - p[0]) * u[:, 1] - (q[1] - p[1]) * u[:, 0]
            ok = (cross > 0) & (cand != a) & (cand != b)
            if not ok.any():
                return -1 if found is None else found
            cand, height = cand[ok], (u * v).sum(1)[ok] / cross[ok]
            found = int(cand[height.argmin()])
            centre, r2 = self._circle(a, b, found)
            r = np.sqrt(r2) * (1 + 1e-9)
            inside = self.index.box(centre[0] - r, centre[0] + r, centre[1] - r, centre[1] + r)
            inside = np.concatenate([inside, self.outer])
            d2 = ((self.p[inside] - centre) ** 2).sum(1)
            other = (inside != a) & (inside != b) & (inside != found)
            better = inside[(d2 < r2 * (1 - 1e-12)) & other]
            if not len(better):
                break
            u = self.p[better] - p
            if not ((q[0] - p[0]) * u[:, 1] - (q[1] - p[1]) * u[:, 0] > 0).any():
                break
            cand = better
        round_ = inside[(d2 <= r2 * (1 + 1e-12)) & other & (inside < self.n)]
        if not len(round_) or max(a, b, found) >= self.n:
            return found
        ring = np.concatenate([[a, b, found], round_])
        least = int(ring[self.index.order[ring].argmin()])
        if least not in (a, b):
            return least
        rest = ring[2:]
        angle = np.arctan2(*(self.p[rest] - centre).T[::-1]) - np.arctan2(*(p - centre)[::-1])
        along = np.mod(angle, 2 * np.pi)
        side = rest[(q[0] - p[0]) * (self.p[rest, 1] - p[1]) - (q[1] - p[1]) * (self.p[rest, 0] - p[0]) > 0]
        along = along[np.isin(rest, side)]
        return int(side[along.argmin()] if least == a else side[along.argmax()])

    def _circle(self, a: int, b: int, c: int) -> tuple[np.ndarray, float]:
        p = self.p[a]
        (bx, by), (cx, cy) = self.p[b] - p, self.p[c] - p
        d = 2 * (bx * cy - by * cx)
        u = np.array([cy * (bx * bx + by * by) - by * (cx * cx + cy * cy), bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)]) / d
        return p + u, float(u @ u)

    def neighbours(self, i: int, near: np.ndarray) -> set[int]:
        """Rows that share a triangle's edge with row i; ``near`` are its nearest rows, the nearest first."""
        if not len(near):
            return set()
        out, first = set(), int(near[0])
        j = first
        while True:
            k = self.left_of(i, j, near)
            if k < 0:
                raise ValueError(f"no triangle beside row {self.index.id[i]}")
            if max(j, k) < self.n:
                out |= {j, k}
            j = k
            if j == first:
                return out
            if len(out) > self.n:
                raise ValueError(f"triangles about row {self.index.id[i]} don't close")

    def triangle(self, at: np.ndarray, near: np.ndarray) -> tuple[int, int, int] | None:
        """Corners of the triangle that holds a place, none outside the rows' hull; by a walk from the nearest row."""
        if len(near) < 2:
            return None
        a = int(near[0])
        d = ((self.p[near[1:]] - self.p[a]) ** 2).sum(1)
        r = float(np.sqrt(d.min())) * (1 + 1e-9)
        close = self.index.box(self.p[a, 0] - r, self.p[a, 0] + r, self.p[a, 1] - r, self.p[a, 1] + r)
        close = close[close != a]
        b = int(close[np.lexsort((self.index.order[close], ((self.p[close] - self.p[a]) ** 2).sum(1)))[0]])
        side = lambda s, t: (self.p[t, 0] - self.p[s, 0]) * (at[1] - self.p[s, 1]) - (self.p[t, 1] - self.p[s, 1]) * (at[0] - self.p[s, 0])
        if side(a, b) < 0:
            a, b = b, a
        for _ in range(4 * self.n + 100):
            c = self.left_of(a, b, near)
            if c < 0:
                return None
            if side(b, c) < 0:
                a, b = c, b
            elif side(c, a) < 0:
                a, b = a, c
            else:
                return (a, b, c) if max(a, b, c) < self.n else None
        raise ValueError("the walk to a triangle doesn't end")


def triangle_edges(triangles: np.ndarray) -> set[tuple[int, int]]:
    return {(int(min(t[a], t[b])), int(max(t[a], t[b]))) for t in triangles for a, b in ((0, 1), (1, 2), (2, 0))}


def barycentric(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Shares of a triangle's corners (3, 2) at points (n, 2)."""
    m = np.array([corners[1] - corners[0], corners[2] - corners[0]]).T
    u = np.linalg.solve(m, (p - corners[0]).T).T
    return np.column_stack([1 - u.sum(1), u])


def inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(np.shape(x), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
        if ay != by:
            out ^= (y > min(ay, by)) & (y <= max(ay, by)) & (x < (y - ay) * (bx - ax) / (by - ay) + ax)
    return out


def set_covariance_table(ring: np.ndarray, resolution: int = 256) -> tuple[np.ndarray, float]:
    """Overlap areas of a polygon with itself moved by (column - middle, row - middle) steps, by FFT; and the step."""
    ring = np.asarray(ring, float)
    lo, hi = ring.min(0), ring.max(0)
    step = float((hi - lo).max() / resolution)
    nx, ny = (np.ceil((hi - lo) / step - 1e-9)).astype(int)
    x, y = np.meshgrid(lo[0] + (np.arange(nx) + 0.5) * step, lo[1] + (np.arange(ny) + 0.5) * step)
    mask = inside(ring, x, y).astype(float)
    f = np.fft.rfft2(mask, (2 * ny, 2 * nx))
    table = np.fft.fftshift(np.fft.irfft2(f * f.conj(), (2 * ny, 2 * nx)))
    return table * step * step, step
