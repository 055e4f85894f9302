"""Which blocks a frame can see, decided for whole cubes of blocks at a time.

Blocks lie sorted along a Morton curve, so a cube of them is a run.  A frame starts at the largest cubes and goes down only
into those of which it cannot say that no voxel in them is seen, or that all of them must be looked at; so its work and
memory follow the blocks in its view.  A domain that is a box needs no list of blocks at all: its cubes are halved as they
are met.

A cube's verdict follows from the camera coordinates of its eight extreme voxel centres, for everything that is asked is
linear, or a quotient with a positive denominator, in the position.  Cubes above one block are judged with room to spare,
so rounding never lets a cube say what one of its blocks would not.
"""

from __future__ import annotations

import numpy as np

from scanengine.functions import geometry as g

SEEN, BEHIND, OUTSIDE, HIDDEN = 0, 1, 2, 3
_SPLIT, _WHOLE = -1, -2
#: Cubes judged at once, so that their corners' arrays stay small.
JUDGED = 16_384
#: Pixels along a side of the tiles whose largest depth is kept.
TILE = 8


def morton(b: np.ndarray) -> np.ndarray:
    """Each block's place on a Morton curve through all of them; up to 21 bits an axis."""
    at = b.astype(np.int64) - b.min(0) if len(b) else b.astype(np.int64)
    code = np.zeros(len(b), np.int64)
    for bit in range(int(at.max()).bit_length() if len(b) else 0):
        for axis in range(3):
            code |= (at[:, axis] >> bit & 1) << (3 * bit + axis)
    return code


class Cubes:
    """Blocks in Morton order and the cubes above them, each with the bounds of its blocks and the run of its children."""

    def __init__(self, blocks: np.ndarray):
        code = morton(blocks)
        order = np.argsort(code, kind="stable")
        self.blocks, code = np.ascontiguousarray(blocks[order], np.int32), code[order]
        #: from the bottom: where each cube's children begin in the level below, and its lowest and highest block
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = high = self.blocks
        while len(low) > 8:
            code = code >> 3
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            low, high, code = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), code[first]
            self.levels.append((np.append(first, len(self.levels[-1][1]) if self.levels else len(self.blocks)), low, high))

    def verdicts(self, m: np.ndarray, cam: g.Camera, grid: g.Grid, depths: Depths | None = None, named: bool = True) -> np.ndarray:
        """A verdict for each block, in the order of `blocks`: what each would say on its own.  With depths, blocks behind all
        that was measured are hidden; unless the verdicts are to be named, a hidden cube is so even where blocks of it lie
        outside of the image."""
        out = np.zeros(len(self.blocks), np.int8)
        level = len(self.levels) - 1
        at = np.arange(len(self.levels[level][1]) if self.levels else len(self.blocks))
        while level >= 0 and len(at):
            first, low, high = self.levels[level]
            said = judged(low[at], high[at], m, cam, grid, depths, True, named)
            final = said != _SPLIT
            if final.any():
                begin, end = first[at[final]], first[at[final] + 1]
                for below in range(level - 1, -1, -1):
                    begin, end = self.levels[below][0][begin], self.levels[below][0][end]
                out[_runs(begin, end)] = np.repeat(np.maximum(said[final], SEEN), end - begin)
            at = _runs(first[at[~final]], first[at[~final] + 1])
            level -= 1
        if len(at):
            out[at] = judged(self.blocks[at], self.blocks[at], m, cam, grid, depths, False)
        return out


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of some runs, one run after another."""
    many = end - begin
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


class Depths:
    """The largest reading in any rectangle of tiles of an image, in constant time: windows of 2^i by 2^j tiles keep theirs, and
    four of them cover a rectangle."""

    def __init__(self, image: np.ndarray, cam: g.Camera):
        image = image.reshape(cam.height, cam.width)
        rows, columns = np.arange(0, cam.height, TILE), np.arange(0, cam.width, TILE)
        tiles = np.maximum.reduceat(np.maximum.reduceat(np.maximum(image, 0), rows, 0), columns, 1)
        self.scale, (n, k) = cam.scale, tiles.shape
        self.windows = np.zeros((n.bit_length(), k.bit_length(), n, k), np.int64)
        self.windows[0, 0] = tiles
        for i in range(n.bit_length()):
            if i:
                half = 1 << (i - 1)
                self.windows[i, 0] = self.windows[i - 1, 0]
                self.windows[i, 0, :-half] = np.maximum(self.windows[i - 1, 0, :-half], self.windows[i - 1, 0, half:])
            for j in range(1, k.bit_length()):
                half = 1 << (j - 1)
                self.windows[i, j] = self.windows[i, j - 1]
                self.windows[i, j, :, :-half] = np.maximum(self.windows[i, j - 1, :, :-half], self.windows[i, j - 1, :, half:])

    def largest(self, v0: np.ndarray, v1: np.ndarray, u0: np.ndarray, u1: np.ndarray) -> np.ndarray:
        """Metres, 0 without a reading, over the tiles that pixels v0 to v1, u0 to u1 lie in; ends included."""
        r0, r1, c0, c1 = (x // TILE for x in (v0, v1, u0, u1))
        i, j = (np.frexp((b - a + 1).astype(np.float64))[1] - 1 for a, b in ((r0, r1), (c0, c1)))
        r1, c1 = r1 - (1 << i) + 1, c1 - (1 << j) + 1
        w = self.windows
        raw = np.maximum(np.maximum(w[i, j, r0, c0], w[i, j, r0, c1]), np.maximum(w[i, j, r1, c0], w[i, j, r1, c1]))
        return raw.astype(np.float64) * self.scale


def judged(low: np.ndarray, high: np.ndarray, m: np.ndarray, cam: g.Camera, grid: g.Grid, depths: Depths | None, spare: bool, named: bool = False) -> np.ndarray:
    """Verdicts of cubes from their lowest to their highest block.  spare: leave out what is close, and say which cubes must
    be gone into (_SPLIT) and which lie in view as a whole (_WHOLE).  named: only the latter are hidden as a whole."""
    out = np.empty(len(low), np.int8)
    for k in range(0, len(low), JUDGED):
        some = slice(k, k + JUDGED)
        out[some] = _judged(low[some], high[some], m, cam, grid, depths, spare, named)
    return out


def _judged(low: np.ndarray, high: np.ndarray, m: np.ndarray, cam: g.Camera, grid: g.Grid, depths: Depths | None, spare: bool, named: bool) -> np.ndarray:
    ends = (np.stack([low, high], 2).astype(np.float64) * g.SIDE + np.array([0, 7]) + 0.5) * grid.voxel  # cube, axis, end
    d = ends - m[[3, 7, 11]][None, :, None]
    slack = 1e-9 * (1.0 + np.abs(d).max((1, 2)))
    x, y, z = (
        (m[i] * d[:, 0, :, None, None] + m[i + 4] * d[:, 1, None, :, None] + m[i + 8] * d[:, 2, None, None, :]).reshape(len(low), 8) for i in range(3)
    )
    out = np.full(len(low), _SPLIT if spare else SEEN, np.int8)
    if not (abs(cam.fx) <= 1e4 and abs(cam.fy) <= 1e4 and max(cam.width, cam.height, abs(cam.cx), abs(cam.cy)) <= 1e5):
        return out
    room = 2 * slack if spare else slack
    near = z.min(1)
    ahead = near > room
    # an edge's margin: how far rounding can move its test
    edge = slack * (abs(cam.fx) + abs(cam.fy) + cam.width + cam.height + abs(cam.cx) + abs(cam.cy)) if spare else 0.0
    aside, within = np.zeros(len(low), bool), ahead.copy()
    for side in (
        cam.fx * x + (cam.cx + 0.5 + 0.5) * z,
        -(cam.fx * x + (cam.cx - (cam.width - 0.5) - 0.5) * z),
        cam.fy * y + (cam.cy + 0.5 + 0.5) * z,
        -(cam.fy * y + (cam.cy - (cam.height - 0.5) - 0.5) * z),
    ):
        aside |= side.max(1) < -edge
        within &= side.min(1) > edge
    out[ahead & aside] = OUTSIDE
    out[z.max(1) < -room] = BEHIND
    if depths is None:
        if spare:
            out[within] = _WHOLE
        return out
    at = np.flatnonzero((out <= SEEN) & (within if spare and named else ahead))
    if len(at):
        u, v = cam.fx * x[at] / z[at] + cam.cx, cam.fy * y[at] / z[at] + cam.cy
        clip = lambda a, n: np.clip(a, 0, n - 1).astype(np.int64)
        spans = [clip(np.floor(c.min(1) + 0.5) - 1, n) if first else clip(np.floor(c.max(1) + 0.5) + 1, n) for c, n in ((v, cam.height), (u, cam.width)) for first in (True, False)]
        out[at[near[at] - slack[at] > depths.largest(*spans) + grid.truncation]] = HIDDEN
    return out


Box = tuple[np.ndarray, np.ndarray]


def blocks_in_view(box: Box, m: np.ndarray, cam: g.Camera, grid: g.Grid, depths: Depths | None) -> tuple[np.ndarray, int]:
    """The blocks of a box (its lowest and highest block) that a frame must look at, and how many cubes it judged for that."""
    first, last = (np.asarray(x, np.int64) for x in box)
    if (last < first).any():
        return np.zeros((0, 3), np.int64), 0
    side = 1 << int((last - first).max()).bit_length()
    at, seen = first[None], 0
    child = np.array([[k & 1, k >> 1 & 1, k >> 2] for k in range(8)])
    while True:
        high = np.minimum(at + side - 1, last)
        said = judged(at, high, m, cam, grid, depths, side > 1)
        seen += len(at)
        at = at[(said == _SPLIT) | (said == _WHOLE) | (said == SEEN)]
        if side == 1 or not len(at):
            return at, seen
        side //= 2
        at = (at[:, None] + child * side).reshape(-1, 3)
        at = at[(at <= last).all(1)]
