"""Column builders for calibrated cameras and voxel blocks.

Every sum of products is written term by term, so each result has the same bits wherever it is computed; nothing here
divides before a gate says it may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Voxels along a block's side.
SIDE = 8


@dataclass(frozen=True)
class Camera:
    """A pinhole depth camera without distortion; scale turns raw depth into metres."""

    width: int = 32
    height: int = 24
    fx: float = 24.0
    fy: float = 24.0
    cx: float = 15.5
    cy: float = 11.5
    scale: float = 0.001

    def __post_init__(self) -> None:
        if not (self.fx > 0 and self.fy > 0 and 0 <= self.cx < self.width and 0 <= self.cy < self.height):
            raise ValueError("a camera needs positive focal lengths and its centre inside the image")


@dataclass(frozen=True)
class Grid:
    """A voxel grid anchored at the world's origin: voxel size and truncation in metres."""

    voxel: float
    truncation: float

    def __post_init__(self) -> None:
        if not (self.voxel > 0 and self.truncation >= self.voxel):
            raise ValueError("truncation must be at least a voxel")

    @property
    def extent(self) -> float:
        return self.voxel * SIDE


def lit(x: float) -> Column:
    return F.lit(float(x))


def metric(raw: Column, cam: Camera) -> Column:
    """One conversion and one multiplication."""
    return raw.cast("double") * lit(cam.scale)


def camera_point(u: Column, v: Column, z: Column, cam: Camera) -> tuple[Column, Column]:
    return (u - lit(cam.cx)) * z / lit(cam.fx), (v - lit(cam.cy)) * z / lit(cam.fy)


def transform(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A row-major 3x4 rigid transform, term by term."""
    row = lambda i: m[i] * x + m[i + 1] * y + m[i + 2] * z + m[i + 3]
    return row(0), row(4), row(8)


def inverse_transform(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """P5: the transposed rotation applied to the point less the translation."""
    dx, dy, dz = x - m[3], y - m[7], z - m[11]
    col = lambda i: m[i] * dx + m[i + 4] * dy + m[i + 8] * dz
    return col(0), col(1), col(2)


def rotate(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The rotation alone, as for normals."""
    row = lambda i: m[i] * x + m[i + 1] * y + m[i + 2] * z
    return row(0), row(4), row(8)


def pose(prefix: str = "m") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(12)]


def block_of(c: Column, extent: float) -> Column:
    """P10: the block that holds a coordinate: floor, corrected by multiplying back."""
    e = lit(extent)
    i = F.floor(c / e)
    return F.when(i * e > c, i - 1).when((i + 1) * e <= c, i + 1).otherwise(i)


def span_of(c: Column, extent: float, reach: float) -> tuple[Column, Column]:
    """First and last block within reach of a coordinate, outward where rounding leaves doubt."""
    e, r = lit(extent), lit(reach)
    lo, hi = F.floor((c - r) / e), F.ceil((c + r) / e)
    lo = F.when(lo * e > c - r, lo - 1).otherwise(lo)
    hi = F.when(hi * e < c + r, hi + 1).otherwise(hi)
    return lo, hi - 1


def block_part(g: Column) -> Column:
    """Block of a global voxel index (floors for negatives)."""
    return F.shiftright(g.cast("long"), 3)


def local_part(g: Column) -> Column:
    return F.pmod(g.cast("long"), F.lit(SIDE))


def centre(g: Column, voxel: float) -> Column:
    """A voxel's centre along one axis."""
    return (g.cast("double") + lit(0.5)) * lit(voxel)


def projected(c: Column, z: Column, f: float, centre_px: float) -> Column:
    """Pixel coordinate; null unless z is positive."""
    return F.when(z > 0, lit(f) * c / z + lit(centre_px))


def in_image(u: Column, size: int) -> Column:
    return (u >= lit(-0.5)) & (u < lit(size - 0.5))


def nearest_pixel(u: Column) -> Column:
    return F.floor(u + lit(0.5)).cast("int")


def truncated(sd: Column, truncation: float) -> Column:
    """A signed distance in truncations, at most 1; beyond +1 it still counts, as 1."""
    return F.least(lit(1.0), F.greatest(lit(-1.0), sd / lit(truncation)))


def normalised(total: Column, weight: Column) -> Column:
    """The mean signed distance; null where nothing was observed."""
    return F.when(weight > 0, total / weight)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def quaternion_matrix(qx: Column, qy: Column, qz: Column, qw: Column) -> list[Column]:
    """The 3x3 rotation, row-major, of a quaternion of any length but zero."""
    n = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    x, y, z, w = qx / n, qy / n, qz / n, qw / n
    two = lit(2.0)
    return [
        lit(1.0) - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), lit(1.0) - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), lit(1.0) - two * (x * x + y * y),
    ]


def compose(a: list[Column], b: list[Column]) -> list[Column]:
    """The product of two 3x4 rigid transforms."""
    out = []
    for i in (0, 4, 8):
        for j in range(4):
            term = a[i] * b[j] + a[i + 1] * b[4 + j] + a[i + 2] * b[8 + j]
            out.append(term + a[i + 3] if j == 3 else term)
    return out


def inverse(m: list[Column]) -> list[Column]:
    """The inverse of a rigid transform."""
    t = lambda i: -(m[i] * m[3] + m[i + 4] * m[7] + m[i + 8] * m[11])
    return [m[0], m[4], m[8], t(0), m[1], m[5], m[9], t(1), m[2], m[6], m[10], t(2)]


def is_rigid(m: list[Column], tolerance: float = 1e-5) -> Column:
    """Orthonormal rotation with determinant +1, within a tolerance, all finite."""
    rows = [(m[0], m[1], m[2]), (m[4], m[5], m[6]), (m[8], m[9], m[10])]
    near = lambda x, y: F.abs(x - lit(y)) <= lit(tolerance)
    ok = F.lit(True)
    for x in m:
        ok = ok & ~F.isnan(x) & (F.abs(x) < lit(1e300))
    for i in range(3):
        for j in range(i, 3):
            ok = ok & near(dot(rows[i], rows[j]), 1.0 if i == j else 0.0)
    return ok & near(dot(rows[0], cross(rows[1], rows[2])), 1.0)


def point_triangle_squared(p: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """Squared distance from a point to a triangle: to its plane where the foot falls inside, else to an edge."""
    sub = lambda x, y: tuple(i - j for i, j in zip(x, y))

    def to_edge(q: tuple, r: tuple) -> Column:
        d, w = sub(r, q), sub(p, q)
        dd = dot(d, d)
        t = F.when(dd > 0, F.least(lit(1.0), F.greatest(lit(0.0), dot(w, d) / dd))).otherwise(lit(0.0))
        off = tuple(w[k] - t * d[k] for k in range(3))
        return dot(off, off)

    n = cross(sub(b, a), sub(c, a))
    nn = dot(n, n)
    side = lambda q, r: dot(cross(sub(r, q), sub(p, q)), n)
    inside = (nn > 0) & (side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0)
    h = dot(sub(p, a), n)
    return F.when(inside, h * h / F.when(nn > 0, nn)).otherwise(F.least(to_edge(a, b), to_edge(b, c), to_edge(c, a)))
