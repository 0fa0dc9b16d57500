"""Numeric functions as column expressions: vectors, Morton codes, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MORTON_BITS = 21
POINT_SCALE = 500.0
# What spreads the low 21 bits of a number to every third bit, as (shift, mask).
SPREAD_21 = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def spread(c: Column) -> Column:
    out = c.cast("long").bitwiseAND(F.lit((1 << MORTON_BITS) - 1))
    for shift, mask in SPREAD_21:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def grid(c: Column, center: Column, half: Column, bits: int = MORTON_BITS) -> Column:
    """The cell of a coordinate in a cube, 0 to 2^bits - 1."""
    unit = (c - (center - half)) / (half * 2.0)
    return F.least(F.greatest(F.floor(unit * float(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def morton_of_cells(x: Column, y: Column, z: Column) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def morton(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column, half: Column, bits: int = MORTON_BITS) -> Column:
    """Z-order code of a point in a cube: 3 times ``bits`` bits, x lowest."""
    return morton_of_cells(*(grid(p, c, half, bits) for p, c in ((x, cx), (y, cy), (z, cz))))


def digit(code: Column, level: int, levels: int = MORTON_BITS) -> Column:
    """The octant, 0 to 7, that a code takes below ``level``."""
    return F.shiftright(code, 3 * (levels - 1 - level)).bitwiseAND(F.lit(7).cast("long"))


def child_center(center: Column, half: Column, octant: Column, axis: int) -> Column:
    up = F.shiftright(octant, axis).bitwiseAND(F.lit(1).cast("long"))
    return center + half / 2.0 * (2 * up - 1)


def separation(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], three_d: bool) -> tuple[Column, Column, Column, Column]:
    """a - b and its length; without z in two dimensions."""
    dx, dy = a[0] - b[0], a[1] - b[1]
    dz = a[2] - b[2] if three_d else F.lit(0.0)
    return dx, dy, dz, F.sqrt(dx * dx + dy * dy + dz * dz)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment in a plane; from its point where it has no length. Taken from the start
    of the segment, the shift along it is subtracted last, as in SQL: adding it to the start first rounds otherwise,
    and near 0 that decides between segments."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length2 > 0, F.least(F.greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length2, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    x, y = px - ax - t * (bx - ax), py - ay - t * (by - ay)
    return F.sqrt(x * x + y * y)


def point_diameter(size: Column, z: Column) -> Column:
    """On screen; 0 at or behind the camera, which looks along falling z."""
    return F.when(z < 0, size * POINT_SCALE / -z).otherwise(F.lit(0.0))


def clear_color(c: Column) -> Column:
    return c / 255.0


def millis_per_step(seconds: Column, steps: Column) -> Column:
    return F.when(steps > 0, seconds * 1000.0 / steps).otherwise(F.lit(0.0))


def view_projection(pitch: float, yaw: float, eye: tuple[float, float, float], fov: float, aspect: float, near: float, far: float) -> list[list[float]]:
    """Right-handed perspective, depth 0 to 1, times a turn about x, a turn about y and a shift; row by row,
    for column vectors. Folded on the driver to sixteen numbers."""
    cx, sx, cy, sy = math.cos(pitch), math.sin(pitch), math.cos(yaw), math.sin(yaw)
    f = 1 / math.tan(fov / 2)
    project = [[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, far / (near - far), near * far / (near - far)], [0, 0, -1, 0]]
    turn_x = [[1, 0, 0, 0], [0, cx, -sx, 0], [0, sx, cx, 0], [0, 0, 0, 1]]
    turn_y = [[cy, 0, sy, 0], [0, 1, 0, 0], [-sy, 0, cy, 0], [0, 0, 0, 1]]
    shift = [[1, 0, 0, eye[0]], [0, 1, 0, eye[1]], [0, 0, 1, eye[2]], [0, 0, 0, 1]]

    def times(a, b):
        return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]

    return times(times(times(project, turn_x), turn_y), shift)


def project(matrix: list[list[float]], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """Clip coordinates of a point."""
    return tuple(sum((F.lit(float(m)) * c for m, c in zip(row[1:3], (y, z))), F.lit(float(row[0])) * x) + F.lit(float(row[3])) for row in matrix)
