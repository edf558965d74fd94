"""Rotations, poses and projections as Column expressions.

A quaternion is a 4-tuple (w, x, y, z) of Columns, a vector a 3-tuple, a matrix a 3-tuple of
row vectors. ``named`` turns a tuple into aliased columns, so each step of a chain can be a
projection of its own and Catalyst computes it once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]
Mat = tuple[Vec, Vec, Vec]

TINY = 1e-12
SMALL_ANGLE = 1e-8
NEAREST_DEPTH = 1e-6


def vec(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def named(values: tuple[Column, ...], *names: str) -> dict[str, Column]:
    return dict(zip(names, values, strict=True))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def length(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: tuple[Column, ...], by: Column) -> tuple[Column, ...]:
    return tuple(x * by for x in a)


def plus(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def minus(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def quat_normalise(q: Quat) -> Quat:
    """Unit quaternion; the zero quaternion stays zero."""
    size = F.greatest(length(q), F.lit(TINY))
    return tuple(c / size for c in q)


def quat_conjugate(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def quat_multiply(a: Quat, b: Quat) -> Quat:
    real = a[0] * b[0] - dot(a[1:], b[1:])
    turn = cross(a[1:], b[1:])
    return (real, *[a[0] * b[i + 1] + b[0] * a[i + 1] + turn[i] for i in range(3)])


def quat_rotate(q: Quat, p: Vec) -> Vec:
    """Rotate ``p`` by a unit quaternion without building a matrix."""
    t = scaled(cross(q[1:], p), 2.0)
    u = cross(q[1:], t)
    return tuple(p[i] + q[0] * t[i] + u[i] for i in range(3))


def align_hemisphere(q: Quat, reference: Quat) -> Quat:
    sign = F.when(dot(q, reference) < 0, -1.0).otherwise(1.0)
    return scaled(q, sign)


def nlerp(a: Quat, b: Quat, share: Column) -> Quat:
    near = align_hemisphere(b, a)
    return quat_normalise(tuple(x + (y - x) * share for x, y in zip(a, near, strict=True)))


def quat_to_matrix(q: Quat) -> Mat:
    """Rotation matrix of a unit quaternion."""
    w, x, y, z = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def unit_pose(q: Quat) -> Quat:
    """Pose quaternion scaled to unit length; a zero-length one is NULL, an unusable pose."""
    size = length(q)
    return tuple(F.when(size > 0, c / size) for c in q)


def transpose(m: Mat) -> Mat:
    return tuple(tuple(m[r][c] for r in range(3)) for c in range(3))


def apply(m: Mat, p: Vec) -> Vec:
    return tuple(dot(row, p) for row in m)


def matrix_to_quat(m: Mat) -> Quat:
    """Unit quaternion of a rotation matrix, from its largest diagonal term for stability."""
    (a, b, c), (d, e, f), (g, h, i) = m
    trace = a + e + i
    # each case holds four times the dominant component squared, then the numerators
    cases = [
        (trace > 0, 1 + trace, lambda s: (s / 4, (h - f) / s, (c - g) / s, (d - b) / s)),
        ((a > e) & (a > i), 1 + a - e - i, lambda s: ((h - f) / s, s / 4, (b + d) / s, (c + g) / s)),
        (e > i, 1 + e - a - i, lambda s: ((c - g) / s, (b + d) / s, s / 4, (f + h) / s)),
        (None, 1 + i - a - e, lambda s: ((d - b) / s, (c + g) / s, (f + h) / s, s / 4)),
    ]
    options = [(test, parts(2 * F.sqrt(F.greatest(size, F.lit(0.0))))) for test, size, parts in cases]
    picked = []
    for k in range(4):
        choice = F.when(options[0][0], options[0][1][k])
        for test, parts in options[1:3]:
            choice = choice.when(test, parts[k])
        picked.append(choice.otherwise(options[3][1][k]))
    return quat_normalise(tuple(picked))


def axis_angle_to_quat(v: Vec) -> Quat:
    theta = length(v)
    share = F.when(theta < SMALL_ANGLE, 0.5 - theta * theta / 48.0).otherwise(
        F.sin(theta / 2) / F.greatest(theta, F.lit(SMALL_ANGLE))
    )
    return (F.cos(theta / 2), *scaled(v, share))


def quat_to_axis_angle(q: Quat) -> Vec:
    """The shorter of the two equivalent rotations; expects a unit quaternion."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    w, v = q[0] * sign, scaled(q[1:], sign)
    size = length(v)
    share = F.when(size < SMALL_ANGLE, 2.0).otherwise(
        2.0 * F.atan2(size, w) / F.greatest(size, F.lit(SMALL_ANGLE))
    )
    return scaled(v, share)


def angular_error_degrees(a: Quat, b: Quat) -> Column:
    """Angle between two rotations from the relative quaternion; stable near zero."""
    relative = quat_multiply(quat_conjugate(a), b)
    return F.degrees(2.0 * F.atan2(length(relative[1:]), F.abs(relative[0])))


def camera_to_world(q: Quat) -> Mat:
    return transpose(quat_to_matrix(q))


def camera_centre(q: Quat, t: Vec) -> Vec:
    """Where the camera stands: -Rᵀt."""
    return scaled(apply(camera_to_world(q), t), F.lit(-1.0))


def opengl_pose(q: Quat, t: Vec) -> tuple[Column, ...]:
    """Row-major 4x4 camera-to-world in the OpenGL convention (y and z columns negated)."""
    turn, centre = camera_to_world(q), camera_centre(q, t)
    rows = []
    for r in range(3):
        rows += [turn[r][0], -turn[r][1], -turn[r][2], centre[r]]
    return (*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def capture_frame(q: Quat, t: Vec) -> dict[str, Column]:
    """Viewer frame of a pose: eye, forward (third row of R) and up (minus its second row)."""
    m = quat_to_matrix(q)
    made = named(camera_centre(q, t), "eye_x", "eye_y", "eye_z")
    made |= named(m[2], "forward_x", "forward_y", "forward_z")
    return made | named(scaled(m[1], F.lit(-1.0)), "up_x", "up_y", "up_z")


def to_camera(p: Vec, q: Quat, t: Vec) -> Vec:
    return plus(apply(quat_to_matrix(q), p), t)


def project(seen: Vec, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixel of a camera-space point; NULL behind the camera."""
    depth = F.when(seen[2] > NEAREST_DEPTH, seen[2])
    return (fx * seen[0] / depth + cx, fy * seen[1] / depth + cy)


def rotation_to_y_up(up: Vec) -> Mat:
    """Shortest rotation of the unit vector ``up`` onto +Y.

    A half turn when it points down; the identity when it already points up.
    """
    x, y, z = up
    sine = F.sqrt(x * x + z * z)
    # the axis up × Y lies in the ground plane: (-z, 0, x)
    kx, kz = -z / F.greatest(sine, F.lit(TINY)), x / F.greatest(sine, F.lit(TINY))
    one_less = 1 - y
    turned = (
        (y + one_less * kx * kx, -sine * kz, one_less * kx * kz),
        (sine * kz, y, -sine * kx),
        (one_less * kx * kz, sine * kx, y + one_less * kz * kz),
    )
    upright = sine < SMALL_ANGLE
    identity = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    half_turn = ((-1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0))
    return tuple(
        tuple(
            F.when(upright & (y > 0), F.lit(identity[r][c]))
            .when(upright, F.lit(half_turn[r][c]))
            .otherwise(turned[r][c])
            for c in range(3)
        )
        for r in range(3)
    )
