"""Rotations, poses and projections as Column expressions.

A rotation is a list of nine Columns (row-major); a vector is a list of three.
Poses are world-to-camera (``p_cam = R p_world + t``) unless a name says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def clean(c: Column, digits: int = 6) -> Column:
    """Round for comparison and turn -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


# --- vectors and matrices -------------------------------------------------


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def rows(r: Vec) -> list[Vec]:
    return [r[0:3], r[3:6], r[6:9]]


def transpose(r: Vec) -> list[Column]:
    return [r[0], r[3], r[6], r[1], r[4], r[7], r[2], r[5], r[8]]


def apply(r: Vec, v: Vec) -> list[Column]:
    return [dot(row, v) for row in rows(r)]


def multiply(a: Vec, b: Vec) -> list[Column]:
    cols = rows(transpose(b))
    return [dot(row, col) for row in rows(a) for col in cols]


def rot_y(deg: Column) -> list[Column]:
    c, s, o, i = F.cos(F.radians(deg)), F.sin(F.radians(deg)), lit(0), lit(1)
    return [c, o, s, o, i, o, -s, o, c]


def rot_z(deg: Column) -> list[Column]:
    c, s, o, i = F.cos(F.radians(deg)), F.sin(F.radians(deg)), lit(0), lit(1)
    return [c, -s, o, s, c, o, o, o, i]


# --- quaternions (w, x, y, z) --------------------------------------------


def quat_to_rot(q: Vec) -> list[Column]:
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def quat_multiply(a: Vec, b: Vec) -> list[Column]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    ]


def rot_to_quat(r: Vec) -> list[Column]:
    """Unit quaternion with w >= 0, divided by the largest of the four candidates for accuracy."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = r
    trace = m00 + m11 + m22
    big = F.greatest(trace, m00, m11, m22)
    # For each pivot: the four quaternion entries times 4 * pivot entry.
    by_w = [1 + trace, m21 - m12, m02 - m20, m10 - m01]
    by_x = [m21 - m12, 1 + m00 - m11 - m22, m01 + m10, m02 + m20]
    by_y = [m02 - m20, m01 + m10, 1 + m11 - m00 - m22, m12 + m21]
    by_z = [m10 - m01, m02 + m20, m12 + m21, 1 + m22 - m00 - m11]

    def pick(i: int) -> Column:
        return (
            F.when(big == trace, by_w[i]).when(big == m00, by_x[i]).when(big == m11, by_y[i]).otherwise(by_z[i])
        )

    entries = [pick(i) for i in range(4)]
    size = norm(entries)
    sign = F.when(entries[0] < 0, lit(-1)).otherwise(lit(1))
    return [sign * e / size for e in entries]


# --- poses ----------------------------------------------------------------


def camera_center(r: Vec, t: Vec) -> list[Column]:
    return [-c for c in apply(transpose(r), t)]


def forward_axis(r: Vec) -> list[Column]:
    """The camera's +Z axis in the world: last row of the world-to-camera rotation."""
    return list(r[6:9])


def invert_pose(r: Vec, t: Vec) -> tuple[list[Column], list[Column]]:
    return transpose(r), camera_center(r, t)


def camera_to_world(r: Vec, t: Vec, p: Vec) -> list[Column]:
    return apply(transpose(r), [a - b for a, b in zip(p, t)])


def affine_plan(a: Vec, p: Vec) -> list[Column]:
    """2x4 affine (row-major, eight Columns) applied to a 3D point."""
    return [dot(a[0:3], p) + a[3], dot(a[4:7], p) + a[7]]


def pose_to_plan(r: Vec, t: Vec, a: Vec) -> tuple[Column, Column, Column]:
    """Floorplan x, y and heading in [0, 360) of a camera; null when any input is null."""
    centre = camera_center(r, t)
    ahead = [c + f for c, f in zip(centre, forward_axis(r))]
    x0, y0 = affine_plan(a, centre)
    x1, y1 = affine_plan(a, ahead)
    return x0, y0, F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), lit(360))


# --- equirectangular and pinhole cameras ------------------------------------


def to_equirect(p: Vec, cols, rows_, y_down: bool = True) -> tuple[Column, Column]:
    """Camera-frame point to panorama pixel; null at the camera centre."""
    size = norm(p)
    ok = size >= 1e-10
    elevation = F.asin(p[1] / size)
    sign = 1 if y_down else -1
    u = lit(cols) * (F.atan2(p[0], p[2]) / (2 * math.pi) + 0.5)
    v = lit(rows_) * (sign * elevation / math.pi + 0.5)
    return F.when(ok, u), F.when(ok, v)


def equirect_bearing(u: Column, v: Column, width, height) -> list[Column]:
    """Unit ray of a panorama pixel in the camera frame (Y down, Z ahead)."""
    lon = (u / lit(width) - 0.5) * (2 * math.pi)
    drop = (v / lit(height) - 0.5) * math.pi
    return [F.cos(drop) * F.sin(lon), F.sin(drop), F.cos(drop) * F.cos(lon)]


def depth_to_camera(u: Column, v: Column, depth: Column, width, height, convention: str = "camera") -> list[Column]:
    """Panorama depth pixel to a 3D point: ``camera`` (Y down, +Z ahead) or ``opengl`` (Y up, -Z ahead)."""
    ray = equirect_bearing(u, v, width, height)
    x, y, z = (depth * c for c in ray)
    if convention == "camera":
        return [x, y, z]
    if convention == "opengl":
        return [x, -y, -z]
    raise ValueError(f"unknown convention {convention!r}")


def depth_in_range(depth: Column, convention: str = "camera") -> Column:
    # Valid metres per convention.
    if convention == "camera":
        return (depth > 0.1) & (depth < 50)
    return (depth > 0) & (depth < 100)


def decode_depth(raw: Column, source: Column) -> Column:
    """Stored integer depth to metres, by file source."""
    # Divisor per source.
    return F.when(source == "millimetre", raw / 1000).when(source == "quarter_mm", raw / 4000).when(
        source == "half_k", raw / 512
    ).otherwise(raw.cast("double"))


def pinhole_ray_point(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> list[Column]:
    return [(u - lit(cx)) * depth / lit(fx), (v - lit(cy)) * depth / lit(fy), depth]


# --- slicing panoramas --------------------------------------------------------


def slice_size(width: Column, fov: Column, multiple: int | None = None) -> tuple[Column, Column]:
    """Slice width and height in pixels (16:9), optionally floored to a patch multiple."""
    w = (fov / 360.0 * width).cast("long")
    h = (w * 9 / 16).cast("long")
    if multiple:
        w, h = (F.floor(c / multiple) * multiple for c in (w, h))
    return w, h


def slice_rotation(yaw: Column, pitch: Column) -> list[Column]:
    """Yaw about Z, then pitch about Y."""
    return multiply(rot_z(yaw), rot_y(pitch))


def focal_length(width: Column, fov: Column) -> Column:
    return width / (2 * F.tan(F.radians(fov) / 2))


def level_yaw_pitch(r_cw: Vec, yaw: Column) -> tuple[Column, Column]:
    """Yaw and pitch in the camera frame that level the camera for a target world yaw.

    The levelling rotation turns the camera's Y axis onto (0, 0, -1) about their
    common normal; the result is read back as intrinsic-free y-then-x Euler angles.
    """
    down = [lit(0), lit(0), lit(-1)]
    y_axis = [r_cw[1], r_cw[4], r_cw[7]]
    axis = cross(y_axis, down)
    s = norm(axis)
    k = [a / s for a in axis]
    c = F.greatest(lit(-1), F.least(lit(1), dot(y_axis, down)))
    angle = F.acos(c)
    sn, vs = F.sin(angle), 1 - F.cos(angle)
    cs = F.cos(angle)
    skew = [lit(0), -k[2], k[1], k[2], lit(0), -k[0], -k[1], k[0], lit(0)]
    eye = [lit(1) if i % 4 == 0 else lit(0) for i in range(9)]
    level = []
    for i in range(9):
        turned = k[i // 3] * k[i % 3] * vs + skew[i] * sn + eye[i] * cs
        level.append(F.when(s < 1e-6, eye[i]).otherwise(turned))
    target = multiply(rot_y(yaw), multiply(level, r_cw))
    delta = multiply(transpose(r_cw), target)
    # Extrinsic y then x: R = Rx(pitch) Ry(yaw) up to the roll the rotation may carry.
    pitch_deg = F.degrees(F.atan2(-delta[5], delta[8]))
    yaw_deg = F.degrees(F.asin(F.greatest(lit(-1), F.least(lit(1), delta[2]))))
    return yaw_deg, pitch_deg


def perspective_sample(col: Column, row: Column, width, height, fov, yaw: Column, pitch: Column, eq_w, eq_h):
    """Panorama coordinate (lon, lat pixel) that a perspective pixel samples."""
    w, h, f = float(width), float(height), float(fov)
    half_w = math.tan(math.radians(f / 2.0))
    half_h = math.tan(math.radians(f * h / w / 2.0))
    # A chord of the unit sphere seen under the field of view has half length tan(fov/2).
    y = (col - (w - 1) / 2.0) * (2 * half_w / (w - 1))
    z = -(row - (h - 1) / 2.0) * (2 * half_h / (h - 1))
    ray = [lit(1) + 0 * col, y, z]
    turned = apply(multiply(rot_z(yaw), rot_y(-pitch)), ray)
    size = norm(turned)
    cx, cy = (eq_w - 1) / 2.0, (eq_h - 1) / 2.0
    lon = F.atan2(turned[1], turned[0]) / math.pi * cx + cx
    lat = -F.asin(turned[2] / size) / (math.pi / 2) * cy + cy
    return lon, lat


def cube_face(p: Vec) -> Column:
    """Face of the cube map a bearing hits: axis of the largest absolute component."""
    ax, ay, az = (F.abs(c) for c in p)
    return (
        F.when((az >= ax) & (az >= ay), F.when(p[2] >= 0, "front").otherwise("back"))
        .when((ax >= ay), F.when(p[0] >= 0, "right").otherwise("left"))
        .otherwise(F.when(p[1] >= 0, "down").otherwise("up"))
    )
