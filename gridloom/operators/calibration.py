"""Cameras: projection and undistortion as column expressions, robust estimates per group of point pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import consensus


def rodrigues(r: Sequence[float]) -> np.ndarray:
    """The rotation matrix of a rotation vector."""
    r = np.array(r, float)
    theta = np.linalg.norm(r)
    if theta <= 1e-14:
        return np.eye(3)
    x, y, z = k = r / theta
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return math.cos(theta) * np.eye(3) + (1 - math.cos(theta)) * np.outer(k, k) + math.sin(theta) * cross


def rotation_vector(m: Sequence[Sequence[float]]) -> np.ndarray:
    """The rotation vector of the rotation matrix nearest to m."""
    u, _, v = np.linalg.svd(np.array(m, float))
    m = u @ v
    axis = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    s, c = np.linalg.norm(axis), (np.trace(m) - 1) / 2
    if s >= 1e-5:
        return axis / s * math.atan2(s, c)
    if c > 0:
        return np.zeros(3)
    k = np.sqrt(np.maximum((np.diag(m) + 1) / 2, 0))
    k[1] *= -1 if m[0, 1] < 0 else 1
    k[2] *= -1 if m[0, 2] < 0 else 1
    return k / np.linalg.norm(k) * math.pi


def default_new_camera_matrix(camera: np.ndarray, size: tuple[int, int] | None = None, center: bool = False) -> np.ndarray:
    """camera, its principal point moved to the middle of an image of size (width, height) if wanted."""
    out = np.array(camera, float)
    if center and size:
        out[0, 2], out[1, 2] = (size[0] - 1) / 2, (size[1] - 1) / 2
    return out


def _coefficients(d: Sequence[float]) -> list[float]:
    """k1 k2 p1 p2 k3 k4 k5 k6 s1 s2 s3 s4 of 0, 4, 5, 8, 12 or 14 coefficients; the last two tilt, see tilt()."""
    if len(d) not in (0, 4, 5, 8, 12, 14):
        raise ValueError("distortion has 4, 5, 8, 12 or 14 coefficients")
    return [float(v) for v in d[:12]] + [0.0] * (12 - min(12, len(d)))


def tilt(d: Sequence[float]) -> np.ndarray | None:
    """The map of image places onto a sensor tilted about x and y by the last two of 14 coefficients; None without."""
    if len(d) < 14 or not (d[12] or d[13]):
        return None
    turn = math.atan2(d[13], d[12])
    about_z = rodrigues((0, 0, turn))
    return np.linalg.inv(about_z @ rodrigues((d[12], 0, 0)) @ rodrigues((0, d[13], 0)) @ about_z.T)


def distorted(x: Column, y: Column, d: Sequence[float]) -> tuple[Column, Column]:
    """Where a lens and a tilted sensor put the normalised place (x, y)."""
    bent, m = _bent(x, y, d), tilt(d)
    if m is None:
        return bent
    a, b, c = (float(m[k][0]) * bent[0] + float(m[k][1]) * bent[1] + float(m[k][2]) for k in range(3))
    return a / c, b / c


def _bent(x: Column, y: Column, d: Sequence[float]) -> tuple[Column, Column]:
    k1, k2, p1, p2, k3, k4, k5, k6, s1, s2, s3, s4 = _coefficients(d)
    r2 = x * x + y * y
    r4, r6 = r2 * r2, r2 * r2 * r2
    radial = (1 + k1 * r2 + k2 * r4 + k3 * r6) / (1 + k4 * r2 + k5 * r4 + k6 * r6)
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x) + s1 * r2 + s2 * r4, y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y + s3 * r2 + s4 * r4


def _camera_frame(r: Sequence[float], t: Sequence[float]) -> list[Column]:
    m = rodrigues(r)
    return [F.col("x") * float(m[k][0]) + F.col("y") * float(m[k][1]) + F.col("z") * float(m[k][2]) + float(t[k]) for k in range(3)]


def project_points(points: DataFrame, r: Sequence[float], t: Sequence[float], camera: np.ndarray, d: Sequence[float] = ()) -> DataFrame:
    """Points (x, y, z) with their image places u and v; a depth of 0 counts as 1."""
    x, y, z = _camera_frame(r, t)
    inv = F.when(z == 0, F.lit(1.0)).otherwise(1 / F.when(z == 0, F.lit(1.0)).otherwise(z))
    x, y = distorted(x * inv, y * inv, d)
    return points.withColumns({"u": x * float(camera[0][0]) + float(camera[0][2]), "v": y * float(camera[1][1]) + float(camera[1][2])})


def rotation_derivatives(r: Sequence[float]) -> list[np.ndarray]:
    """The derivatives of the rotation matrix by the three parts of its vector."""
    r, m = np.array(r, float), rodrigues(r)
    cross = lambda v: np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    theta2 = float(r @ r)
    if theta2 <= 1e-28:
        return [cross(e) for e in np.eye(3)]
    return [(r[k] * cross(r) + cross(np.cross(r, (np.eye(3) - m)[:, k]))) @ m / theta2 for k in range(3)]


#: What the derivatives of project_jacobian are by, in this order.
PARAMETERS = ("r0", "r1", "r2", "t0", "t1", "t2", "fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")


def project_jacobian(points: DataFrame, r: Sequence[float], t: Sequence[float], camera: np.ndarray, d: Sequence[float] = (), aspect_ratio: float = 0.0) -> DataFrame:
    """project_points() with du and dv: the derivatives of u and v by each of PARAMETERS, as arrays of 15.

    Derivatives go forward with the values, as columns of each row: through rotation and translation, the division by
    depth (a depth of 0 counts as 1), the lens and the tilt. They are true derivatives for every number of coefficients.
    With an aspect ratio, fy is fx times that.
    """
    fx, cx, cy = float(camera[0][0]), float(camera[0][2]), float(camera[1][2])
    fy = fx * aspect_ratio if aspect_ratio else float(camera[1][1])
    k1, k2, p1, p2, k3, k4, k5, k6, s1, s2, s3, s4 = _coefficients(d)
    own = points.columns
    frame = _camera_frame(r, t)
    turned = {f"_p{k}{i}": F.col("x") * float(m[i][0]) + F.col("y") * float(m[i][1]) + F.col("z") * float(m[i][2]) for k, m in enumerate(rotation_derivatives(r)) for i in range(3)}
    rows = points.withColumns({"_z": frame[2], **turned}).withColumn("_inv", F.when(F.col("_z") == 0, F.lit(1.0)).otherwise(1 / F.when(F.col("_z") == 0, F.lit(1.0)).otherwise(F.col("_z"))))
    inv = F.col("_inv")
    rows = rows.withColumns({"_x": frame[0] * inv, "_y": frame[1] * inv})
    x, y, r2 = F.col("_x"), F.col("_y"), F.col("_r2")
    rows = rows.withColumn("_r2", x * x + y * y)
    rows = rows.withColumns({"_over": 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), "_under": 1 + r2 * (k4 + r2 * (k5 + r2 * k6))})
    over, under = F.col("_over"), F.col("_under")
    # the ratio's derivative by r2, and from it the lens's by x and y
    slope = ((k1 + r2 * (2 * k2 + r2 * (3 * k3))) * under - over * (k4 + r2 * (2 * k5 + r2 * (3 * k6)))) / (under * under)
    bent = _bent(x, y, d)
    rows = rows.withColumns({"_ratio": over / under, "_slope": slope, "_bx": bent[0], "_by": bent[1]})
    ratio, slope = F.col("_ratio"), F.col("_slope")
    lens = {
        "_xx": ratio + 2 * x * x * slope + 2 * p1 * y + 6 * p2 * x + 2 * x * (s1 + 2 * s2 * r2), "_xy": 2 * x * y * slope + 2 * p1 * x + 2 * p2 * y + 2 * y * (s1 + 2 * s2 * r2),
        "_yx": 2 * x * y * slope + 2 * p1 * x + 2 * p2 * y + 2 * x * (s3 + 2 * s4 * r2), "_yy": ratio + 2 * y * y * slope + 6 * p1 * y + 2 * p2 * x + 2 * y * (s3 + 2 * s4 * r2),
    }
    m = np.eye(3) if tilt(d) is None else tilt(d)
    a, b, c = (float(m[k][0]) * F.col("_bx") + float(m[k][1]) * F.col("_by") + float(m[k][2]) for k in range(3))
    rows = rows.withColumns({**lens, "_c": c, "_dx": a / c, "_dy": b / c})
    at = {"_u": F.col("_dx"), "_v": F.col("_dy")}
    rows = rows.withColumns({f"{n}{j}": (float(m[i][j]) - v * float(m[2][j])) / F.col("_c") for i, (n, v) in enumerate(at.items()) for j in range(2)})

    def by_lens(bx: Column, b_y: Column, n: str) -> Column:
        """The derivative of a sensor place, given that of the bent one."""
        return F.col(f"{n}0") * bx + F.col(f"{n}1") * b_y

    def by_place(dx: Column, dy: Column, n: str) -> Column:
        return by_lens(F.col("_xx") * dx + F.col("_xy") * dy, F.col("_yx") * dx + F.col("_yy") * dy, n)

    poses = [((F.col(f"_p{k}0") - x * F.col(f"_p{k}2")) * inv, (F.col(f"_p{k}1") - y * F.col(f"_p{k}2")) * inv) for k in range(3)]
    poses += [(inv, F.lit(0.0)), (F.lit(0.0), inv), (-x * inv, -y * inv)]
    bends = [(x * r2 / under, y * r2 / under), (x * r2 * r2 / under, y * r2 * r2 / under), (2 * x * y, r2 + 2 * y * y), (r2 + 2 * x * x, 2 * x * y), (x * r2 * r2 * r2 / under, y * r2 * r2 * r2 / under)]
    out = {}
    for name, n, f, place, whole in (("du", "_u", fx, "_dx", (True, False, True, False)), ("dv", "_v", fy, "_dy", (False, True, False, True))):
        inner = [F.col(place) if k < 2 and on else F.lit(1.0 if on else 0.0) for k, on in enumerate(whole)]
        out[name] = F.array(*[f * by_place(*p, n) for p in poses], *inner, *[f * by_lens(*p, n) for p in bends])
    return rows.select(*own, (fx * F.col("_dx") + cx).alias("u"), (fy * F.col("_dy") + cy).alias("v"), *[c.alias(k) for k, c in out.items()])


def _theta_scale(r: Column, d: Sequence[float]) -> Column:
    theta = F.atan(r)
    t2 = theta * theta
    bent = theta * (1 + d[0] * t2 + d[1] * t2 * t2 + d[2] * t2 * t2 * t2 + d[3] * t2 * t2 * t2 * t2)
    return F.when(r == 0, F.lit(1.0)).otherwise(bent / F.when(r == 0, F.lit(1.0)).otherwise(r))


def fisheye_project_points(points: DataFrame, r: Sequence[float], t: Sequence[float], camera: np.ndarray, d: Sequence[float] = (0, 0, 0, 0), alpha: float = 0.0) -> DataFrame:
    x, y, z = _camera_frame(r, t)
    x, y = x / z, y / z
    s = _theta_scale(F.sqrt(x * x + y * y), d)
    return points.withColumns({"u": (x * s + alpha * y * s) * float(camera[0][0]) + float(camera[0][2]), "v": y * s * float(camera[1][1]) + float(camera[1][2])})


def undistort_map(spark: SparkSession, camera: np.ndarray, d: Sequence[float], rows: int, cols: int, rotation: np.ndarray | None = None, new_camera: np.ndarray | None = None, fisheye: bool = False) -> DataFrame:
    """(y, x, map_x, map_y) for every pixel of the undistorted image: where in the distorted one its value lies."""
    new = np.eye(3) if new_camera is None and fisheye else np.array(camera if new_camera is None else new_camera, float)[:, :3]
    m = np.linalg.inv(new @ (np.eye(3) if rotation is None else np.array(rotation, float)))
    at = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("y"), F.pmod("id", F.lit(cols)).cast("int").alias("x"))
    ray = [F.col("x") * float(m[k][0]) + F.col("y") * float(m[k][1]) + float(m[k][2]) for k in range(3)]
    x, y = ray[0] / ray[2], ray[1] / ray[2]
    if fisheye:
        s = _theta_scale(F.sqrt(x * x + y * y), d)
        x, y = x * s, y * s
    else:
        x, y = distorted(x, y, d)
    return at.withColumns({"map_x": x * float(camera[0][0]) + float(camera[0][2]), "map_y": y * float(camera[1][1]) + float(camera[1][2])})


def undistort(planes: DataFrame, camera: np.ndarray, d: Sequence[float], new_camera: np.ndarray | None = None) -> DataFrame:
    """8-bit planes without their lens's distortion: places in 1/32, zero outside."""
    from gridloom.functions import planes as P
    from gridloom.operators.common import COLS, D, ROWS, changed
    from gridloom.operators.resampling import bilinear

    m = np.linalg.inv(np.array(camera if new_camera is None else new_camera, float))

    def value(data: Column, y: Column, x: Column) -> Column:
        ray = [x * float(m[k][0]) + y * float(m[k][1]) + float(m[k][2]) for k in range(3)]
        snap = lambda p: F.rint(p * 32) / 32

        def mixed(s: Column) -> Column:
            u, v = distorted(s["x"], s["y"], d)
            return bilinear(data, snap(v * float(camera[1][1]) + float(camera[1][2])), snap(u * float(camera[0][0]) + float(camera[0][2])))

        return F.floor(P.let(F.struct((ray[0] / ray[2]).alias("x"), (ray[1] / ray[2]).alias("y")), mixed) + 0.5).cast("double")

    return changed(planes, P.grid_over(D(), ROWS(), COLS(), value))


def _gathered(models: DataFrame, flagged: DataFrame) -> DataFrame:
    masks = flagged.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "inlier"))), lambda p: p["inlier"]).alias("inliers"))
    return masks.join(models, "set_id", "left").select("set_id", F.coalesce("model", F.array().cast("array<double>")).alias("matrix"), "inliers")


def estimate_affine_2d(pairs: DataFrame, method: str = "ransac", threshold: float = 3.0, rounds: int = 2000, confidence: float = 0.99) -> DataFrame:
    """(set_id, matrix, inliers) of point pairs (set_id, pos, x, y, u, v), an empty matrix where there is none; see
    consensus.affine, which keeps large sets in rows."""
    return _gathered(*consensus.affine(pairs, method, threshold, rounds, confidence))


def find_homography(pairs: DataFrame, method: str = "all", threshold: float = 3.0, rounds: int = 2000, confidence: float = 0.99) -> DataFrame:
    """(set_id, matrix, inliers); sets of fewer than four pairs have an empty matrix; see consensus.homography."""
    return _gathered(*consensus.homography(pairs, method, threshold, rounds, confidence))
