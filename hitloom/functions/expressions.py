"""Scalar functions as column expressions: bits, matrices, spherical coordinates, areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero: for results that are compared across engines."""
    return F.round(c, 6) + F.lit(0.0)


def morton(x: Column, y: Column, bits: int = 3) -> Column:
    """Interleave the low ``bits`` bits of x (even places) and y (odd places)."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for v, at in ((x, 2 * k), (y, 2 * k + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), at))
    return out


def unmorton(code: Column, bits: int = 3) -> tuple[Column, Column]:
    """The two numbers that :func:`morton` has interleaved."""
    take = lambda at: [F.shiftleft(F.shiftright(code, 2 * k + at).bitwiseAND(F.lit(1).cast("long")), k) for k in range(bits)]
    x, y = (sum(parts[1:], parts[0]) for parts in (take(0), take(1)))
    return x, y


def shape_pixels(shape: Column) -> Column:
    """Array of the bit numbers (0 to 62) that a cluster shape has set."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.get_bit(shape, k) == 1) if hasattr(F, "get_bit") else F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit(shape, k) == 1)


def polygon_area(points: Column) -> Column:
    """Area by the shoelace formula of an array of structs (x, y) in order round the edge."""
    n = F.size(points)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def chi2_pvalue(chi2: Column, ndof: Column) -> Column:
    """Upper tail of the chi-squared distribution for an even number of degrees of freedom."""
    half = chi2 / 2
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), (ndof / 2).cast("int"))),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct((a["t"] * half / k).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when((ndof >= 2) & (ndof % 2 == 0), F.exp(-half) * terms)


def scatter_angle(budget: Column, momentum: Column, beta: Column) -> Column:
    """Width of multiple scattering (rad) for a material budget in radiation lengths and p in MeV."""
    return F.when(budget > 0, 13.6 / (momentum * beta) * F.sqrt(budget) * (1 + 0.038 * F.log(budget)))


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """phi in [0, 2 pi), theta and radius."""
    r = F.sqrt(x * x + y * y + z * z)
    phi = F.atan2(y, x)
    return F.when(phi < 0, phi + 2 * F.pi()).otherwise(phi), F.when(r > 0, F.acos(z / r)), r


def cartesian(phi: Column, theta: Column, r: Column) -> tuple[Column, Column, Column]:
    return r * F.cos(phi) * F.sin(theta), r * F.sin(phi) * F.sin(theta), r * F.cos(theta)


def euler_angles(m: dict[str, Column], eps: float = 1e-12) -> tuple[Column, Column, Column]:
    """alpha, beta, gamma of Rz Ry Rx from columns r11 to r33; alpha takes all of a locked gimbal."""
    s = m["r31"]
    locked = F.abs(s) >= 1 - eps
    alpha = F.when(s <= -1 + eps, F.atan2(m["r12"], m["r13"])).when(s >= 1 - eps, F.atan2(-m["r12"], -m["r13"])).otherwise(F.atan2(m["r32"], m["r33"]))
    beta = F.when(s <= -1 + eps, F.pi() / 2).when(s >= 1 - eps, -F.pi() / 2).otherwise(-F.asin(s))
    return alpha, beta, F.when(locked, 0.0).otherwise(F.atan2(m["r21"], m["r11"]))


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    """Vector product: the normal of the plane that two directions span."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def skew(v: tuple) -> list[list[Column]]:
    """Matrix whose product with w is v x w."""
    zero = F.lit(0.0)
    return [[zero, -v[2], v[1]], [v[2], zero, -v[0]], [-v[1], v[0], zero]]


def in_window(dx: Column, dy: Column, cut_x: Column, cut_y: Column, pitch_x: Column, pitch_y: Column) -> Column:
    """Inside an ellipse if both cuts are at least 2.5 pitches, else inside a rectangle; a null cut is open."""
    big = 1.7976931348623157e308
    ax, ay = F.coalesce(cut_x, F.lit(big)), F.coalesce(cut_y, F.lit(big))
    round_ = (ax >= 2.5 * pitch_x) & (ay >= 2.5 * pitch_y)
    return F.when(round_, (dx / ax) * (dx / ax) + (dy / ay) * (dy / ay) <= 1).otherwise((F.abs(dx) <= ax) & (F.abs(dy) <= ay))


def mask_of(duts: list[int]) -> int:
    return sum(1 << d for d in duts)


def all_bits(flag: Column, duts: list[int]) -> Column:
    m = mask_of(duts)
    return flag.bitwiseAND(F.lit(m).cast("long")) == m


def no_bits(flag: Column, duts: list[int]) -> Column:
    return flag.bitwiseAND(F.lit(mask_of(duts)).cast("long")) == 0
