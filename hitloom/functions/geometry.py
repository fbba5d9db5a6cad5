"""Plane geometry: a small dimension table and column expressions on it.

Rotation is R = Rz(gamma) Ry(beta) Rx(alpha); its nine coefficients are computed
once per plane and stand in the geometry row, so that coordinate changes are
plain arithmetic inside code generation.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixel pitch in micrometres, matrix size and primitive cell in pixels of known detectors (fixed values).
MODELS = {
    "FEI4": (250.0, 50.0, 80, 336, 2, 1),
    "RD53A": (50.0, 50.0, 400, 192, 1, 1),
    "RD53A_8x8": (50.0, 50.0, 400, 192, 8, 8),
    "ITkPix": (50.0, 50.0, 400, 384, 1, 1),
    "ITkPix_8x8": (50.0, 50.0, 400, 384, 8, 8),
    "TJMonopix1": (40.0, 36.0, 112, 224, 1, 1),
    "TJMonopix1_2x2": (40.0, 36.0, 112, 224, 2, 2),
    "PSI46": (150.0, 100.0, 52, 80, 2, 1),
    "Mimosa26": (18.4, 18.4, 1152, 576, 1, 1),
    "DepfetInner": (50.0, 55.0, 64, 64, 1, 1),
    "DepfetOuter": (50.0, 85.0, 64, 64, 1, 1),
    "Timepix3": (55.0, 55.0, 256, 256, 1, 1),
    "Diamond3D": (250.0, 50.0, 80, 336, 2, 1),
    "DiamondPseudo3D": (250.0, 50.0, 80, 336, 2, 1),
}

# Fixed values of diamond sensors, which stand on an FEI4 matrix (micrometres; columns and rows from the sensor's first pixel).
#: Bump bonds of odd and even columns are away from the centre by so much in x.
BONDS = (-100.0, 100.0)
#: Columns and rows of the sensor; the first 30 rows are square cells, the others hexagonal.
SENSOR = (12, 30, 62)
#: Shift of a square cell by column % 4 and row % 2, in the sensor with and without columns of electrodes.
SQUARE_CELLS = {
    "Diamond3D": {(0, 0): (100.0, 25.0), (0, 1): (225.0, -25.0), (1, 1): (-100.0, -25.0), (2, 1): (100.0, -25.0), (3, 0): (-100.0, 25.0), (3, 1): (-225.0, -25.0)},
    "DiamondPseudo3D": {(0, 0): (100.0, 25.0), (0, 1): (225.0, -25.0), (1, 1): (-100.0, -25.0), (2, 0): (100.0, 25.0), (3, 0): (-100.0, 25.0), (3, 1): (-225.0, -25.0)},
}
#: Shift of a hexagonal cell by row % 4 (x counts against the bond's side); in the fourth row only columns 1 and 2 of four move.
HEXAGONS = ((167.265, 75.0), (51.785, 25.0), (109.525, 75.0), (225.0, 25.0))
#: Cells that are not connected: first column, column after the last, first row, row after the last.
DEFECTS = {
    "Diamond3D": [(1, 2, 8, 12), (4, 5, 12, 16), (3, 4, 24, 30), (8, 9, 0, 8), (10, 12, 8, 18), (10, 12, 30, 31), (10, 12, 32, 35)],
    "DiamondPseudo3D": [],
}


def rotation(alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Rz(gamma) Ry(beta) Rx(alpha)."""
    ca, sa, cb, sb, cg, sg = (f(v) for v in (alpha, beta, gamma) for f in (math.cos, math.sin))
    return [
        [cb * cg, sa * sb * cg - ca * sg, ca * sb * cg + sa * sg],
        [cb * sg, sa * sb * sg + ca * cg, ca * sb * sg - sa * cg],
        [-sb, sa * cb, ca * cb],
    ]


@dataclass(frozen=True)
class Plane:
    """One detector plane; lengths in micrometres, angles in radians, a null limit is open."""

    dut: int
    name: str = "plane"
    column_size: float = 100.0
    row_size: float = 50.0
    n_columns: int = 16
    n_rows: int = 16
    tx: float = 0.0
    ty: float = 0.0
    tz: float = 0.0
    alpha: float = 0.0
    beta: float = 0.0
    gamma: float = 0.0
    x_lo: float | None = None
    x_hi: float | None = None
    y_lo: float | None = None
    y_hi: float | None = None
    material_budget: float = 0.0
    resolution_x: float | None = None
    resolution_y: float | None = None
    cell_columns: int = 1
    cell_rows: int = 1

    def of_model(self, model: str) -> Plane:
        c, r, n, m, cc, cr = MODELS[model]
        return replace(self, column_size=c, row_size=r, n_columns=n, n_rows=m, cell_columns=cc, cell_rows=cr)

    def row(self) -> dict:
        m = rotation(self.alpha, self.beta, self.gamma)
        return asdict(self) | {f"r{i + 1}{j + 1}": m[i][j] for i in range(3) for j in range(3)}


FIELDS = (
    "dut int, name string, column_size double, row_size double, n_columns int, n_rows int, tx double, ty double, tz double, alpha double, beta double, gamma double,"
    " x_lo double, x_hi double, y_lo double, y_hi double, material_budget double, resolution_x double, resolution_y double, cell_columns int, cell_rows int"
)
SCHEMA = FIELDS + (
    ", r11 double, r12 double, r13 double, r21 double, r22 double, r23 double, r31 double, r32 double, r33 double"
)

#: Planes of the ``hits`` view and of the ``tracks`` view.
HIT_PLANES = [
    Plane(0, "p0"),
    Plane(1, "p1", tx=30.0, ty=-20.0, tz=10000.0, gamma=0.01, cell_columns=2),
    Plane(2, "p2", tx=-15.0, ty=40.0, tz=20000.0, alpha=0.002, beta=-0.001, gamma=-0.02, cell_columns=2, cell_rows=2, x_lo=-600.0, x_hi=700.0, y_lo=-300.0, y_hi=350.0),
]
TRACK_PLANES = [Plane(i, f"m{i}", tz=150000.0 * i, material_budget=7e-4).of_model("Mimosa26") for i in range(6)]
#: A rotation of the whole telescope towards the beam.
BEAM = (0.0005, -0.0003, 0.0)


def geometry(spark: SparkSession, planes: list[Plane]) -> DataFrame:
    """One row per plane; always small."""
    rows = [tuple(float(v) if isinstance(v, float) else v for v in p.row().values()) for p in planes]
    return spark.createDataFrame(rows, SCHEMA)


def save_geometry(spark: SparkSession, planes: list[Plane], path: str, version: int) -> None:
    """Write the planes as one version; a version that is written again is replaced."""
    spark.createDataFrame([tuple(asdict(p).values()) for p in planes], FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_geometry(spark: SparkSession, path: str, version: int | None = None) -> list[Plane]:
    """Planes of a version, by default the latest, in the order of their numbers."""
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    return [Plane(**{k: v for k, v in r.asDict().items() if k != "version"}) for r in rows.where(F.col("version") == version).orderBy("dut").collect()]


def with_geometry(df: DataFrame, geo: DataFrame) -> DataFrame:
    """Attach plane constants by a broadcast join on ``dut``; a telescope has at most a few dozen planes."""
    return df.join(F.broadcast(geo), "dut")


def sql_values(planes: list[Plane]) -> str:
    """The geometry as SQL, for oracles."""
    rows = [p.row() for p in planes]
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r.values())) + ")" for r in rows) + f") AS g({', '.join(rows[0])})"


def _c(name: str) -> Column:
    return F.col(name)


def local_from_index(column: Column, row: Column, strict: bool = False) -> tuple[Column, Column]:
    """Centre of a pixel; pixels are numbered from 1 and the matrix is centred on the origin. Indices outside it are an error if ``strict``."""
    if strict:
        wrong = F.raise_error(F.concat_ws(" ", F.lit("outside the matrix:"), column.cast("string"), row.cast("string"))).cast("double")
        fits = column.between(0.5, _c("n_columns") + 0.5) & row.between(0.5, _c("n_rows") + 0.5)
        return tuple(F.when(fits, v).otherwise(wrong) for v in local_from_index(column, row))
    return _c("column_size") * (column - 0.5 - _c("n_columns") * 0.5), _c("row_size") * (row - 0.5 - _c("n_rows") * 0.5)


def index_from_local(x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional column and row of a position."""
    return x / _c("column_size") + 0.5 + _c("n_columns") * 0.5, y / _c("row_size") + 0.5 + _c("n_rows") * 0.5


def diamond_shift(model: str, sensor: tuple[int, int], column: Column, row: Column) -> tuple[Column, Column]:
    """How far a diamond sensor's pixel stands from its place in the matrix; ``sensor`` is the column and row of its first pixel."""
    c, r = column - sensor[0], row - sensor[1]
    width, square, height = SENSOR
    dx, dy = F.when(column % 2 == 1, BONDS[0]).otherwise(BONDS[1]), F.lit(0.0)
    on = (c >= 0) & (c < width) & (r >= 0) & (r < height)
    for c0, c1, r0, r1 in DEFECTS[model]:
        on = on & ~((c >= c0) & (c < c1) & (r >= r0) & (r < r1))
    for (i, j), (x, y) in SQUARE_CELLS[model].items():
        here = on & (r < square) & (c % 4 == i) & (r % 2 == j)
        dx, dy = dx + F.when(here, x).otherwise(0.0), dy + F.when(here, y).otherwise(0.0)
    for j, (x, y) in enumerate(HEXAGONS):
        here = on & (r >= square) & ((r - square) % 4 == j) & (F.lit(True) if j < 3 else (c % 4).isin(1, 2))
        dx, dy = dx + F.when(here, F.when(c % 2 == 0, x).otherwise(-x)).otherwise(0.0), dy + F.when(here, y).otherwise(0.0)
    return dx, dy


def pixel_positions(spark: SparkSession, planes: list[Plane], sensors: dict[int, tuple[str, tuple[int, int]]]) -> DataFrame:
    """Rows (dut, column, row, px, py) with every pixel's centre; ``sensors`` names the planes with a diamond, its model and first pixel."""
    parts = []
    for p in planes:
        at = spark.range(p.n_columns * p.n_rows).select((F.col("id") % p.n_columns + 1).cast("int").alias("column"), (F.floor(F.col("id") / p.n_columns) + 1).cast("int").alias("row"))
        x, y = p.column_size * (F.col("column") - 0.5 - p.n_columns * 0.5), p.row_size * (F.col("row") - 0.5 - p.n_rows * 0.5)
        dx, dy = diamond_shift(*sensors[p.dut], F.col("column"), F.col("row")) if p.dut in sensors else (F.lit(0.0), F.lit(0.0))
        parts.append(at.select(F.lit(p.dut).alias("dut"), "column", "row", (x + dx).alias("px"), (y + dy).alias("py")))
    return reduce(DataFrame.unionAll, parts)


def extent(axis: int) -> tuple[Column, Column]:
    """Least and greatest global coordinate of a plane's corners on an axis (0 x, 1 y, 2 z)."""
    corners = [to_global(a * _c("column_size") * _c("n_columns") * 0.5, b * _c("row_size") * _c("n_rows") * 0.5, F.lit(0.0))[axis] for a in (-1, 1) for b in (-1, 1)]
    return F.least(*corners), F.greatest(*corners)


def with_extents(df: DataFrame, geo: DataFrame, width: float) -> DataFrame:
    """Attach the first edge ``edge_*`` and the number ``bins_*`` of bins in x and y that ``extent_bin`` needs; they are worked out once per plane."""
    columns = {}
    for i, a in enumerate("xy"):
        lo, hi = extent(i)
        n = F.ceil((hi - lo) / width)
        columns |= {f"bins_{a}": n, f"edge_{a}": _c(f"t{a}") - n * (width / 2)}
    return df.join(F.broadcast(geo.select("dut", *(c.alias(k) for k, c in columns.items()))), "dut")


def extent_bin(position: Column, axis: str, width: float) -> Column:
    """Bin of a global position on a histogram that is centred on the plane and covers its extent in whole bins (``with_extents``); null outside."""
    b = F.floor((position - _c(f"edge_{axis}")) / width)
    return F.when((b >= 0) & (b < _c(f"bins_{axis}")), b)


def in_matrix(column: Column, row: Column) -> Column:
    return column.between(1, _c("n_columns")) & row.between(1, _c("n_rows"))


def rotate(x: Column, y: Column, z: Column, back: bool = False) -> tuple[Column, Column, Column]:
    """R v, or its transpose applied to v."""
    r = lambda i, j: _c(f"r{j}{i}" if back else f"r{i}{j}")
    return tuple(r(i, 1) * x + r(i, 2) * y + r(i, 3) * z for i in (1, 2, 3))


def to_global(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(v + _c(t) for v, t in zip(rotate(x, y, z), ("tx", "ty", "tz"), strict=True))


def to_local(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return rotate(x - _c("tx"), y - _c("ty"), z - _c("tz"), back=True)


def fixed_rotation(m: list[list[float]], x: Column, y: Column, z: Column, back: bool = False) -> tuple[Column, Column, Column]:
    """A constant rotation of the whole telescope."""
    k = [[m[j][i] for j in range(3)] for i in range(3)] if back else m
    return tuple(F.lit(k[i][0]) * x + F.lit(k[i][1]) * y + F.lit(k[i][2]) * z for i in range(3))


def normal() -> tuple[Column, Column, Column]:
    """Plane normal R z, flipped to a positive z component."""
    sign = F.when(_c("r33") < 0, -1.0).otherwise(1.0)
    return sign * _c("r13"), sign * _c("r23"), sign * _c("r33")


def intersect(o: tuple, d: tuple) -> tuple[Column, Column, Column]:
    """Point where the line o + k d meets the plane; null for a parallel line."""
    n, p = normal(), (_c("tx"), _c("ty"), _c("tz"))
    over = (p[0] - o[0]) * n[0] + (p[1] - o[1]) * n[1] + (p[2] - o[2]) * n[2]
    under = d[0] * n[0] + d[1] * n[1] + d[2] * n[2]
    k = F.when(under != 0, over / under)
    return tuple(o[i] + d[i] * k for i in range(3))


def within_limits(x: Column, y: Column) -> Column:
    """Inside the plane's optional local limits."""
    return (
        F.coalesce(x >= _c("x_lo"), F.lit(True)) & F.coalesce(x <= _c("x_hi"), F.lit(True))
        & F.coalesce(y >= _c("y_lo"), F.lit(True)) & F.coalesce(y <= _c("y_hi"), F.lit(True))
    )


def angles(sx: Column, sy: Column, sz: Column) -> tuple[Column, Column, Column]:
    """Total, alpha and beta angle of a slope to the plane normal in the local frame."""
    return F.acos(F.abs(sz) / F.sqrt(sx * sx + sy * sy + sz * sz)), F.atan2(sy, F.abs(sz)), F.atan2(-sx, F.abs(sz))


def cell_position(x: Column, y: Column) -> tuple[Column, Column]:
    """Coordinate inside the primitive cell, counted from its lower edge."""
    fold = lambda v, pitch, n, k: F.pmod(v + _c(pitch) * _c(n) * 0.5, _c(pitch) * _c(k))
    return fold(x, "column_size", "n_columns", "cell_columns"), fold(y, "row_size", "n_rows", "cell_rows")
