"""Writers. Large outputs are written by tasks; files whose format is one stream of fixed records (LAS, BIN)
are written in parts that Spark's tasks make and one pass joins; rasters are written row by row, primitives are few."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions.colors import LUMA_SHORT, clamp_round, luma
from terravox.sources.binary import LAS_FORMATS, PRIMITIVE_HEADER, PRIMITIVES, open_path


def write_octree_table(points: DataFrame, nodes: DataFrame, path: str, prefix: int = 1) -> None:
    """K1: points sorted by octree key and partitioned by its first digits, and the node table; replaces what is there."""
    keyed = points.withColumn("prefix", F.substring("key", 1, prefix))
    keyed.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/points")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def text_lines(cloud: DataFrame, offset: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """K2: lines "x y z r g b" in source coordinates, as the only column ``value``. The reference writes 12 significant
    digits, which moves points; here a coordinate has the digits that it takes to read the same number back."""
    xyz = [(F.col(c).cast("double") + float(o)).cast("string") for c, o in zip("xyz", offset, strict=True)]
    return cloud.select(F.format_string("%s %s %s %d %d %d", *xyz, *[F.col(c).cast("int") for c in "rgb"]).alias("value"))


def fixed_lines(cloud: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """K5, K7, K8: lines of fixed-point numbers, as outliers, test dumps and selections with or without normals."""
    return cloud.select(F.format_string(" ".join([f"%.{digits}f"] * len(columns)), *[F.col(c).cast("double") for c in columns]).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_records(cloud: DataFrame, columns: Sequence[str], path: str, head: bytes, record: Callable[[dict[str, np.ndarray]], bytes]) -> int:
    """A file of a header and records in the order of the rows' partitions; returns the number of records.

    Every task writes its own part beside the file (a part appears when it is complete, so a task that runs again does no
    harm); the driver then copies bytes from part to part into one stream, and sees no row."""
    files, name = open_path(path)
    folder = f"{name}.parts-{uuid.uuid4().hex}"
    files.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        own, _ = open_path(path)
        temporary = f"{folder}/_{uuid.uuid4().hex}"
        with own.open_output_stream(temporary) as out:
            for b in batches:
                out.write(record({c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}))
                count += b.num_rows
        own.move(temporary, f"{folder}/{part:08d}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([count], pa.int64())], ["part", "n"])

    parts = sorted(cloud.select(*columns).mapInArrow(write, "part long, n long").collect())
    with files.open_output_stream(name) as out:
        out.write(head)
        for part, _ in parts:
            with files.open_input_stream(f"{folder}/{part:08d}") as f:
                while chunk := f.read(8 << 20):
                    out.write(chunk)
    files.delete_dir(folder)
    return sum(n for _, n in parts)


def packed(kind: np.dtype, names: dict[str, str] | None = None) -> Callable[[dict[str, np.ndarray]], bytes]:
    """A record maker: fields of ``kind`` from columns of the same names (or those that ``names`` gives); others are 0."""

    def make(columns: dict[str, np.ndarray]) -> bytes:
        out = np.zeros(len(next(iter(columns.values()))), kind)
        for c, values in columns.items():
            out[(names or {}).get(c, c)] = values
        return out.tobytes()

    return make


def write_bin(cloud: DataFrame, path: str, colour: bool = False) -> int:
    """K4, K6: the BIN format (intensity is the luma) or its colour form; returns the number of points."""
    n = cloud.count()
    xyz = [F.col(c).cast("float").alias(c) for c in "xyz"]
    if colour:
        kind = np.dtype([(c, "<f4") for c in "xyz"] + [(c, "u1") for c in "rgba"])
        rows = cloud.select(*xyz, *[F.col(c).cast("short").alias(c) for c in "rgb"], F.lit(255).cast("short").alias("a"))
        return write_records(rows, [*"xyzrgba"], path, struct.pack("<I", n), packed(kind))
    grey = luma(F.col("r"), F.col("g"), F.col("b"), LUMA_SHORT)
    kind = np.dtype([(c, "<f4") for c in "xyzi"])
    return write_records(cloud.select(*xyz, grey.cast("float").alias("i")), [*"xyzi"], path, struct.pack("<I", n), packed(kind))


def las_quantised(cloud: DataFrame, scale: float, origin: tuple) -> DataFrame:
    """K3: integer coordinates floor((p - origin) / scale + 0.5)."""
    return cloud.withColumns({f"i{c}": F.floor((F.col(c).cast("double") - float(o)) / scale + 0.5) for c, o in zip("xyz", origin, strict=True)})


#: Points that the older LAS header can count.
LAS_MOST = (1 << 32) - 1


def las_head(n: int, scale: float, origin: tuple, bounds: Sequence[float], point_format: int = 0) -> bytes:
    """The header of LAS 1.2, or of 1.4, whose count has 64 bits, for more points than that counts. ``bounds`` are max x,
    min x, max y, min y, max z, min z."""
    large = n > LAS_MOST
    size = 375 if large else 227
    head = bytearray(size)
    struct.pack_into("<4s", head, 0, b"LASF")
    struct.pack_into("<BB", head, 24, 1, 4 if large else 2)
    struct.pack_into("<HI", head, 94, size, size)
    struct.pack_into("<BHI5I", head, 104, point_format, LAS_FORMATS[point_format][0], 0 if large else n, 0 if large else n, 0, 0, 0, 0)
    struct.pack_into("<12d", head, 131, *([scale] * 3), *origin, *bounds)
    if large:
        struct.pack_into("<2Q", head, 247, n, n)
    return bytes(head)


def write_las(cloud: DataFrame, path: str, scale: float = 0.001, origin: tuple | None = None) -> int:
    """K3: LAS with point format 0; intensity and class are zero, colours are lost. The origin is the centre of the
    bounds unless given."""
    b = cloud.agg(F.count("*"), *[f(F.col(c).cast("double")) for c in "xyz" for f in (F.max, F.min)]).first()
    n, bounds = b[0], [0.0 if v is None else v for v in b[1:]]
    origin = origin or tuple((bounds[2 * i] + bounds[2 * i + 1]) / 2 for i in range(3))
    kind = np.dtype([("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("rest", "V8")])
    return write_records(las_quantised(cloud, scale, origin), ["ix", "iy", "iz"], path, las_head(n, scale, origin, bounds), packed(kind))


def write_side(cloud: DataFrame, columns: Sequence[str], path: str, id_column: str = "id") -> None:
    """K9: a side file: further columns of a cloud's points (colours, normals) by id, apart from the cloud."""
    cloud.select(id_column, *columns).write.mode("overwrite").parquet(path)


def with_side(cloud: DataFrame, path: str, id_column: str = "id") -> DataFrame:
    """A cloud with the columns of a side file; points that it doesn't have get nulls."""
    return cloud.join(cloud.sparkSession.read.parquet(path), id_column, "left")


def write_pgm(grid: DataFrame, shape: tuple[int, int], value: str, path: str, white: float | None = None) -> None:
    """A grey picture of a grid's quality (weights, residuals): north row first, 0 black, ``white`` (the greatest value
    unless given) 255; vertices without a value are black. Rows reach the driver one by one."""
    nx, ny = shape
    top = white or grid.agg(F.max(value)).first()[0] or 1.0
    grey = clamp_round(F.col(value) * (255.0 / top))
    rows = grid.where(F.col(value).isNotNull()).groupBy("gy").agg(F.collect_list(F.struct("gx", grey.alias("v"))).alias("row")).orderBy(F.desc("gy"))
    files, name = open_path(path)
    at = ny - 1
    with files.open_output_stream(name) as out:
        out.write(f"P5\n{nx} {ny}\n255\n".encode())
        for r in rows.toLocalIterator():
            out.write(bytes(nx * (at - r.gy)))
            line = np.zeros(nx, "u1")
            line[[c.gx for c in r.row]] = [c.v for c in r.row]
            out.write(line.tobytes())
            at = r.gy - 1
        out.write(bytes(nx * (at + 1)))


def write_bil(grid: DataFrame, shape: tuple[int, int], origin: tuple, cell: tuple, path: str, offset: float = 0.0) -> None:
    """32-bit raster of millimetres, north row first, and its header; vertices without height are 0. A raster is
    written row by row."""
    nx, ny = shape
    files, name = open_path(path)
    stem = name.rsplit(".", 1)[0]
    with files.open_output_stream(f"{stem}.hdr") as out:
        fields = [("BYTEORDER", "I"), ("LAYOUT", "BIL"), ("NBANDS", 1), ("NBITS", 32), ("NCOLS", nx), ("NROWS", ny), ("BANDROWBYTES", nx * 4), ("TOTALROWBYTES", nx * 4), ("ULXMAP", f"{origin[0]:f}"), ("ULYMAP", f"{origin[1] + (ny - 1) * cell[1]:f}"), ("XDIM", f"{cell[0]:f}"), ("YDIM", f"{cell[1]:f}")]
        out.write("".join(f"{k} {v}\r\n" for k, v in fields).encode())
    rows = grid.where("z is not null").groupBy("gy").agg(F.collect_list(F.struct("gx", F.floor((F.col("z") - offset) * 1000 + 0.5).alias("v"))).alias("row")).orderBy(F.desc("gy"))
    blank, at = np.zeros(nx, "<u4"), ny - 1
    with files.open_output_stream(name) as out:
        for r in rows.toLocalIterator():
            while at > r.gy:
                out.write(blank.tobytes())
                at -= 1
            line = blank.copy()
            line[[c.gx for c in r.row]] = np.array([c.v for c in r.row]).astype("<i8").astype("<u4")
            out.write(line.tobytes())
            at -= 1
        while at >= 0:
            out.write(blank.tobytes())
            at -= 1


def write_tiles(grid: DataFrame, path: str, size: tuple[int, int] = (256, 4)) -> None:
    """Big-endian float tiles of 256 by 4 vertices, as rows (tile_x, tile_y, data) of a Parquet table."""
    import pandas as pd

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full(size[::-1], np.float32(-3.4028235e38), ">f4")
        a[pdf.gy % size[1], pdf.gx % size[0]] = pdf.z.astype("f4")
        return pd.DataFrame({"tile_x": [key[0]], "tile_y": [key[1]], "data": [a.tobytes()]})

    g = grid.where("z is not null").withColumns({"tile_x": F.floor(F.col("gx") / size[0]), "tile_y": F.floor(F.col("gy") / size[1])})
    g.groupBy("tile_x", "tile_y").applyInPandas(tile, "tile_x long, tile_y long, data binary").write.mode("overwrite").parquet(path)


def write_primitives(primitives: DataFrame, path: str, program: str = "terravox", only: Sequence[int] | None = None) -> int:
    """A primitive file, or the subset with the given ids; the header names the writing program."""
    rows = (primitives if only is None else primitives.where(F.col("id").isin(list(only)))).orderBy("id")
    files, name = open_path(path)
    with files.open_output_stream(name) as out:
        head = program.encode()[: 38 - len(PRIMITIVE_HEADER)] + PRIMITIVE_HEADER
        out.write(head.ljust(38) + b"\n\0")
        count = 0
        for r in rows.toLocalIterator():
            names, form = PRIMITIVES[r.prim_type]
            out.write(struct.pack("<i", r.prim_type) + struct.pack(form, *[r[n] for n in names]))
            count += 1
    return count


def coverage_boxes(extents: DataFrame) -> DataFrame:
    """A VRML box with its name for each row (name, min_x ... max_z), as lines."""
    mid = [((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2) for c in "xyz"]
    size = [(F.col(f"max_{c}") - F.col(f"min_{c}")) for c in "xyz"]
    return extents.select(F.format_string("Transform { translation %f %f %f children [ Shape { geometry Box { size %f %f %f } } Shape { geometry Text { string \"%s\" } } ] }", *mid, *size, F.col("name").cast("string")).alias("value"))


def write_offset(offset: tuple, path: str) -> None:
    """Three float64, negated."""
    files, name = open_path(path)
    with files.open_output_stream(name) as out:
        out.write(struct.pack("<3d", *[-float(o) for o in offset]))
