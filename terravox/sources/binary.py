"""Binary readers as one Python data source.

A reader looks at a file's header on the driver and cuts its records into ranges; each task opens the file itself, seeks
to its range and hands out Arrow batches, so a file of any size is read by many tasks. Paths are anything
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records in one range and in one batch.
RANGE, BATCH = 1_000_000, 65_536
POINT = "x double, y double, z double, r double, g double, b double"
FULL = POINT + ", intensity int, classification int, gps_time double"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Layout(NamedTuple):
    start: int  #: byte of the first record
    count: int  #: records
    kind: np.dtype
    columns: Callable[[np.ndarray], dict]  #: decoded columns of a batch of records


def _grey(i) -> dict:
    return {"r": i, "g": i, "b": i}


def _xyz(a: np.ndarray) -> dict:
    return {c: a[c].astype(float) for c in "xyz"}


def bin_layout(head: bytes, size: int, options: dict) -> Layout:
    """Count, then x, y, z, intensity as float32."""
    kind = np.dtype([(c, "<f4") for c in ("x", "y", "z", "i")])
    return Layout(4, struct.unpack("<I", head[:4])[0], kind, lambda a: _xyz(a) | _grey(a["i"].astype(float)))


def binrgb_layout(head: bytes, size: int, options: dict) -> Layout:
    """Count, then x, y, z as float32 and r, g, b, a as bytes."""
    kind = np.dtype([(c, "<f4") for c in "xyz"] + [(c, "u1") for c in "rgba"])
    return Layout(4, struct.unpack("<I", head[:4])[0], kind, lambda a: _xyz(a) | {c: a[c].astype(float) for c in "rgb"})


#: LAS point formats 0 to 3: record lengths, where the GPS time and the colour begin.
LAS_FORMATS = {0: (20, None, None), 1: (28, 20, None), 2: (26, None, 20), 3: (34, 20, 28)}


class LasHeader(NamedTuple):
    offset: int
    format: int
    length: int
    count: int
    scale: tuple
    origin: tuple
    bounds: tuple  #: max x, min x, max y, min y, max z, min z


def las_header(head: bytes) -> LasHeader | None:
    """The fields of a LAS header, or None for a file that isn't one or has another point format."""
    if len(head) < 227 or head[:4] != b"LASF":
        return None
    offset, = struct.unpack_from("<I", head, 96)
    kind, length, count = struct.unpack_from("<BHI", head, 104)
    if offset < 227 or kind not in LAS_FORMATS or LAS_FORMATS[kind][0] != length:
        return None
    if not count and head[24:26] == b"\1\4" and len(head) >= 375:
        count, = struct.unpack_from("<Q", head, 247)
    d = struct.unpack_from("<12d", head, 131)
    return LasHeader(offset, kind, length, count, d[:3], d[3:6], d[6:])


def las_layout(head: bytes, size: int, options: dict) -> Layout:
    """S3: positions are scaled in double precision and moved by the file's own offset; the colour is RGB where the
    format has it, else the intensity. A file that isn't understood has no records."""
    h = las_header(head)
    if h is None:
        return Layout(0, 0, np.dtype("u1"), lambda a: {})
    _, time, rgb = LAS_FORMATS[h.format]
    names, formats, offsets = ["xyz", "i", "class"], [("<i4", 3), "<u2", "u1"], [0, 12, 15]
    for name, form, at in (("t", "<f8", time), ("rgb", ("<u2", 3), rgb)):
        if at is not None:
            names, formats, offsets = [*names, name], [*formats, form], [*offsets, at]
    kind = np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": h.length})

    def columns(a: np.ndarray) -> dict:
        p = a["xyz"] * np.array(h.scale) + np.array(h.origin)
        colour = {c: a["rgb"][:, k].astype(float) for k, c in enumerate("rgb")} if rgb is not None else _grey(a["i"].astype(float))
        extra = {"intensity": a["i"].astype(np.int32), "classification": a["class"].astype(np.int32), "gps_time": a["t"] if time is not None else None}
        return {c: p[:, k] for k, c in enumerate("xyz")} | colour | extra

    return Layout(h.offset, h.count, kind, columns)


#: Fields of a galaxy record, in file order: name and format.
GALAXY = np.dtype([("gal_id", "<u4", 2), ("halo_id", "<u4", 2), ("type", "<u4"), ("position", "<f4", 3), ("velocity", "<f4", 3), ("spin", "<f4", 3), *[(n, "<f4") for n in "ra dec z_obs z central_m_vir m_vir r_vir v_vir v_max vel_disp stellar_mass bulge_mass cold_gas hot_gas ejected_mass black_hole_mass sfr cooling heating".split()], ("app_sdss", "<f4", 5), ("app_sdss_bulge", "<f4", 5), ("abs_sdss", "<f4", 5), ("app_deep", "<f4", 4), ("app_deep_bulge", "<f4", 4), ("abs_bvrik", "<f4", 5), ("abs_bvrik_bulge", "<f4", 5), ("abs_bvrik_no_dust", "<f4", 5)])


def galaxy_layout(head: bytes, size: int, options: dict) -> Layout:
    """Redshift catalogue: the position is (dec, ra, 1) times 3200 redshifts, the colour from absolute
    magnitudes; ``m_vir`` stays for its range."""

    def columns(a: np.ndarray) -> dict:
        z = 3200.0 * a["z"].astype(float)
        m = a["abs_sdss"].astype(float)
        return {"x": a["dec"] * z, "y": a["ra"] * z, "z": z, "r": m[:, 2] - m[:, 3] + 1.13, "g": (-m[:, 2] - 14.62) * 0.3, "b": m[:, 1] - m[:, 2] + 0.73, "gps_time": a["m_vir"].astype(float)}

    return Layout(4, struct.unpack("<I", head[:4])[0], GALAXY, columns)


#: PLY scalar types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


class PlyHeader(NamedTuple):
    format: str
    size: int  #: bytes of the header
    elements: list  #: (name, count, [(property, type, list count type or None)])


def ply_header(head: bytes) -> PlyHeader:
    """The header of a PLY file; only version 1.0 is known."""
    end = re.search(rb"end_header[ \t]*\r?\n", head)
    if not head.lstrip().startswith(b"ply") or end is None:
        raise ValueError("not a PLY file, or its header is too long")
    form, elements = "", []
    for line in head[: end.start()].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            if w[1] not in ("ascii", "binary_little_endian", "binary_big_endian") or float(w[2]) != 1.0:
                raise ValueError(f"unknown PLY format {line!r}")
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[4], PLY_TYPES[w[3]], PLY_TYPES[w[2]]) if w[1] == "list" else (w[2], PLY_TYPES[w[1]], None))
    return PlyHeader(form, end.end(), elements)


def _ply_columns(a, names: list[str], colours: tuple[str, ...]) -> dict:
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("the PLY vertices have no x, y and z")
    n = len(a["x"])
    return {c: np.asarray(a[c], float) for c in "xyz"} | {c: np.asarray(a[k], float) if k in names else np.full(n, 255.0) for c, k in zip("rgb", colours, strict=True)}


def ply_layout(head: bytes, size: int, options: dict) -> Layout:
    """Vertices of a binary PLY file; elements before them must have no lists."""
    h = ply_header(head)
    order = "<" if h.format == "binary_little_endian" else ">"
    colours = tuple(options.get("colours", "red,green,blue").split(","))
    start = h.size
    for name, count, properties in h.elements:
        if any(p[2] for p in properties):
            raise ValueError("lists before or in the vertices can't be skipped by ranges")
        kind = np.dtype([(p, order + t) for p, t, _ in properties])
        if name == "vertex":
            return Layout(start, count, kind, lambda a: _ply_columns(a, list(a.dtype.names), colours))
        start += count * kind.itemsize
    return Layout(start, 0, np.dtype("u1"), lambda a: {})


LAYOUTS = {"bin": bin_layout, "binrgb": binrgb_layout, "las": las_layout, "galaxies": galaxy_layout, "ply": ply_layout}


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def _batch(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    got = [pa.nulls(n, f.type) if columns.get(f.name) is None else pa.array(columns[f.name]).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(got, schema=schema)


_ARROW = pa.schema([(n, {"double": pa.float64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in FULL.split(", "))])


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.layout_of = LAYOUTS[self.options["layout"]]

    def _layout(self, path: str) -> Layout:
        files, name = open_path(path)
        with files.open_input_file(name) as f:
            return self.layout_of(f.read(1 << 16), f.size(), self.options)

    def partitions(self) -> list[Range]:
        found = []
        for path in self.options["paths"].split("\n"):
            n = self._layout(path).count
            found += [Range(path, k, min(RANGE, n - k)) for k in range(0, n, RANGE)]
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        layout = self._layout(part.path)
        files, name = open_path(part.path)
        with files.open_input_file(name) as f:
            f.seek(layout.start + part.first * layout.kind.itemsize)
            for k in range(0, part.count, BATCH):
                raw = f.read(min(BATCH, part.count - k) * layout.kind.itemsize)
                a = np.frombuffer(raw[: len(raw) // layout.kind.itemsize * layout.kind.itemsize], layout.kind)
                if len(a):
                    yield _batch(layout.columns(a), len(a), _ARROW)


class RecordSource(DataSource):
    """Format ``terravox_records``: options ``layout`` and ``paths`` (one per line)."""

    @classmethod
    def name(cls) -> str:
        return "terravox_records"

    def schema(self) -> str:
        return FULL

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, paths: str | list[str], layout: str, classes: int | None = None, **options: str) -> DataFrame:
    """Points of binary files: x, y, z, r, g, b, and intensity, classification and gps_time where a format has them.
    ``classes`` is a bit mask of LAS classes to keep."""
    spark.dataSource.register(RecordSource)
    made = spark.read.format("terravox_records").options(layout=layout, paths=paths if isinstance(paths, str) else "\n".join(paths), **options).load()
    if classes is None:
        return made
    return made.where(f"shiftleft(1, classification & 31) & {int(classes)} != 0")


def las_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A5: what the headers alone say of LAS files: path, format, n and bounds; a file that isn't understood has null n.
    Tasks read 375 bytes of each file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                files, name = open_path(path)
                with files.open_input_file(name) as f:
                    h = las_header(f.read(375))
                bounds = dict(zip([f"{k}_{c}" for c in "xyz" for k in ("max", "min")], h.bounds, strict=True)) if h else {}
                out.append({"path": path, "format": h.format if h else None, "n": h.count if h else None} | bounds)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("format", pa.int32()), ("n", pa.int64()), *[(f"{k}_{c}", pa.float64()) for c in "xyz" for k in ("min", "max")]]))

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200)))
    return listed.mapInArrow(rows, "path string, format int, n long, " + ", ".join(f"{k}_{c} double" for c in "xyz" for k in ("min", "max")))


def las_profile(spark: SparkSession, path: str) -> DataFrame:
    """A5: count, bounds, and the ranges of intensity, class and colour of the records of a LAS file, as one row."""
    columns = ("x", "y", "z", "intensity", "classification", "r", "g", "b")
    return read_records(spark, path, "las").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))])


def read_galaxies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Galaxies with ``m_vir``."""
    return read_records(spark, paths, "galaxies").select("x", "y", "z", "r", "g", "b", F.col("gps_time").alias("m_vir"))


def read_ply(spark: SparkSession, path: str, colours: str = "red,green,blue") -> DataFrame:
    """Vertices of a PLY file: binary files in ranges, ASCII files by one task."""
    files, name = open_path(path)
    with files.open_input_file(name) as f:
        h = ply_header(f.read(1 << 16))
    if h.format != "ascii":
        return read_records(spark, path, "ply", colours=colours).select("x", "y", "z", "r", "g", "b")
    skip, names = 0, []
    for element, count, properties in h.elements:
        if element == "vertex":
            names = [p[0] for p in properties]
            break
        skip += count

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                lines = content.as_py()[h.size :].decode("latin-1").splitlines()[skip : skip + count]
                a = np.array([ln.split()[: len(names)] for ln in lines], float).reshape(-1, len(names))
                c = _ply_columns({n: a[:, k] for k, n in enumerate(names)}, names, tuple(colours.split(",")))
                yield pa.RecordBatch.from_arrays([pa.array(c[k]) for k in ("x", "y", "z", "r", "g", "b")], ["x", "y", "z", "r", "g", "b"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, POINT)


def _leaves(index: bytes, start: int, node: np.dtype) -> list[tuple[int, int]]:
    """(data offset, points) of the leaves of a tree of nodes in a file, from the root at a byte offset on."""
    found, stack = [], [start]
    while stack:
        n = np.frombuffer(index, node, 1, stack.pop())[0]
        if n["children"]:
            stack += [int(n["children"]) + k * node.itemsize for k in reversed(range(8))]
        elif n["points"]:
            found.append((int(n["data"]), int(n["points"])))
    return found


#: Octree node records: this format's, and the older one's.
NODE = np.dtype([("children", "<u8"), ("detail", "<f4"), ("points", "<u4"), ("data", "<u8")])
OLD_NODE = np.dtype([("children", "<u8"), ("detail", "<f4"), ("data", "<u8"), ("points", "<u4")])
_LIDAR_POINT = np.dtype([(c, "<f4") for c in "xyz"] + [(c, "u1") for c in "rgba"])


def read_bil(spark: SparkSession, path: str, offset: float = 0.0) -> DataFrame:
    """The vertices (gx, gy, z) of a 32-bit raster of millimetres with a header beside it, by ranges of its rows; 0 is no
    height."""
    files, name = open_path(path)
    with files.open_input_stream(f"{name.rsplit('.', 1)[0]}.hdr") as f:
        fields = dict(line.split(maxsplit=1) for line in f.read().decode().splitlines() if line.strip())
    nx, ny = int(fields["NCOLS"]), int(fields["NROWS"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = open_path(path)
        with own.open_input_file(place) as f:
            for b in batches:
                for gy in b.column(0).to_pylist():
                    f.seek((ny - 1 - gy) * nx * 4)
                    line = np.frombuffer(f.read(nx * 4), "<u4").astype("<i4")
                    gx = np.flatnonzero(line)
                    yield pa.RecordBatch.from_arrays([pa.array(gx.astype(np.int32)), pa.array(np.full(len(gx), gy, np.int32)), pa.array(line[gx] / 1000 + offset)], ["gx", "gy", "z"])

    return spark.range(ny).mapInArrow(rows, "gx int, gy int, z double")


def read_tiles(spark: SparkSession, path: str, size: tuple[int, int] = (256, 4)) -> DataFrame:
    """The vertices (gx, gy, z) of a table of big-endian float tiles."""

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tx, ty, data in zip(*(b.column(k).to_pylist() for k in ("tile_x", "tile_y", "data")), strict=True):
                a = np.frombuffer(data, ">f4").reshape(size[::-1]).astype(float)
                v, u = np.nonzero(a > -3.4e38)
                yield pa.RecordBatch.from_arrays([pa.array((u + tx * size[0]).astype(np.int32)), pa.array((v + ty * size[1]).astype(np.int32)), pa.array(a[v, u])], ["gx", "gy", "z"])

    return spark.read.parquet(path).select("tile_x", "tile_y", "data").mapInArrow(vertices, "gx int, gy int, z double")


def world_file(path: str) -> tuple[float, float, float, float, float, float]:
    """A, d, b, e, c, f of the world file (.tfw) beside an image: world x = a col + b row + c, y = d col + e row + f,
    for the centres of pixels, row 0 at the top."""
    files, name = open_path(path)
    with files.open_input_stream(name.rsplit(".", 1)[0] + ".tfw") as f:
        numbers = [float(v) for v in f.read().split()[:6]]
    if len(numbers) != 6:
        raise ValueError(f"the world file of {path!r} has no six numbers")
    return tuple(numbers)


def read_images(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Images (img_id by the order of the paths, a, d, b, e, c, f, width, height) with their world files, and their
    pixels (img_id, col, row, r, g, b). Images are what Spark's image source opens; one task reads one image."""
    places = [(k, p.rsplit("/", 1)[-1], *world_file(p)) for k, p in enumerate(paths)]
    known = spark.createDataFrame(places, "img_id int, name string, a double, d double, b double, e double, c double, f double")
    opened = spark.read.format("image").load(paths).select("image.*").withColumn("name", F.element_at(F.split("origin", "/"), -1))
    images = known.join(opened.select("name", "width", "height"), "name").drop("name")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for img, height, width, channels, data in zip(*(b.column(k).to_pylist() for k in ("img_id", "height", "width", "nChannels", "data")), strict=True):
                a = np.frombuffer(data, "u1").reshape(height, width, channels).astype(np.int16)
                bgr = [a[:, :, min(k, channels - 1)].ravel() for k in range(3)]
                n = height * width
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, img, np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), height)), pa.array(np.repeat(np.arange(height, dtype=np.int32), width)), *[pa.array(x) for x in reversed(bgr)]], ["img_id", "col", "row", "r", "g", "b"])

    some = opened.join(known.select("img_id", "name"), "name").select("img_id", "height", "width", "nChannels", "data")
    return images, some.mapInArrow(pixels, "img_id int, col int, row int, r short, g short, b short")


def read_octree(spark: SparkSession, path: str, old: bool = False) -> DataFrame:
    """The points of all leaves of an octree: a folder with Index and Points, or, with ``old``, the stem of a
    pair of .oct and .obin files. The index is read on the driver; points by tasks of up to RANGE points."""
    index_name, points_name = (f"{path}.oct", f"{path}.obin") if old else (f"{path}/Index", f"{path}/Points")
    files, name = open_path(index_name)
    with files.open_input_file(name) as f:
        index = f.read()
    leaves = _leaves(index, 20 if old else 28, OLD_NODE if old else NODE)
    head, step = (0, 1) if old else (4, _LIDAR_POINT.itemsize)  # the older format has byte offsets
    tasks = spark.createDataFrame([(head + data * step, n) for data, n in leaves], "at long, n long")

    def rows(batches):
        own, place = open_path(points_name)
        with own.open_input_file(place) as f:
            for b in batches:
                for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    f.seek(at)
                    a = np.frombuffer(f.read(n * _LIDAR_POINT.itemsize), _LIDAR_POINT)
                    yield pa.RecordBatch.from_arrays([pa.array(a[c].astype(float)) for c in ("x", "y", "z", "r", "g", "b")], ["x", "y", "z", "r", "g", "b"])

    per_task = max(1, sum(n for _, n in leaves) // RANGE)
    return tasks.repartition(per_task).mapInArrow(rows, POINT)


def read_offset(path: str) -> tuple[float, float, float]:
    """Three float64; a cloud stored with an offset is read back with its negative."""
    files, name = open_path(path)
    with files.open_input_file(name) as f:
        return tuple(-v for v in struct.unpack("<3d", f.read(24)))


#: Fields after the type tag of a primitive: names and struct formats.
PRIMITIVES = {
    0: (("n_points", "rms", "nx", "ny", "nz", "offset", *[f"corner{i}_{c}" for i in range(4) for c in "xyz"], "grid_x", "grid_y"), "<Id3dd12d2i"),
    1: (("n_points", "rms", "center_x", "center_y", "center_z", "radius"), "<Id3dd"),
    2: (("n_points", "rms", "center_x", "center_y", "center_z", "axis_x", "axis_y", "axis_z", "radius", "length", "grid_x", "grid_y"), "<Id3d3ddd2i"),
    3: (("n_points", "rms", "center_x", "center_y", "center_z", "axis_x", "axis_y", "axis_z", "length"), "<Id3d3dd"),
    4: (("center_x", "center_y", "center_z"), "<3d"),
}
PRIMITIVE_COLUMNS = tuple(dict.fromkeys(n for names, _ in PRIMITIVES.values() for n in names))
#: How the 40 bytes of a primitive file's header end; what stands before names the program that wrote it.
PRIMITIVE_HEADER = b" primitive file v1.2"


def primitive_schema() -> str:
    return "id long, prim_type int, " + ", ".join(f"{n} {'long' if n == 'n_points' else 'int' if n.startswith('grid') else 'double'}" for n in PRIMITIVE_COLUMNS)


def parse_primitives(raw: bytes) -> list[dict]:
    """The records of a primitive file; an unknown type ends it."""
    if PRIMITIVE_HEADER not in raw[:40]:
        raise ValueError("not a primitive file of version 1.2")
    at, out = 40, []
    while at + 4 <= len(raw):
        kind, = struct.unpack_from("<i", raw, at)
        if kind not in PRIMITIVES:
            break
        names, form = PRIMITIVES[kind]
        out.append(dict.fromkeys(PRIMITIVE_COLUMNS) | {"id": len(out), "prim_type": kind} | dict(zip(names, struct.unpack_from(form, raw, at + 4), strict=True)))
        at += 4 + struct.calcsize(form)
    return out


def read_primitives(spark: SparkSession, path: str) -> DataFrame:
    """Fitted primitives; the columns of other types are null."""
    files, name = open_path(path)
    with files.open_input_file(name) as f:
        rows = parse_primitives(f.read())
    names = ["id", "prim_type", *PRIMITIVE_COLUMNS]
    return spark.createDataFrame([[r[n] for n in names] for r in rows], primitive_schema())
