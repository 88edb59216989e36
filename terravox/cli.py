"""Command line: ``python -m terravox.cli COMMAND ...``.

Clouds are files of any known format, or Parquet tables of points (x, y, z and optional columns).
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.operators import grid, neighborhood, octree, points, spatial, surfaces
from terravox.sources import auto, binary, text, writers


def read(spark: SparkSession, path: str, a: argparse.Namespace) -> DataFrame:
    """A cloud with ids."""
    if path.rstrip("/").endswith(".parquet"):
        cloud = spark.read.parquet(path)
    else:
        cloud = auto.read_points(spark, path, tuple(getattr(a, "columns", None) or (0, 1, 2)), getattr(a, "header", 0), getattr(a, "las_classes_mask", None))
    return cloud if "id" in cloud.columns else cloud.withColumn("id", F.monotonically_increasing_id())


def _print(rows: DataFrame) -> None:
    """All rows, tab separated under their names, without holding them together."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terravox", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for f in files:
            c.add_argument(f.rstrip("*"), nargs="+" if f.endswith("*") else None)
        for option, (default, count) in options.items():
            kind = type(default) if not isinstance(default, (tuple, type(None))) else float
            flag = f"--{option.replace('_', '-')}"
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, type=kind, default=default, nargs=count)
        return c

    c = command("import", "inputs*", offset=((0.0, 0.0, 0.0), 3), offset_file=("", None), transform=(None, 12), c=((1.0, 1.0, 1.0), 3), np=(4096, None), max_level=(12, None), header=(0, None), columns=(None, "+"), las_classes=(None, "+"))
    c.add_argument("-o", "--output", required=True)
    command("normals", "cloud", "output", neighbors=(0, None), radius=(0.0, None), save_outliers=("", None))
    command("outliers", "cloud", "output", radius=(1.0, None), min_neighbors=(3, None))
    command("subtract", "cloud", "remove", "output", eps=(1e-7, None))
    command("similarity", "cloud", "other", "eps")
    command("ground", "cloud", "output", radius=(1.0, None), tolerance=(0.0, None), max_angle=(270.0, None))
    command("colour", "cloud", "images", "pixels", "output")
    command("export", "cloud", "output", box=(None, 6), las=(False, None))
    command("grid", "cloud", "output", grid_min=((0.0, 0.0), 2), grid_max=((1.0, 1.0), 2), cell_size=((1.0, 1.0), 2), lobes=(3, None))
    command("profile", "cloud", "output", line=((0.0, 0.0, 1.0, 1.0), "+"), segment=(1.0, None), oversampling=(2, None), width=(1.0, None), lobes=(3, None))
    command("range", "inputs*", box_only=(False, None), show_coverage=("", None))
    command("primitives", "file", indices=(None, "*"), output=("", None))
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "import":
        a.las_classes_mask = sum(1 << int(c) for c in a.las_classes) if a.las_classes else None
        a.columns = tuple(map(int, a.columns)) if a.columns else None
        offset = binary.read_offset(a.offset_file) if a.offset_file else tuple(a.offset)
        matrix = [a.transform[k : k + 4] for k in (0, 4, 8)] if a.transform else None
        cloud = points.import_points(points.union_clouds(*[read(spark, f, a) for f in a.inputs]), offset, matrix, tuple(a.c))
        cube = octree.root_cube(cloud)
        keyed = cloud.withColumn("key", octree.octree_key(cube, a.max_level))
        writers.write_octree_table(keyed, octree.node_table(keyed, a.max_level, a.np), a.output)
    elif a.command == "range":
        clouds = [read(spark, f, a).withColumn("name", F.lit(f)) for f in a.inputs]
        boxes = points.extents(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), clouds), "name", rollup=True)
        _print(boxes.drop("n") if a.box_only else boxes)
        if a.show_coverage:
            writers.write_text(writers.coverage_boxes(boxes.where("name is not null")), a.show_coverage)
    elif a.command == "primitives":
        found = binary.read_primitives(spark, a.file)
        _print(found)
        if a.output:
            writers.write_primitives(found, a.output, only=[int(i) for i in a.indices or []])
    else:
        cloud = read(spark, a.cloud, a)
        if a.command == "similarity":
            _print(spatial.similarity(cloud, read(spark, a.other, a), float(a.eps)))
            return
        if a.command == "normals":
            out = cloud.join(neighborhood.normals(cloud, a.radius or None, a.neighbors or None).withColumnRenamed("qid", "id"), "id")
            if a.save_outliers:
                writers.write_text(writers.fixed_lines(out.where("n < 3"), "xyz", 6), a.save_outliers)
        elif a.command == "outliers":
            out = cloud.join(neighborhood.outliers(cloud, a.radius, a.min_neighbors), "id")
        elif a.command == "subtract":
            out = spatial.eps_subtract(cloud, read(spark, a.remove, a) if a.remove.endswith((".parquet", ".bin")) else text.read_positions(spark, a.remove), a.eps)
        elif a.command == "ground":
            out = cloud.join(surfaces.classify_ground(cloud, a.radius, a.tolerance, a.max_angle).withColumnRenamed("qid", "id"), "id")
        elif a.command == "colour":
            out = surfaces.raster_colour(cloud, spark.read.parquet(a.images), spark.read.parquet(a.pixels))
        elif a.command == "export":
            chosen = cloud.where(points.in_box(a.box[:3], a.box[3:])) if a.box else cloud
            if a.las:
                writers.write_las(chosen, a.output)
            else:
                writers.write_text(writers.text_lines(chosen), a.output)
            return
        elif a.command == "grid":
            low, high, cell = tuple(a.grid_min), tuple(a.grid_max), tuple(a.cell_size)
            shape, origin = grid.grid_shape(low, high, cell)
            writers.write_bil(grid.adaptive_grid(grid.grid_vertices(spark, low, high, cell), cloud, cell, a.lobes), shape, origin, cell, a.output)
            return
        else:
            line = list(zip(a.line[::2], a.line[1::2], strict=True))
            out = grid.profile(grid.profile_samples(spark, line, a.segment, a.oversampling), cloud, a.width, a.lobes, a.segment)
        out.write.mode("overwrite").parquet(a.output)


def main() -> None:
    import sys

    run(SparkSession.builder.appName("terravox").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
