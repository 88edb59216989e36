"""Each command end to end on small files."""

import numpy as np

from terravox import cli


def test_commands(spark, tmp_path, capsys):
    d = str(tmp_path)
    p = np.random.default_rng(1).random((200, 3))
    (tmp_path / "a.xyzrgb").write_text("".join(f"{x} {y} {z} 1 2 3\n" for x, y, z in p))
    run = lambda *argv: cli.run(spark, [str(v) for v in argv])
    run("import", f"{d}/a.xyzrgb", "-o", f"{d}/tree", "--np", 20, "--max-level", 4)
    assert spark.read.parquet(f"{d}/tree/points").count() == 200
    assert spark.read.parquet(f"{d}/tree/nodes").where("level = 0").first().n == 200
    run("normals", f"{d}/a.xyzrgb", f"{d}/normals.parquet", "--radius", 0.4)
    run("outliers", f"{d}/a.xyzrgb", f"{d}/outliers.parquet", "--radius", 0.05)
    run("ground", f"{d}/a.xyzrgb", f"{d}/ground.parquet", "--radius", 0.2)
    for name in ("normals", "ground"):
        assert spark.read.parquet(f"{d}/{name}.parquet").count() == 200
    run("subtract", f"{d}/a.xyzrgb", f"{d}/a.xyzrgb", f"{d}/rest.parquet", "--eps", 0.001)
    assert spark.read.parquet(f"{d}/rest.parquet").count() == 0
    run("export", f"{d}/a.xyzrgb", f"{d}/a.las", "--las", "--box", 0, 0, 0, 1, 1, 0.5)
    run("similarity", f"{d}/a.xyzrgb", f"{d}/a.las", 0.01)
    run("range", f"{d}/a.las", "--show-coverage", f"{d}/boxes")
    assert "percent" in capsys.readouterr().out
    run("grid", f"{d}/a.xyzrgb", f"{d}/g.bil", "--grid-max", 1, 1, "--cell-size", 0.25, 0.25)
    assert (tmp_path / "g.bil").stat().st_size == 100
    run("profile", f"{d}/a.xyzrgb", f"{d}/profile.parquet", "--line", 0, 0, 1, 1, "--segment", 0.2)
    assert spark.read.parquet(f"{d}/profile.parquet").count() > 5
