"""Binary files: exact round trips, both headers, ranges, damaged files, and the command line on them."""

import struct

import numpy as np
import pytest

from ellipsa.__main__ import main
from ellipsa.operators.model import Mixture
from ellipsa.sources import binary, models
from ellipsa.sources.files import FormatError, header_bytes


def made(n=103, d=3):
    return np.random.default_rng(3).normal(size=(n, d)).astype("<f4")


def test_headers_fit_their_formats():
    assert header_bytes(5, 3) == struct.pack("<ii", 5, 3)
    assert header_bytes(5, 3, True) == struct.pack("<iiq", -1, 3, 5)
    assert header_bytes(1 << 31, None) == struct.pack("<iq", -1, 1 << 31)


@pytest.mark.parametrize("long", [False, True])
def test_read_file(spark, tmp_path, long):
    x = made()
    path = str(tmp_path / "x.bin")
    with open(path, "wb") as f:
        f.write(header_bytes(*x.shape, long) + x.tobytes())
    assert binary.query_header(path) == x.shape
    got = binary.read_vectors(spark, path, partitions=4).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(len(x)))
    assert (np.array([r.features for r in got], "f4") == x).all()
    some = binary.read_vectors(spark, path, 10, 7, 3).orderBy("row_id").collect()
    assert [r.row_id for r in some] == list(range(10, 17))
    assert (np.array([r.features for r in some], "f4") == x[10:17]).all()
    assert binary.read_vectors(spark, path, 1000).count() == 0


def test_vectors_round_trip(spark, tmp_path):
    x = made()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)][::-1], "row_id long, features array<double>").repartition(5)
    folder, path = str(tmp_path / "parts"), str(tmp_path / "one.bin")
    for _ in range(2):  # the second write replaces the first
        binary.write_vectors(df, folder)
    got = binary.read_vectors(spark, folder).orderBy("row_id").collect()
    assert (np.array([r.features for r in got], "f4") == x).all()
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if not p.name.startswith((".", "part-"))) == ["_parts"]
    # what a lost task and an interrupted older write leave behind isn't read, and goes with the next write
    for name in ("part-0000000000-lost", "part-0000000009-lost.body"):
        (tmp_path / "parts" / name).write_bytes(b"x" * 11)
    assert binary.query_header(folder) == x.shape
    with pytest.raises(Exception, match="FileExists"):
        df.selectExpr("row_id", "cast(features as array<float>) features").write.format("vecbin").mode("append").save(folder)
    binary.write_vectors(df, folder)
    assert not list((tmp_path / "parts").glob("*lost*"))
    binary.join_parts(folder, path)
    assert open(path, "rb").read() == header_bytes(*x.shape) + x.tobytes()


def test_empty_and_bad_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id long, features array<double>")
    binary.write_vectors(empty, str(tmp_path / "none"))
    assert binary.read_vectors(spark, str(tmp_path / "none")).count() == 0
    for rows in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(0, [])], [(0, [None])]):
        bad = spark.createDataFrame(rows, "row_id long, features array<double>").coalesce(1)
        with pytest.raises(Exception, match="FormatError"):
            binary.write_vectors(bad, str(tmp_path / "bad"))


def test_classes_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i * i % 7) for i in range(50)], "row_id long, cluster int").repartition(3)
    folder, path = str(tmp_path / "c"), str(tmp_path / "c.cls")
    binary.write_classes(df, folder)
    binary.join_parts(folder, path, False)
    assert struct.unpack("<51i", open(path, "rb").read()) == (50, *[i * i % 7 + 1 for i in range(50)])
    assert sorted(map(tuple, binary.read_classes(spark, path).collect())) == [(i, i * i % 7) for i in range(50)]


def test_damaged_files_are_named(tmp_path):
    path = str(tmp_path / "x.bin")
    for data in (b"", b"\1\0\0", struct.pack("<ii", 2, 3), struct.pack("<ii", -5, 3), struct.pack("<ii", -1, 3)):
        with open(path, "wb") as f:
            f.write(data)
        with pytest.raises(FormatError):
            binary.query_header(path)
        with pytest.raises(FormatError):
            models.read_mixture(path)
    with pytest.raises(FileNotFoundError):
        binary.query_header(str(tmp_path / "absent"))


def test_model_files(tmp_path):
    m = Mixture(np.array([0.25, 0.75]), np.array([[1.0, 2], [3, 4]]), np.array([np.eye(2), [[2, 0.5], [0.5, 1]]]))
    path = str(tmp_path / "m.cmp")
    models.write_mixture(path, m, -3.5)
    assert len(open(path, "rb").read()) == 8 + 8 * (2 * 7 + 1)
    back, likelihood = models.read_mixture(path)
    assert likelihood == -3.5 and all((a == b).all() for a, b in ((back.weights, m.weights), (back.means, m.means), (back.covs, m.covs)))
    models.write_centroids(path, m.means)
    assert (models.read_centroids(path, 2, 2) == m.means).all()
    with pytest.raises(FormatError):
        models.read_centroids(path, 3)


def test_command_line(spark, tmp_path):
    x = np.concatenate([made(60) - 5, made(60) + 5])
    path, first, last, classes = (str(tmp_path / n) for n in ("x.bin", "first.cmp", "last.cmp", "cls"))
    with open(path, "wb") as f:
        f.write(header_bytes(*x.shape) + x.tobytes())
    main(["start", path, "-c", "2", "-I", "kmeansoror", "-r", "3", "-g", "0.01", "-o", first], spark)
    report = main(["em", path, "-c", "2", "-I", first, "-m", "20", "-g", "0.01", "-o", last, "-O", classes], spark)
    model, likelihood = models.read_mixture(last)
    assert report["sweeps"] >= 2 and likelihood == report["log_likelihood"] and abs(model.weights - 0.5).max() < 1e-6
    models.write_centroids(str(tmp_path / "c.centroids"), model.means)
    report = main(["start", path, "-c", "2", "-I", str(tmp_path / "c.centroids"), "-o", first], spark)
    assert report["components"] == 2 and np.allclose(np.sort(models.read_mixture(first)[0].weights), 0.5)
    starts = [main(["start", path, "-c", "2", "-I", "jain", "-r", seed, "-o", str(tmp_path / f"j{seed}")], spark) and models.read_mixture(str(tmp_path / f"j{seed}"))[0].means for seed in ("1", "2")]
    assert not np.allclose(*starts)
    halves = {(r.row_id < 60, r.cluster) for r in binary.read_classes(spark, classes).collect()}
    assert len(halves) == 2
    with pytest.raises(SystemExit):
        main(["em", path, "-f", "0"], spark)
