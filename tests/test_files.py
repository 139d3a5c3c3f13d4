import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.sources import bigann, files


def numbered(spark, first, n, tasks=3):
    rows = spark.range(first, first + n).select(F.col("id").alias("row"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    return rows.repartitionByRange(tasks, "row").sortWithinPartitions("row")


def read(spark, path):
    return sorted((r.row, r.vector[0]) for r in spark.read.format("bigann").load(path).collect())


def write(df, path, mode="append", **options):
    df.write.format("bigann").options(**options).mode(mode).save(path)


@pytest.fixture(autouse=True)
def known(spark):
    bigann.register(spark)


@pytest.mark.parametrize("scheme", ["file://", "file:", ""])
@pytest.mark.parametrize("layout", [{}, {"shards": "true"}, {"folder": "true"}])
def test_layouts_on_uris(spark, tmp_path, scheme, layout):
    path = f"{scheme}{tmp_path}/deep/er/base.fbin"
    write(numbered(spark, 0, 50), path, **layout)
    name = path.replace("base.fbin", "base_*.fbin") if "shards" in layout else path
    assert read(spark, name) == [(i, float(i)) for i in range(50)]
    some = spark.read.format("bigann").load(name).where("row >= 10 AND row < 13")
    assert sorted(r.row for r in some.collect()) == [10, 11, 12]
    if not layout:
        with pytest.raises(Exception, match="exists"):
            write(numbered(spark, 0, 5), path)


def test_folder_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b.fbin")
    write(numbered(spark, 0, 10), path, folder="true")
    write(numbered(spark, 100, 5, 1), path, folder="true")
    # row numbers go on in the order of the files
    assert read(spark, path) == [(i, float(i)) for i in range(10)] + [(10 + i, 100.0 + i) for i in range(5)]
    assert bigann.manifest_version(path) == 2
    (tmp_path / "b.fbin" / "part-lost-0-0-0.fbin").write_bytes(b"half a fi")  # of a lost attempt
    assert len(read(spark, path)) == 15
    write(numbered(spark, 7, 2), path, "overwrite", folder="true")
    assert read(spark, path) == [(0, 7.0), (1, 8.0)]
    kept = {n for n in files.names(path) if n.startswith("part-") and "lost" not in n}
    assert kept == {p["name"] for p in json.loads((tmp_path / "b.fbin" / "_manifest-0000000003.json").read_text())["files"]}
    wide = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "row bigint, vector array<float>").coalesce(1)
    with pytest.raises(Exception, match="another length"):
        write(wide, path, folder="true")
    assert read(spark, path) == [(0, 7.0), (1, 8.0)]
    write(numbered(spark, 0, 0), path, "overwrite", folder="true")
    assert read(spark, path) == []
    with pytest.raises(bigann.FormatError, match="without a manifest"):
        (tmp_path / "none.fbin").mkdir()
        bigann.shards(str(tmp_path / "none.fbin"))


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(1, [1.0]), (0, [2.0])], "row bigint, vector array<float>").coalesce(1)
    for layout in ({}, {"folder": "true"}):
        with pytest.raises(Exception, match="sorted"):
            write(bad, str(tmp_path / "x.fbin"), **layout)
    assert not any(p.is_file() for p in tmp_path.rglob("*"))


def test_tasks_write_files_of_bounded_size(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    class Task:
        partitionId = attemptNumber = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Task))
    monkeypatch.setattr(bigann, "PART_BYTES", 64)
    x = np.arange(40, dtype=np.float32).reshape(20, 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 4)), pa.array(x[a : a + 4].tolist(), pa.list_(pa.float32()))], names=["row", "vector"]) for a in range(0, 20, 4)]
    for layout in ("folder", "one"):
        path = str(tmp_path / f"{layout}.fbin")
        writer = bigann.BigAnnWriter(path, False, layout)
        part = writer.write(iter(batches))
        assert [p[1] for p in part.made] == [8, 8, 4] and [p[3] for p in part.made] == [0, 8, 16]
        writer.commit([part, None])
        assert [(s.rows, s.first) for s in bigann.shards(path)] == ([(8, 0), (8, 8), (4, 16)] if layout == "folder" else [(20, 0)])
        reader = bigann.BigAnnReader(path, {})
        assert [r for p in reader.partitions() for b in reader.read(p) for r in b.column(1).to_pylist()] == x.tolist()


def test_stream_gives_each_committed_file_once(spark, tmp_path):
    path, out, at = str(tmp_path / "s.fbin"), str(tmp_path / "out"), str(tmp_path / "at")

    def follow():
        stream = spark.readStream.format("bigann").load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.row, r.vector[0]) for r in spark.read.parquet(out).collect())

    write(numbered(spark, 0, 6), path, folder="true")
    assert follow() == [(i, float(i)) for i in range(6)]
    write(numbered(spark, 50, 3, 2), path, folder="true")
    want = [(i, float(i)) for i in range(6)] + [(6 + i, 50.0 + i) for i in range(3)]
    assert follow() == want and follow() == want
    write(numbered(spark, 0, 1, 1), path, "overwrite", folder="true")
    with pytest.raises(Exception, match="overwritten"):
        follow()


def test_patterns(tmp_path):
    for name in ("a_1/x_2.fbin", "a_1/x_10.fbin", "a_2/x_1.fbin", "a_2/.x_0.fbin", "b/x_3.fbin", "a_1/deep/x_9.fbin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    short = lambda pattern: [p.removeprefix(f"file://{tmp_path}/") for p in files.expand(f"file://{tmp_path}/{pattern}")]
    assert short("a_1/*.fbin") == ["a_1/x_2.fbin", "a_1/x_10.fbin"]
    assert short("a_*/x_*.fbin") == ["a_1/x_2.fbin", "a_1/x_10.fbin", "a_2/x_1.fbin"]
    assert short("none/*.fbin") == [] and short("b/x_3.fbin") == ["b/x_3.fbin"]


def test_schemes(monkeypatch):
    seen = []
    monkeypatch.setattr(files, "fs", type("F", (), {"FileSystem": type("G", (), {"from_uri": staticmethod(lambda u: seen.append(u) or (None, "bucket/key"))}), "LocalFileSystem": files.fs.LocalFileSystem}))
    for path in ("s3a://bucket/key", "s3://bucket/key", "hdfs://host:8020/key"):
        files.located(path)
    assert seen == ["s3://bucket/key", "s3://bucket/key", "hdfs://host:8020/key"]
    assert files.located("/a:b/c")[1] == "/a:b/c" and files.located("file:///a/b")[1] == files.located("file:/a/b")[1] == "/a/b"
