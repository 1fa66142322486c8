import datetime
import statistics

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone import queries as engine
from siltstone.plans import analysis, metrics
from siltstone.sources import files
from siltstone.streaming import ingest

SF = "/root/testdata/sf0.001"


def tidy(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    cell = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(repr(tuple(cell(x.item() if hasattr(x, "item") else x) for x in row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    got, expected = engine.QUERIES[name](spark, SF).toPandas(), db.sql(engine.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert tidy(got) == tidy(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_empty_and_single_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 4.0), ("c", None)], "k string, v double")
    student = {r.k: (r.n, r.mean, r.half_width) for r in analysis.student_interval(df, ["k"], "v").collect()}
    assert student["a"] == (1, 1.0, 0.0) and "c" not in student
    normal = {r.k: r.ci95 for r in analysis.normal_interval(df, ["k"], "v").collect()}
    assert normal["a"] == 0.0 and normal["b"] == pytest.approx(1.96 * 1.5 / 2**0.5, abs=1e-4)


def test_student_quantiles(spark):
    # Two-sided 95 %: tabulated values for 5, 10, 30 and 139 degrees of freedom.
    for n, t in ((6, 2.5706), (11, 2.2281), (31, 2.0423), (140, 1.9772)):
        assert spark.range(1).select(analysis.student_quantile(F.lit(n))).first()[0] == pytest.approx(t, abs=2e-3)
    values = [float(v) for v in (3, 5, 8, 13, 21, 34, 1, 9)]
    got = analysis.student_interval(spark.createDataFrame([(v,) for v in values], "v double"), [], "v").first()
    assert got.half_width == pytest.approx(2.3646 * statistics.stdev(values) / 8**0.5, abs=2e-2)


def test_truncation(spark):
    df = spark.createDataFrame([(10_000_000, "0.973916125"), (12, "3"), (5, "0")], "size long, s string")
    got = df.select(analysis.rate_mib(F.col("size"), F.col("s").cast("decimal(20,9)")).cast("string")).collect()
    assert [r[0] for r in got] == ["9.78", "0.00", None]


def test_logs_and_versions(spark, tmp_path):
    for name in ("b10.tar", "b9.tar", "B1.tgz", "note.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())
    got = files.versions(spark, str(tmp_path / "in"), 2, files.ARCHIVES).orderBy("version").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["B1.tgz", "b9.tar"]
    (tmp_path / "log.csv").write_text(
        "Version,LogicalSize_Bytes,CommitTime_Seconds,Throughput_MB/s,LooseObjectsSize_Bytes,LooseMetadataSize_Bytes,LooseTotalSize_Bytes\n"
        "1,100,.973916125,1.50,40,2,42\n"
    )
    one = files.log(spark, str(tmp_path / "log.csv"))
    assert str(one.first()["CommitTime_Seconds"]) == "0.973916125"
    assert files.union_logs(one, one).count() == 2
    (tmp_path / "mixed.csv").write_text("x\n1.5\nno\n\n2\n")
    mixed = spark.read.csv(str(tmp_path / "mixed.csv"), header=True)
    assert sorted(r.value for r in files.numeric(mixed, "x").collect()) == [1.5, 2.0]


def test_dumps(spark, tmp_path):
    schema = "chunk_id long, base_chunk_id long, chunk_size long, save_size long, store_kind string"
    index = spark.createDataFrame([(0, None, 10, 5, "base_lz"), (1, 0, 10, 2, "delta_feature"), (2, None, 3, 3, "base_raw")], schema)
    recipes = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2)], "version long, seq long, chunk_id long")
    files.write_recipe_dump(recipes, index, str(tmp_path / "recipe"))
    files.write_index_dump(index, str(tmp_path / "index"))
    flags = {r.chunk_id: r.flag for r in spark.read.csv(str(tmp_path / "recipe"), header=True).collect()}
    assert flags == {"0": "NO_DELTA", "1": "DELTA", "2": "NO_LZ4"}
    assert spark.read.csv(str(tmp_path / "index"), header=True).count() == 3


def test_versions_in_windows(spark, tmp_path):
    """Files larger than a window: every byte once, chunks restore each version, empty files stay."""
    from siltstone.operators import chunking, fingerprint, methods, store
    from siltstone.sources import windows

    bodies = {"v2.bin": bytes(range(256)) * 40, "v10.bin": b"x" * 5000 + bytes(range(256)) * 20, "v1.bin": b"", "sub/v3.bin": b"end"}
    (tmp_path / "sub").mkdir()
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    found = windows.version_windows(spark, f"file://{tmp_path}", 4096).cache()
    assert found.count() == 3 + 3 + 1 + 1 and max(len(r.content) for r in found.collect()) == 4096
    order = ["sub/v3.bin", "v1.bin", "v2.bin", "v10.bin"]
    chunks = chunking.chunk(found.drop("offset"), "content", "fastcdc", least=64, average=256, most=1024)
    chunks = fingerprint.with_fingerprint(windows.in_order(chunks)).cache()
    index = fingerprint.chunk_index(chunks, "chunk").cache()
    whole = store.restore(fingerprint.recipes(chunks, index), methods.reduce(index, "odess"), found)
    assert {r.version: bytes(r.content) for r in whole.collect()} == {k: bodies[name] for k, name in enumerate(order)}


def test_report_lines(spark, tmp_path):
    from siltstone.plans import analysis

    figures = spark.createDataFrame([(10, 2.5, None)], "chunks long, ocr double, dcr double")
    for _ in range(2):
        metrics.write_report(figures, str(tmp_path / "report"))
    lines = spark.read.text(str(tmp_path / "report"))
    assert sorted(r[0] for r in lines.collect()) == ["chunks: 10", "chunks: 10", "ocr: 2.5", "ocr: 2.5"]
    keyed = lines.selectExpr("1 AS k", "value AS line", "value AS o")
    assert analysis.metric_lines(keyed, "line", r"^ocr: (.*)$", ["k"], "o").first().line == "2.5,2.5"


def test_figures_of_no_events(spark):
    schema = "version long, chunk_id long, kind string, store_kind string, chunk_size long, save_size long, is_first boolean"
    row = metrics.counts(spark.createDataFrame([], schema)).first()
    assert row.logical_chunks == 0 and row.ocr is None


def test_stream_equals_batch_and_ages(spark, tmp_path):
    batch = engine._narrow(spark, SF).select("fp").distinct().count()
    assert engine.stream_unique_chunks(spark, SF).count() == batch
    start = datetime.datetime(2024, 1, 1)
    day = lambda n: start + datetime.timedelta(days=n)
    rows = [(7, 0, day(0)), (7, 1, day(2)), (7, 2, day(6)), (8, 3, day(0)), (7, 4, day(7))]
    spark.createDataFrame(rows, "sf long, chunk_id long, seen timestamp").coalesce(1).write.parquet(str(tmp_path / "sfs"))
    stream = spark.readStream.schema("sf long, chunk_id long, seen timestamp").parquet(str(tmp_path / "sfs"))
    got = ingest.drain(ingest.aged_first_seen(stream.withWatermark("seen", "0 seconds"), 2), "aged")
    assert sorted(map(tuple, got.collect())) == [(7, 1, 0), (7, 4, 2)]
