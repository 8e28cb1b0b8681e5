"""Readers, writers, workflows, streams and the command line."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid import cli
from phasegrid.plans import workflow
from phasegrid.sources import raster, tables, text
from phasegrid.streaming import running


def test_text_lists(spark, tmp_path):
    (tmp_path / "pairs").write_text("20180102_20180105.int\n20180101_20180102.int\n\n")
    (tmp_path / "base").write_text("S1A_20180101.geo S1A_20180113.geo 12.0 -16.73\n")
    (tmp_path / "stations.csv").write_text("TXA,31.5,-103.2,800\n")
    (tmp_path / "d.rsc").write_text("WIDTH         4\nFILE_LENGTH   3\nX_FIRST -103.0\nY_FIRST 31.0\nX_STEP 0.1\nY_STEP -0.1\nX_UNIT degrees\nPROJECTION LL\n")
    (tmp_path / "poly.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}))
    assert [r.early.day for r in text.read_pairs(spark, f"{tmp_path}/pairs").collect()] == [1, 2]
    b = text.read_baselines(spark, f"{tmp_path}/base").first()
    assert (b.slc1, b.slc2, b.temporal, b.spatial) == (dt.date(2018, 1, 1), dt.date(2018, 1, 13), 12.0, -16.73)
    assert text.read_dates(spark, f"{tmp_path}/missing").count() == 0
    assert tuple(text.read_stations(spark, f"{tmp_path}/stations.csv").first()) == ("TXA", -103.2, 31.5)
    h = text.read_header(spark, f"{tmp_path}/d.rsc").first()
    assert (h.width, h.file_length, h.x_step, h.projection, h.z_scale) == (4, 3, 0.1, "LL", None)
    (tmp_path / "e.rsc").write_text(text.header_text(h.asDict()))
    assert text.read_header(spark, f"{tmp_path}/e.rsc").first() == h
    assert len(text.read_polygon(spark, f"{tmp_path}/poly.geojson").first().ring) == 4
    p = text.parse_products(spark.createDataFrame([("S1A_IW_SLC__1SDV_20180420T004512_20180420T004539_021546_0251C9_5D3A.SAFE",), ("other",)], "name string"))
    assert (p.count(), p.first().path, p.first().date) == (1, (21546 - 73) % 175 + 1, dt.date(2018, 4, 20))


def test_flat_rasters(spark, tmp_path):
    raster.register(spark)
    image = np.arange(12, dtype="<f4").reshape(3, 4)
    two = np.hstack([image, image * 10]).astype("<f4")
    cpx = (image + 1j * image).astype("<c8")
    for name, a in (("a.bin", image), ("b.unw", two), ("c.int", cpx)):
        a.tofile(tmp_path / name)
        (tmp_path / f"{name}.rsc").write_text("WIDTH 4\nFILE_LENGTH 3\n")
    read = lambda n, **o: {(r.prow, r.pcol): (r.value, r.imag) for r in spark.read.format("flat_raster").options(path=f"{tmp_path}/{n}", **o).load().collect()}
    assert read("a.bin")[2, 3] == (11.0, 0.0)
    assert read("b.unw", kind="float32x2", band="2")[1, 2] == (60.0, 0.0)
    assert read("c.int", kind="complex64")[0, 3] == (3.0, 3.0)
    df = spark.read.format("flat_raster").option("path", f"{tmp_path}/a.bin").load().withColumn("path", F.lit("out.bin")).withColumn("value", F.col("value") * 2)
    df.repartition(1, "path").write.format("flat_raster").mode("append").save(f"{tmp_path}/written")
    assert np.array_equal(np.fromfile(tmp_path / "written/out.bin", "<f4").reshape(3, 4), image * 2)


def test_tables(spark, tmp_path):
    df = spark.range(4).withColumn("b", F.col("id") % 2)
    root = str(tmp_path)
    assert tables.save(df, root, "x") and not tables.save(df, root, "x", "ignore")
    with pytest.raises(Exception):
        tables.save(df, root, "x")
    tables.save(df, root, "y", "overwrite", ["b"])
    tables.save(df.filter("b = 1").withColumn("id", F.lit(9).cast("long")), root, "y", "overwrite", ["b"])
    assert sorted((r.id, r.b) for r in tables.load(spark, root, "y").collect()) == [(0, 0), (2, 0), (9, 1), (9, 1)]
    tables.record(spark, root, {"order": 1})
    assert spark.read.text(f"{root}/parameters").count() == 1
    assert tables.described(df, "cm").schema["b"].metadata["unit"] == "cm"


def _network(spark, noise=0.0):
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=12 * k) for k in range(6)]
    history = lambda r, c, k: (r + 1) * 0.1 * 12 * k + 0.3 * c * (k > 3)
    net = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    pairs = spark.createDataFrame([(n, days[i], days[j], (days[j] - days[i]).days) for n, (i, j) in enumerate(net)], "ifg_idx int, early date, late date, dt_days int")
    stack = spark.createDataFrame([(n, r, c, history(r, c, j) - history(r, c, i)) for n, (i, j) in enumerate(net) for r in range(3) for c in range(2)], "ifg_idx int, prow int, pcol int, phase double")
    return days, history, pairs, stack


def test_workflow(spark, tmp_path):
    days, history, pairs, stack = _network(spark)
    cor = stack.select("ifg_idx", "prow", "pcol", F.lit(0.8).alias("cor"))
    out = workflow.run_inversion(stack, pairs, spark.createDataFrame([(days[2],)], "date date"), cor, workflow.Inversion(max_days=40, scale=1.0, cor_threshold=0.5))
    got = {(r.prow, r.pcol, r.date): r.defo for r in out["history"].collect()}
    assert len(got) == 5 * 6 and all(abs(v - (history(r, c, days.index(d)) - history(r, c, 0))) < 1e-9 for (r, c, d), v in got.items())
    m = workflow.model_history(out["history"].filter("pcol = 0"))
    assert all(abs(r.velocity - (r.prow + 1) * 0.1 * 365.25) < 1e-6 for r in workflow.model_history(out["history"].filter("pcol = 0"), False)["velocity"].collect())
    assert set(m) == {"atmosphere", "velocity", "model"}
    prepared = workflow.prepare_stack(stack, cor, stack.select("ifg_idx", "prow", "pcol", (F.col("prow") == 9).alias("masked")), workflow.Prepare(reference=(1, 1), window=1))
    assert all(abs(r.phase) < 1e-9 for r in prepared.filter("prow = 1 and pcol = 1").collect())
    root = str(tmp_path)
    pairs.write.parquet(f"{root}/pairs")
    stack.write.parquet(f"{root}/stack")
    assert cli.main(["--root", root, "invert", "--max-days", "40", "--model"]) == 0
    assert spark.read.parquet(f"{root}/out_history").count() == 36


def test_plans(tmp_path, capsys):
    assert workflow.parse_steps("1,9-10") == [1, 9, 10] and workflow.parse_steps("4,5,7") == [4, 5, 7]
    with pytest.raises(ValueError):
        workflow.parse_steps("0-3")
    assert workflow.parse_extra(["--num-sigma", "3", "--verbose", "--name", "x", "--flag", "false"]) == {"num_sigma": 3.0, "verbose": True, "name": "x", "flag": False}
    r, c = workflow.block_shape(100, 1000, 1000, (10, 10))
    assert 100 * r * c * 4 <= 10e6 and r == 1000 and c == 20
    (tmp_path / "jobs.toml").write_text('[los]\norder = 1\nmask = true\n[paths.78.los]\norder = 2\n[paths.85.los]\n')
    jobs = workflow.read_jobs(str(tmp_path / "jobs.toml"))[1]
    assert [(j.name, j.options["order"], j.options["mask"]) for j in jobs] == [("78", 2, True), ("85", 1, True)]
    assert cli.main(["steps", "3-5"]) == 0 and capsys.readouterr().out == "3 4 5\n"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, r, float(k * r)) for k in range(5) for r in range(3)], "layer int, prow int, value double").withColumn("pcol", F.lit(0))
    df.filter("layer < 3").write.parquet(f"{tmp_path}/in/a")
    df.filter("layer >= 3").write.parquet(f"{tmp_path}/in/b")
    stream = running.arriving(spark, f"{tmp_path}/in/*", "layer int, prow int, value double, pcol int")
    q = running.to_memory(running.running_mean(stream), "means", "complete", f"{tmp_path}/cp")
    q.awaitTermination()
    want = {(r.prow, r.pcol): (round(r["mean"], 9), r.n) for r in running.running_mean(df).collect()}
    assert {(r.prow, r.pcol): (round(r["mean"], 9), r.n) for r in spark.table("means").collect()} == want


def test_entry_and_sql(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
