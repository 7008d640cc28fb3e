import json

import pytest

from skarn.operators.scoring import ExpressionScorer
from skarn.plans import cli, runs
from skarn.sources import readers, writers
from skarn.streaming.scorer import score_stream


def test_merge_and_overrides():
    assert runs.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"b": None, "c": [2]}, "d": 3}) == {"a": {"b": 1, "c": [2]}, "d": 3}
    args = cli._parser().parse_args(["score", "--config", "c", "--threshold", "0.3"])
    assert cli.overrides(args) == {"scoring": {"threshold": 0.3}}
    assert cli.main(["no-such-command"]) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,None\n2,\n")
    assert [r.y for r in readers.read_table(spark, str(tmp_path / "a.csv")).collect()] == ["None", None]
    assert [r.y for r in readers.read_csv(spark, str(tmp_path / "a.csv"), na_values=("None",)).collect()] == [None, None]
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "b.csv"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no reader"):
        readers.read_table(spark, str(tmp_path / "a.txt"))
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="mapping"):
        readers.load_yaml(str(tmp_path / "l.yaml"))
    with pytest.raises(ValueError, match="unknown source"):
        readers.load_dataset(spark, {"source": "x"})


def test_batch_inference(spark, tmp_path):
    spark.range(1, 26).selectExpr("id as customer_id", "id / 25 as x").write.parquet(str(tmp_path / "in"))
    config = {"input": {"path": str(tmp_path / "in")}, "output": {"path": str(tmp_path / "out")}, "model": {"expression": "x"}, "scoring": {"id_column": "customer_id", "chunk_size": 10, "sample_rows": 3}}
    tracker = runs.build_tracker({"kind": "json", "folder": str(tmp_path / "runs")})
    got = runs.batch_inference(spark, config, tracker)
    assert got.metrics["n"] == 25 and got.metrics["positives"] == 13 and got.chunks == 3
    assert spark.read.parquet(str(tmp_path / "out")).where("run_id is not null").count() == 25
    assert json.loads((tmp_path / "runs" / f"{got.run_id}.json").read_text())["status"] == "FINISHED"
    with pytest.raises(RuntimeError), runs.tracked(tracker, "bad"):
        raise RuntimeError
    assert json.loads((tmp_path / "runs" / "bad.json").read_text())["status"] == "FAILED"


def test_writer(spark, tmp_path):
    writer = writers.RunWriter(str(tmp_path), "r", "2020-01-02")
    writer.write(spark.range(0))
    assert not (tmp_path / "run_date=2020-01-02").exists()
    writer.finalize()
    with pytest.raises(RuntimeError):
        writer.write(spark.range(1))
    assert writers.markdown_table(["a"], []) == "_(no rows)_"
    assert "a\\|b" in writers.markdown_table(["a"], [["a|b"]])


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "d.csv").write_text("x,c\n" + "".join(f"{i},{'ab'[i % 2]}\n" for i in range(50)))
    (tmp_path / "s.yaml").write_text("columns:\n  x: {dtype: int, max: 40}\n  c: {dtype: str}\n")
    assert cli.main(["validate-schema", "--config", str(tmp_path / "s.yaml"), "--input", str(tmp_path / "d.csv"), "--report", str(tmp_path / "r")]) == 1
    assert json.loads((tmp_path / "r.json").read_text())["rows"][0]["rule"] == "range.max"
    (tmp_path / "f.yaml").write_text("numeric_features:\n  x: {psi_warn: 0.1, psi_fail: 0.25, ks_fail: 0.1}\ncategorical_features:\n  c: {psi_fail: 0.2}\n")
    call = ["detect-drift", "--config", str(tmp_path / "f.yaml"), "--reference", str(tmp_path / "d.csv"), "--current", str(tmp_path / "d.csv"), "--report", str(tmp_path / "q")]
    assert cli.main(call) == 0
    assert cli.main([*call[:-1], str(tmp_path / "q"), "--config", str(tmp_path / "none.yaml")]) == 2


def test_stream(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.range(5).selectExpr("id", "id / 4 as x").write.parquet(source)
    for more in (5, 8):
        score_stream(spark, source, "id long, x double", str(tmp_path / "o"), str(tmp_path / "c"), ExpressionScorer("x"), 0.5, "id").awaitTermination()
        assert spark.read.parquet(str(tmp_path / "o")).count() == more
        spark.range(5, 8).selectExpr("id", "1.0D as x").write.mode("append").parquet(source)


def test_train_save_load_predict(spark, tmp_path):
    config = {
        "data": {"n_samples": 400}, "features": {"numeric": ["tenure_months", "monthly_charges"], "categorical": ["contract_type"], "target": "churn", "id_column": "customer_id"},
        "model": {"name": "logistic_regression"}, "tuning": {"folds": 2}, "output": {"model": str(tmp_path / "m"), "metrics": str(tmp_path / "m.json")},
    }
    record = runs.train_run(spark, config)
    assert json.loads((tmp_path / "m.json").read_text())["test"] == record["test"] and record["n_train"] + record["n_test"] == 400
    readers.load_dataset(spark, {"n_samples": 20}).write.option("header", True).csv(str(tmp_path / "in.csv"))
    out = runs.predict_csv(spark, str(tmp_path / "m"), str(tmp_path / "in.csv"), str(tmp_path / "out"), "churn")
    back = readers.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == out.columns and "churn" not in back.columns and back.where("churn_probability between 0 and 1").count() == 20
    first = runs.content_sha256(spark, str(tmp_path / "m"))
    assert first == runs.content_sha256(spark, str(tmp_path / "m")) and len(first) == 64
    with pytest.raises(FileNotFoundError):
        readers.load_model(spark, str(tmp_path / "none"))
    import hashlib

    assert runs.content_sha256(spark, str(tmp_path / "m.json")) == hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest()


def png(path, pixels):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(x for p in line for x in p) for line in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "mild.png", [[(255, 0, 51)] * 7] * 3)
    png(tmp_path / "severe.png", [[(0, 255, 0)] * 4 + [(0, 0, 255)] * 4] * 500)
    (tmp_path / "notes.png").write_text("no image")
    got = {r.path.split("/")[-1]: r for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"mild.png", "severe.png"}
    assert (got["mild.png"].label, got["severe.png"].label) == (0, 1)
    assert [round(got["mild.png"][c], 6) for c in "rgb"] == [1, 0, 0.2]
    assert [round(got["severe.png"][c], 6) for c in "rgb"] == [0, 0.5, 0.5]
