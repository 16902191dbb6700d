import json

from lexigraph import runtime
from lexigraph.plans import cli


def test_clear_removes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_made", {})
    df = runtime.materialize(spark.range(10))
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 10 and spark.read.parquet(folder).count() == 10
    runtime.clear(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    runtime.clear(spark)


def encoder(texts):
    """Vectors of two numbers."""
    import numpy as np

    return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)


def test_command_line_with_an_encoder(spark, tmp_path, monkeypatch):
    from mini import LANGUAGES, RECORDS

    monkeypatch.setattr(runtime, "_made", {})
    (tmp_path / "dump.jsonl").write_text("\n".join(json.dumps(r) for r in RECORDS))
    (tmp_path / "languages.json").write_text(json.dumps(LANGUAGES))
    cli.main(["-d", f"{tmp_path}/dump.jsonl", "-l", f"{tmp_path}/languages.json", "-s", f"{tmp_path}/snapshot", "-t", f"{tmp_path}/turtle", "-c", f"{tmp_path}/vectors", "-m", "tests.test_runtime:encoder"])
    assert {len(r["vec"]) for r in spark.read.parquet(f"{tmp_path}/vectors").collect()} == {2}
    assert spark.read.parquet(f"{tmp_path}/snapshot/items").count() > 0 and spark.read.text(f"{tmp_path}/turtle").count() > 0
