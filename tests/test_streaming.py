from __future__ import annotations

from tessella.streaming.fingerprints import follow


def test_each_file_counts_once(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, text string"
    for k in range(2):
        spark.createDataFrame([(f"p{k}", "é" * k)], schema).write.mode("append").parquet(folder)
        for _ in range(2):
            follow(spark, folder, schema, target, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r["path"], r["size"]) for r in spark.read.parquet(target).collect()) == [("p0", 0), ("p1", 2)]
