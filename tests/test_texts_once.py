from __future__ import annotations

from tessella.plans import catalogue


def test_a_plan_reads_texts_once(spark, tmp_path):
    rows = [(k, f"text {k % 9} " * 3, "en", "s") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("reconcile_states", "apply_collapse", "collapse_decisions"):
        found = catalogue.queries()[name](spark, str(tmp_path))
        assert not [f for f in found.inputFiles() if "documents.parquet" in f]
