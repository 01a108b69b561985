from __future__ import annotations

from collections import Counter
from pathlib import Path

import corpus_pipeline as P
from tessella.runtime import SOME, shared_dir
from tests.llm import test_jaccard_join as J
from tests.llm.test_pipeline import SCHEMA, corpus


def test_cut_lineage_has_few_files_with_many_partitions(spark):
    """As many files a step as cores ask for, however many partitions there are."""
    folder, conf = Path(shared_dir(spark).removeprefix("file:")), {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held, before = {k: spark.conf.get(k) for k in conf}, set(folder.iterdir()) if folder.exists() else set()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = J.corpus(4)
        assert J.run(spark, rows) == J.expected(rows)
        docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
        assert P.mixing(spark, P.near_duplicates(spark, docs, ""), "").count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = Counter(f.parent.name for d in set(folder.iterdir()) - before for f in d.glob("part-*.parquet"))
    assert files and max(files.values()) <= SOME * spark.sparkContext.defaultParallelism, files.most_common(5)
