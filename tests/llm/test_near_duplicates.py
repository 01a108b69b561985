from __future__ import annotations

import corpus_pipeline as P
from tests.llm.test_pipeline import SCHEMA


def kept(spark, rows):
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    return sorted(map(tuple, got), key=str)


def row(k, text, source="s"):
    return (k, text, "en", source, len(text))


def test_unique_texts_stay_whatever_their_ids(spark):
    far = " ".join(f"w{k}" for k in range(40))
    near = far + " more"
    rows = [row(None, "a b c"), row(1, "x y z"), row(1, "other words"), row(None, "q r s"), row(2, far), row(3, near), row(3, "only here"), row(None, far)]
    assert kept(spark, rows) == sorted([r for r in rows if r not in (row(3, near), row(None, far))], key=str)


def test_copies_go_also_without_ids(spark):
    rows = [row(None, "a b c"), row(None, "A b c"), row(None, "a b c", "t"), row(5, "x y"), row(5, "x y"), row(5, "X  y"), row(6, "x y")]
    got = kept(spark, rows)
    assert [r[0] for r in got] == [5, None] and {r[1].lower().split()[0] for r in got} == {"x", "a"}
    empty = [row(None, ""), row(None, ""), row(None, "", "t"), row(7, ""), row(8, "")]
    assert kept(spark, empty) == sorted(set(empty), key=str)


def test_an_id_that_a_third_of_all_rows_share_loses_nothing(spark):
    rows = [row(0 if k % 3 == 0 else None if k % 3 == 1 else k, f"alone{k} here{k}") for k in range(90)]
    assert kept(spark, rows) == sorted(rows, key=str)
