from __future__ import annotations

import random
from collections import defaultdict

from tessella.llm.line_dedup import LineConfig, drop_boilerplate

AROUND = " \t\n\x0b\x0c\r"


def expected(rows, sites):
    spread = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            spread[line.strip(AROUND)].add(site)
    out = []
    for key, text, site in rows:
        lines = text.split("\n") if text is not None else []
        gone = [x for x in lines if x.strip(AROUND) and len(spread[x.strip(AROUND)]) >= sites]
        kept = "\n".join(x for x in lines if not (x.strip(AROUND) and len(spread[x.strip(AROUND)]) >= sites))
        out.append((key, None if text is None else kept, site, sum(bool(x.strip(AROUND)) for x in lines), len(gone)))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(8)
    common = [f"line {k} é" for k in range(12)]  # line k is on about 2 k sites
    rows = []
    for k in range(150):
        site = rng.choice([None, "", *(f"s{j}" for j in range(24))])
        text = [x for j, x in enumerate(common) if rng.random() < j / 24] + [f"own {k}", "", " \t"] + [f"own {k}"] * rng.randint(0, 2)
        rng.shuffle(text)
        rows.append((k, rng.choice(["\n", "\r\n", "\n \n"]).join(text), site))
    return [*rows, (200, None, "s1"), (201, "", "s2"), (202, "line 11 é", None), (202, "line 11 é", None), (203, "x " * 60_000 + "\nline 11 é", "s3")]


def result(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_equals_brute_force_on_both_ways(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for sites in (2, 9, 10):
        want = expected(rows, sites)
        assert result(drop_boilerplate(docs, LineConfig(min_sites=sites))) == want
        assert result(drop_boilerplate(docs, LineConfig(min_sites=sites, broadcast_lines=0))) == want


def test_wide_spreads_are_decided_by_sketches(spark):
    rows = [(k, "everywhere\n" + ("half\n" if k % 2 else "") + f"own {k}", f"site {k}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(drop_boilerplate(docs, LineConfig(min_sites=1200))) == expected(rows, 1200)
    assert result(drop_boilerplate(docs, LineConfig(min_sites=750))) == expected(rows, 750)


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([("a", "b", "c", "d")], "line string, text string, source string, site string")
    assert [tuple(r) for r in drop_boilerplate(docs).collect()] == [("a", "b", "c", "d", 1, 0)]
    assert drop_boilerplate(docs.limit(0)).count() == 0
