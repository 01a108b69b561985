from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm.mixing import MixConfig, leaf_budgets, mix


def fill(budget, children):
    """Water-filling by handing out what is left until nothing changes: {name: (weight, cap)}."""
    open_ = dict(children)
    out, left = {}, budget
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = [c for c, (w, cap) in open_.items() if cap / w <= level]
        if not full:
            return out | {c: int(level * w) for c, (w, _) in open_.items()}
        for c in full:
            out[c] = open_.pop(c)[1]
            left -= out[c]
    return out


def expected(rows, config):
    n = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    leaf_of = lambda r: ("d" + (r[3] or "")[-1:], r[2] or "", r[3] or "")
    units = defaultdict(lambda: defaultdict(int))
    for r in rows:
        units[leaf_of(r)]["" if r[0] is None else str(r[0])] += n(r[1])
    tokens = {leaf: sum(u.values()) for leaf, u in units.items() if sum(u.values())}
    cap = lambda *path: sum(t * config.max_epochs for leaf, t in tokens.items() if leaf[: len(path)] == path)
    kids = lambda *path: {leaf[len(path)] for leaf in tokens if leaf[: len(path)] == path}
    budget = {}
    for d, b in fill(sum(tokens.values()) * config.percent // 100, {d: (config.domain_weights.get(d, 1), cap(d)) for d in kids()}).items():
        for x, c in fill(b, {x: (config.lang_weights.get(x, 1), cap(d, x)) for x in kids(d)}).items():
            for s, v in fill(c, {s: (config.source_weights.get(s, 1), cap(d, x, s)) for s in kids(d, x)}).items():
                budget[d, x, s] = v
    times = Counter()
    for leaf, b in budget.items():
        full, rest = divmod(b, tokens[leaf])
        order = sorted(units[leaf], key=lambda k: hashlib.md5(f"{config.seed}:{full}:{k}".encode()).hexdigest())
        running = 0
        for k in order:
            running += units[leaf][k]
            times[leaf, k] = full + (running <= rest)
    out = []
    for r in rows:
        out += [(*r, e) for e in range(times[leaf_of(r), "" if r[0] is None else str(r[0])])]
    return budget, sorted(map(str, out))


def corpus():
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randint(1, 40)), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for k in range(500)]
    return [*rows, (None, "null key here", "en", "s2"), (501, None, "en", "s1"), (502, "", "xx", "s9"), (503, "twin text", "de", "s3"), (503, "twin text", "de", "s3"), (504, "long " * 30_000, "de", "s2")]


def test_mix_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    domain = F.concat(F.lit("d"), F.coalesce(F.substring("source", -1, 1), F.lit("")))
    for config in (
        MixConfig(), MixConfig(percent=120, max_epochs=3, domain_weights={"d1": 5}, lang_weights={"de": 7}, source_weights={"s2": 3}),
        MixConfig(percent=500, max_epochs=1), MixConfig(percent=30, broadcast_leaves=0),
    ):
        budget, want = expected(rows, config)
        assert sorted(str(tuple(r)) for r in mix(docs, domain, config).collect()) == want
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ ]+"), lambda w: w != "")).cast("long")
        tokens = docs.select(domain.alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), words.alias("tokens"))
        assert {(r["domain"], r["lang"], r["source"]): r["budget"] for r in leaf_budgets(tokens, config).collect()} == budget


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "x", 7)], "doc_id long, text string, lang string, source string, domain string, tokens int")
    assert [tuple(r) for r in mix(docs, F.lit("d"), MixConfig(percent=100)).collect()] == [(1, "a b", "en", "s", "x", 7, 0)]
    assert mix(docs.limit(0), F.lit("d")).count() == 0
