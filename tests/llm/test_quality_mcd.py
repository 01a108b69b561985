from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tessella.llm.quality_mcd import QualityConfig, concentrated, estimate, quality_verdicts, text_statistics

TEXTS = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "q\x0bw\x0ce\rr",
    "one two three\none two three\n\n \none two three four\n#*$%&|<>", "é ü 日本 🙂 é ü 日本 🙂", "a b c d a b c b c d a b",
    "w x y z", "lone words " * 4000, " ".join(map(str, range(3000))) + " 1 2 3 4",
]


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(covered)


def test_statistics_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = text_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_estimate_is_robust_and_near_the_bulk(spark):
    rng = np.random.default_rng(5)
    bulk = rng.multivariate_normal([0, 0, 0, 0], [[4, 2, 0, 0], [2, 3, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]], 4000) * 1000
    far = rng.normal(30_000, 100, (800, 4))
    rows = [("g", *map(int, x), 1) for x in np.vstack([bulk, far]).round()]
    config = QualityConfig(floors=(0.0,) * 4)
    model = estimate(spark.createDataFrame(rows, "grp string, z0 long, z1 long, z2 long, z3 long, weight long"), config).first()
    assert max(abs(model[f"m{i}"]) for i in range(4)) < 300  # the mean of all rows is at 5000
    low = np.array([[model[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    got = low @ low.T / model["scale"]
    # the overall median is the 0.6 quantile of the bulk, as a sixth of the rows lies beyond it
    wide = 4.0446 / 3.3567
    assert np.allclose(got / 1e6 / wide, [[4, 2, 0, 0], [2, 3, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]], atol=0.3)


def test_verdicts(spark):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    rows = [(k, plain(rng.integers(60, 300)), "en", "s") for k in range(200)]
    rows += [(200, "w# $$x %y " * 10 + plain(60), "en", "s"), (201, "short text", "en", "s"), (202, None, None, None), (203, plain(80), None, "t"), (203, plain(80), None, "t")]
    rows += [(204, "a b c " * 100, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_words": F.lit("x"), "grp": F.lit(1)})
    got = quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert sum(not kept[k] for k in range(200)) <= 2
    assert not kept[200] and not kept[201] and not kept[202] and kept[203] and not kept[204]
    assert {r["doc_id"] for r in got if r["base_failed"]} == {201, 202, 204}
    salted = quality_verdicts(docs, QualityConfig(broadcast_groups=0)).collect()
    assert sorted(map(str, got)) == sorted(map(str, salted))
    assert quality_verdicts(docs.limit(0)).count() == 0


def rank_mcd(x: np.ndarray, h: int, tries: int = 300) -> float:
    """The least log determinant of ``h`` rows that random starts of five rows end at."""
    rng, least = np.random.default_rng(0), np.inf
    for _ in range(tries):
        at = rng.choice(len(x), 5, replace=False)
        for _ in range(60):
            mean, cov = x[at].mean(0), np.cov(x[at].T, bias=True) + 1e-6 * np.eye(4)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if len(new) == len(at) and (new == at).all():
                break
            at = new
        least = min(least, np.linalg.slogdet(np.cov(x[at].T, bias=True))[1])
    return least


def test_determinant_is_that_of_a_search_with_random_starts(spark):
    config, h = QualityConfig(floors=(0.0,) * 4), int(np.ceil(0.75 * 240))
    rng, rows, want = np.random.default_rng(8), [], {}
    for name, share in (("clean", 0.0), ("some", 0.1), ("many", 0.2)):
        mix = rng.normal(0, 1, (4, 4)) + 2 * np.eye(4)
        x = (rng.normal(0, 1, (240, 4)) @ mix * 3000).round()
        far = int(share * 240)
        x[:far] = (rng.normal(0, 1, (far, 4)) * 800 + [20_000, -15_000, 10_000, 25_000]).round()
        want[name] = rank_mcd(x, h)
        rows += [(name, *map(int, r), 1) for r in x]
    cells = spark.createDataFrame(rows, "grp string, z0 long, z1 long, z2 long, z3 long, weight long")
    got = {r["grp"]: r["logdet"] for r in concentrated(cells, config).collect()}
    assert set(got) == set(want)
    for name in want:  # the h-th row's bucket counts by its share here, so the subsets differ by a row or so
        assert abs(got[name] - want[name]) < 0.12, (name, got, want)
    # rows that are repeated count as often as they are weighed
    twice = cells.filter("grp = 'some'").withColumn("weight", F.lit(2).cast("long"))
    assert abs(concentrated(twice, config).first()["logdet"] - got["some"]) < 0.02


def brute_verdicts(docs, config):
    """The whole method in numpy, row by row: {id: (kept, distance)}."""
    unit, floors = 1024, np.array(config.floors) * 1024
    rnd = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
    out, groups = {}, {}
    for k, text, lang, source in docs:
        n, chars, symbols, lines, repeats = brute(text)
        if n < config.min_words or 100 * repeats > config.max_repeat_percent * n:
            out[k] = (False, None)
            continue
        z = rnd(np.array([np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(lines / n), np.sqrt(repeats / n)]) * unit)
        groups.setdefault((lang or "", source or ""), []).append((k, z))
    bucket = lambda d: np.floor(np.log2(np.minimum(d, 1e12) * 16 + 1) * 32)
    upper = lambda b: (2 ** ((b + 1) / 32) - 1) / 16
    far = lambda x, m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    middle = lambda d: np.sort(bucket(d))[(len(d) + 1) // 2 - 1]

    def moments(x, w):
        m = (w[:, None] * x).sum(0) / w.sum()
        return m, (w[:, None] * x).T @ x / w.sum() - np.outer(m, m) + np.diag(floors**2)

    def fit(x):
        med = np.median(x, axis=0)
        d = np.maximum(np.median(np.abs(x - med), axis=0) * 1.4826 + floors, 1.0)
        y, best = (x - med) / d, None
        for start in range(3):
            if start == 1:
                q = (y * y).sum(1, keepdims=True)
                r = (y.T @ np.divide(y, q, out=np.zeros_like(y), where=q > 0)) / len(y)
            else:
                r = np.cov(np.tanh(y).T, bias=True) if start else np.eye(4)
            s = np.diag(r)
            both = np.outer(s, s)
            r = np.where(both > 1e-12, 0.99 * r / np.sqrt(np.maximum(both, 1e-12)), 0.0)
            np.fill_diagonal(r, 1.0)
            m, c, det = med, (r if start else np.eye(4)) * np.outer(d, d), np.inf
            for _ in range(config.steps):
                b = bucket(far(x, m, c))
                h, w = np.ceil(len(x) * config.subset), np.zeros(len(x))
                for v in np.unique(b):
                    w[b == v] = np.clip((h - (b < v).sum()) / (b == v).sum(), 0, 1)
                m2, c2 = moments(x, w)
                new = np.linalg.slogdet(c2)[1]
                if not new < det - config.tolerance:
                    break
                m, c, det = m2, c2, new
            if best is None or det < best[0]:
                best = (det, m, c)
        _, m, c = best
        d2 = far(x, m, c)
        reach = upper(max(middle(d2), bucket(config.chi_median))) * config.chi_reweight / config.chi_median
        inner = d2 <= reach
        return inner.sum(), *moments(x[inner], np.ones(inner.sum()))

    every = fit(np.array([z for g in groups.values() for _, z in g]))
    for g in groups.values():
        x = np.array([z for _, z in g])
        n, m, c = fit(x)
        a = config.prior / (n + config.prior)
        m, c = (1 - a) * m + a * every[1], (1 - a) * c + a * every[2]
        d2 = far(x, m, c)
        d2 = d2 * config.chi_median / max(upper(middle(d2)), config.chi_median)
        out |= {k: (bool(v <= config.cutoff), v) for (k, _), v in zip(g, d2, strict=True)}
    return out


def test_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(1, 10)))
    docs = []
    for k in range(260):
        text = " ".join(word() for _ in range(rng.integers(40, 160)))
        if k % 6 == 0:
            text += "\n# | $" * int(rng.integers(1, 30))
        if k % 9 == 0:
            text += " " + text[: rng.integers(1, len(text))]
        docs.append((k, text, ["en", "de", None][k % 3] if k < 250 else "xx", f"s{k % 2}" if k < 250 else f"few{k}"))
    config = QualityConfig(cutoff=14.0)
    got = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality_verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), config).collect()}
    want = brute_verdicts(docs, config)
    assert got.keys() == want.keys() and 3 < sum(not v for v, _ in want.values()) < 80
    for k, (kept, d) in want.items():
        assert (got[k][1] is None) == (d is None), k
        assert d is None or abs(got[k][1] - d) <= 1e-4 * max(d, 1), (k, got[k], d)
        assert got[k][0] == kept, k
