from __future__ import annotations

import random
import zlib

from tessella.llm.langid_ftrl import LangConfig, fit_temperature, identify, tag_languages
from tessella.llm.toxicity_nnpu import ToxicConfig, score_toxicity

SYLLABLES = {"xx": "ka to mi ne su ra".split(), "yy": "öl ße äch üng tze ie".split(), "zz": "ñor ción llo que rra ez".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        yield k, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(2, 60))), lang


def test_languages_held_out_accuracy_and_defined_results(spark):
    rows = [(k, t, lang, 0) for k, t, lang in texts(600)]
    rows += [(1000, None, "xx", 0), (1001, "", "xx", 0), (1002, "12 34 !!", "yy", 0), (None, "kato mira", "xx", 0), (1003, "kato mira", None, 0), (1004, "ka to mi " * 60_000, None, 0), (5, rows[5][1], None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)
    got = identify(docs).collect()
    assert len(got) == len(rows)
    truth = {k: lang for k, _, lang, _ in rows[:600]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 100
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002, None, 1003, 1004)] == ["und", "und", "und", "xx", "xx", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got)
    tagged = tag_languages(docs)
    assert tagged.columns == ["doc_id", "text", "lang", "score", "lang_pred", "lang_score"] and tagged.count() == len(rows)
    assert identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(docs.filter("lang IS NULL")).collect()} == {"und"}


def test_held_out_languages_do_not_matter(spark):
    rows = [(k, t, lang) for k, t, lang in texts(90, 4)]
    wrong = [(k, t, "qq" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (sorted(tuple(r) for r in identify(spark.createDataFrame(x, schema), LangConfig(epochs=2)).collect()) for x in (rows, wrong))
    assert a == b


def test_temperature_is_found():
    import numpy as np

    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, (4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    truth = np.array([rng.choice(3, p=x) for x in p])
    assert abs(fit_temperature(logits * 4, truth) - 4) < 0.4


def toxic_rows(n=1500):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        text, bad = rng.choices(words, k=rng.randint(3, 300)), rng.random() < 0.12
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Vileword", "zornig", "zornlos,", "nasty"]))
        rows.append((k, " ".join(text), 0))
        if rng.random() < 0.5:
            labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_defined_results(spark):
    rows, labels = toxic_rows()
    more = [(9001, None, 0), (9002, "", 0), (None, "vileword here", 0), (9003, "lang " * 100_000 + "zornige", 0), (7, rows[7][1], 0)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, score int").repartition(3)
    lab = spark.createDataFrame([(k, y, 1) for k, y in labels] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    got = score_toxicity(docs, lab).collect()
    assert len(got) == len(rows) + len(more)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held) > 80
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert [by[k] for k in (9001, 9002, None, 9003)] == [0, 0, 1, 1]
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    flipped = lab.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(str, score_toxicity(docs, flipped, ToxicConfig()).collect())) == sorted(map(str, got))
    assert score_toxicity(docs.limit(0), lab).count() == 0
    assert {r["score"] for r in score_toxicity(docs.limit(3), lab.filter("toxic = 0")).collect()} == {0.0}


def test_ftrl_equals_the_plain_update_and_is_sparse():
    import numpy as np

    from tessella.llm.langid_ftrl import fit_ftrl

    rng = np.random.default_rng(2)
    config, size, classes = LangConfig(epochs=2, l1=0.05), 40, 3
    rows = []
    for _ in range(120):
        ids = np.sort(rng.choice(size, 6, replace=False))
        rows.append((ids, rng.random(6), int(ids[0] % classes)))
    got, bias = fit_ftrl(rows, classes, size, config)

    # one coordinate after another, as the update is published
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weight(i, c):
        if abs(z[i, c]) <= config.l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * config.l1) / ((config.beta + np.sqrt(n[i, c])) / config.alpha + config.l2)

    order = np.random.default_rng(config.seed)
    for _ in range(config.epochs):
        for k in order.permutation(len(rows)):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True)), size: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(classes)}
            scores = np.array([sum(x[i] * w[i, c] for i in x) for c in range(classes)])
            p = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
            for i in x:
                for c in range(classes):
                    g = (p[c] - (c == rows[k][2])) * x[i]
                    s = (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / config.alpha
                    z[i, c] += g - s * w[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(classes)] for i in range(size + 1)])
    assert np.allclose(got, want[:-1]) and np.allclose(bias, want[-1])
    assert (fit_ftrl(rows, classes, size, LangConfig(epochs=2, l1=0.5))[0] == 0).mean() > (got == 0).mean() > 0


def test_the_default_penalty_drops_what_tells_nothing():
    import numpy as np

    from tessella.llm.langid_ftrl import fit_ftrl

    rng = np.random.default_rng(6)
    rows = [(np.append([k % 3], 3 + np.sort(rng.choice(400, 5, replace=False))), np.full(6, 0.6), k % 3) for k in range(600)]
    sparse, full = (fit_ftrl(rows, 3, 403, LangConfig(l1=x))[0] for x in (LangConfig().l1, 0.0))
    assert (sparse[:3] != 0).all() and (sparse[3:] == 0).mean() > 0.5 and (full[3:] == 0).mean() < 0.05


def test_more_languages_than_the_sample_has_room_for(spark):
    rows = [(k, f"{chr(97 + k % 20) * 3} {chr(97 + k % 20)}x" * (1 + k % 5), f"l{k % 20}") for k in range(400)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), LangConfig(max_sample=100)).collect()
    assert {r["lang_pred"] for r in got} == {f"l{k}" for k in range(20)}


def test_nnpu_equals_the_plain_risk():
    import numpy as np

    from tessella.llm.toxicity_nnpu import fit_nnpu

    rng = np.random.default_rng(1)
    size, prior, config = 12, 0.3, ToxicConfig(steps=60, l1=0.01)
    dense = lambda n, p: (rng.random((n, size)) < p).astype(float)
    xp, xu = dense(30, np.linspace(0.6, 0.1, size)), dense(80, 0.2)
    got, bias = fit_nnpu([np.flatnonzero(r) for r in xp], [np.flatnonzero(r) for r in xu], size, prior, config)

    def loss(x, w, b, sign):
        return float(np.mean([np.log1p(np.exp(-sign * (r @ w + b))) for r in x]))

    def slope(x, w, b, sign):
        s = [-sign / (1 + np.exp(sign * (r @ w + b))) for r in x]
        return np.append(np.mean([k * r for k, r in zip(s, x, strict=True)], axis=0), np.mean(s))

    w, m, v = np.append(np.zeros(size), np.log(prior / (1 - prior))), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, config.steps + 1):
        a, b = w[:-1], w[-1]
        negative = loss(xu, a, b, -1) - prior * loss(xp, a, b, -1)
        corrected = slope(xu, a, b, -1) - prior * slope(xp, a, b, -1)
        g = prior * slope(xp, a, b, 1) + corrected if negative >= -config.beta else -corrected
        for k in range(size):
            g[k] = g[k] + config.l1 * np.sign(a[k]) if a[k] else np.sign(g[k]) * max(abs(g[k]) - config.l1, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        new = w - config.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        new[:-1][new[:-1] * a < 0] = 0
        w = new
    assert np.allclose(got, w[:-1]) and abs(bias - w[-1]) < 1e-9
    risk = lambda a, b: prior * loss(xp, a, b, 1) + max(0.0, loss(xu, a, b, -1) - prior * loss(xp, a, b, -1))
    assert risk(got, bias) < risk(np.zeros(size), np.log(prior / (1 - prior)))
