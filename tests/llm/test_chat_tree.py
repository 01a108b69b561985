from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from tessella.llm.chat_tree import START, format_report, pack, turns, unescape

NASTY = ["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "\\", "\\|", "<", "|", "<\\|", "é🙂", "\n", "", "\\n", "plain words"]


def corpus():
    rng = random.Random(6)
    openings = [("user", "hello"), ("system", "be kind"), (None, None), ("us\ner", "x<|y")]
    rows = []
    for conv in range(60):
        for k in range(rng.randint(1, 6)):
            role, text = openings[conv % 4] if k == 0 else (("assistant", "user")[k % 2], rng.choice(["same", "same", "".join(rng.choices(NASTY, k=4))]))
            rows.append((conv if conv else None, k, role, text))
    rows += [(100, k, *("user", "hello")) for k in (0, 0, None)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, got in by.items():
        got.sort()
        loss = "".join(t for *_, r, t in got if r == "assistant")
        esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
        chars = sum(len(f"<|im_start|>{esc(r).replace(chr(10), '--')}\n{esc(t)}<|im_end|>\n") for *_, r, t in got)
        out.append((conv, len(got), sha("".join(f"{r}\n{t}\n" for *_, r, t in got)), len(loss), sha(loss), chars))
    return sorted(map(str, out))


def test_reports_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, path int").repartition(3)
    assert sorted(str(tuple(r)) for r in format_report(df).collect()) == expected(rows)
    assert format_report(df.limit(0)).count() == 0


def test_layout(spark):
    rows = turns(spark.createDataFrame(corpus(), "conv_id long, turn long, role string, text string")).persist()
    nodes = sorted(pack(rows).collect(), key=lambda r: r["start"])
    at, text, spans = 0, "", {}
    for r in nodes:
        assert r["start"] == at and r["size"] == len(r["segment"])
        spans[r["start"]] = (r, at + r["size"])
        at, text = at + r["size"], text + r["segment"]
    for r in nodes:
        above = r["ancestors"]
        assert len(above) == r["depth"] and sum(x["end"] - x["start"] for x in above) == r["position"]
        for k, x in enumerate(above):
            parent, end = spans[x["start"]]
            assert end == x["end"] and parent["depth"] == k and parent["start"] < r["start"]
            # depth first: all between an ancestor and its descendant is below the ancestor
            assert all(x["start"] in {a["start"] for a in y["ancestors"]} for y in nodes if x["start"] < y["start"] <= r["start"])
    # shared turns are there once
    distinct = {tuple(r["path"]) for r in rows.select("path").collect()}
    assert len(nodes) == len(distinct) < rows.count()
    assert text.count(START) == len(nodes)


def test_unescape_inverts():
    for t in NASTY:
        assert unescape(t.replace("\\", "\\\\").replace("<|", "<\\|")) == t
