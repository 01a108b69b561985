from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline as P
from tessella.llm.langid_ftrl import identify
from tests.llm.test_jaccard_join import expected as groups_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda lang: "".join(rng.choices({"en": "thaeinor", "de": "üschenrg"}[lang], k=rng.randint(1, 6)))
    rows = []
    for k in range(120):
        lang = "en" if k % 3 else "de"
        lines = [" ".join(word(lang) for _ in range(12)) for _ in range(rng.randint(1, 6))]
        rows.append([k, lines, lang, f"s{k % 15}"])
    for k in range(120, 160):  # copies, some with one word changed
        lines, lang = list(rows[k % 40][1]), rows[k % 40][2]
        if k % 2:
            lines[-1] += " extra"
        rows.append([k, lines, lang, f"s{rng.randrange(15)}"])
    for r in rows:
        if rng.random() < 0.6:
            r[1] = ["subscribe to our newsletter", *r[1]]
    out = [(k, "\n".join(x), lang, s, len("\n".join(x))) for k, x, lang, s in rows]
    return [*out, (200, None, "en", "s1", 0), (201, "12 34", "en", "s1", 5), (202, "", None, None, 0), (203, "solo éa text here", None, None, 17), (3, *out[3][1:]), (3, *out[3][1:])]


def test_stages_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    one = P.language_id(spark, docs, "")
    assert one.columns == docs.columns
    letters = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs).collect()}
    letters = [(r[0], r[1], r[2] or said[r[0]][0], *r[3:]) for r in letters if said[r[0]][1] >= 0.5]
    assert sorted(map(tuple, one.collect()), key=str) == sorted(letters, key=str)

    two = P.line_dedup(spark, one, "")
    spread = defaultdict(set)
    for _, t, _, s, _ in letters:
        for line in t.split("\n"):
            spread[line].add(s)
    cleaned = []
    for k, t, lang, s, _ in letters:
        t = "\n".join(x for x in t.split("\n") if len(spread[x]) < 10)
        cleaned.append((k, t, lang, s, len(t)))
    assert sorted(map(tuple, two.collect()), key=str) == sorted(cleaned, key=str) and any(len(v) >= 10 for v in spread.values())

    three = P.near_duplicates(spark, two, "")
    least = {k: c for k, _, c in groups_of([(r[0], r[1]) for r in cleaned])}
    single = {r for r in cleaned if least[r[0]] == r[0]}
    assert sorted(map(tuple, three.collect()), key=str) == sorted(single, key=str) and len(single) < 125

    four = P.mixing(spark, three, "")
    left = {tuple(r) for r in four.collect()}
    tokens = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert left <= single and four.count() == len(left)
    assert 0.75 * tokens(single) < tokens(left) <= 0.9 * tokens(single)

    five = P.encoding(spark, four, "")
    from tessella.llm.piece_sampling import decode

    assert {(r["doc_id"], r["decoded"]) for r in decode(five).collect()} == {(r[0], r[1]) for r in left}


def test_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_or_with_equal_ids(spark):
    rows = [(None, "a b c", "en", "s", 5), (1, "x y z", "en", "s", 5), (1, "other words", "en", "s", 11)]
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows, key=str)  # three texts that have nothing in common


CLASHES = "lang_pred lang_score n_lines n_removed epoch _id _hash _goes _wordless _rest _leaf_domain _full _last _taken _order_key key text_hash set_id h odd.name".split()


def test_extra_columns_with_the_operators_names_are_kept(spark):
    rows = [(*r, *[f"{r[0]}{c}" for c in CLASHES]) for r in corpus()[:60]]
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    for stage in (P.language_id, P.line_dedup, P.near_duplicates, P.mixing):
        docs = stage(spark, docs, "")
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *CLASHES]
        docs = spark.createDataFrame(docs.collect(), schema)
        assert all(r[5 + k] == f"{r['doc_id']}{c}" for r in docs.collect() for k, c in enumerate(CLASHES))
    assert docs.count() > 20
    assert P.encoding(spark, docs, "").count() > 20


def test_the_classifier_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "mots", "fr", "s", 4), (3, "unclear", "en", "s", 7), (4, "12", "en", "s", 2)], SCHEMA)
    said = {1: ("en", 0.9), 2: ("en", 0.8), 3: ("fr", 0.4), 4: ("und", 0.0)}

    def tagged(docs, predicted, score):
        return spark.createDataFrame([(*r, *said[r["doc_id"]]) for r in docs.collect()], f"{SCHEMA}, {predicted} string, {score} double")

    monkeypatch.setattr(P, "tag_languages", tagged)
    # the third goes by its score; the first had no language; recorded ones stay
    assert {(r["doc_id"], r["lang"]) for r in P.language_id(spark, docs, "").collect()} == {(1, "en"), (2, "fr")}
