from __future__ import annotations

import json
import os

import tessella.cli as C


def call(capsys, *args) -> tuple[int, dict]:
    code = C.main(list(map(str, args)))
    return code, json.loads(capsys.readouterr().out)


def test_round_trip(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "data"))
    s, d = tmp_path / "s", tmp_path / "d"
    s.mkdir()
    d.mkdir()
    text = " ".join(f"w{k}" for k in range(40))
    for name, data in {"a.txt": text, "b.txt": text + " more", "c.txt": text, "e.bin": "x"}.items():
        (s / name).write_text(data)
        os.utime(s / name, (1_700_000_000 + 60 * ord(name[0]),) * 2)  # b.txt is newer than a.txt
    assert call(capsys, "analyze", s)[1]["duplicate_files"] == 2
    assert [p["relationship"] for p in call(capsys, "similar", s)[1]["pairs"]] == ["near_duplicate"]
    assert call(capsys, "plan", s, d)[1]["missing"] == 4
    assert call(capsys, "run", s, d, "--mode", "collapse", "--dry-run")[1]["copied"] == 3
    code, done = call(capsys, "run", s, d)
    assert code == 0 and done["copied"]["files"] == 4
    assert call(capsys, "plan", s, d)[1]["verified"] == 4
    call(capsys, "write-manifest", d)
    assert call(capsys, "verify", d) == (0, {"trusted": True, "unchanged": 4})
    (d / "a.txt").write_text("changed")
    (d / "manifest.json").chmod(0o644)
    (d / "manifest.json").write_text("{}")
    code, report = call(capsys, "verify", d)
    assert code == 1 and report["trusted"] and report["changed"] == 1
    (d / ".tessella/manifest.backup.json").chmod(0o644)
    (d / ".tessella/manifest.backup.json").write_text("{\"x\": 1}")
    assert not call(capsys, "verify", d)[1]["trusted"]


def test_formats_cache_journal_and_text(spark, tmp_path, monkeypatch, capsys):
    from tessella.sources import store

    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "data"))
    s, d, cache, journal = (tmp_path / x for x in ("s", "d", "cache", "journal"))
    s.mkdir()
    d.mkdir()
    rows = [f"{k},value{k}" for k in range(30)]
    (s / "a.csv").write_text("\n".join(rows))
    (s / "b.csv").write_text("\n".join(rows[::-1] + ["31,more"]))  # other order: alike by rows alone
    (s / "c.json").write_text(json.dumps({f"k{k}": "some words here" for k in range(12)}))
    (s / "d.json").write_text(json.dumps({f"k{k}": "some words here" for k in range(11, -1, -1)}, indent=3))
    (s / "e.pdf").write_text("no text that is read")
    code, report = call(capsys, "similar", s)
    assert code == 0 and report["files_skipped"] == {"unsupported": 1} and report["files_considered"] == 4
    assert sorted((os.path.basename(p["a"]), os.path.basename(p["b"])) for p in report["pairs"]) == [("a.csv", "b.csv"), ("c.json", "d.json")]
    assert [os.path.basename(p["a"]) for p in call(capsys, "similar", s, "--ext", ".JSON")[1]["pairs"]] == ["c.json"]
    (s / "f.csv").write_text("\n".join(rows))
    cold, warm = (call(capsys, "analyze", s, "--cache", cache)[1] for _ in range(2))
    assert cold == warm and cold["duplicate_files"] == 2 and store.load_cache(spark, str(cache)).count() == 2
    assert store.load_cache(spark, str(tmp_path / "none")).count() == 0
    call(capsys, "plan", s, d, "--journal", journal)
    assert call(capsys, "run", s, d, "--journal", journal, "--cache", cache)[1]["copied"]["files"] == 6
    tables = [store.journal_table(spark, str(journal), t) for t in ("plan_runs", "plan_entries", "transfer_events")]
    assert sorted(tuple(r) for r in store.counts(*tables).collect()) == [(1, 6, 0), (2, 6, 6)] and store.latest_run(tables[0]).first()[0] == 2
    assert call(capsys, "write-manifest", d, "--source", s)[1]["summary"]["duplicate_group_count"] == 1
    families = {(r["family_id"], r["path"]) for r in spark.read.parquet(str(d / ".tessella/families")).collect()}
    assert families >= {("f_00000", "a.csv"), ("f_00000", "b.csv"), ("f_00001", "c.json")}
    assert spark.read.parquet(str(d / ".tessella/duplicates")).count() == 2
    C.main(["analyze", str(s), "--text"])
    assert "files: 6" in capsys.readouterr().out and C.format_bytes(1536) == "1.50 KiB" and C.format_bytes(12) == "12 B"
