import json

import pytest

from rowloom import cli
from rowloom.cli import run

SCHEMA = "columns:\n- {name: id, type: u64, codec: delta_bitpack}\n- {name: service, type: string, codec: prefix, nullable: true}\n"
STREAM = "columns:\n- {name: ts, type: u64, codec: delta_varint_u64}\n- {name: level, type: string, codec: rle}\n"


def text_of(path):
    return sorted(x for p in path.glob("part-*") for x in p.read_text().splitlines())


def test_encode_scan_decode(spark, tmp_path):
    (tmp_path / "s.yml").write_text(SCHEMA)
    rows = ['{"id":1,"service":"api"}', '{"id":2,"service":"api"}', '{"id":10,"service":null}', '{"id":11,"service":"worker"}']
    (tmp_path / "in.json").write_text("\n".join(rows) + "\n")
    t = str(tmp_path / "t")
    run(["encode", str(tmp_path / "in.json"), t, "--schema", str(tmp_path / "s.yml"), "--row-group-rows", "2"], spark)
    assert run(["decode", t, str(tmp_path / "all")], spark) == {"row_groups_scanned": 2, "row_groups_pruned": 0}
    assert text_of(tmp_path / "all") == sorted(rows)
    got = run(["decode", t, str(tmp_path / "some"), "--columns", "id", "--filter-column", "id", "--filter-op", "ge", "--filter-value", "10"], spark)
    assert got == {"row_groups_scanned": 1, "row_groups_pruned": 1} and text_of(tmp_path / "some") == ['{"id":10}', '{"id":11}']
    assert run(["inspect", t], spark)["row_count"] == 4
    assert run(["validate", t], spark)["sound"]
    assert run(["repair", t, str(tmp_path / "fixed")], spark)["action"] == "None"
    table = spark.read.parquet(t)
    table.withColumn("id", table["id"] + (table["row_index"] == 2).cast("long")).write.parquet(str(tmp_path / "broken"))
    spark.read.parquet(f"{t}/_footer").write.parquet(str(tmp_path / "broken/_footer"))
    assert run(["validate", str(tmp_path / "broken")], spark)["bad_checksums"] == 1
    assert run(["repair", str(tmp_path / "broken"), str(tmp_path / "mended")], spark)["action"] == "TruncateTailAndRebuildFooter"
    assert spark.read.parquet(str(tmp_path / "mended")).count() == 2
    with pytest.raises(ValueError):
        run(["decode", t, str(tmp_path / "x"), "--columns", "missing"], spark)
    json.dumps(run(["bench", t, "--iterations", "1"], spark))


def test_inspect_prints_all(spark, tmp_path, monkeypatch, capsys):
    """More than 1000 terms and row groups."""
    spark.range(2500).selectExpr("concat('t', id) AS term", "id AS doc_id", "array(1L) AS positions").write.parquet(str(tmp_path / "i"))
    spark.range(2500).selectExpr("id AS row_index", "id AS row_group", "id").write.parquet(str(tmp_path / "t"))

    def printed(*argv):
        monkeypatch.setattr("sys.argv", ["rowloom", *argv])
        assert cli.main() == 0
        return json.loads(capsys.readouterr().out)

    monkeypatch.setattr(cli, "run", lambda argv: run(argv, spark))
    terms = printed("search-inspect", str(tmp_path / "i"))
    assert [t["term"] for t in terms] == sorted(f"t{i}" for i in range(2500)) and all(t["doc_count"] == 1 for t in terms)
    whole = printed("inspect", str(tmp_path / "t"))
    assert whole["row_count"] == whole["row_groups"] == 2500
    assert whole["groups"] == [{"row_group": i, "first_row": i, "row_count": 1} for i in range(2500)]


def test_streams(spark, tmp_path):
    (tmp_path / "s.yml").write_text(STREAM)
    log = str(tmp_path / "log")
    for i, rows in enumerate((['{"ts":100,"level":"a"}', '{"ts":101,"level":"b"}'], ['{"ts":102,"level":"c"}'])):
        (tmp_path / f"{i}.json").write_text("\n".join(rows))
        assert run(["stream-append", str(tmp_path / f"{i}.json"), log, "--schema", str(tmp_path / "s.yml")], spark) == {"first_row": 2 * i}
    assert run(["stream-recover", log], spark)["rows"] == 3
    run(["stream-replay", log, str(tmp_path / "out")], spark)
    assert len(text_of(tmp_path / "out")) == 3
    assert run(["stream-roll", log, str(tmp_path / "seg"), "--block-rows", "1", "--max-blocks", "2"], spark) == {"segments": 2}
    assert run(["stream-roll", log, str(tmp_path / "seg2"), "--max-segment-bytes", "20", "--block-bytes", "30"], spark) == {"segments": 3}


def test_search_and_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# x\nfox 1 2,9\nfox 3 5\nbrown 3 4\n")
    index = str(tmp_path / "i")
    run(["search-encode", str(tmp_path / "p.txt"), index], spark)
    assert run(["search-lookup", index, "fox"], spark) == [{"doc_id": 1, "positions": [2, 9]}, {"doc_id": 3, "positions": [5]}]
    assert run(["search-seek", index, "fox", "2"], spark) == []
    assert [r["term"] for r in run(["search-inspect", index], spark)] == ["brown", "fox"]
    (tmp_path / "state").write_bytes(b"aaab")
    run(["snapshot-encode", str(tmp_path / "state"), str(tmp_path / "snap"), "--checkpoint-id", "42"])
    assert run(["snapshot-decode", str(tmp_path / "snap"), str(tmp_path / "back")]) == {"checkpoint_id": 42, "raw_len": 4}
    (tmp_path / "m.yml").write_text("metadata_version: 1\ncolumns:\n- name: id\n  type: u64\n")
    run(["metadata-migrate", str(tmp_path / "m.yml"), str(tmp_path / "m2.yml"), "--assign", "id=10"])
    assert "stable_id: 10" in (tmp_path / "m2.yml").read_text()
    with pytest.raises(FileExistsError):
        run(["metadata-migrate", str(tmp_path / "m.yml"), str(tmp_path / "m2.yml"), "--assign", "id=10"])
