"""Readers, writers and streams where things go wrong or come in pieces."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import validate as V
from millrace.sources import readers as R
from millrace.sources import writers as W
from millrace.streaming import streams as S

c = F.col


def test_strict_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":\n[1]\n{"a":2}\n')
    rows, bad = R.jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2]
    assert sorted(r.reason for r in bad.collect()) == ["not_an_object", "not_json"]
    _, bad = R.jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a int", blank_is_bad=True)
    assert "blank" in {r.reason for r in bad.collect()} and all(r.file.endswith("a.jsonl") for r in bad.collect())


def test_repeated_ids_are_an_error(spark, tmp_path):
    (tmp_path / "ids").write_text("a\nb\n\na\n")
    with pytest.raises(ValueError, match="duplicate"):
        R.ids(spark, str(tmp_path / "ids"))


def test_unknown_kinds(spark):
    with pytest.raises(ValueError):
        R.mixed(spark, ["x.csv"])
    with pytest.raises(ValueError):
        R.mixed(spark, [])
    with pytest.raises(ValueError):
        R.load_bench(spark.range(1), "none")


def test_manifest_of_another_schema(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema_id":"other","frozen":true,"episodes":[]}')
    with pytest.raises(ValueError, match="other"):
        R.manifest(spark, str(tmp_path / "m.json"), "id:bigint,variant:string", "suite", {})


def test_manifest_without_renames(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema_id":"suite","frozen":false,"episodes":[{"id":1,"variant":"x"},{"id":2,"variant":"y"}]}')
    rows = R.manifest(spark, str(tmp_path / "m.json"), "id:bigint,variant:string", "suite", {"x": "z"}).collect()
    assert {(r.id, r.variant, r.frozen) for r in rows} == {(1, "z", False), (2, "y", False)}


@pytest.mark.parametrize("name", ["../up", "/abs", "a/../../b"])
def test_climbing_archive_members(spark, tmp_path, name):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo(name)
        info.size = 2
        tar.addfile(info, io.BytesIO(b"hi"))
    with pytest.raises(Exception, match="isn't allowed"):
        R.tar_members(spark, str(tmp_path / "a.tar")).collect()


def test_nothing_is_published_after_a_bad_check(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        W.release(spark, str(tmp_path / "r"), {"t": df}, lambda w: {}, [lambda w: V.gate(w["t"], [("bad", c("id") > 1)])])
    assert not list(tmp_path.iterdir())
    facts = W.release(spark, str(tmp_path / "r"), {"t": df}, lambda w: {"n": w["t"].count()})
    assert facts == {"n": 3} and (tmp_path / "r" / "summary.json").exists()
    with pytest.raises(FileExistsError):
        W.release(spark, str(tmp_path / "r"), {"t": df}, lambda w: {})


def test_partitions_must_have_the_expected_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="expected"):
        W.partitioned(spark.range(4).withColumn("k", c("id") % 2), str(tmp_path / "p"), "k", {0: 2, 1: 3})


def test_gaps_in_the_row_index(spark, tmp_path):
    df = spark.createDataFrame([(0, ["a"]), (2, ["b"])], "row_index long, images array<string>")
    with pytest.raises(ValueError, match="row_index"):
        W.rewrite(df, str(tmp_path / "p"), "row_index", "images", "/r")


def test_state_goes_on_from_batch_to_batch(spark, tmp_path):
    """The same rows as one file and as many, one a batch, give the same progress."""
    rows = [(i, i % 3, "abab"[i // 3 % 4] if i % 3 else "x") for i in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "id long, episode long, variant string").coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    spark.createDataFrame(rows, "id long, episode long, variant string").coalesce(1).write.parquet(str(tmp_path / "one"))
    got = []
    for name in ("many", "one"):
        out = S.run(S.progress(S.events(spark, str(tmp_path / name), files=1), 15), "update", "episode")
        got.append(sorted(tuple(r) for r in out.select("episode", "steps", "longest", "swings", "over").collect()))
    assert got[0] == got[1] and got[0][0] == (0, 20, 20, 0, True)
