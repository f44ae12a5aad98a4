"""Readers and sinks on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import readers, sinks


def test_survey(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("Unnamed: 0\tR1\tcountry\n0\t5\tUS\n1\tx\tNONE\n2\t3\t\n")
    got = readers.survey(spark, str(tmp_path / "s.tsv"), {"R1": "int", "country": "string"}).orderBy("person_id").collect()
    assert [tuple(r) for r in got] == [(0, 5, "US"), (1, None, "NONE"), (2, 3, None)]
    assert [tuple(r) for r in readers.long_form(spark.createDataFrame([(1, 5, None)], "id int, R1 int, R2 int"), "id", ["R1", "R2"]).collect()] == [(1, "R1", 5)]
    assert readers.nested(spark.createDataFrame([(1, 5, 6)], "id int, R1 int, T1 int"), "id", {"interests": ["R1"], "traits": ["T1"]}).first()["traits"] == {"T1": 6}


def test_codebook(spark, tmp_path):
    (tmp_path / "c.txt").write_text('R1\tTest parts\nTIPI1\tQuiet\ngender\t"1=Male, 2=Female, 3=Other"\n')
    book = readers.codebook(spark, str(tmp_path / "c.txt"))
    assert {tuple(r) for r in book["items"].collect()} == {("R1", "Test parts"), ("TIPI1", "Quiet")}
    assert {tuple(r) for r in book["decode"].collect()} == {("gender", 1, "Male"), ("gender", 2, "Female"), ("gender", 3, "Other")}


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}]))
    records = readers.json_array(spark, str(tmp_path / "a.json"), "id string, n int")
    ids = spark.createDataFrame([("b",), ("c",)], "id string")
    assert [tuple(r) for r in readers.wanted(records, ids, "id").collect()] == [("b", 2)]
    assert {(r["id"], r["reason"]) for r in readers.found_or_reason(records, ids, "id").collect()} == {("b", None), ("c", "not found")}
    run = tmp_path / "runs" / "one"
    run.mkdir(parents=True)
    (run / "r.jsonl").write_text('{"id": "x", "n": 1}\n{"id": "y", "n"')
    assert readers.jsonl(spark, str(run / "r.jsonl"), "id string, n int", tolerant=True).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        readers.jsonl(spark, str(run / "r.jsonl"), "id string, n int").collect()
    (run / "r.jsonl").write_text('{"id": "x", "n": 1}\n')
    assert [tuple(r) for r in readers.by_folder(spark, str(tmp_path / "runs"), "id string, n int").collect()] == [("x", 1, "one")]


def test_pool_and_labels(spark, tmp_path):
    (tmp_path / "p.csv").write_text('canonical_id,canonical_name,clean,qualifies,ambiguous_identity,variants,transcripts\nc1,Jane Doe,True,yes,0,Jane Doe; J. Doe,"NPR-1|2001-02-03|A; B|cl1|S"\n')
    row = readers.typed_pool(spark, str(tmp_path / "p.csv")).first()
    assert row["clean"] and row["qualifies"] and not row["ambiguous_identity"] and row["variants"] == ["Jane Doe", "J. Doe"] and row["transcripts"][0]["program"] == "A; B"
    for n, doc in enumerate(({"1": "same", "2": None}, {"labels": {"1": "same", "2": None}}, {"rows": [{"id": 1, "label": "same"}, {"id": 2, "label": None}]})):
        (tmp_path / f"l{n}.json").write_text(json.dumps(doc))
        assert {tuple(r) for r in readers.labels(spark, str(tmp_path / f"l{n}.json")).collect()} == {(1, "SAME"), (2, None)}
    (tmp_path / "l9.json").write_text(json.dumps({"rows": [{"id": 1, "label": "a"}, {"id": 1, "label": "b"}]}))
    with pytest.raises(Exception, match="given twice"):
        readers.labels(spark, str(tmp_path / "l9.json")).collect()


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, f"c{i % 2}") for i in range(6)], "id int, chunk string")
    sinks.chunked(d, str(tmp_path / "chunks"))
    assert readers.chunks(spark, str(tmp_path / "chunks"), "id int", ["c1"]).count() == 3
    sinks.sorted_csv(d, str(tmp_path / "csv"), F.desc("id"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6
    assert sinks.append_missing(d.limit(4), str(tmp_path / "t"), ["id"]) == 4 and sinks.append_missing(d, str(tmp_path / "t"), ["id"]) == 2 and sinks.append_missing(d, str(tmp_path / "t"), ["id"]) == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("hello")
    assert tuple(readers.digests(spark, str(tmp_path / "f")).first()) == ("x.txt", "f", 5, hashlib.sha256(b"hello").hexdigest())
    sinks.jsonl(d, str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, chunk string").json(str(tmp_path / "in"))
    for _ in range(2):
        sinks.ledger_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_fallback_and_schema(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("hello")
    assert readers.resolved(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "x.txt") == f"{tmp_path}/b/x.txt"
    with pytest.raises(FileNotFoundError, match=r"none of .*/a"):
        readers.resolved(spark, [str(tmp_path / "a")], "x.txt")
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    sinks.chunked(spark.createDataFrame([(1, "c1")], "id int, chunk string"), str(tmp_path / "chunks"))
    for _ in range(2):
        assert readers.chunks(spark, str(tmp_path / "chunks"), schema, ["c1"]).count() == 1
    assert schema.names == ["id"]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    """Off one machine, an application without the setting stops."""
    from tessella import runtime

    class Bare:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        runtime.ensure_checkpoint_dir(type("Session", (), {"sparkContext": Bare}))
