import json

import pytest
from pyspark.sql import functions as F
from test_symbols import corpus

from treelens.operators import records
from treelens.operators.symbols import file_records

SUMMARY = {"overview": "o", "key_symbols": ["k"], "patterns": [], "tribal_knowledge": ["t"]}
FILE = {"path": "/srv/tides/moon.py", "relative_path": "tides/moon.py", "size_bytes": 77,
        "content_hash": "9f1e", "source": "class Moon: ...", "module_docstring": "Phases by date.",
        "functions": ["phase", "age"], "classes": ["Moon"], "imports": ["calendar"]}


def read(spark, reader, value):
    text = spark.createDataFrame([(json.dumps(value),)], "t string")
    return text.select(reader(F.col("t")).alias("r")).first().r.asDict(recursive=True)


def test_file_round_trip(spark):
    assert read(spark, records.file_from_json, FILE) == FILE
    row = file_records(corpus(spark, {"d/m.py": '"""Doc."""\nimport os'}), keep_source=True)
    sent = row.select(records.as_json(records.file_struct(F.col("source"))).alias("j")).first().j
    assert json.loads(sent)["source"] == '"""Doc."""\nimport os'
    assert read(spark, records.file_from_json, json.loads(sent)) == json.loads(sent)


def test_nulls_are_written_and_defaults_read(spark):
    row = file_records(corpus(spark, {"m.py": ""}))
    sent = json.loads(row.select(records.as_json(records.file_struct())).first()[0])
    assert sent["module_docstring"] is None and "source" in sent
    blank = {"path": "x", "relative_path": None, "size_bytes": 0, "content_hash": "",
             "source": None, "module_docstring": None, "functions": [], "classes": [],
             "imports": []}
    assert read(spark, records.file_from_json, {"path": "x", "unknown": 1}) == blank
    made = spark.range(1).select(records.empty_file(F.lit("x")).alias("r")).first().r
    assert made.asDict() == blank


@pytest.mark.parametrize("reader", [records.file_from_json, records.directory_from_json])
def test_path_is_required(spark, reader):
    with pytest.raises(Exception, match="record without 'path'"):
        read(spark, reader, {"content_hash": "x"})


def test_directory_and_summary(spark):
    value = {"path": "/p", "files": [FILE], "subdirectories": ["sub"], "content_hash": "77aa",
             "summary": SUMMARY}
    assert read(spark, records.directory_from_json, value) == value
    assert read(spark, records.directory_from_json, {"path": "/p"}) == {
        "path": "/p", "files": [], "subdirectories": [], "content_hash": "", "summary": None
    }
    assert read(spark, records.summary_from_json, {}) == {
        "overview": "", "key_symbols": [], "patterns": [], "tribal_knowledge": []
    }
    assert read(spark, records.summary_from_json, {"overview": 3, "patterns": [1, None, "x"]}) == {
        "overview": "3", "key_symbols": [], "patterns": ["1", "x"], "tribal_knowledge": []
    }


def test_blank_directory(spark):
    row = spark.range(1).select(records.empty_directory(F.lit("/p")).alias("r")).first().r
    assert row.asDict() == {
        "path": "/p", "files": [], "subdirectories": [], "summary": None,
        "content_hash": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    }


def test_gathered_directory_to_json(spark):
    from test_rollup import made

    from treelens.operators.summaries import named

    gathered = named(made(spark, {"d/m.py": "import os", "d/s/n.py": ""}).records).where("dir = 'd'")
    sent = gathered.select(records.as_json(records.directory_struct()).alias("j")).first().j
    back = read(spark, records.directory_from_json, json.loads(sent))
    assert back["path"] == "r/d" and back["subdirectories"] == ["s"] and back["summary"] is None
    assert [f["imports"] for f in back["files"]] == [["os"]]
    assert back["files"][0]["path"] == "r/d/m.py"
