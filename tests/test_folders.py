import os

import pytest

from treelens.operators.sinks import export_documents, remove_exported
from treelens.operators.symbols import file_records
from treelens.sources.corpus import TreeCorpus


@pytest.mark.parametrize("folder", ["s3a://bucket/x", "hdfs://host/x", "relative/x"])
def test_only_mounted_folders_are_written(spark, tmp_path, monkeypatch, folder):
    monkeypatch.chdir(tmp_path)
    rows = spark.createDataFrame(
        [("r", "d", 0, 0, "text")], "root string, dir string, section int, start long, markdown string"
    )
    with pytest.raises(ValueError):
        export_documents(rows, folder)
    with pytest.raises(ValueError):
        remove_exported(rows, folder)
    assert os.listdir(tmp_path) == []


def test_bytes_of_trees_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os")
    corpus = TreeCorpus(spark, (str(tmp_path),))
    parsed = file_records(corpus.contents([]), spread=False)
    text = parsed._jdf.queryExecution().executedPlan().toString()
    # The one exchange deals out paths, below the reader.
    assert text.index("MapInArrow") < text.index("Exchange") and text.count("Exchange") == 1
