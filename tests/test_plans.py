"""What the physical plans must look like."""

import pytest

from treelens.functions.ignore import DEFAULT_IGNORE, IgnoreRules
from treelens.operators.listing import directories_of, is_member, reached, with_path_parts
from treelens.operators.rollup import directory_hashes
from treelens.operators.symbols import (
    file_records, import_edges, ordered_union, parse_failures, symbols,
)
from treelens.operators.workspace import written


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", f"d{n % 3}/m{n}.py", f"import a{n}\ndef f(): ...".encode()) for n in range(20)]
    return written(spark.createDataFrame(rows, "root string, path string, content binary"), "files")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "use",
    [import_edges, parse_failures, symbols, lambda r: ordered_union(symbols(r)),
     lambda r: r.where("module_docstring is not null")],
)
def test_sources_are_parsed_once(files, use):
    assert plan(use(file_records(with_path_parts(files)))).count("ArrowEvalPython") == 1


def test_parsing_shuffles_only_inputs_too_small_to_split(spark, files):
    setting = "spark.sql.files.maxPartitionBytes"
    assert "RoundRobin" in plan(file_records(with_path_parts(files)))
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64b")
    try:
        assert "Exchange" not in plan(file_records(with_path_parts(files)))
    finally:
        spark.conf.set(setting, before)


def test_listing_does_not_read_contents(files):
    rules = IgnoreRules.of(DEFAULT_IGNORE)
    listing = with_path_parts(files).where(is_member(rules) & reached(rules, 3))
    for frame in (listing.select("root", "path"), directories_of(with_path_parts(files))):
        assert "content" not in plan(frame).split("ReadSchema")[1]
        assert "Python" not in plan(frame)


def test_hash_roll_up_is_one_shuffle_with_partial_aggregates(files):
    records = written(file_records(with_path_parts(files)), "records")
    text = plan(directory_hashes(records)).split("Initial Plan")[0]
    assert text.count("Exchange") == 1 and "partial_collect_list" in text
    assert "module_docstring" not in text.split("ReadSchema")[1]
