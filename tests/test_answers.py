import json

import pytest
from pyspark.sql import functions as F

from treelens.functions.responses import has_content, validate_answers
from treelens.operators.summaries import ask, summaries_from

FULL = {"overview": "Turns tide tables into charts.", "key_symbols": ["chart", "Tide"],
        "patterns": ["tables first"], "tribal_knowledge": ["heights are in feet"]}
EMPTY = {"overview": "", "key_symbols": [], "patterns": [], "tribal_knowledge": []}
TEXT = json.dumps(FULL)
CASES = [
    (TEXT, FULL, "ok"),
    (f" \n{TEXT}\n ", FULL, "ok"),
    (f"```json\n{TEXT}\n```", FULL, "ok"),
    (f"```\n{TEXT}\n```  ", FULL, "ok"),
    (f"```json\n{TEXT}", FULL, "ok"),
    (f"```json {TEXT} ```", EMPTY, "bad_json"),
    ("not json", EMPTY, "bad_json"),
    ("", EMPTY, "ok"),
    (None, EMPTY, "ok"),
    ("  ", EMPTY, "bad_json"),
    ("[1, 2]", EMPTY, "not_object"),
    ("3", EMPTY, "not_object"),
    ("null", EMPTY, "not_object"),
    ("{}", EMPTY, "ok"),
    ('{"overview": "a", "more": 1}', EMPTY | {"overview": "a"}, "ok"),
    ('{"overview": null}', EMPTY, "ok"),
    ('{"overview": 42}', EMPTY | {"overview": "42"}, "ok"),
    ('{"key_symbols": "foo"}', EMPTY, "bad_field"),
    ('{"key_symbols": {"a": 1}, "patterns": ["p"]}', EMPTY | {"patterns": ["p"]}, "bad_field"),
    ('{"key_symbols": null}', EMPTY, "bad_field"),
    ('{"key_symbols": [1, 2, 3]}', EMPTY | {"key_symbols": ["1", "2", "3"]}, "ok"),
    ('{"patterns": ["a", null, "b"]}', EMPTY | {"patterns": ["a", "b"]}, "ok"),
    ('{"overview": "a", "overview": "b", "patterns": "p", "patterns": ["x"]}', EMPTY | {"overview": "b", "patterns": ["x"]}, "ok"),
    ('{"patterns": ["x"], "patterns": 1, "overview": 2, "other": {"a": 1, "a": 2}}', EMPTY | {"overview": "2"}, "bad_field"),
    ('{"overview": "a", "overview": null}', EMPTY, "ok"),
    ('{"overview": "a"} and more', EMPTY, "bad_json"),
    ('{"overview": "a", "overview": "b"} and more', EMPTY, "bad_json"),
    ('{"overview": "a"}, {"overview": "b"}', EMPTY, "bad_json"),
    ("{'overview': 'a', 'overview': 'b'}", EMPTY, "bad_json"),
    ('{"overview": "é \\u00e9 \\" {"}', EMPTY | {"overview": 'é é " {'}, "ok"),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "n int, raw string")
    found = validate_answers(rows).withColumn("filled", has_content(F.col("summary")))
    return {r.n: r for r in found.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_answer(checked, n):
    _, summary, status = CASES[n]
    assert checked[n].summary.asDict() == summary
    assert checked[n].parse_status == status
    assert checked[n].filled is (summary != EMPTY)


def sent(spark, names):
    rows = [("r", n, [("system", "s"), ("user", n)]) for n in names]
    return spark.createDataFrame(
        rows, "root string, dir string, messages array<struct<role string, content string>>"
    )


def by_dir(frame):
    return {r.dir: r for r in frame.collect()}


def test_retry_then_success(spark):
    def factory():
        calls = {}

        def answer(messages):
            name = messages[-1]["content"]
            calls[name] = calls.get(name, 0) + 1
            if calls[name] <= {"a": 0, "b": 1, "c": 2, "d": 9}[name]:
                raise ConnectionError(f"call {calls[name]}")
            return '{"overview": "%s"}' % name

        return answer

    rows = by_dir(ask(sent(spark, "abcd"), factory, 2, 0.0, partitions=2))
    assert {d: r.attempts for d, r in rows.items()} == {"a": 1, "b": 2, "c": 3, "d": 3}
    assert rows["d"].error == "ConnectionError: call 3" and rows["d"].raw is None
    assert rows["c"].error is None
    one = by_dir(ask(sent(spark, "bd"), factory, 0, 0.0))
    assert {d: r.attempts for d, r in one.items()} == {"b": 1, "d": 1}


def test_delays_double(spark):
    def factory():
        import time

        waits = []
        time.sleep = waits.append

        def answer(messages):
            if len(waits) < 3:
                raise OSError("busy")
            return '{"overview": "%s"}' % waits

        return answer

    rows = by_dir(summaries_from(ask(sent(spark, "a"), factory, 3, 0.5)))
    assert rows["a"].summary.overview == "[0.5, 1.0, 2.0]"


def test_failures_are_data(spark):
    def factory():
        def answer(messages):
            if messages[-1]["content"] == "b":
                raise ValueError("no")
            return {"a": None, "c": "junk"}[messages[-1]["content"]]

        return answer

    rows = by_dir(summaries_from(ask(sent(spark, "abc"), factory, 1, 0.0)))
    assert {d: r.summary_status for d, r in rows.items()} == {
        "a": "ok", "b": "failed", "c": "bad_json"
    }
    assert all(r.summary.asDict() == EMPTY for r in rows.values())
    assert rows["b"].error == "ValueError: no"


def test_broken_factory_is_an_error_per_row(spark):
    def factory():
        raise ImportError("no client")

    rows = by_dir(summaries_from(ask(sent(spark, "ab"), factory, 0, 0.0)))
    assert {r.error for r in rows.values()} == {"ImportError: no client"}


def test_record_form(spark):
    from test_rollup import made

    from treelens.operators.summaries import prompts

    def factory():
        def answer(record):
            assert record["content_hash"] and record["subdirectories"] == []
            names = [f["relative_path"] for f in record["files"]]
            return {"overview": record["path"], "key_symbols": names}

        return answer

    records = made(spark, {"d/b.py": "", "d/a.py": "def f(): ..."}).records.where("dir = 'd'")
    [row] = summaries_from(ask(prompts(records), factory, 0, request="record")).collect()
    assert row.error is None
    assert row.summary.overview == "r/d" and row.summary.key_symbols == ["a.py", "b.py"]


def test_no_answer_ends_the_job(spark):
    given = [1, True, ["a"], "x\ud800y", None, {"overview": "\ud800"}]

    def factory():
        def answer(sent):
            value = given[sent[0]["n"]]
            if value is None:
                raise ValueError("\udfff")
            return value

        return answer

    rows = spark.range(len(given)).select(
        F.lit("r").alias("root"),
        F.col("id").cast("string").alias("dir"),
        F.array(F.struct(F.col("id").alias("n"))).alias("messages"),
    )
    got = {r.dir: r for r in ask(rows, factory, max_retries=0).collect()}
    assert [got[str(k)].raw for k in range(4)] == ["1", "true", '["a"]', "x\\ud800y"]
    assert got["4"].error == "ValueError: \\udfff" and got["5"].error is None
