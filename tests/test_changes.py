from datetime import datetime

from treelens.operators.changes import (
    MANIFEST, change_status, current_manifest, purge_listing, run_summary,
)


def manifest(spark, rows):
    full = [("r", d, h, datetime(2024, 1, day), gone, status, "3", "x") for d, h, day, gone, status in rows]
    return spark.createDataFrame(full, MANIFEST)


def test_latest_state_counts(spark):
    current = current_manifest(manifest(spark, [
        ("a", "1", 1, False, "ok"), ("a", "2", 2, False, "ok"),
        ("b", "1", 1, False, "ok"), ("b", "1", 2, True, "ok"),
        ("c", "1", 1, True, "ok"), ("c", "3", 2, False, "failed"),
    ]))
    assert {r.dir: r.content_hash for r in current.collect()} == {"a": "2", "c": "3"}


def test_status(spark):
    current = current_manifest(manifest(spark, [
        ("same", "h", 1, False, "ok"), ("other", "x", 1, False, "ok"),
        ("failed", "h", 1, False, "failed"), ("gone", "h", 1, False, "ok"),
    ]))
    hashes = spark.createDataFrame(
        [("r", d, "h") for d in ("same", "other", "failed", "new")],
        "root string, dir string, content_hash string",
    )

    def changed(**options):
        rows = change_status(hashes, current, **options).where("changed").collect()
        return {r.dir for r in rows}

    assert changed() == {"other", "new"}
    assert changed(retry_failed=True) == {"other", "new", "failed"}
    assert changed(force=True) == {"same", "other", "failed", "new"}


def test_purge_is_in_path_order_and_below(spark):
    current = current_manifest(manifest(spark, [
        (d, "h", 1, False, "ok") for d in ("", "a", "a/b", "a-b", "ab", "a/b/c")
    ]))
    assert [r.dir for r in purge_listing(current, "r").collect()] == [
        "", "a", "a/b", "a/b/c", "a-b", "ab"
    ]
    assert [r.dir for r in purge_listing(current, "r", "a").collect()] == ["a", "a/b", "a/b/c"]
    assert purge_listing(current, "other").count() == 0


def test_counts(spark):
    rows = spark.createDataFrame([(True, 1), (True, 0), (False, None)], "changed boolean, errors int")
    assert tuple(run_summary(rows).first()) == (2, 1, 1)
    assert tuple(run_summary(rows, dry_run=True).first()) == (0, 3, 1)
    assert tuple(run_summary(rows.where("false")).first()) == (0, 0, 0)
