import os

import pytest
from pyspark.sql import functions as F

from duelmark.operators import quality as ql
from duelmark.session import materialize, scratch_path, shared_dir
from duelmark.sources import append as ap, files as fl


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]


def test_read_trimmed_blank_is_null(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("k,name\n1,  Ann  \n2,\n")
    rows = fl.read_trimmed(spark, str(path), "k int, name string").orderBy("k").collect()
    assert [(r.k, r.name) for r in rows] == [(1, "Ann"), (2, None)]


def test_append_dedup_and_schema_growth(spark):
    path = scratch_path(spark, "t")
    rows = spark.createDataFrame([("same", 1, "x"), ("same", 2, "y"), ("other", 3, "z")], "id string, at int, v string")
    ap.append_dedup(rows, path, ["id"], ["at"])
    ap.append_dedup(rows, path, ["id"], ["at"])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("other", "z"), ("same", "x")]
    ap.append_evolving(spark.createDataFrame([("new", 9, "n", 0.5)], "id string, at int, v string, p double"), path)
    schema = spark.createDataFrame([], "id string, p double, at int").schema
    got = {r.id: r.p for r in ap.conform(ap.read_table(spark, path), schema).collect()}
    assert got == {"other": None, "same": None, "new": 0.5}


def rows_of(spark, path):
    return ap.read_current(spark, path).count()


def test_staged_replace_keeps_the_old_table_when_a_gate_fails(spark):
    path = scratch_path(spark, "swap")
    ap.staged_replace(spark.range(3), path, lambda s: [])
    failing = spark.createDataFrame([("bad", 1)], "check string, n long")
    with pytest.raises(ValueError, match="refresh rejected: bad=1"):
        ap.staged_replace(spark.range(9), path, lambda s: [failing])
    assert rows_of(spark, path) == 3
    ap.staged_replace(spark.range(9), path, lambda s: [failing.filter("n > 5")])
    assert rows_of(spark, path) == 9
    with pytest.raises(FileNotFoundError):
        ap.read_current(spark, scratch_path(spark, "nothing"))


@pytest.mark.parametrize("step", ["write", "gate", "publish", "pointer"])
def test_a_failure_between_the_steps_leaves_the_old_version(spark, monkeypatch, step):
    path = scratch_path(spark, "torn")
    ap.staged_replace(spark.range(3), path, lambda s: [])

    class Broken(Exception):
        pass

    def breaks(*args):
        raise Broken

    new, gates = spark.range(9), lambda s: []
    if step == "write":
        new = spark.range(9).select(F.raise_error(F.lit("torn")).alias("id"))
        broken = Exception
    elif step == "gate":
        gates, broken = breaks, Broken
    elif step == "publish":
        monkeypatch.setattr(ap, "_publish", breaks)
        broken = Broken
    else:
        # the pointer is there, its version is not
        def half(fs, pointer, version, folder):
            fs.create(pointer, False).close()
            raise Broken

        monkeypatch.setattr(ap, "_publish", half)
        broken = Broken
    with pytest.raises(broken):
        ap.staged_replace(new, path, gates)
    monkeypatch.undo()
    assert rows_of(spark, path) == 3
    ap.staged_replace(spark.range(5), path, lambda s: [])
    assert rows_of(spark, path) == 5


def test_two_writers_cannot_both_replace_and_readers_keep_their_version(spark):
    path = scratch_path(spark, "race")
    ap.staged_replace(spark.range(3), path, lambda s: [])
    held = ap.read_current(spark, path)

    def meanwhile(staged):
        ap.staged_replace(spark.range(7), path, lambda s: [])
        return []

    with pytest.raises(ap.ConcurrentReplace):
        ap.staged_replace(spark.range(9), path, meanwhile)
    assert rows_of(spark, path) == 7 and held.count() == 3
    for n in (11, 12, 13):
        ap.staged_replace(spark.range(n), path, lambda s: [])
    assert rows_of(spark, path) == 13
    assert len([d for d in os.listdir(path.removeprefix("file:")) if d.startswith("version=")]) == 2


def test_month_partitions_prune(spark):
    path = scratch_path(spark, "m")
    df = spark.range(60).withColumn("t", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")))
    ap.write_by_month(df, path, "t")
    plan = spark.read.parquet(path).filter("month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_large_month_gets_many_files_and_small_ones_share_a_task(spark):
    path = scratch_path(spark, "sized")
    day = F.when(F.col("id") < 900, F.lit("2024-05-05")).otherwise(F.date_add(F.lit("2024-01-01"), (F.col("id") % 90).cast("int")))
    ap.write_by_month(spark.range(1000).withColumn("t", day.cast("date")), path, "t", rows_per_file=100)
    log = spark.read.parquet(path)
    files = log.groupBy("month", F.input_file_name().alias("f")).count().collect()
    assert log.count() == 1000 and max(r["count"] for r in files) <= 100
    assert sum(r["count"] for r in files if r.month == "2024-05") == 900 and len([r for r in files if r.month == "2024-05"]) >= 9
    assert len([r for r in files if r.month != "2024-05"]) <= 6


def test_fingerprints(spark, tmp_path):
    import hashlib
    data = os.urandom(1000)
    for name, content in (("f.bin", b"abc"), ("l.bin", data)):
        (tmp_path / name).write_bytes(content)

    def sha(x):
        return hashlib.sha256(x).hexdigest()

    want = {(n, len(c), sha(c), sha(b"".join(hashlib.sha256(c[k:k + 64]).digest() for k in range(0, len(c), 64))))
            for n, c in (("f.bin", b"abc"), ("l.bin", data))}
    # as one value, and block by block from ranges
    for at_once in (1 << 20, 2):
        assert {tuple(r) for r in fl.file_fingerprint(spark, str(tmp_path), "*.bin", block=64, at_once=at_once).collect()} == want
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    a = fl.table_fingerprint(df, ["k", "v"]).first()
    assert a == fl.table_fingerprint(df.orderBy(F.desc("k")), ["k", "v"]).first()
    assert a != fl.table_fingerprint(df.filter("k = 1"), ["k", "v"]).first()


def bout(spark, **change):
    base = dict(date="2024-01-01", a="1", b="2", name_a="x", name_b="y", winner="A", pair="1|2", url_a="/fighter-details/1", url_b="/fighter-details/2")
    return spark.createDataFrame([tuple({**base, **change}.values())], ", ".join(f"{k} string" for k in base))


def failed(df):
    return {r["check"]: r["n"] for r in df.filter("n > 0").collect()}


@pytest.mark.parametrize("change,want", [
    ({}, {}), ({"winner": "C"}, {"invalid_winner": 1}), ({"winner": None}, {"invalid_winner": 1}), ({"date": None}, {"invalid_date": 1}),
    ({"a": " "}, {"missing_id_a": 1, "url_id_mismatch_a": 1}), ({"name_b": "x"}, {"self_match_name": 1}),
    ({"b": "1"}, {"self_match_id": 1, "url_id_mismatch_b": 1}), ({"url_a": None}, {"missing_url_a": 1, "url_id_mismatch_a": 1})])
def test_bout_audit(spark, change, want):
    assert failed(ql.audit_bouts(bout(spark, **change), url_a="url_a", url_b="url_b")) == want


def test_bout_audit_duplicates_and_missing_columns(spark):
    twice = bout(spark).unionByName(bout(spark))
    assert failed(ql.audit_bouts(twice)) == {"duplicate_date_pair": 1}
    assert failed(ql.audit_bouts(twice.drop("winner"))) == {"missing_column:winner": 1}
    with pytest.raises(ValueError, match="duplicate_date_pair=1"):
        ql.assert_clean(ql.audit_bouts(twice))


def test_upcoming_audit(spark):
    df = spark.createDataFrame([("2024-01-01", "a", "b", "+120", "-140", 0.4, 3, 120.0, "x"), (None, "c", "c", "0", "abc", 1.2, 0, 50.0, " ")],
                               "date string, a string, b string, odds_a string, odds_b string, p double, n int, best double, book string")
    df = df.withColumn("pair", F.concat("a", "b"))
    assert failed(ql.audit_upcoming(df, prob="p", books="n", best=("best", "book", "best", "book"))) == {
        "invalid_date": 1, "missing_or_zero_price": 1, "self_match": 1, "invalid_probability": 1, "invalid_book_count": 1,
        "invalid_best_a": 1, "best_without_book_a": 1, "invalid_best_b": 1, "best_without_book_b": 1}


def test_refresh_regressions(spark):
    old = spark.createDataFrame([("2024-01-01", "1", "2"), ("2024-01-09", "3", "4")], "date string, a string, b string")
    new = old.filter("date < '2024-01-05'")
    assert failed(ql.refresh_regressions(old, new, "date", ["a", "b"])) == {"rows_shrank": 1, "latest_moved_backward": 1, "ids_dropped": 2}
    assert failed(ql.refresh_regressions(new, old, "date", ["a", "b"])) == {}
