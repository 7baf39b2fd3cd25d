"""Commits over several tables, keyed batches, and what is left after failures."""

import pytest
from pyspark.sql import functions as F

from strataline.sources import versions

TABLES = {"files": "path string, score double", "edges": "src string, dst string"}


@pytest.fixture()
def store(spark, tmp_path):
    return versions.Store(spark, str(tmp_path / "store"), "scan_id", TABLES)


def parts(spark, scans, score=1.0):
    files = spark.createDataFrame([(s, f"f{k}", score) for s in scans for k in range(2)], "scan_id long, path string, score double")
    edges = spark.createDataFrame([(s, "f0", "f1") for s in scans], "scan_id long, src string, dst string")
    return {"files": files, "edges": edges}


def seen(store):
    return sorted((r["scan_id"], r["path"], r["score"]) for r in store.read("files").collect()), sorted(r["scan_id"] for r in store.read("edges").collect())


def test_a_write_killed_between_two_tables_leaves_the_old_version(spark, store, monkeypatch):
    assert seen(store) == ([], [])
    store.replace(parts(spark, [1, 2]))
    before = seen(store)
    late = parts(spark, [2, 3], 9.0)
    late["edges"] = late["edges"].withColumn("dst", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        store.replace(late)
    assert seen(store) == before and len(store.commits()) == 1
    monkeypatch.setattr(versions.Store, "_forget", lambda *_: None)  # as when the driver dies, nothing is tidied up
    with pytest.raises(Exception, match="killed"):
        store.replace(late)
    monkeypatch.setattr(versions.Store, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.replace(parts(spark, [2, 3], 9.0))
    monkeypatch.undo()
    assert spark.read.parquet(f"{store.folder}/files").count() > 4  # rows without a commit
    assert seen(store) == before
    store.replace(parts(spark, [2], 5.0))
    assert seen(store) == ([(1, "f0", 1.0), (1, "f1", 1.0), (2, "f0", 5.0), (2, "f1", 5.0)], [1, 2])


def test_delete_cascades_and_vacuum_frees_versions(spark, store):
    store.replace(parts(spark, [1, 2, 3]))
    store.delete(spark.createDataFrame([(1,), (3,)], "scan_id long"))
    assert seen(store) == ([(2, "f0", 1.0), (2, "f1", 1.0)], [2])
    assert store.vacuum() == []
    store.replace({"files": parts(spark, [2], 4.0)["files"]})  # a scan without edges now
    assert seen(store) == ([(2, "f0", 4.0), (2, "f1", 4.0)], [])
    assert len(store.vacuum()) == 1 and seen(store) == ([(2, "f0", 4.0), (2, "f1", 4.0)], [])
    store.replace(parts(spark, [1]), scopes=spark.createDataFrame([(1,), (2,)], "scan_id long"))
    assert {s for s, *_ in seen(store)[0]} == {1}


def test_a_commit_after_another_is_refused_where_it_must_not_be(spark, store):
    store.replace(parts(spark, [1]))
    with pytest.raises(versions.Raced):
        store.replace(parts(spark, [1]), after=0)
    assert store.replace(parts(spark, [1]), after=1) == 2


def change(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, op string, id long, name string, mail string")


def test_batches_give_back_what_breaks_a_key(spark, tmp_path):
    users = versions.KeyedTable(spark, str(tmp_path / "users"), "id", "name string, mail string", [["name"], ["mail"]])
    batch = [(1, "insert", 1, "a", "a@x"), (2, "insert", 2, "b", None), (3, "insert", 1, "again", "z@x"), (4, "insert", 3, "a", "c@x"), (5, "insert", 4, "d", None), (6, "insert", None, "e", "e@x"), (7, "update", 9, "f", "f@x")]
    good, bad = users.apply(change(spark, batch))
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 4]
    assert {(r["ordinal"], r["reason"]) for r in bad.collect()} == {(3, "repeated"), (4, "taken in batch"), (6, "no key"), (7, "missing")}
    good, bad = users.apply(change(spark, [(1, "update", 1, "a", "new@x"), (2, "update", 2, "a", "b@x"), (3, "delete", 4, None, None), (4, "insert", 5, "e", "e@x"), (5, "insert", 6, "e", "y@x")]))
    assert {(r["ordinal"], r["reason"]) for r in bad.collect()} == {(2, "taken"), (5, "taken in batch")}
    assert [r["reason"] for r in users.apply(change(spark, [(1, "insert", 2, "y", "y@x")]))[1].collect()] == ["exists"]
    assert sorted(tuple(r) for r in users.read().select("id", "name", "mail").collect()) == [(1, "a", "new@x"), (2, "b", None), (5, "e", "e@x")]


def test_a_raced_batch_is_judged_again(spark, tmp_path):
    table = lambda: versions.KeyedTable(spark, str(tmp_path / "users"), "id", "name string, mail string", [["name"]])
    other, calls = table(), []

    def meanwhile():
        if not calls:
            calls.append(1)
            other.apply(change(spark, [(1, "insert", 7, "a", "first@x")]))

    good, bad = table().apply(change(spark, [(1, "insert", 7, "b", "x"), (2, "insert", 8, "a", "x"), (3, "insert", 9, "c", "x")]), checked=meanwhile)
    assert [r["id"] for r in good.collect()] == [9] and {(r["id"], r["reason"]) for r in bad.collect()} == {(7, "exists"), (8, "taken")}
    assert {r["id"]: r["mail"] for r in table().read().collect()} == {7: "first@x", 9: "x"}


def test_get_or_create_makes_each_key_once(spark, tmp_path):
    cache = versions.KeyedTable(spark, str(tmp_path / "cache"), "id", "name string", kind="long")
    made = []

    def make(missing):
        made.append(sorted(r["id"] for r in missing.collect()))
        if len(made) == 1:
            cache.apply(spark.createDataFrame([(0, "insert", 2, "other")], "ordinal long, op string, id long, name string"))
        return missing.withColumn("name", F.lit("mine"))

    wanted = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert {r["id"]: r["name"] for r in cache.get_or_create(wanted, make).collect()} == {1: "mine", 2: "other"}
    assert {r["id"] for r in cache.get_or_create(wanted.union(spark.createDataFrame([(5,)], "id long")), make).collect()} == {1, 2, 5}
    assert made == [[1, 2], [5]]
