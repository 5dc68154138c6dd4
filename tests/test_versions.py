"""Versioned tables, the key set on disk, compact running state, and bounded duplicate suppression."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.sources.versions import Conflict, Versions
from scorelake.streaming import incremental, seen_keys
from scorelake.streaming.seen_keys import SeenKeys


def test_versions_swap_and_old_readers_end(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "table"))
    assert table.latest() is None and table.numbers() == []
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(10)) == 1
    reader = table.read()
    assert table.replace(table.read().where("id > 2")) == 2
    assert table.replace(table.read().withColumn("more", F.lit("x"))) == 3
    assert reader.count() == 10 and table.read().count() == 7 and table.read(2).columns == ["id"]
    assert table.drop_before(keep=2) == 1 and table.numbers() == [2, 3]
    assert table.read().count() == 7


def test_second_writer_of_a_version_fails(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "table"))
    table.replace(spark.range(3))
    start = table.latest()
    table.replace(spark.range(4), after=start)
    with pytest.raises(Conflict):
        table.replace(spark.range(5), after=start)
    assert table.read().count() == 4
    assert table.publish(table.content(2), 2, again=True) == 2


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 62), 1 << 62, 20000)
    field = seen_keys.bloom(hashes)
    assert seen_keys.may_hold(field, hashes).all()
    assert seen_keys.may_hold(field, rng.integers(-(1 << 62), 1 << 62, 20000)).mean() < 0.02
    assert not seen_keys.may_hold(seen_keys.bloom(hashes[:0]), hashes).any()


def _keys(spark, first, last):
    return spark.range(first, last).select(F.col("id").alias("a"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("b"))


def test_batches_read_a_share_of_the_key_files(spark, tmp_path):
    held = SeenKeys(spark, str(tmp_path / "keys"), ["a", "b"], per_bucket=500)
    assert held.unseen(_keys(spark, 0, 10)).rows.count() == 10
    for number, (first, last) in enumerate(((0, 60000), (60000, 100000), (100000, 101000), (101000, 101010))):
        held.add(_keys(spark, first, last), number)
    generations = dict(held.states())[3]
    # The second batch was merged with the first; later ones are too small for that.
    assert [g["keys"] for g in generations] == [100000, 1000, 10] and generations[0]["buckets"] == 200
    new = held.unseen(_keys(spark, 200000, 201000))
    # 5 keys a bucket at 1 in 100: 5 % of the large generation, and all 2 + 1 files of the small ones.
    assert new.rows.count() == 1000 and new.files == 203 and new.read <= 30
    mixed = held.unseen(_keys(spark, 50000, 50005).unionByName(_keys(spark, 300000, 300010)))
    assert {r.a for r in mixed.rows.collect()} == set(range(300000, 300010)) and mixed.read <= 12
    assert held.unseen(_keys(spark, 0, 101010)).rows.count() == 0
    # The state before a batch does not know its keys; adding them again gives the same state.
    assert held.unseen(_keys(spark, 100990, 101010), before=3).rows.count() == 10
    held.add(_keys(spark, 101000, 101010), 3)
    assert [g["keys"] for g in dict(held.states())[3]] == [100000, 1000, 10]


def _scored(spark, first, last):
    data = [(f"m{i % 3}", ("unit_test_gen", None, "e2e_ui")[i % 5 % 3], f"s{i % 400}", i, i % 5 != 0, i) for i in range(first, last)]
    return spark.createDataFrame(data, "model_slug string, track string, sample_id string, trial int, passed boolean, seq long")


def test_running_state_is_compact_and_exact(spark, tmp_path):
    tables = incremental.Tables(str(tmp_path / "tables"))
    run = incremental.score_batch(tables, lambda df: df.drop("seq"), "seq")
    sizes = []
    for number in range(4):
        run(_scored(spark, 250 * number, 250 * (number + 1)), number)
        folder = Versions(spark, tables.state).folder()
        sizes.append(spark.read.parquet(f"{folder}/samples").count())
    run(_scored(spark, 750, 1000), 3)  # once more, after a failure
    everything = _scored(spark, 0, 1000)
    expected = everything.where("track IS NOT NULL").groupBy("model_slug", "track").agg(F.count_distinct("sample_id").alias("n"))
    overall = everything.groupBy("model_slug").agg(F.count_distinct("sample_id").alias("n"))
    want = {(r.model_slug, r.track): r.n for r in expected.collect()} | {(r.model_slug, "ALL"): r.n for r in overall.collect()}
    got = incremental.samples_seen(spark, tables)
    assert {(r.model_slug, r.track): r.n_samples for r in got.collect()} == want
    assert sizes[1:] == [9, 9, 9]  # a row per model and track, whatever the number of batches
    numbers = spark.read.parquet(f"{Versions(spark, tables.state).folder()}/dictionary")
    assert numbers.count() == 400 == numbers.select("number").distinct().count()
    assert numbers.agg(F.max("number")).first()[0] < 64 * 20


def test_late_rows_and_old_state_go(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("inbox", "out", "progress"))
    day = lambda n: f"2024-01-{n:02d} 00:00:00"

    def deliver(*rows):
        df = spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("t"))
        df.write.mode("append").parquet(inbox)
        stream = incremental.unique_stream(spark.readStream.schema(df.schema).parquet(inbox), "t", "2 days", ("k",))
        return incremental.append_unique(stream, out, progress)

    assert deliver((1, day(1)), (2, day(2)), (2, day(2)), (3, day(10))) == 1  # days 1 and 2 are forgotten
    assert deliver((3, day(10)), (4, day(12)), (5, day(3))) == 2  # a repeat, a new one, a late one
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_text_files_are_replaced_whole(spark, tmp_path):
    from scorelake.sources import datasets

    root = str(tmp_path / "files")
    rows = spark.createDataFrame([("a/b/x.md", "one"), ("a/c/ü y.md", None), ("z.md", "three")], "path string, text string")
    assert datasets.write_texts(rows.repartition(2), root) == 3
    assert datasets.write_texts(rows.where("path = 'z.md'").withColumn("text", F.lit("3")), root) == 1
    found = sorted((str(p.relative_to(root)), p.read_text()) for p in (tmp_path / "files").rglob("*.md"))
    assert found == [("a/b/x.md", "one"), ("a/c/ü y.md", ""), ("z.md", "3")]
    with pytest.raises(Exception, match="outside"):
        datasets.write_texts(spark.createDataFrame([("../x", "t")], "path string, text string"), root)
    assert datasets.write_texts(rows.limit(0), root) == 0
