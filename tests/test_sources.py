import gzip
import struct

import pytest

from loomgraph import terms as T
from loomgraph.plans.rules import OWL2RL_SPEC
from loomgraph.plans.tbox import TBox
from loomgraph.sources import files
from loomgraph.sources.store import insert, read_store, scan_store, write_store
from loomgraph.streaming.ingest import ingest, predicate_rates

S = "s long, p long, o long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_triple_files(spark, tmp_path):
    data = [(i, i % 3, (1 << 40) + i) for i in range(1000)] + [(-1, 0, -(1 << 62))]
    df = spark.createDataFrame(data + [(None, 1, 2)], S)
    assert files.write_triple_files(df, f"{tmp_path}/pos", "pos") == 1001
    back = files.read_triple_files(spark, f"{tmp_path}/pos", "pos")
    assert rows(back.select("s", "p", "o")) == sorted(data)
    first = files.first_elements(spark, f"{tmp_path}/pos")
    assert first.count() == len(files.local_files(f"{tmp_path}/pos"))
    # a file of two gzip members and a broken record at the end
    raw = gzip.compress(struct.pack(">3q", 1, 2, 3)) + gzip.compress(struct.pack(">3q", 4, 5, 6) + b"xx")
    (tmp_path / "one").write_bytes(raw)
    assert rows(files.read_triple_files(spark, f"{tmp_path}/one")) == [(1, 2, 3, "one"), (4, 5, 6, "one")]


def test_list_files(spark, tmp_path):
    data = [(7, 0, 0, 70), (7, 0, 1, 71), (7, 1, 0, 72), (1 << 35, 0, 0, 73)]
    files.write_list_file(spark.createDataFrame(data + data[:1], "head long, list_id int, pos int, el long"), f"{tmp_path}/list")
    assert rows(files.read_list_file(spark, f"{tmp_path}/list")) == sorted(data)


def test_list_file_in_a_new_folder(spark, tmp_path):
    data = [(7, 0, 0, 70), (8, 0, 0, 71)]
    for at in (f"{tmp_path}/not/there/list", f"file://{tmp_path}/nor/here/list"):
        files.write_list_file(spark.createDataFrame(data, "head long, list_id int, pos int, el long"), at)
        assert rows(files.read_list_file(spark, at)) == data


def test_dictionary_files(spark, tmp_path):
    data = [(5, "<http://x/é>"), (0, '"a"'), (1 << 50, ""), (5, "<http://x/é>"), (6, None), (None, "x")]
    files.write_dictionary_files(spark.createDataFrame(data, "id long, text string"), f"{tmp_path}/d")
    assert rows(files.read_dictionary_files(spark, f"{tmp_path}/d")) == [(0, '"a"'), (5, "<http://x/é>"), (1 << 50, "")]
    assert files.check_dictionary_sorted(spark, f"{tmp_path}/d")
    raw = (tmp_path / "d" / "index_sorted.data").read_bytes()
    (tmp_path / "d" / "index_sorted.data").write_bytes(raw[20:] + raw[:20])
    assert not files.check_dictionary_sorted(spark, f"{tmp_path}/d")


def test_ntriples(spark, tmp_path):
    (tmp_path / "t.nt").write_text(
        '<http://a> <http://p> "x \\" y"@en .\n# remark\n\n_:b1 <http://p> <http://a> . # end\n<http://a> <http://p> "1"^^<http://i> .\nbroken <http://p> .\n'
    )
    df = files.read_ntriples(spark, f"{tmp_path}/t.nt")
    assert df.count() == 4 and df.where("subject IS NULL").select("line").first()[0].startswith("broken")
    known = spark.createDataFrame([(7, "<http://p>"), (7, "<http://p>"), (9, None)], "id long, text string")
    triples, dictionary = files.encode(df, known)
    ids = {r["text"]: r["id"] for r in dictionary.collect()}
    assert ids["<http://p>"] == 7 and len(ids) == 5 and len(set(ids.values())) == 5 and min(ids.values()) == 7
    assert rows(triples) == sorted([(ids["<http://a>"], 7, ids['"x \\" y"@en']), (ids["_:b1"], 7, ids["<http://a>"]), (ids["<http://a>"], 7, ids['"1"^^<http://i>'])])


@pytest.mark.parametrize("few", [True, False])
def test_store(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr("loomgraph.sources.store.MOST_FOLDERS", 1)
    data = [(i, i % 4, i * 7 % 50) for i in range(200)]
    write_store(spark.createDataFrame(data + data + [(None, 1, 1)], S), f"{tmp_path}/s")
    assert rows(read_store(spark, f"{tmp_path}/s")) == sorted(data)
    assert rows(scan_store(spark, f"{tmp_path}/s", p=2, o=14)) == sorted(t for t in data if t[1] == 2 and t[2] == 14)
    # the largest subject, a repeated one, a new predicate
    assert insert(spark, f"{tmp_path}/s", spark.createDataFrame([data[5], (10**15, 2, 1), (1, 99, 1), (1, 99, 1), (None, 1, 2)], S)) == 2
    want = sorted([*data, (10**15, 2, 1), (1, 99, 1)])
    for order in ("pso", "pos"):
        assert rows(read_store(spark, f"{tmp_path}/s", order)) == want
    assert insert(spark, f"{tmp_path}/s", spark.createDataFrame(data, S)) == 0
    assert rows(scan_store(spark, f"{tmp_path}/s", s=10**15)) == [(10**15, 2, 1)]


def test_stream_into_the_store(spark, tmp_path):
    write_store(spark.createDataFrame([(1, 400, 2)], S), f"{tmp_path}/s")
    tbox = TBox(spark.createDataFrame([(400, 4, 401), (401, 0, T.TRANSITIVE)], S), OWL2RL_SPEC)
    insert(spark, f"{tmp_path}/s", spark.createDataFrame([(1, 401, 2)], S))  # closed under the rules
    spark.createDataFrame([(2, 400, 3), (2, 400, 3), (None, 400, 1)], S).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(3, 400, 4), (2, 400, 3)], S).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(S).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ingest(stream, f"{tmp_path}/s", f"{tmp_path}/c", tbox.compiled).awaitTermination()
    want = [(i, 400, i + 1) for i in (1, 2, 3)] + [(i, 401, j) for i in (1, 2, 3) for j in (2, 3, 4) if j > i]
    assert rows(read_store(spark, f"{tmp_path}/s")) == sorted(want)
    # nothing new: nothing happens
    ingest(stream, f"{tmp_path}/s", f"{tmp_path}/c", tbox.compiled).awaitTermination()
    assert rows(read_store(spark, f"{tmp_path}/s")) == sorted(want)


def test_rates(spark, tmp_path):
    schema = "s long, p long, o long, asserted_at timestamp"
    spark.sql("SELECT 1L s, 5L p, 1L o, timestamp'2024-01-01 00:10:00' asserted_at UNION ALL SELECT 2L, 5L, 1L, timestamp'2024-01-01 00:50:00' UNION ALL SELECT 2L, NULL, 1L, NULL").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = predicate_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["p"], r["n"]) for r in spark.sql("SELECT * FROM rates").collect()] == [(5, 2)]


def test_late_first_deliveries_are_ingested(spark, tmp_path):
    """Statements far older than the watermark come in, repeated ones once."""
    from loomgraph.sources.store import read_store, write_store
    from loomgraph.streaming.ingest import ingest

    schema = "s long, p long, o long, asserted_at timestamp"
    at, store, source = "CAST(asserted_at AS timestamp) asserted_at", str(tmp_path / "store"), str(tmp_path / "in")
    write_store(spark.createDataFrame([(0, 100, 0)], "s long, p long, o long"), store)
    for day, row in (("2024-06-01", 1), ("2024-06-02", 2), ("2024-01-01", 3), ("2024-06-02", 2)):
        spark.createDataFrame([(row, 100, row, day)], "s long, p long, o long, asserted_at string").selectExpr("s", "p", "o", at).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest(stream, store, str(tmp_path / "checkpoint"), late="2 days").awaitTermination()
    assert sorted(tuple(r) for r in read_store(spark, store).select("s", "p", "o").collect()) == [(i, 100, i) for i in range(4)]


def test_insert_is_completed_after_a_failure(spark, tmp_path, monkeypatch):
    from loomgraph.sources import store

    path = f"{tmp_path}/store"
    write_store(spark.createDataFrame([(1, 100, 2)], S), path)
    new = spark.createDataFrame([(3, 100, 4), (3, 100, 4), (1, 100, 2), (5, 101, 6), (None, 1, 1)], S)
    write = store._write

    def failing(rows, target, order, folders, mode):
        if order == "pos":
            raise OSError("lost")
        write(rows, target, order, folders, mode)

    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(OSError):
        insert(spark, path, new)
    monkeypatch.setattr(store, "_write", write)
    assert insert(spark, path, new) == 0  # the first copy has them
    want = [(1, 100, 2), (3, 100, 4), (5, 101, 6)]
    assert rows(read_store(spark, path, "pso")) == rows(read_store(spark, path, "pos")) == want
    assert insert(spark, path, new) == 0
    store.compact(spark, path)
    assert rows(read_store(spark, path, "pso")) == rows(read_store(spark, path, "pos")) == want
    assert not [x for x in (tmp_path / "store").iterdir() if x.name.startswith("_")]


def test_subsets_are_kept(spark, tmp_path):
    from loomgraph.sources.store import read_subsets, write_subsets

    closed = spark.createDataFrame([(1, 5, 2), (1, 5, 2), (3, 0, 10), (4, 0, 9), (5, 16, 6), (7, 999, 8)], S)
    assert write_subsets(closed, f"{tmp_path}/c") == {"rdfs-subclasses": 1, "owl-transitive-properties": 1, "owl-symmetric-properties": 1, "owl-on-properties": 1}
    assert rows(read_subsets(spark, f"{tmp_path}/c", "rdfs-subclasses")) == [(1, 5, 2, "rdfs-subclasses")]


def test_plans_that_only_read(spark, tmp_path):
    from loomgraph.workspace import is_scan

    spark.createDataFrame([(1, 2, 3)], S).write.parquet(f"{tmp_path}/Join Aggregate")
    df = spark.read.parquet(f"{tmp_path}/Join Aggregate")
    assert is_scan(df.where("s > 0").union(df).select("s"))
    assert not is_scan(df.distinct()) and not is_scan(df.join(df.select("s"), "s"))


def _folders(path, order):
    return sum(x.name.startswith("p=") for x in (path / order).iterdir())


@pytest.mark.parametrize("most, each", [(10, 1), (1000, 20)])
def test_many_new_predicates_are_no_folders(spark, tmp_path, monkeypatch, most, each):
    """A store of few predicates gets many more: too many for folders, or too few rows in each."""
    from loomgraph.sources.store import compact

    monkeypatch.setattr("loomgraph.sources.store.MOST_FOLDERS", most)
    monkeypatch.setattr("loomgraph.sources.store.FOLDER_ROWS", each, raising=False)
    store, path = tmp_path / "s", f"{tmp_path}/s"
    old = [(i, i % 3, i * 7 % 50) for i in range(90)]
    few, many = [(i, 50, 1) for i in range(30)], [(i, 100 + i, i) for i in range(60)]
    write_store(spark.createDataFrame(old, S), path)
    assert insert(spark, path, spark.createDataFrame(few + old[:5], S)) == 30
    assert (_folders(store, "pso"), _folders(store, "pos")) == (4, 4)
    for added, data in ((60, old + few + many), (1, [(1, 1000, 1)])):
        assert insert(spark, path, spark.createDataFrame(data, S)) == added
        assert (_folders(store, "pso"), _folders(store, "pos")) == (0, 0)
    want = sorted([*old, *few, *many, (1, 1000, 1)])
    for _ in range(2):
        assert rows(read_store(spark, path)) == rows(read_store(spark, path, "pos")) == want
        assert not [x for x in store.iterdir() if x.name.startswith("_")]
        compact(spark, path)
    assert rows(scan_store(spark, path, p=110)) == [(10, 110, 10)]


def test_an_exchange_cut_short_is_undone(spark, tmp_path):
    from loomgraph.sources.store import compact

    store, path = tmp_path / "s", f"{tmp_path}/s"
    write_store(spark.createDataFrame([(1, 2, 3)], S), path)
    (store / "pos").rename(store / "_pos-old")
    assert insert(spark, path, spark.createDataFrame([(1, 2, 3), (4, 5, 6)], S)) == 1
    compact(spark, path)
    assert rows(read_store(spark, path)) == rows(read_store(spark, path, "pos")) == [(1, 2, 3), (4, 5, 6)]


def test_a_store_of_nothing(spark, tmp_path):
    write_store(spark.createDataFrame([(1, None, 3)], S), f"{tmp_path}/s")
    assert rows(read_store(spark, f"{tmp_path}/s")) == []
    assert insert(spark, f"{tmp_path}/s", spark.createDataFrame([(4, 5, 6)], S)) == 1
    assert rows(read_store(spark, f"{tmp_path}/s", "pos")) == [(4, 5, 6)]
