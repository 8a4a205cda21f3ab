"""Changed files, expiring progress, items sent with retries, and keyed tables, against what they should hold."""

import collections
import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemosail import plans
from mnemosail.plans.stream_queries import ROCKS
from mnemosail.sources import changed_files as C
from mnemosail.sources import item_sink
from mnemosail.sources.keyed_table import KeyedTable
from mnemosail.streaming.progress import stream_new_messages_expiring
from tests.conftest import DATA

# changed files


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(**options):
        got = []

        def sink(batch, n):
            got.extend((os.path.relpath(r.path, tmp_path / "in"), r.line, r.value) for r in batch.collect())

        stream = C.changed_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", **options)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    return tmp_path / "in", run


def test_changed_files_are_delivered_whole(folder):
    place, run = folder
    assert run(pattern="**/*.txt", exclude="**/skip/**") == []
    (place / "sub/skip").mkdir(parents=True)
    (place / "a.txt").write_text("one\r\ntwo\n")
    (place / "sub/b.txt").write_text("é")
    (place / "sub/skip/c.txt").write_text("no")
    (place / "d.log").write_text("no")
    (place / "e.txt").write_bytes(b"\xff\n\n")
    options = {"pattern": "**/*.txt", "exclude": "**/skip/**", "partitionBytes": 5}
    first = run(**options)
    assert first == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("e.txt", 0, "�"), ("e.txt", 1, ""), ("sub/b.txt", 0, "é")]
    assert run(**options) == []  # nothing changed
    with (place / "a.txt").open("a") as f:
        f.write("three")
    assert run(**options) == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("a.txt", 2, "three")]
    (place / "a.txt").write_text("short")  # shrunk
    (place / "sub/b.txt").unlink()
    assert run(**options) == [("a.txt", 0, "short")]
    (place / "sub/b.txt").write_text("é")  # back again
    assert run(**options) == [("sub/b.txt", 0, "é")]
    os.utime(place / "a.txt", ns=(0, 10**18))  # touched
    assert run(**options) == [("a.txt", 0, "short")]
    listings = [x for x in os.listdir(place.parent / "state") if x.endswith(".json")]
    assert len(listings) <= 3 and not [x for x in os.listdir(place.parent / "state") if x.endswith(".part")]


def test_whole_files_and_long_ones(folder):
    place, run = folder
    (place / "a").write_text("x\ny")
    (place / "b").write_text("")
    assert run(format="whole") == [("a", 0, "x\ny"), ("b", 0, "")]
    long = "\n".join(f"{k} " + "z" * (k % 977) for k in range(9000))
    (place / "c").write_text(long)
    assert [v for _, _, v in sorted(run(format="lines"), key=lambda r: r[1])] == long.split("\n")


def test_batches_of_some_files(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(7):
        (tmp_path / f"in/{k}").write_text("x" * k)
    reader = C.ListingReader({"path": str(tmp_path / "in"), "state": str(tmp_path / "state"), "maxFiles": "3"})
    at, seen = reader.initialOffset(), []
    while True:
        new = reader.latestOffset()
        if new == at:
            break
        batch = [os.path.basename(p) for part in reader.partitions(at, new) for p, *_ in part.paths]
        assert 0 < len(batch) <= 3
        seen, at = seen + batch, new
        reader.commit(at)
        reader = C.ListingReader({"path": str(tmp_path / "in"), "state": str(tmp_path / "state"), "maxFiles": "3"})  # a restart
    assert sorted(seen) == [str(k) for k in range(7)]
    (tmp_path / "in/3").unlink()
    assert reader.partitions(at, reader.latestOffset()) == []


# progress that expires


def test_progress_expires(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    got = collections.defaultdict(list)
    try:
        for n, rows in enumerate(
            [
                [("a", 0, "01"), ("a", 1, "01"), ("b", 0, "01"), ("c", 0, "01")],
                [("a", 0, "05"), ("a", 1, "05"), ("a", 2, "05"), ("b", 0, "05")],  # nothing new in b
                [("a", 0, "11"), ("a", 1, "11"), ("a", 2, "11"), ("a", 3, "11"), ("c", 0, "11"), ("c", 1, "11")],  # c was idle for ten days, and is late for its timer
                [("b", 0, "20"), ("a", 0, "12")],  # b after fifteen days; a is shorter now
            ]
        ):
            pd.DataFrame({"t": [r[0] for r in rows], "raw_idx": [r[1] for r in rows], "ts": [f"2024-01-{r[2]} 00:00:00" for r in rows]}).to_json(tmp_path / f"{n}.json", orient="records", lines=True)
            stream = spark.readStream.schema("t string, raw_idx long, ts timestamp").json(f"file://{tmp_path}/*.json")

            def sink(batch, _, n=n):
                got[n] += [(r.t, r.raw_idx) for r in batch.collect()]

            stream_new_messages_expiring(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    assert [sorted(got[n]) for n in range(4)] == [[("a", 0), ("a", 1), ("b", 0), ("c", 0)], [("a", 2)], [("a", 3), ("c", 0), ("c", 1)], [("a", 0), ("b", 0)]]


@pytest.mark.parametrize("name", ["stream_new_messages", "stream_hourly_vs_nightly"])
def test_streams_read_tables_in_several_files(spark, tmp_path, name):
    for table in ("conversations", "events"):
        spark.read.parquet(f"{DATA}/sf0.001/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, want = (plans.QUERIES[name](spark, at).collect() for at in (f"file://{tmp_path}", f"{DATA}/sf0.001"))
    assert len(got) and sorted(got) == sorted(want)


# items


class Service(ThreadingHTTPServer):
    def __init__(self):
        self.items, self.tries, self.lock = {}, collections.Counter(), threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_PUT(self):  # noqa: N802
                body, name = self.rfile.read(int(self.headers["Content-Length"])), self.path.rpartition("/")[2]
                with self.server.lock:
                    self.server.tries[name] += 1
                    k = self.server.tries[name]
                    code = 400 if name == "13" else 503 if name.endswith("7") or (name.endswith("5") and k < 3) else 200
                    if code == 200:
                        self.server.items[name] = json.loads(body)
                self.send_response(code)
                self.end_headers()

            def log_message(self, *_):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()


def test_items_are_sent_with_retries(spark, tmp_path):
    service = Service()
    df = spark.range(40).select(F.when(F.col("id") < 39, F.col("id")).alias("id"), F.concat(F.lit("text ö "), F.col("id").cast("string")).alias("text"), F.array("id").alias("tags")).repartition(3)
    for _ in range(2):  # sending again leaves each item once
        done = item_sink.send_items(df, f"http://127.0.0.1:{service.server_port}/items", f"file://{tmp_path}/report", attempts=3, wait=0.01)
        assert done == {"sent": 34, "failed": 6}
    assert set(service.items) == {str(k) for k in range(39) if k % 10 != 7 and k != 13} - {"39"}
    assert service.items["5"] == {"id": 5, "text": "text ö 5", "tags": [5]}
    assert service.tries["13"] == 2 and service.tries["7"] == 6 and service.tries["5"] == 4  # refused at once; given up after three; the third worked
    failed = [json.loads(x) for p in (tmp_path / "report").glob("failed-*.json") for x in p.read_text().splitlines()]
    assert sorted(str(f["id"]) for f in failed) == sorted(["7", "17", "27", "37", "13", "None"]) and {f["reason"] for f in failed if f["id"] is None} == {"no id"}
    service.shutdown()


def test_waits_double():
    waits, calls = [], []

    def send():
        calls.append(1)
        raise OSError("down")

    assert item_sink.tried(send, 4, 0.5, waits.append) == "OSError: down" and waits == [0.5, 1.0, 2.0] and len(calls) == 4


# keyed tables


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "id long, v string, ver int"
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, "id", "ver", 16)
    assert table.rows().count() == 0 and table.upsert(spark.createDataFrame([], schema)) == 0
    want, r = {}, random.Random(1)
    for turn in range(5):
        rows = [(r.randrange(200) if r.random() > 0.02 else None, f"v{turn}-{k}", r.randrange(4)) for k in range(400 if turn == 0 else 5)]
        rows = list({k: (k, v, n) for k, v, n in rows}.values())
        before = table.folders()
        touched = table.upsert(spark.createDataFrame(rows, schema).repartition(3))
        for k, v, n in rows:
            if k not in want or n >= want[k][1]:
                want[k] = (v, n)
        after = table.folders()
        assert {r.id: (r.v, r.ver) for r in table.rows().collect()} == want and table.rows().count() == len(want)
        if turn:
            assert touched < 16 and sum(before.get(b) != after[b] for b in after) == touched
            again = table.folders()
            table.upsert(spark.createDataFrame(rows, schema))  # the same batch again
            assert {r.id: (r.v, r.ver) for r in table.rows().collect()} == want and set(again) == set(table.folders())


def test_declared_rows_replace_the_rest(spark, tmp_path):
    schema = "id long, v string"
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, "id", buckets=8)
    first = spark.range(100).select("id", F.lit("a").alias("v")).unionByName(spark.createDataFrame([(None, "n")], schema))
    assert table.declare(first.unionByName(first)) == 8 and table.rows().count() == 101
    assert table.declare(first) == 0
    before, held = table.folders(), table.rows()
    changed = first.where("id <> 5 or id is null").withColumn("v", F.when(F.col("id") == 6, None).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(1000, "new")], schema))
    touched = table.declare(changed)
    assert 1 <= touched <= 3 and sum(before.get(b) != f for b, f in table.folders().items()) == touched
    assert {(r.id, r.v) for r in table.rows().collect()} == {(r.id, r.v) for r in changed.collect()}
    assert held.count() == 101  # who reads the old version still can
    assert table.declare(changed.limit(0)) == 8 and table.rows().count() == 0
