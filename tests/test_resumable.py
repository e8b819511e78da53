"""Sinks, stores, streams and downloads that survive interruptions."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, sinks, store
from corpusmill.sources.download import Limits, download, fetch
from corpusmill.streaming import scoring


def named(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.format_string("%05d.txt", "id").alias("name"), F.concat(F.lit("Tëxt "), "id").alias("text"))


def stored(spark, path):
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return {r.f: r.value for r in df.select(F.col("_metadata.file_name").alias("f"), "value").collect()}


# ---- one file per row


@pytest.mark.parametrize("layout", ["parts", "flat"])
def test_one_file_per_row(spark, tmp_path, layout):
    spark.dataSource.register(sinks.TextFiles)
    path = str(tmp_path / "out")
    named(spark, 40).write.format("one_file_per_row").option("layout", layout).mode("append").save(path)
    want = {f"{i:05d}.txt": f"Tëxt {i}" for i in range(40)}
    assert stored(spark, path) == want
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    more = spark.createDataFrame([("x.txt", None), ("y.txt", "")], "name string, text string")
    more.write.format("one_file_per_row").option("layout", layout).mode("append").save(path)
    assert stored(spark, path).keys() == want.keys() | {"x.txt", "y.txt"} or stored(spark, path) == want  # Spark reads no empty files
    assert (len(list((tmp_path / "out").rglob("*.txt")))) == 42
    more.write.format("one_file_per_row").option("layout", layout).mode("overwrite").save(path)
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 2


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(sinks.TextFiles)
    path = tmp_path / "out"
    bad = named(spark, 40).withColumn("name", F.when(F.col("name") == "00033.txt", "a/b").otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a name"):
        bad.write.format("one_file_per_row").mode("append").save(str(path))
    assert not path.exists() or not list(path.rglob("*.txt"))
    twice = named(spark, 3).unionByName(named(spark, 3))
    with pytest.raises(Exception, match="come twice"):
        twice.write.format("one_file_per_row").option("layout", "flat").mode("append").save(str(path))
    assert not list(path.rglob("*.txt"))


def test_a_killed_attempt_leaves_nothing(tmp_path):
    writer = sinks.TextFilesWriter(str(tmp_path / "out"), "parts", False)
    rows = [{"name": f"{i}.txt", "text": str(i)} for i in range(5)]

    def dying():
        yield from rows[:3]
        raise OSError("killed")

    with pytest.raises(OSError):
        writer.write(dying())
    late = writer.write(iter(rows))  # a speculative attempt that Spark does not choose
    good = writer.write(iter(rows))
    assert late.folder != good.folder
    writer.commit([good, None])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.txt")) == [f"{i}.txt" for i in range(5)]
    assert [p.name for p in (tmp_path / "out").iterdir()] == [f"part-00000-{writer.job}"]


# ---- a store that resumes


def samples(spark, ids, text=lambda i: f"t{i}"):
    rows = [(f"d{i // 2}", i % 2, text(i), "ab"[i % 2], "train" if i % 3 else "test") for i in ids]
    return spark.createDataFrame(rows, "document_id string, chunk int, hash string, source string, split string").repartition(3)


def ids_of(s):
    return sorted((r.sample_id, r.document_id, r.chunk) for r in s.read().select("sample_id", "document_id", "chunk").collect())


def test_interrupted_runs_give_the_ids_of_one(spark, tmp_path, monkeypatch):
    batches = [range(0, 30), range(20, 50), range(40, 80)]
    whole = store.SampleStore(spark, str(tmp_path / "whole"))
    for b in batches:
        whole.add(samples(spark, b), ["document_id", "chunk"])
    broken = store.SampleStore(spark, str(tmp_path / "broken"))
    for b in batches:
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(broken, "_commit", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt()))
            broken.add(samples(spark, b), ["document_id", "chunk"])
        broken = store.SampleStore(spark, str(tmp_path / "broken"))  # another process
        broken.add(samples(spark, b), ["document_id", "chunk"])
    assert ids_of(broken) == ids_of(whole) and [i for i, *_ in ids_of(whole)] == list(range(1, 81))
    last = whole.manifest()
    assert last["version"] == 3 and last["next_id"] == 81 and whole.counts() == {"a": 40, "b": 40}
    assert {(c["source"], c["split"]): c["n"] for c in last["counts"]} == {(r.source, r.split): r["count"] for r in whole.read().groupBy("source", "split").count().collect()}


def test_store_keeps_out_what_it_has(spark, tmp_path):
    s = store.SampleStore(spark, str(tmp_path))
    assert s.read() is None and s.manifest()["next_id"] == 1
    s.add(samples(spark, range(10), lambda i: f"t{i % 4}"), ["document_id", "chunk"])
    assert s.read().count() == 4
    before = s.manifest()
    assert s.add(samples(spark, range(10), lambda i: f"t{i % 4}"), ["document_id", "chunk"]) == before  # nothing new: no version
    s.add(samples(spark, range(100, 140)), ["document_id", "chunk"], target=7)
    assert s.counts() == {"a": 7, "b": 7}
    assert sorted(r.sample_id for r in s.read().collect()) == list(range(1, 15))
    with pytest.raises(RuntimeError, match="another run"):
        s._commit(s.manifest())


# ---- scoring with partial output


@pytest.mark.parametrize("stop_at", [0, 2, 4])
def test_scoring_resumes_after_any_batch(spark, tmp_path, stop_at):
    q, out, check = (str(tmp_path / x) for x in ("queue", "out", "check"))
    rows = spark.range(0, 50, 1, 1).select("id", F.concat(F.lit("t"), "id").alias("text"))
    scoring.queue(rows, q, every=10)
    seen = []

    def scorer(batch):
        seen.append(batch.count())
        return batch.withColumn("score", F.length("text"))

    def dying(batch):
        out = scorer(batch)
        if len(seen) == stop_at + 1:
            raise RuntimeError("killed")
        return out

    with pytest.raises(Exception, match="killed"):
        scoring.score(spark, q, rows.schema, dying, out, check).awaitTermination()
    assert not stop_at or scoring.scored(spark, out).count() == 10 * stop_at  # what was committed is there
    scoring.score(spark, q, rows.schema, scorer, out, check).awaitTermination()
    done = scoring.scored(spark, out).collect()
    assert sorted(r.id for r in done) == list(range(50)) and all(r.score == len(r.text) for r in done) and max(seen) == 10
    scoring.queue(rows.withColumn("id", F.col("id") + 50), q, every=10)
    scoring.score(spark, q, rows.schema, scorer, out, check).awaitTermination()
    assert sorted(r.id for r in scoring.scored(spark, out).collect()) == list(range(100))


# ---- downloads


class Host(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        Host.asked.append((self.path, time.monotonic()))
        if self.path == "/missing":
            return self.send_error(404)
        if self.path == "/busy" and sum(p == "/busy" for p, _ in Host.asked) < 3:
            return self.send_error(503)
        self.send_response(200)
        if self.path == "/declared":
            self.send_header("Content-Length", "10000000")
        self.end_headers()
        try:
            if self.path == "/endless":
                while True:
                    self.wfile.write(b"x" * 10_000)
            elif self.path == "/drip":
                for _ in range(100):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.1)
            else:
                self.wfile.write(b"%PDF " + self.path.encode())
        except OSError:
            pass

    def log_message(self, *a):
        pass


@pytest.fixture
def host():
    Host.asked = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_downloads_are_bounded(spark, host):
    limits = Limits(most_bytes=100_000, seconds=1.5, per_second=50, wait=0.05)
    paths = ["/a", "/b", "/missing", "/busy", "/declared", "/endless", "/drip"]
    urls = [*(host + p for p in paths), "ftp://x/y", "http://127.0.0.1:9/closed", None, host + "/a"]
    got = {r.url: r for r in download(spark.createDataFrame([(u,) for u in urls], "url string"), limits=limits).collect()}
    assert len(got) == len(paths) + 2
    reasons = {u.removeprefix(host): r.skip_reason for u, r in got.items()}
    assert reasons == {"/a": None, "/b": None, "/busy": None, "/missing": "download_refused", "/declared": "download_too_large", "/endless": "download_too_large", "/drip": "download_too_slow", "ftp://x/y": "download_bad_address", "http://127.0.0.1:9/closed": "download_failed"}
    assert bytes(got[host + "/a"].content) == b"%PDF /a" and got[host + "/missing"].status == 404
    assert got[host + "/drip"].seconds < 4


def test_a_host_is_asked_at_its_rate(spark, host):
    urls = spark.createDataFrame([(f"{host}/p{i}",) for i in range(12)], "url string").repartition(4)
    assert download(urls, limits=Limits(per_second=10)).where("skip_reason is null").count() == 12
    at = sorted(t for _, t in Host.asked)
    assert at[-1] - at[0] >= 1.0 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.05


def test_fetch_never_raises():
    assert fetch("http://[broken", Limits(tries=1))[2] in ("download_failed", "download_bad_address")


# ---- the first file of several folders


def test_first_existing_file(spark, tmp_path):
    folders = []
    for k, ids in enumerate([(1, 2), (2, 3), (3, 4, 5), (1, 5, 6)]):
        folders.append(str(tmp_path / f"f{k}"))
        (tmp_path / f"f{k}").mkdir()
        for i in ids:
            (tmp_path / f"f{k}" / f"{i}.txt").write_text(f"ü{k}-{i}")
    rows = spark.createDataFrame([(i, f"l{i}") for i in [1, 2, 3, 4, 5, 6, 7, 1]], "id long, label string").repartition(3)
    got = sorted((r.id, r.label, r.text_folder, r.text) for r in files.texts_of(rows, folders).collect() if r.id < 7)
    want = {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3}
    assert got == sorted((i, f"l{i}", want[i], f"ü{want[i]}-{i}") for i in [1, 1, 2, 3, 4, 5, 6])
    assert [(r.text, r.text_folder) for r in files.texts_of(rows.where("id = 7"), folders).collect()] == [(None, None)]


def test_configurations(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("labels:\n  0: {name: human}\n  1: {name: ai}\ntraining:\n  learning_rate: 2.0e-5\n  folds: [1, 2]\n")
    (tmp_path / "c.json").write_text('{"labels": {"0": {"name": "human"}, "1": {"name": "ai"}}, "training": {"learning_rate": 2e-5, "folds": [1, 2]}}')
    a, b = (files.load_config(str(tmp_path / f"c.{x}"), ("labels", "training")) for x in ("yaml", "json"))
    assert a == b and a["labels"][1]["name"] == "ai"
    for x in ("yaml", "json"):
        with pytest.raises(ValueError, match="models"):
            files.load_config(str(tmp_path / f"c.{x}"), ("labels", "models"))
