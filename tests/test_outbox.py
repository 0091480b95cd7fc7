"""Alerts are posted once, whatever runs again, and failures can be sent again."""

import pytest

from hostlens.streaming import jobs, outbox


class Webhook:
    """Appends what it gets to a file, and fails for some numbers."""

    def __init__(self, path, fails=()):
        self.path, self.fails = str(path), tuple(fails)

    def __call__(self, alerts):
        for alert in alerts:
            if alert["n"] in self.fails:
                raise OSError("down")
            with open(self.path, "a") as f:
                f.write(f"{alert['n']} {alert['alert_id']}\n")

    def got(self):
        with open(self.path) as f:
            return [line.split() for line in f]


def test_a_micro_batch_that_runs_twice_posts_once(spark, tmp_path):
    hook, place = Webhook(tmp_path / "got"), str(tmp_path / "outbox")
    rows = spark.range(300).selectExpr("id AS n", "id % 7 AS kind").repartition(3)
    outbox.post_once(rows, 4, hook, place)
    outbox.post_once(rows, 4, hook, place)
    assert sorted(int(n) for n, _ in hook.got()) == list(range(300))
    outbox.post_once(rows.limit(5), 5, hook, place)
    assert len(hook.got()) == 305, "another micro-batch is another matter"


def test_equal_alerts_are_each_posted(spark, tmp_path):
    hook, place = Webhook(tmp_path / "got"), str(tmp_path / "outbox")
    rows = spark.createDataFrame([(1,), (1,), (2,), (1,)], "n long")
    for _ in range(2):
        outbox.post_once(rows, 0, hook, place)
    assert sorted(int(n) for n, _ in hook.got()) == [1, 1, 1, 2] and len({i for _, i in hook.got()}) == 4


def test_what_a_lost_run_has_recorded_is_not_posted_again(spark, tmp_path, monkeypatch):
    """A run that ends in the middle: the chunks before are recorded, the rest is posted by the next."""
    monkeypatch.setattr(outbox, "CHUNK", 10)
    hook, place = Webhook(tmp_path / "got"), str(tmp_path / "outbox")
    rows = spark.range(35).withColumnRenamed("id", "n").coalesce(1)

    class Ends(Webhook):
        def __call__(self, alerts):
            if len(self.got() if (tmp_path / "got").exists() else []) == 20:
                raise KeyboardInterrupt
            super().__call__(alerts)

    send = outbox._sender(Ends(tmp_path / "got"), place)
    with pytest.raises(KeyboardInterrupt):
        send(outbox.identified(rows).withColumn("outbox_batch", outbox.F.lit(0)).collect())
    assert outbox.records(spark, place, 0).count() == 20
    outbox.post_once(rows, 0, hook, place)
    assert sorted(int(n) for n, _ in hook.got()) == list(range(35))


def test_failures_are_sent_again(spark, tmp_path):
    place = str(tmp_path / "outbox")
    rows = spark.range(20).withColumnRenamed("id", "n")
    outbox.post_once(rows, 0, Webhook(tmp_path / "got", range(0, 20, 4)), place)
    assert outbox.states(outbox.records(spark, place)).where("NOT sent").count() == 5
    hook = Webhook(tmp_path / "got")
    outbox.resend(spark, hook, place)
    outbox.resend(spark, hook, place)
    assert sorted(int(n) for n, _ in hook.got()) == list(range(20))
    got = {r.id: (r.sent, r.attempts) for r in outbox.states(outbox.records(spark, place)).collect()}
    assert all(sent for sent, _ in got.values()) and sorted(a for _, a in got.values()) == [1] * 15 + [2] * 5


def test_a_stream_with_an_outbox(spark, tmp_path):
    spark.range(12).withColumnRenamed("id", "n").write.parquet(str(tmp_path / "in"))
    hook = Webhook(tmp_path / "got")
    for _ in range(2):
        stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
        jobs.follow_alerts(stream, hook, str(tmp_path / "check"), to_end=True).awaitTermination()
    assert sorted(int(n) for n, _ in hook.got()) == list(range(12))
    assert outbox.records(spark, str(tmp_path / "check-outbox")).where("sent").count() == 12
    assert outbox.records(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_task_leaves_few_files(spark, tmp_path, monkeypatch):
    hook, place = Webhook(tmp_path / "got"), tmp_path / "outbox"
    rows = [outbox.Row(outbox_batch=i % 2, alert_id=f"a{i}", n=i) for i in range(1000)]
    outbox._sender(hook, str(place))(rows)
    assert len(list(place.rglob("*.json"))) == 2, "one for each micro-batch"
    monkeypatch.setattr(outbox, "MERGED", 20_000)
    outbox._sender(hook, str(place))(rows)
    assert 4 < len(list(place.rglob("*.json"))) < 30
    assert not list((place / outbox.OPEN).iterdir())
    assert {(r.attempts, r.sent) for r in outbox.states(outbox.records(spark, str(place))).collect()} == {(2, True)}
    assert outbox.records(spark, str(place), 1).count() == 1000


def test_chunks_that_are_both_merged_and_open_are_one_attempt(spark, tmp_path, monkeypatch):
    place = tmp_path / "outbox"
    real = outbox.fs.FileSystem.from_uri

    class Lost:
        """A file system on which a task is lost before it deletes."""

        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def delete_dir(self, path):
            raise KeyboardInterrupt

    class From:
        @staticmethod
        def from_uri(uri):
            system, root = real(uri)
            return Lost(system), root

    rows = [outbox.Row(outbox_batch=0, alert_id=f"a{i}", n=i) for i in range(120)]
    with monkeypatch.context() as m:
        m.setattr(outbox.fs, "FileSystem", From)
        with pytest.raises(KeyboardInterrupt):
            outbox._sender(Webhook(tmp_path / "got"), str(place))(rows)
    assert outbox.records(spark, str(place), 0).count() == 240
    assert [(r.attempts, r.sent) for r in outbox.states(outbox.records(spark, str(place), 0)).collect()] == [(1, True)] * 120
