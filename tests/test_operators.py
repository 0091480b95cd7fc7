"""Behaviour on small event files, written and read as JSON lines."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlens.operators import arrival, explain, filters, hunt, iocs, replay, score, stats, tree
from hostlens.sources import index, jsonl, sinks
from hostlens.sources.rules import Rules, load_rules
from hostlens.streaming import jobs

START = datetime(2026, 3, 13, 10)


def event(number, minute, data, key=None, image=None, source="Sensor", category="Process", severity="Info", rule=None):
    out = {"id": f"{number:08x}-0000-0000-0000-000000000000", "timestamp": (START + timedelta(minutes=minute)).isoformat() + "Z", "hostname": "T", "agent_id": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "sensor_version": "1", "source": source, "category": category, "severity": severity, "data": data}
    if key:
        out["process_context"] = {"process_key": key} | ({"image_path": image} if image else {})
    if rule:
        out["rule"] = {"id": rule, "name": "n", "description": "d", "mitre": {"tactic": "t", "technique_id": "T1", "technique_name": "x"}, "confidence": "High", "evidence": []}
    return out


def create(number, minute, pid, ppid, image, key=None, line="cmd", time=None):
    return event(number, minute, {"type": "ProcessCreate", "pid": pid, "ppid": ppid, "image_path": image, "command_line": line, "user": "u", "integrity_level": "m", "hashes": None, "create_time": time}, key)


def network(number, minute, pid, dst, key=None, image=None):
    return event(number, minute, {"type": "NetworkConnect", "pid": pid, "image_path": "C:\\a\\n.exe", "protocol": "TCP", "src_addr": "10.0.0.1", "src_port": 1, "dst_addr": dst, "dst_port": 443, "direction": "Outbound"}, key, image, {"Etw": {"provider": "Microsoft-Windows-Kernel-Network"}}, "Network")


def evasion(number, minute, pid, rule="R-1", key=None, technique="EtwPatching"):
    return event(number, minute, {"type": "EvasionDetected", "technique": technique, "pid": pid, "process_name": "p.exe", "details": "d"}, key, None, "EvasionDetector", "Evasion", "High", rule)


def load(number, minute, pid, name, signed, key=None):
    return event(number, minute, {"type": "ImageLoad", "pid": pid, "image_path": f"C:\\l\\{name}", "image_name": name, "signed": signed, "signature": None, "hashes": "MD5=1, SHA1=2"}, key, None, {"Sysmon": {"event_id": 7}}, "ImageLoad")


@pytest.fixture
def events(spark, tmp_path):
    made = []

    def of(rows, extra=()):
        path = tmp_path / f"e{len(made)}.jsonl"
        made.append(path)
        path.write_text("\n".join([json.dumps(r) for r in rows] + list(extra)) + "\n")
        read = jsonl.read_events(spark, str(path))
        # One file of one split: the line's number is the order of arrival.
        return read.withColumn("seq", F.col("seq.line")).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))

    return of


def test_malformed_lines_are_skipped(events):
    good = create(1, 0, 4, 1, "a.exe")
    bad = [json.dumps(x) for x in ({**good, "id": "zz"}, {**good, "severity": "Grave"}, {**good, "timestamp": "today"}, {**good, "data": {**good["data"], "pid": -1}}, {**good, "data": {**good["data"], "pid": 2**32}}, {**good, "data": {k: v for k, v in good["data"].items() if k != "user"}}, {**good, "data": {**good["data"], "type": "Other"}}, {**good, "source": "Elsewhere"})]
    rows = events([good, {**good, "unknown": 1}], ["", "{", "[]", "null", *bad]).collect()
    assert len(rows) == 2 and rows[0].data.pid == 4
    with pytest.raises(Exception):
        events([]).sparkSession.read.text("/nowhere/at/all").count()


def test_old_rows_without_newer_fields(events):
    e = create(1, 0, 4, 1, "a.exe")
    del e["data"]["create_time"], e["data"]["hashes"]
    assert events([e]).count() == 1


def test_pid_reuse_keeps_processes_apart(events):
    rows = events([network(1, 0, 7, "1.1.1.1", "7:1"), network(2, 1, 7, "1.1.1.1", "7:2", "second.exe"), network(3, 2, 7, "1.1.1.1", "7:2"), network(4, 3, 7, "1.1.1.1")])
    got = {r.pkey: (r.pid, r.image, r.n) for r in stats.top_processes(rows).collect()}
    assert got == {"7:1": (7, None, 1), "7:2": (7, "second.exe", 2), "pid:7": (7, None, 1)}


def test_empty_input(events, spark):
    none = events([])
    assert stats.totals(none).first().total_events == 0 and stats.totals(none).first().earliest is None
    for rows in (hunt.hunt(none), score.scores(none), iocs.indicators(none), tree.edges(none), arrival.enriched(none), arrival.backtest(none), stats.by_category(none)):
        assert rows.count() == 0


def test_filters(events):
    rows = events([network(1, 0, 7, "1.1.1.1", "7:1"), evasion(2, 1, 8), load(3, 2, 9, "x.dll", False)])
    ids = lambda **c: [r.id[:8] for r in filters.query(rows, **c).collect()]
    assert ids(pid=8) == ["00000002"] and ids(process_key="7:1") == ["00000001"] and ids(category="imageload") == ["00000003"]
    assert ids(rule="R-1") == ["00000002"] and ids(severity="HIGH") == ["00000002"]
    assert ids(source="etw") == ["00000001"] == ids(source="kernel-NET") and ids(source="sysmon") == ["00000003"] and ids(source="EvasionDetector") == ["00000002"] and ids(source="sensor") == []
    assert ids(contains="c:\\l\\X.dll") == ["00000003"]
    assert ids(since="2026-03-13 10:01:00", until="2026-03-13 10:01:00") == ["00000002"] and ids(limit=2) == ["00000001", "00000002"]
    assert filters.find_by_id(rows, "00000002").first().data.pid == 8
    with pytest.raises(LookupError, match="several"):
        filters.find_by_id(rows, "0000")
    with pytest.raises(LookupError, match="no event"):
        filters.find_by_id(rows, "f")


def test_provider_names(spark):
    from hostlens.sources.normalise import provider_name

    rows = spark.createDataFrame([("{22FB2CD6-0e7b-422b-a0c7-2fad1fd0e716}",), ("f4e1897c-bb5d-5668-f1d8-040f4d8dd344",), ("0",)], "g string")
    assert [r[0] for r in rows.select(provider_name(F.col("g"))).collect()] == ["Microsoft-Windows-Kernel-Process", "Microsoft-Windows-Threat-Intelligence", "Unknown"]


def test_a_waiting_child_outlasts_a_harmless_process(events):
    rows = events([create(1, 9, 20, 10, "cmd.exe", "20:1"), create(2, 3, 10, 1, "notepad.exe"), create(3, 4, 10, 1, "winword.exe")])
    got = arrival.backtest(rows, order="seq").collect()
    assert [(r.rule, r.pkey) for r in got] == [("suspicious-parent", "20:1")]
    assert got[0].at == (START + timedelta(minutes=9) - datetime(1970, 1, 1)).total_seconds()


def test_hunt_rules(events):
    rows = events([create(2, 5, 20, 10, "C:\\w\\CMD.exe", "20:1"), create(1, 0, 10, 1, "C:\\o\\WINWORD.EXE"), create(3, 6, 30, 99, "certutil.exe"), load(4, 7, 30, "bad.dll", False), load(5, 7, 30, "ok.dll", True), *[network(6 + i, 8, 20, "8.8.8.8", "20:1") for i in range(3)], network(20, 9, 20, "10.0.0.1")])
    found = hunt.hunt(rows, Rules(beaconing_threshold=3)).collect()
    assert [(r.rule, r.severity, r.pid) for r in found] == [("suspicious-parent", "High", 20), ("lolbin", "Medium", 30), ("beaconing", "Medium", 20), ("unsigned-dll", "Low", 30)]
    assert found[0].detail == "WINWORD.EXE spawned CMD.exe (cmd)" and found[2].detail == "3 connections to 8.8.8.8 from n.exe"
    assert hunt.hunt(rows, only=("lolbin",)).count() == 1
    with pytest.raises(ValueError):
        hunt.hunt(rows, only=("other",))
    assert hunt.hunt(rows, load_rules("[rules.hunt]\nlolbins = ['CMD.EXE']\nbeaconing_threshold = 99\n"), only=("lolbin", "beaconing")).first().pid == 20


def test_scores(events):
    rows = events([evasion(1, 0, 5, key="5:1"), network(2, 1, 5, "8.8.8.8", "5:1"), network(3, 1, 5, "8.8.8.8", "5:1"), network(4, 1, 5, "9.9.9.9", "5:1"), load(5, 2, 6, "x.dll", False), network(6, 3, 7, "10.0.0.1"), evasion(7, 4, None)])
    got = {r.pkey: r.score for r in score.scores(rows).collect()}
    assert got == {"5:1": 44, "pid:6": 5, "pid:0": 40}
    assert score.scores(rows, load_rules("[rules.score]\ndetection = 1\n")).where("pkey = '5:1'").first().score == 5


def test_tree(events):
    rows = events([create(1, 0, 1, 0, "a"), create(2, 1, 2, 1, "b"), create(3, 2, 3, 2, "c"), create(4, 3, 2, 1, "d"), create(5, 4, 4, 2, "e"), create(6, 5, 6, 6, "f"), create(7, 6, 9, 77, "g")])
    edge = tree.edges(rows).cache()
    by = {r.seq: r.parent_seq for r in edge.collect()}
    first = min(by)
    assert {k - first: None if v is None else v - first for k, v in by.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: None, 6: None}
    down = tree.descendants(edge, edge.where("pid = 1").select("seq"))
    assert sorted((r.pid, r.depth) for r in down.collect()) == [(1, 0), (2, 1), (2, 1), (3, 2), (4, 2)]
    up = tree.ancestors(edge, edge.where("pid = 4").select("seq"))
    assert [r.pid for r in up.orderBy("depth").collect()] == [4, 2, 1]
    made = json.loads(tree.as_json(down, edge, rows).first().json)
    assert [c["image_path"] for c in made["children"]] == ["b", "d"] and made["children"][1]["children"][0]["pid"] == 4
    assert "children" not in made["children"][0]["children"][0] and made["ppid"] == 0 and made["timestamp"].startswith("2026-03-13T10:00:00")
    assert {r.pid: r.seq - first for r in tree.latest_instance(rows).collect()}[2] == 3


def test_mutual_parents_end(events):
    edge = tree.edges(events([create(1, 0, 1, 2, "a"), create(2, 0, 2, 1, "b")])).cache()
    assert tree.descendants(edge, edge.where("pid = 1").select("seq")).count() == 2
    assert tree.ancestors(edge, edge.where("pid = 1").select("seq")).count() == 2


def test_iocs(events):
    dns = lambda n, name, answer: event(n, n, {"type": "DnsQuery", "pid": 1, "query_name": name, "query_type": "A", "response": answer}, category="Dns")
    rows = events([network(1, 3, 1, "8.8.8.8"), network(2, 1, 1, "8.8.8.8"), dns(4, "h.io", "8.8.8.8; 10.0.0.1;9.9.9.0"), dns(5, "", "7.7.7.7"), dns(6, "h.io", None), load(7, 7, 1, "x.dll", True)])
    got = {(r.kind, r.value): (r.n, r.sources) for r in iocs.indicators(rows).collect()}
    assert got == {("ip", "8.8.8.8"): (3, "DNS/h.io,n.exe"), ("ip", "9.9.9.0"): (1, "DNS/h.io"), ("domain", "h.io"): (2, "DnsQuery"), ("hash", "MD5=1"): (1, "x.dll"), ("hash", "SHA1=2"): (1, "x.dll")}
    with pytest.raises(ValueError):
        iocs.indicators(rows, "mail")


def test_around_an_event(events):
    script = lambda n, m, key=None: event(n, m, {"type": "ScriptBlock", "pid": 5, "script_engine": "PS", "content": "x"}, key, category="Script")
    rows = events([network(1, 0, 5, "1.1.1.1", "5:1"), evasion(2, 4, 5, key="5:1", technique="AmsiBypass"), script(3, 5, "5:1"), network(4, 10, 5, "1.1.1.1", "5:1"), network(5, 4, 5, "1.1.1.1", "5:2"), evasion(6, 4, 5), create(7, 4, 5, 1, "x")])
    pick = lambda n: filters.find_by_id(rows, f"{n:08x}")
    ids = lambda r: sorted(int(x.id[:8], 16) for x in r.collect())
    assert ids(explain.timeline(rows, pick(2))) == [1, 2, 3]
    assert ids(explain.timeline(rows, pick(6))) == [1, 2, 3, 5, 6]
    assert ids(explain.related(rows, pick(2))) == [1, 3] and ids(explain.related(rows, pick(6))) == []
    assert ids(explain.script_activity(rows, pick(2))) == [3] and ids(explain.script_activity(rows, pick(1))) == []
    assert explain.script_counts(explain.script_activity(rows, pick(2))).first()[:] == (1, 0, 0)
    assert explain.manifest(rows, pick(2)).first().event_count == 3


def test_replay(events):
    rows = events([network(1, 5, 1, "x"), network(2, 0, 1, "x")])
    assert [r.gap_us for r in replay.replay_gaps(rows, 2.0).orderBy("event_ts").collect()] == [None, 150_000_000]
    with pytest.raises(ValueError):
        replay.replay_gaps(rows, -1)


def test_enrichment_priority(events):
    end = lambda n, pid, time=None: event(n, n, {"type": "ProcessTerminate", "pid": pid, "image_path": "a", "create_time": time})
    rows = [create(1, 0, 5, 1, "strong.exe", time=42), create(2, 0, 5, 1, "weak.exe"), network(3, 0, 5, "x"), end(4, 5), end(5, 5, 41), network(6, 0, 5, "x"), end(7, 5, 42), network(8, 0, 5, "x"), create(9, 0, 5, 1, "weak.exe"), create(10, 0, 5, 1, "new.exe", time=50), network(11, 0, 5, "x"), network(12, 0, 6, "x")]
    read = events(rows)
    first = read.agg(F.min("seq")).first()[0]
    got = {r.seq - first + 1: (r.context_key, r.context_image) for r in arrival.enriched(read).collect()}
    assert got == {1: ("5:42", None), 2: ("5:42", None), 3: ("5:42", "strong.exe"), 4: (None, None), 5: (None, None), 6: ("5:42", "strong.exe"), 7: ("5:42", "strong.exe"), 8: (None, None), 9: ("5:0", None), 10: ("5:50", None), 11: ("5:50", "new.exe"), 12: (None, None)}


def test_alerts_in_either_order_and_cooldown(events):
    rows = events([create(1, 5, 20, 10, "cmd.exe", "20:1"), create(2, 4, 10, 1, "winword.exe"), create(3, 5, 21, 10, "cmd.exe", "21:1"), evasion(4, 6, 7, key="7:1"), evasion(5, 8, 7, key="7:1"), evasion(6, 12, 7, key="7:1"), create(7, 13, 30, 40, "cmd.exe"), create(8, 14, 40, 1, "excel.exe")])
    for order in ("seq", "at"):
        got = [(r.rule, r.pkey) for r in arrival.backtest(rows, order=order).orderBy("seq").collect()]
        assert sorted(got) == sorted([("suspicious-parent", "20:1"), ("suspicious-parent", "21:1"), ("R-1", "7:1"), ("R-1", "7:1"), ("score-threshold", "7:1"), ("score-threshold", "7:1")])
    alerts = arrival.alert_candidates(rows)
    assert arrival.cooled(alerts.where("rule = 'R-1'"), 300).count() == 2
    assert arrival.cooled(alerts.where("rule = 'R-1'"), 121).count() == 2 and arrival.cooled(alerts.where("rule = 'R-1'"), 60).count() == 3


def test_stream_equals_backtest(spark, events, tmp_path):
    rows = events([create(1, 5, 20, 10, "cmd.exe", "20:1"), create(2, 4, 10, 1, "winword.exe"), evasion(3, 6, 7, key="7:1"), evasion(4, 7, 7, key="7:1"), load(5, 8, 20, "x.dll", False, "20:1")])
    want = sorted(tuple(r) for r in arrival.backtest(rows, order="seq").collect())
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in jobs.run_to_end(jobs.stream_alerts(stream), "t").collect())
    assert got == want and len(got) == 4
    seen = jobs.run_to_end(jobs.tail(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), category="evasion").select("id"), "t")
    assert seen.count() == 2


def test_lines_round_trip(spark, events, tmp_path):
    rows = [create(1, 0, 4, 1, "C:\\a \"q\"\\é/x.exe"), network(2, 1, 5, "1.1.1.1", "5:1"), evasion(3, 2, 6), load(4, 3, 7, "x.dll", True)]
    read = events(rows)
    jsonl.write_lines(read, str(tmp_path / "out"), 700)
    back = jsonl.read_events(spark, str(tmp_path / "out"))
    same = lambda r: sorted((x.id, x.source, x.data, x.rule, x.process_context, x.severity) for x in r.collect())
    assert [x[:2] for x in same(back)] == [x[:2] for x in same(read)] and back.count() == 4
    assert {x.data.image_path for x in back.collect()} == {x.data.image_path for x in read.collect()}


def test_index(spark, events, tmp_path):
    rows = events([network(1, 0, 5, "x", "5:1"), network(2, 1, 5, "x", "5:1"), network(2, 9, 6, "x")])
    path = str(tmp_path / "index")
    assert index.indexed_or_scanned(spark, path, rows).count() == 2
    index.rebuild(rows, path)
    index.update(events([network(2, 1, 5, "x"), network(3, 2, 5, "x", "5:1")]), path)
    table = spark.read.parquet(path)
    assert index.status(table).first().events == 3
    assert index.lookup(table, "2026-03-13 10:00:00", "2026-03-13 10:01:00", process_key="5:1").count() == 2


def test_index_is_used_where_it_can_be_read(spark, events, tmp_path):
    rows = events([network(1, 0, 5, "x", "5:1"), network(2, 1, 5, "x", "5:1"), network(3, 9, 6, "x")])
    source, path = str(tmp_path / "lines"), str(tmp_path / "index")
    jsonl.write_lines(rows, source)
    find = lambda: [r.event_id[:8] for r in index.find(spark, path, rows, "2026-03-13 10:00:00", "2026-03-13 10:05:00", pid=5).collect()]
    assert find() == ["00000001", "00000002"]
    index.rebuild(rows, path, source)
    size = sum(p.stat().st_size for p in (tmp_path / "lines").rglob("events.jsonl.*"))
    assert tuple(index.coverage(spark, path, source).first()) == (size, size, True) and find() == ["00000001", "00000002"]
    jsonl.write_lines(rows.limit(1), source)
    now = index.coverage(spark, path, source).first()
    assert now.covered_bytes == size < now.source_bytes and not now.is_current
    index.update(rows, path, source)
    assert index.coverage(spark, path, source).first().is_current and spark.read.parquet(path).count() == 3
    for part in (tmp_path / "index").rglob("part-*.parquet"):
        part.write_bytes(b"broken")
    assert find() == ["00000001", "00000002"]


def test_alerts_are_posted_one_by_one(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((self.headers["Authorization"], body["seq"]))
            self.send_response(500 if body["seq"] == 2 else 200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    spark.range(5).withColumnRenamed("id", "seq").repartition(2).write.parquet(str(tmp_path / "in"))
    alerts = spark.readStream.schema("seq long").parquet(str(tmp_path / "in"))
    query = jobs.follow_alerts(alerts, f"http://127.0.0.1:{server.server_port}", str(tmp_path / "c"), to_end=True, token="t")
    query.awaitTermination()
    server.shutdown()
    assert sorted(got) == [("Bearer t", n) for n in range(5)]


def test_http_and_dead_letters(spark):
    lines = spark.range(250).select(F.col("id").alias("seq"), F.concat(F.lit("{"), "id", F.lit("}")).alias("value"))
    batches = sinks.http_batches(lines)
    got = {r.batch: (r.n, r.body[:4]) for r in batches.collect()}
    assert got == {0: (100, "[{0}"), 1: (100, "[{10"), 2: (50, "[{20")}

    def send(url, data, head):
        if head.get("X") != "1":
            raise OSError
        import gzip

        if b"{0}" in gzip.decompress(data):
            raise OSError

    sent = {r.batch: (r.sent, r.attempts) for r in sinks.post_batches(batches, "http://x", headers={"X": "1"}, retries=2, backoff=0, send=send).collect()}
    assert sent == {0: (False, 3), 1: (True, 1), 2: (True, 1)}
    failed = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([4, 5, 3, 2])], "batch long, body string")
    assert [(r.batch, r.used) for r in sinks.dead_letters(failed, 9).orderBy("batch").collect()] == [(0, 4), (1, 9)]
    assert [r.batch for r in sinks.dead_letters(failed, 8).orderBy("batch").collect()] == [0, 2]


def test_delivery_and_redrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("".join('{"n":%d}\n' % i for i in range(7)))
    log = tmp_path / "log"

    def send(url, data, head):
        if b'"n":0}' in data and url == "http://down":
            raise OSError
        with log.open("ab") as out:
            out.write(data + b"\n")

    dead = str(tmp_path / "dead")
    assert jobs.dead_letter_table(spark, dead) is None
    jobs.deliver(spark.readStream.text(str(tmp_path / "in")), "http://down", dead, str(tmp_path / "c"), size=3, compress=False, retries=0, send=send).awaitTermination()
    table = jobs.dead_letter_table(spark, dead)
    assert [json.loads(r.body) for r in table.collect()] == [[{"n": 0}, {"n": 1}, {"n": 2}]]
    assert sum(len(json.loads(x)) for x in log.read_text().splitlines()) == 4
    assert [r.sent for r in jobs.redrive(table, "http://down", compress=False, retries=0, send=send).collect()] == [False]
    assert [r.sent for r in jobs.redrive(table, "http://up", compress=False, retries=0, send=send).collect()] == [True]
