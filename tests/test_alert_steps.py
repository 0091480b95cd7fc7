"""The steps of a stream's alerts without Spark: a call takes a bucket of many keys, whose entries do not mix."""

import pandas as pd

from hostlens.sources.rules import Rules
from hostlens.streaming import alerts


class Entries(dict):
    getValue, updateValue, containsKey, removeKey = dict.get, dict.__setitem__, dict.__contains__, dict.pop


class Handle:
    def getMapState(self, name, key, value, ttlDurationMs=None):
        return Entries()


def run(step, batches):
    step.init(Handle())
    return [sorted(f.astype(object).itertuples(index=False, name=None)) for b in batches for f in step.handleInputRows((0,), iter([b]), None)]


def each(make, batches, key):
    """What steps give that see one key each."""
    keys = sorted({k for b in batches for k in b[key]})
    alone = [run(make(), [b[b[key] == k] for b in batches]) for k in keys]
    return [sorted(row for a in alone for row in a[i]) for i in range(len(batches))]


def test_a_call_takes_a_bucket_of_keys():
    spawn = lambda *rows: pd.DataFrame(rows, columns=["agent_id", "key", "seq", "side", "at", "bad", "pkey", "pid", "image", "base", "line"])
    parent = lambda key, seq, bad: (1, key, seq, 1, float(seq), bad, f"{key}:1", key, "p", "winword.exe", "")
    child = lambda key, seq: (1, key, seq, 0, float(seq), False, f"{seq}:1", seq, "c", "cmd.exe", "x")
    batches = [spawn(child(7, 11), child(8, 2), parent(9, 3, True), child(9, 4), child(7, 5)), spawn(parent(7, 6, True), parent(8, 1, True), child(7, 9), parent(9, 8, False), child(9, 10))]
    family = lambda: alerts.Families("agent_id long, key long", "agent_id long, " + alerts._SPAWNED, 0)
    got = run(family(), batches)
    assert got == each(family, batches, "key") and [[r[1] for r in b] for b in got] == [[4], [1, 6, 9]]

    names = ["agent_id", "dedup", *alerts._names(alerts._ALERT)[:-1]]
    alert = lambda dedup, seq, at: (1, dedup, dedup, seq, 0, at, at, "hunt", "r", "Low", "T", 1, "i", "d", False)
    batches = [pd.DataFrame([alert("a", 1, 0.0), alert("b", 2, 1.0), alert("a", 3, 5.0), alert("b", 4, 90.0)], columns=names), pd.DataFrame([alert("b", 5, 95.0), alert("a", 6, 61.0)], columns=names)]
    cooldown = lambda: alerts.Cooldowns("agent_id long, dedup string", 60.0, "agent_id long, " + alerts._ALERT, 0)
    got = run(cooldown(), batches)
    assert got == each(cooldown, batches, "dedup") and [sorted(r[2] for r in b) for b in got] == [[1, 2, 4], [6]]

    names = ["agent_id", "pkey", "seq", "at", "side", "ord", "kind", "value", "pid", "image", "passed", "alert_type", "rule", "severity", "mitre", "detail", "about"]
    mark = lambda pkey, seq, kind, value: (1, pkey, seq, float(seq), 0, 0, kind, value, 1, "i", None, None, None, None, None, None, None)
    batches = [pd.DataFrame([mark("a", 1, "network", "8.8.8.8"), mark("b", 2, "network", "8.8.8.8"), mark("b", 3, "dns", "x")], columns=names), pd.DataFrame([mark("a", 4, "network", "8.8.8.8"), mark("b", 5, "dns", "y")], columns=names)]
    score = lambda: alerts.Scores("agent_id long, pkey string", Rules(threshold=1, cooldown=0, external_ip=3, dns_query=1), 0)
    step = score()
    step.init(Handle())
    got = [[(r.pkey, r.score) for f in step.handleInputRows((0,), iter([b]), None) for r in f.itertuples()] for b in batches]
    assert got == [[("a", 3), ("b", 3), ("b", 4)], [("a", 3), ("b", 5)]]
