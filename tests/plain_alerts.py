"""The rules of alerts, event by event: what windows and streams are held against."""

from __future__ import annotations

from collections.abc import Iterator

from hostlens.sources.rules import Rules


class AgentAlerts:
    """All alerts of an agent's events in arrival order, with running scores and either order of parent and child.

    An alert has the seq of the event that raised it and the time that it is about, a late parent's the child's.
    """

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.emitted: dict[str, float] = {}
        self.processes: dict[int, tuple[str, float]] = {}
        self.waiting: dict[int, list[tuple]] = {}
        self.scores: dict[str, dict] = {}

    def _passes(self, dedup: str, at: float) -> bool:
        if dedup in self.emitted and at - self.emitted[dedup] < self.rules.cooldown:
            return False
        self.emitted[dedup] = at
        return True

    def _score(self, key: str, pid: int, image: str) -> dict:
        return self.scores.setdefault(key, {"pid": pid, "image": image, "detections": 0, "lolbin": False, "parent": False, "unsigned": 0, "ips": set(), "names": set()})

    def _total(self, s: dict) -> int:
        r = self.rules
        return s["detections"] * r.detection + s["parent"] * r.suspicious_parent + s["lolbin"] * r.lolbin + s["unsigned"] * r.unsigned_dll + len(s["ips"]) * r.external_ip + len(s["names"]) * r.dns_query

    def take(self, row: dict) -> Iterator[tuple]:
        out: list[tuple] = []
        kind, key, at, pid = row["kind"], row["pkey"], row["at"], int(row["pid"] or 0)

        def alert(alert_type, rule, severity, mitre, key, pid, image, detail, dedup, score=None, time=at):
            if self._passes(f"{key}|{dedup}", at):
                out.append((int(row["seq"]), alert_type, rule, severity, mitre, key, pid, image, detail, score, time))

        def spawned(parent: str, child: tuple, begun: float) -> None:
            key_, pid_, image_, line_ = child
            self._score(key_, pid_, image_)["parent"] = True
            alert("hunt", "suspicious-parent", "High", "T1204.002", key_, pid_, image_, f"{_base(parent)} spawned {_base(image_)} ({line_})", "suspicious-parent", time=begun)

        if kind == "create":
            score = self._score(key, pid, row["image"])
            base, line = _base(row["image"]), row["line"] or ""
            if base.lower() in self.rules.lolbins:
                score["lolbin"] = True
                alert("hunt", "lolbin", "Medium", "T1218", key, pid, row["image"], f"LOLBin execution: {base} ({line})", "lolbin")
            ppid = int(row["ppid"])
            risky = base.lower() in self.rules.suspicious_children
            if ppid in self.processes:
                image, begun = self.processes[ppid]
                if begun <= at and risky and _base(image).lower() in self.rules.suspicious_parents:
                    spawned(image, (key, pid, row["image"], line), at)
            elif risky:
                self.waiting.setdefault(ppid, []).append((at, (key, pid, row["image"], line)))
            self.processes[pid] = row["image"], at
            if base.lower() in self.rules.suspicious_parents:
                for begun, child in self.waiting.pop(pid, []):
                    if begun >= at:
                        spawned(row["image"], child, begun)
        elif kind == "detection":
            self._score(key, pid, row["image"])["detections"] += 1
            alert("detection", row["value"], row["severity"], row["mitre"], key, pid, row["image"], row["detail"], row["value"])
        elif kind == "unsigned":
            self._score(key, pid, row["image"])["unsigned"] += 1
            alert("hunt", "unsigned-dll", "Low", "T1574.001", key, pid, row["image"], row["detail"], f"unsigned-dll|{row['value']}")
        elif kind == "network" and row["value"] is not None:
            self._score(key, pid, row["image"])["ips"].add(row["value"])
        elif kind == "dns" and row["value"] is not None:
            self._score(key, pid, row["image"])["names"].add(row["value"])
        touched = {a[5] for a in out} | ({key} if kind in ("network", "dns") else set())
        for k in sorted(touched & set(self.scores)):
            total = self._total(self.scores[k])
            if total >= self.rules.threshold:
                alert("score", "score-threshold", "High", None, k, self.scores[k]["pid"], self.scores[k]["image"], f"Process score {total} reached threshold {self.rules.threshold}", "score-threshold", total)
        yield from out


def _base(path: str) -> str:
    return (path or "").replace("/", "\\").rsplit("\\", 1)[-1]
