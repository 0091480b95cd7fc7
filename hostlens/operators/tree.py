"""Process trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.scratch import dropped, written
from . import scan
from .hunt import creations


def edges(events: DataFrame) -> DataFrame:
    """Creations (seq, pid, image, time) with parent_seq: of the creations of their ppid that are not later, the last to arrive.

    A process is not its own parent. The last to arrive is the largest seq so far of the (agent, pid), in a
    scan in segments in which parents stand before the children of their time. Where a row whose ppid is
    its own pid finds itself, the largest before it in that order is the next one.
    """
    rows = written(creations(events), "creations")  # read by both sides, and by the range sort for its bounds
    child = rows.withColumns({"key": F.col("ppid"), "at": F.lit(None).cast("long"), "side": F.lit(1)})
    parent = rows.withColumns({"key": F.col("pid"), "at": F.col("seq"), "side": F.lit(0)})
    found = scan.running(child.unionByName(parent), ["agent_id", "key"], ["event_ts", "side", "seq"], {"last": scan.most(F.col("at")), "other": scan.most(F.col("at"), before=True)})
    columns = ["agent_id", "seq", "event_ts", "pid", "ppid", "pkey", "image_path", "parent_seq"]
    others = found.where("side = 1 AND ppid <> pid").withColumn("parent_seq", F.col("last")).select(columns)
    own = found.where("ppid = pid").groupBy(*columns[:-1]).agg(F.max(F.when(F.col("side") == 1, F.col("last"))).alias("last"), F.max(F.when(F.col("side") == 0, F.col("other"))).alias("other"))
    own = own.withColumn("parent_seq", F.when(F.col("last") != F.col("seq"), F.col("last")).otherwise(F.col("other"))).select(columns)
    return others.unionByName(own)


def latest_instance(events: DataFrame) -> DataFrame:
    """The creation of each (agent, pid) that arrived last."""
    rows = creations(events)
    rest = [c for c in rows.columns if c not in ("agent_id", "pid")]
    last = rows.groupBy("agent_id", "pid").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return last.select("agent_id", "pid", "r.*").select(rows.columns)


def roots_of(events: DataFrame, pid: int | None = None, process_key: str | None = None) -> DataFrame:
    """The last creation of a pid on each agent, or of a process key; one that was never created is an error."""
    rows = creations(events)
    if process_key is not None:
        rest = [c for c in rows.columns if c != "agent_id"]
        last = rows.where(F.col("pkey") == process_key).groupBy("agent_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
        found = last.select("agent_id", "r.*").select(rows.columns)
    else:
        found = latest_instance(events.where(C.event_pid(F.col("data")) == pid))
    if found.isEmpty():
        raise LookupError(f"no process was created with {'key ' + process_key if process_key is not None else f'pid {pid}'}")
    return found


def _links(edge: DataFrame) -> DataFrame:
    return edge.select("seq", "parent_seq")


def descendants(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, seq, pid, ppid, depth) of all processes below the roots (seq), the roots included; cycles end.

    Each process points to its parent, and pointers are doubled: in a round a process takes over where its
    pointer's target points, until it meets a root. So a tree of any depth takes as many rounds as its depth has
    binary digits, each a join of tables that were written, and no row holds a path. Where roots stand below
    roots, the same is done with the roots alone, which are then joined to what is nearest to each.
    """
    marked = roots.select("seq").distinct().withColumn("is_root", F.lit(True))
    links = _links(edge).join(marked, "seq", "left")
    # up: where the pointer leads, dist steps away; a root's own pointer stays for the roots above it.
    start = links.select("seq", F.when(F.col("is_root"), F.col("seq")).otherwise(F.col("parent_seq")).alias("up"), F.when(F.col("is_root"), 0).otherwise(1).alias("dist"), F.coalesce("is_root", F.lit(False)).alias("done"))
    nearest = _jumped(start)
    first = links.where("is_root").select(F.col("seq").alias("below"), "parent_seq").join(nearest.select(F.col("seq").alias("parent_seq"), F.col("up").alias("above"), F.col("dist")), "parent_seq").select("below", "above", (F.col("dist") + 1).alias("dist")).where("below <> above")
    pairs = _closed(first)
    reach = marked.select(F.col("seq").alias("root"), F.col("seq").alias("up"), F.lit(0).alias("more")).unionByName(pairs.select(F.col("above").alias("root"), F.col("below").alias("up"), F.col("dist").alias("more")))
    rows = nearest.join(written(reach, "reach"), "up").select("root", "seq", (F.col("dist") + F.col("more")).alias("depth"))
    return rows.join(edge.select("seq", "pid", "ppid"), "seq").select("root", "seq", "pid", "ppid", "depth")


def _jumped(start: DataFrame) -> DataFrame:
    """Rows (seq, up, dist) of what reaches a done row by its pointers; what reaches none is left out.

    A round that ends no pointer means that none of the rest, twice as far or in a cycle, will end.
    """
    now, ended = written(start.where("up IS NOT NULL"), "pointers"), -1
    while True:
        there = now.select(F.col("seq").alias("up"), F.col("up").alias("next"), F.col("dist").alias("far"), F.col("done").alias("there"))
        open_ = now.where("NOT done").join(there, "up").select("seq", F.col("next").alias("up"), (F.col("dist") + F.col("far")).alias("dist"), F.col("there").alias("done"))
        after = written(now.where("done").unionByName(open_), "pointers")
        counts = after.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        dropped(now)
        now = after
        if counts[1] == 0 or counts[0] == ended:
            return now.where("done").select("seq", "up", "dist")
        ended = counts[0]


def _closed(pairs: DataFrame) -> DataFrame:
    """All (below, above, dist) that steps of `pairs`, of which each `below` has one, lead to; no pair of one with itself.

    Of several ways round a cycle the shortest stays.
    """
    step = written(pairs, "steps")
    all_ = written(step, "reached")
    n = all_.count()
    while n:
        ahead = step.select(F.col("below").alias("above"), F.col("above").alias("on"), F.col("dist").alias("far"))
        further = all_.join(ahead, "above").select("below", F.col("on").alias("above"), (F.col("dist") + F.col("far")).alias("dist"))
        more = all_.unionByName(further).where("below <> above").groupBy("below", "above").agg(F.min("dist").alias("dist"))
        more = written(more, "reached")
        twice = step.join(ahead, "above").select("below", F.col("on").alias("above"), (F.col("dist") + F.col("far")).alias("dist"))
        twice = written(twice, "steps")
        dropped(step, all_)
        step, all_, last = twice, more, n
        n = all_.count()
        if n == last:
            break
    return all_


def ancestors(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """The chain of parents of each root, until one has none, pid 0 or itself as parent, or was met; any depth, by doubled steps."""
    up = edge.where("parent_seq IS NOT NULL AND ppid <> 0 AND ppid <> pid").select(F.col("seq").alias("below"), F.col("parent_seq").alias("above"), F.lit(1).alias("dist"))
    step = written(up, "steps")
    all_ = written(roots.select("seq").distinct().select(F.col("seq").alias("root"), "seq", F.lit(0).alias("depth")), "reached")
    n = all_.count()
    while n:
        further = all_.join(step.withColumnRenamed("below", "seq"), "seq").select("root", F.col("above").alias("seq"), (F.col("depth") + F.col("dist")).alias("depth"))
        more = written(all_.unionByName(further).groupBy("root", "seq").agg(F.min("depth").alias("depth")), "reached")
        ahead = step.select(F.col("below").alias("above"), F.col("above").alias("on"), F.col("dist").alias("far"))
        twice = written(step.join(ahead, "above").select("below", F.col("on").alias("above"), (F.col("dist") + F.col("far")).alias("dist")), "steps")
        dropped(step, all_)
        step, all_, last = twice, more, n
        n = all_.count()
        if n == last:
            break
    dropped(step)
    return all_.join(edge.select("seq", "pid", "ppid"), "seq").select("root", "seq", "pid", "ppid", "depth")


def _tour(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """The Euler tours of the trees: (root, seq, depth, leaves, far, has_children, is_first), a row where the tour enters a process and one where it leaves it.

    far is the number of steps to the end of the root's tour, by doubled pointers: a tree of any depth and size
    takes as many rounds as the tour's length has binary digits. Children go by time, then arrival; the next one
    comes from a scan in segments, so that a process may have any number of them.
    """
    micros = F.coalesce(F.unix_micros(F.col("event_ts").cast("timestamp")), F.lit(-(2**62)))
    at = rows.select("root", "seq", "depth").join(edge.select("seq", "parent_seq", micros.alias("at")), "seq")
    at = at.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent_seq"))).drop("parent_seq")
    at = scan.running(at.withColumns({"late": -F.col("at"), "later": -F.col("seq")}), ["root", "parent"], ["late", "later"], {"next": scan.last(F.col("seq"), before=True)})
    at = written(at.select("root", "seq", "depth", "parent", "at", F.when(F.col("depth") > 0, F.col("next")).alias("next")), "siblings")
    first = at.where("parent IS NOT NULL").groupBy("root", F.col("parent").alias("seq")).agg(F.min_by("seq", F.struct("at", "seq")).alias("child"))
    at = at.join(first, ["root", "seq"], "left").join(first.select("root", F.col("child").alias("seq"), F.lit(True).alias("is_first")), ["root", "seq"], "left")
    at = written(at.withColumn("is_first", F.coalesce("is_first", F.lit(False))), "tour")

    def stop(seq: str, leaves: bool) -> Column:
        return F.struct(F.col("root").alias("root"), F.col(seq).alias("seq"), F.lit(leaves).alias("leaves"))

    ends = F.col("depth") == 0
    enter = at.select(stop("seq", False).alias("seq"), F.coalesce(F.when(F.col("child").isNotNull(), stop("child", False)), stop("seq", True)).alias("up"), F.lit(1).alias("dist"), F.lit(False).alias("done"))
    leave = at.select(stop("seq", True).alias("seq"), F.when(ends, stop("seq", True)).when(F.col("next").isNotNull(), stop("next", False)).otherwise(stop("parent", True)).alias("up"), F.when(ends, 0).otherwise(1).alias("dist"), ends.alias("done"))
    far = _jumped(enter.unionByName(leave)).select("seq.*", F.col("dist").alias("far"))
    return far.join(at.select("root", "seq", "depth", F.col("child").isNotNull().alias("has_children"), "is_first"), ["root", "seq"])


def preorder(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Descendants (root, seq, depth) with their place in their root's tree from 1: a process, then its children's trees by time.

    Where the tour enters a process, it has entered depth + 1 processes more than it has left.
    """
    tour = _tour(rows, edge).where("NOT leaves")
    whole = tour.where("depth = 0").select("root", F.col("far").alias("length"))
    place = ((F.col("length") - F.col("far") + F.col("depth") + 2) / 2).cast("long")
    return tour.join(whole, "root").select("root", "seq", "depth", place.alias("place"))


def as_json(rows: DataFrame, edge: DataFrame, events: DataFrame) -> DataFrame:
    """Trees of descendants as JSON text, (root, json): each process with its facts and, where it has any, its children.

    The text is what the tour says where it enters and leaves each process, sorted and joined; so it is of any
    depth, but a tree's text is one value.
    """
    d = F.col("data")
    time = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    facts = F.to_json(F.struct(d["pid"].alias("pid"), d["ppid"].alias("ppid"), d["image_path"].alias("image_path"), d["command_line"].alias("command_line"), d["user"].alias("user"), time.alias("timestamp"), F.col("process_context.process_key").alias("process_key")))
    told = events.where(d["type"] == "ProcessCreate").select("seq", F.regexp_replace(facts, r"\}$", "").alias("facts"))
    tour = _tour(rows, edge).join(told, "seq")
    comma = F.when(F.col("is_first") | (F.col("depth") == 0), "").otherwise(",")
    enters = F.concat(comma, "facts", F.when(F.col("has_children"), ',"children":[').otherwise(""))
    text = F.when(~F.col("leaves"), enters).when(F.col("has_children"), "]}").otherwise("}")
    said = tour.groupBy("root").agg(F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("at"), text.alias("text")))).alias("said"))
    return said.select("root", F.array_join(F.transform("said", lambda x: x["text"]), "").alias("json"))
