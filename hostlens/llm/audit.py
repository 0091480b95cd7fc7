"""Filter interaction audit with decision diagrams.

Each document has a mask of the filters that it fails; Spark counts the masks of each part. A part's
counts are a decision diagram: a level for each filter, two children of a node (passes, fails), leaves
that are counts, and equal nodes shared. A node's weight is the sum of the leaves under it, so in an
order of the filters the path on which all pass gives what each step keeps and removes. The diagrams of
all orders come out of one by swaps of neighbouring levels, each of which makes one level anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Weight = tuple[int, int, int]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure conditions by letter, of a text that is not null and its words.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that a text identical to one of a smaller doc_id fails.
DUPLICATE = "E"
COUNTS = ("n", "good", "toxic")


def masks(docs: DataFrame, labels: DataFrame, conditions: dict[str, Callable[[Column, Column], Column]] = CONDITIONS, part: str = "lang") -> DataFrame:
    """Counts (part, mask, n, good, toxic) of documents by the filters that they fail, a bit for each condition in turn and the last for copies.

    Copies are found by SHA-256 of the text, summed up by text, part and mask before they meet, so a text
    of very many copies is a few rows. A document with the smallest doc_id of its text is no copy; one
    without a doc_id neither is nor makes one.
    """
    text = F.coalesce("text", F.lit(""))
    known = labels.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("words", _words(F.col("text")))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(conditions.values())]
    mask = F.lit(0)
    for bit in bits:
        mask = mask + bit
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.when(F.col("doc_id").isNotNull(), F.sha2("text", 256)).alias("sha"))
    rows = rows.groupBy("doc_id", "part", "mask", "sha").agg(F.count("*").alias("n"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "mask", "sha", "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS[1:]])
    texts = rows.groupBy("sha", "part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min(F.struct("doc_id", *COUNTS)).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("sha"))
    passes = F.when(F.col("sha").isNull(), F.struct(*COUNTS)).when(F.col("first.doc_id") == smallest, F.struct(*[F.col(f"first.{c}").alias(c) for c in COUNTS])).otherwise(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]))
    texts = texts.withColumn("passes", passes)
    own = F.struct("mask", *[F.col(f"passes.{c}").alias(c) for c in COUNTS])
    copies = F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), *[(F.col(c) - F.col(f"passes.{c}")).alias(c) for c in COUNTS])
    both = texts.select("part", F.explode(F.array(own, copies)).alias("x")).select("part", "x.*").where("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


class Diagram:
    """A count-weighted decision diagram; levels[i] has the children (passes, fails) of each node of level i."""

    def __init__(self, names: str, counts: dict[int, Weight]):
        self.order = list(names)
        self.weight: list[Weight] = []
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in names]
        leaves: dict[Weight, int] = {}
        shared: list[dict[tuple[int, int], int]] = [{} for _ in names]

        def build(level: int, mask: int) -> int:
            if level == len(names):
                weight = counts.get(mask, (0, 0, 0))
                if weight not in leaves:
                    leaves[weight] = self._node(weight)
                return leaves[weight]
            return self._shared(level, build(level + 1, mask), build(level + 1, mask | 1 << level), shared[level])

        self.root = build(0, 0)

    def _node(self, weight: Weight) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _shared(self, level: int, passes: int, fails: int, known: dict[tuple[int, int], int]) -> int:
        """The node of a level with these children, made if there is none."""
        if (passes, fails) not in known:
            a, b = self.weight[passes], self.weight[fails]
            node = known[passes, fails] = self._node((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            self.levels[level][node] = passes, fails
        return known[passes, fails]

    def swap(self, i: int) -> None:
        """Swaps levels i and i + 1: nodes of level i stay, with new children of which equal ones are one."""
        below, self.levels[i + 1], known = self.levels[i + 1], {}, {}
        for node, (passes, fails) in self.levels[i].items():
            (pp, pf), (fp, ff) = below[passes], below[fails]
            self.levels[i][node] = self._shared(i + 1, pp, fp, known), self._shared(i + 1, pf, ff, known)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """(filter, kept, removed) along the path on which all pass."""
        node = self.root
        for name, level in zip(self.order, self.levels):
            node, fails = level[node]
            yield name, self.weight[node], self.weight[fails]


def neighbour_swaps(n: int) -> list[int]:
    """Swaps of places i and i + 1 that go through all orders of n things, each once."""
    if n < 2:
        return []
    out, to_left = [], list(range(n - 2, -1, -1))
    for k, inner in enumerate([*neighbour_swaps(n - 1), None]):
        out += to_left[::-1] if k % 2 else to_left
        if inner is not None:
            out.append(inner if k % 2 else inner + 1)
    return out


def audit_part(names: str, counts: dict[int, Weight]) -> pd.DataFrame:
    """All orders and steps of one part."""
    diagram, rows = Diagram(names, counts), []
    fails, alone, shapley = {}, {}, dict.fromkeys(names, 0)
    for i in [None, *neighbour_swaps(len(names))]:
        if i is not None:
            diagram.swap(i)
        order = "".join(diagram.order)
        for k, (name, kept, removed) in enumerate(diagram.steps()):
            if k == 0:
                fails[name] = removed[0]
            if k == len(names) - 1:
                alone[name] = removed[0]
            shapley[name] += removed[0]
            rows.append((order, k + 1, name, kept[0], *removed))
    out = pd.DataFrame(rows, columns=["filter_order", "step", "filter", "kept", "removed", "good_lost", "toxic_lost"])
    out["redundant"] = out["filter"].map(fails) - out["removed"]
    out["unique_fails"] = out["filter"].map(alone)
    out["shapley"] = out["filter"].map(shapley)
    return out


def audited(counts: DataFrame, names: str) -> DataFrame:
    """For each part, each order of the filters and each step: what it keeps and removes, and what its filter does in all orders.

    `counts` has (part, mask, n, good, toxic), at most a row for each mask of a part. Up to 7 filters.
    """
    if not 1 <= len(names) <= 7:
        raise ValueError("1 to 7 filters have orders that can be listed")

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        out = audit_part(names, {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()})
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    columns = "part string, filter_order string, step int, filter string, kept long, removed long, good_lost long, toxic_lost long, redundant long, unique_fails long, shapley long"
    return counts.groupBy("part").applyInPandas(of, columns)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over the parts of `lang`.

    Null texts are empty, a null lang is the part of the empty string. A document counts as good or toxic
    if any of its label rows says so; without one, or with nulls, it is neither. Repeated rows count each:
    those that have the smallest doc_id of their text all pass E. An empty table has no parts and no rows;
    other columns don't matter.
    """
    return audited(masks(docs, labels), "".join(CONDITIONS) + DUPLICATE)
