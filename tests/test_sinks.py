"""Dead letters under a cap against a walk, and the pretty form of lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hostlens.sources import jsonl, sinks

from .test_operators import create, evasion, events, network  # noqa: F401


def walk(sizes, cap, spools):
    used, kept = {}, {}
    for batch, size in sorted(sizes.items()):
        spool = batch % spools
        if used.get(spool, 0) + size <= cap:
            used[spool] = used.get(spool, 0) + size
            kept[batch] = used[spool]
    return kept


@pytest.mark.parametrize("spools", [1, 4])
@pytest.mark.parametrize("cap", [0, 7, 300, 4000, 10**9])
def test_batches_that_fit_are_those_of_a_walk(spark, cap, spools):
    rng = random.Random(cap + spools)
    sizes = {i: rng.choice([0, 1, 2, 5, 40, 41, 400]) for i in rng.sample(range(10_000), 250)}
    failed = spark.createDataFrame(list(sizes.items()), "batch long, n int").select("batch", F.expr("repeat('x', n)").alias("body")).repartition(3)
    got = {r.batch: r.used for r in sinks.dead_letters(failed, cap, spools).collect()}
    assert got == walk(sizes, cap, spools)


def test_no_dead_letters(spark):
    assert sinks.dead_letters(spark.createDataFrame([], "batch long, body string")).count() == 0


def test_pretty_lines_are_the_same_objects(events):  # noqa: F811
    read = events([create(1, 0, 4, 1, "C:\\a b.exe"), network(2, 1, 5, "1.1.1.1", "5:1"), evasion(3, 2, 6)])
    plain = [r.value for r in jsonl.as_lines(read).orderBy("value").collect()]
    pretty = [r.value for r in jsonl.as_lines(read, pretty=True).collect()]
    assert all("\n" in x and "\n" not in y for x, y in zip(pretty, plain))
    key = lambda x: x["id"]
    assert sorted((json.loads(x) for x in pretty), key=key) == sorted((json.loads(x) for x in plain), key=key)
