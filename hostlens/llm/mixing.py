"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash. A source whose target is above its size gives
all blocks once or twice, and the rest of its target is drawn from a permutation of its blocks, the
last of them in part. A tree splits the sources' exact block counts among the output shards: at each
node the left half's counts are one multivariate-hypergeometric draw, so each shard gets its share of
every source and the counts add up. A shard takes the next blocks of each permutation and shuffles
their documents by a hash of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: A document is taken this often at most, a limit that the targets keep.
MOST = 2
MOST_SOURCES = 100_000
BLOCK_DOCS = 256
#: Blocks of a source, and of all together; with more documents blocks grow instead, so the table of blocks stays small.
MOST_BLOCKS = 65_536
ALL_BLOCKS = 300_000_000


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Words wanted of each source: shares of `share` times all words by weight, none over `most` times its size."""
    out, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * float(sizes.sum())
    while open_.any():
        want = left * weights / weights[open_].sum()
        over = open_ & (want > most * sizes)
        if not over.any():
            out[open_] = want[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of blocks by source and shard; each row adds up to its source's count, shards to equal numbers (or one apart).

    Counts add up to less than 1e9, as all sources together have at most ALL_BLOCKS, drawn at most MOST + 1 times.
    """
    if shards == 1:
        return counts[:, None]
    half = shards // 2
    left = rng.multivariate_hypergeometric(counts, int(counts.sum()) * half // shards, method="marginals")
    return np.concatenate((split(left, half, rng), split(counts - left, shards - half, rng)), axis=1)


def _draw(name: str, seed: int) -> Column:
    return F.xxhash64(F.col(name), F.lit(seed))


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = 16, seed: int = 1, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs' rows as struct `doc` (all columns, or those of `carry`), with size, source_size, target, taken and draws.

    size counts the words of the whole text (null: 0). Sources come by code point, null last, and take
    the weights in turn. draws has (shard, epoch, words) of each time that the document is taken; taken
    is the sum of its words. Only the document at which a source's target ends is taken in part (its
    first words). Rows alike in doc_id and text are interchangeable. A source without words has target
    0; an empty table gives no rows. More than 100,000 sources are an error.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), text)
    sized = written(docs.select("source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")), "sized")
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy(F.asc_nulls_last("source")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = np.array([r["size"] for r in found], float)
    wants = targets(sizes, np.resize(np.array(weights, float), len(found)), share, MOST)
    epochs = np.minimum(np.floor(wants / np.maximum(sizes, 1)), MOST).astype(int)
    rest = np.minimum(np.rint(wants - epochs * sizes), sizes).astype(int)
    most = min(MOST_BLOCKS, ALL_BLOCKS // max(1, len(found)))
    blocks = [min(-(-r["n"] // BLOCK_DOCS), most) for r in found]
    schema = T.StructType([T.StructField("source", docs.schema["source"].dataType)] + [T.StructField(n, t) for n, t in (("number", T.IntegerType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("epochs", T.IntegerType()), ("rest", T.LongType()), ("blocks", T.IntegerType()))])
    plan = spark.createDataFrame([(r["source"], i, int(r["size"]), float(w), int(e), int(x), b) for i, (r, w, e, x, b) in enumerate(zip(found, wants, epochs, rest, blocks))], schema)

    def placed(rows: DataFrame) -> DataFrame:
        """rows with what the plan says of their source, and their block."""
        mine = plan.withColumnRenamed("source", "plan_source")
        return rows.join(F.broadcast(mine), rows["source"].eqNullSafe(mine["plan_source"])).drop("plan_source").withColumn("block", F.pmod("key", "blocks").cast("int"))

    by = Window.partitionBy("number")
    table = placed(sized).groupBy("number", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("epochs", "rest")])
    order = [by.orderBy(_draw("block", seed + e), "block") for e in range(MOST + 1)]
    table = table.select("*", *[(F.row_number().over(order[e]) - 1).alias(f"turn{e}") for e in range(MOST + 1)], F.count("*").over(by).alias("in_all"), (F.sum("words").over(order[MOST].rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"))
    table = written(table, "blocks")
    counts = np.zeros(len(found), np.int64)
    for r in table.groupBy("number").agg(F.sum(F.col("epochs") + (F.col("before") < F.col("rest")).cast("int")).alias("n")).collect():
        counts[r["number"]] = r["n"]
    quotas = split(counts, shards, np.random.default_rng(seed)) if len(found) else np.zeros((0, shards), int)
    ends = spark.createDataFrame([(i, x) for i, x in enumerate(np.cumsum(quotas, axis=1).tolist())], "number int, ends array<long>")

    def draw(epoch: int, at: Column) -> Column:
        return F.struct(F.size(F.filter("ends", lambda e: e <= at)).alias("shard"), F.lit(epoch).alias("epoch"))

    whole = [F.when(F.col("epochs") > e, draw(e, e * F.col("in_all") + F.col(f"turn{e}"))) for e in range(MOST)]
    part = F.when(F.col("before") < F.col("rest"), draw(MOST, F.col("epochs") * F.col("in_all") + F.col(f"turn{MOST}")))
    table = table.join(F.broadcast(ends), "number").select("number", "block", F.array_compact(F.array(*whole)).alias("whole"), part.alias("part"), F.greatest(F.lit(0), F.col("rest") - F.col("before")).alias("left"), (F.col("words") > F.col("rest") - F.col("before")).alias("cut"))

    source = [F.struct(*[f"`{c}`" for c in carry or docs.columns]).alias("doc"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")]
    rows = placed(docs.select(*source)).select("doc", "size", "key", "number", "block", "source_size", "target").join(table, ["number", "block"])
    # Only the block at which a source's target ends needs its documents in order.
    inner = Window.partitionBy("number", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ending = F.col("part").isNotNull() & F.col("cut")
    edge = rows.where(ending).withColumn("words", F.greatest(F.lit(0), F.least("size", F.col("left") - (F.sum("size").over(inner) - F.col("size")))))
    rows = rows.where(~ending).withColumn("words", F.when(F.col("part").isNotNull(), F.col("size")).otherwise(F.lit(0))).unionByName(edge)
    last = F.when(F.col("words") > 0, F.struct(F.col("part.shard").alias("shard"), F.col("part.epoch").alias("epoch"), F.col("words").cast("long").alias("words")))
    draws = F.array_compact(F.concat(F.transform("whole", lambda d: F.when(F.col("size") > 0, F.struct(d["shard"].alias("shard"), d["epoch"].alias("epoch"), F.col("size").alias("words")))), F.array(last)))
    return rows.select("doc", "size", "source_size", "target", (F.size("whole") * F.col("size") + F.col("words")).cast("long").alias("taken"), draws.alias("draws"), "key")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = 16, seed: int = 1) -> DataFrame:
    """The mix: docs' columns, once for each time that a document is taken, with mix_shard, mix_order and mix_words.

    mix_order is the place in the shard (a hash; sort by it to shuffle). A text that is taken in part is
    cut to its first words, single spaces between. Columns of docs named like the three are replaced.
    """
    rows = planned(docs, weights, share, shards, seed).select("doc", "size", "key", F.explode("draws").alias("draw"))
    own = ("mix_shard", "mix_order", "mix_words")

    def value(name: str) -> Column:
        old = F.col("doc").getField(name)
        if name != "text":
            return old.alias(name)
        short = F.array_join(F.slice(F.regexp_extract_all(old, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("draw.words").cast("int")), " ")
        return F.when(F.col("draw.words") < F.col("size"), short).otherwise(old).alias(name)

    return rows.select(*[value(c) for c in docs.columns if c not in own], F.col("draw.shard").alias("mix_shard"), F.xxhash64("draw.shard", "draw.epoch", "key").alias("mix_order"), F.col("draw.words").alias("mix_words"))


def write_shards(mix: DataFrame, path: str) -> None:
    """Writes a mix as one folder a shard, each shuffled within its files."""
    mix.repartition("mix_shard", F.pmod("mix_order", F.lit(16))).sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
