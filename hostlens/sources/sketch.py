"""Sketches that tell which parts of a table may hold a value: Bloom filters in blocks, as a table.

A part's filter has ten bits a value or more, a power of two, in blocks of 4 KB. A value sets four bits
of one block, so a lookup reads one row of each part, and many values are looked up by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block (what bitmap_construct_agg makes), bits a value sets, and bits for each value at least.
BLOCK, PROBES, EACH = 1 << 15, 4, 10


def _bucket(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(value), blocks)


def _places(value: Column) -> list[Column]:
    """Bits of a value in its block."""
    a, b = F.xxhash64(value, F.lit(1)), F.xxhash64(value, F.lit(2))
    return [F.pmod(a.bitwiseXOR(F.shiftright(b, 7 * i)), F.lit(BLOCK)) for i in range(PROBES)]


def sketched(rows: DataFrame, parts: list[str], column: str) -> DataFrame:
    """(parts, blocks, bucket, bitmap) of a column's values in each part; nulls are in none."""
    rows = rows.where(F.col(column).isNotNull()).select(*parts, F.col(column).alias("value"))
    log = F.ceil(F.log2(F.approx_count_distinct("value") * EACH / BLOCK))
    sizes = rows.groupBy(*parts).agg(F.pow(F.lit(2.0), F.greatest(F.lit(0), log)).cast("long").alias("blocks"))
    sized = rows.join(sizes, parts)
    bits = sized.select(*parts, "blocks", _bucket(F.col("value"), F.col("blocks")).alias("bucket"), F.explode(F.array(*_places(F.col("value")))).alias("place"))
    return bits.groupBy(*parts, "blocks", "bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def _set(place: Column) -> Column:
    """Whether a bit of `bitmap` is set."""
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def may_hold(sketches: DataFrame, value: str) -> DataFrame:
    """Rows of the sketches of parts that may hold a value; about one in a hundred of the others is among them."""
    test = F.col("bucket") == _bucket(F.lit(value), F.col("blocks"))
    for place in _places(F.lit(value)):
        test = test & _set(place)
    return sketches.where(test)


def may_hold_any(sketches: DataFrame, values: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """(column, parts) of values and the parts that may hold them."""
    sizes = [F.lit(r.blocks).cast("long") for r in sketches.select("blocks").distinct().collect()]  # a few powers of two
    probes = values.select(column, F.explode(F.array(*sizes).cast("array<bigint>")).alias("blocks"))
    probes = probes.withColumn("bucket", _bucket(F.col(column), F.col("blocks")))
    hits = probes.join(sketches, ["blocks", "bucket"])
    for place in _places(F.col(column)):
        hits = hits.where(_set(place))
    return hits.select(column, *parts).distinct()
