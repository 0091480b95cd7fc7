"""What Python holds of executables at once is bounded by files and bytes, whatever a batch has."""

import pandas as pd

from hostlens.operators import pe
from hostlens.plans import fixtures


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(pe, "FILES", 4)
    monkeypatch.setattr(pe, "PIECE", 100)
    sizes = [10, 10, 10, 10, 10, 250, 60, 60, 0, 40, None]
    frame = pd.DataFrame({"path": [str(i) for i in range(len(sizes))], "content": [None if n is None else bytes(n) for n in sizes]})
    got = [p["path"].tolist() for p in pe.pieces(frame)]
    assert got == [["0", "1", "2", "3"], ["4"], ["5"], ["6"], ["7", "8", "9", "10"]]
    assert list(pe.pieces(frame.iloc[:0])) == []


def test_a_large_batch_is_parsed_in_pieces(spark):
    """More files than a piece has come out as the same rows, and the session's batches are bounded by bytes."""
    ranges = spark.range(700, numPartitions=1).select(pe.F.format_string("f%d", "id").alias("path"), pe.F.col("id").alias("k"))
    build = lambda frames: (pd.DataFrame({"path": f["path"], "content": [fixtures.sample_image(k) for k in f["k"]]}) for f in frames)
    files = ranges.mapInPandas(build, "path string, content binary")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    parsed = pe.parsed(files, code=True)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(pe.PIECE)
    rows = {r.path: r for r in parsed.collect()}
    assert len(rows) == 700 and all(r.valid == (int(p[1:]) % 11 != 10) for p, r in rows.items())
    assert rows["f601"].image_size == 0x3000 + 601
