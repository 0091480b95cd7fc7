"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is predicted by a linear classifier over hashed
byte n-grams, and the language whose codeword has the least logistic loss under the predicted margins
wins. Near ties are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, utf8

UNKNOWN = "und"
ORDERS = (1, 2, 3)
DIM = 1 << 13
#: Longer texts are gone through in stretches of so many bytes.
STRETCH = 300_000
#: Documents that a model learns from, of all languages together; of each language at least LEAST if it has them.
MOST_ROWS, LEAST = 20_000, 8
#: Rows that a step of training looks at.
BATCH = 4096
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 97 and b < 123 or b >= 128 else 32 for b in range(256)], np.uint32)
_RESULT = "lang string, score double, ambiguous boolean"


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after another, and where each starts (and the last ends)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def chunks(texts: list[bytes], most: int = 300_000) -> Iterator[list[bytes]]:
    """Lists of texts of about `most` bytes, each text whole."""
    held, size = [], 0
    for text in texts:
        if held and (size + len(text) > most or len(held) == 128):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _counts(data: np.ndarray, offsets: np.ndarray, fresh: int = 0) -> np.ndarray:
    """Hashed n-grams in each text; of those that end before `fresh` none counts."""
    folded = _FOLD[data]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    counts = np.zeros((len(offsets) - 1) * DIM, np.int64)
    for n in ORDERS:
        if len(data) < n:
            continue
        gram = np.full(len(data) - n + 1, n, np.uint32)
        for j in range(n):
            gram = gram * np.uint32(0x01000193) + folded[j : j + len(gram)]
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x85EBCA6B)
        inside = owner[: len(gram)] == owner[n - 1 :]
        inside[: max(0, fresh - n + 1)] = False
        counts += np.bincount(owner[: len(gram)][inside] * DIM + (gram[inside] >> np.uint32(32 - 13)), minlength=len(counts))
    return counts.reshape(-1, DIM)


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed n-grams in each whole text; a long text is counted in stretches."""
    if len(texts) == 1 and len(texts[0]) > STRETCH:
        counts, before = np.zeros((1, DIM), np.int64), max(ORDERS) - 1
        for at in range(0, len(texts[0]), STRETCH):
            first = max(0, at - before)
            part = np.frombuffer(texts[0][first : at + STRETCH], np.uint8)
            counts += _counts(part, np.array([0, len(part)]), at - first)
    else:
        counts = _counts(*joined(texts))
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def packed(row: np.ndarray) -> bytes:
    """The numbers and values of a row's features that are not zero."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIM), np.float32)
    for i, row in enumerate(rows):
        n = len(row) // 6
        out[i, np.frombuffer(row, "<u2", n)] = np.frombuffer(row, "<f4", n, 2 * n)
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code up to 7 languages, else the best of seeded draws."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        rest = (bits[None, :] >> np.arange(n - 1)[:, None] & 1) * 2 - 1
        return np.vstack((-np.ones((1, len(bits))), rest))
    rng, best, far = np.random.default_rng(0), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(50 if n <= 500 else 1):
        code = rng.choice([-1.0, 1.0], (n, length))
        some = code[:500]
        gap = np.min((length - some @ code.T)[~np.eye(len(some), n, dtype=bool)])
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class Model:
    """Languages, their codewords, and the bits' weights and biases."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margin: float = 0.1

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score, and whether the runner-up is too near."""
        return self.decoded(features(texts))

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of rows of features."""
        margins = x @ self.weights + self.bias
        ones = (self.code > 0).T.astype(float)
        loss = (np.logaddexp(0, -margins) @ ones + np.logaddexp(0, margins) @ (1 - ones)) / self.code.shape[1]
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        near = ranked[:, -1] - (ranked[:, -2] if len(self.langs) > 1 else 0) < self.margin
        return share.argmax(1), share.max(1), near


def fit(texts: list[bytes], langs: list[str], steps: int = 150) -> Model | None:
    """A model of texts and their languages; None without a label."""
    return train([packed(row) for part in chunks(texts) for row in features(part)], langs, steps)


def train(rows: list[bytes], langs: list[str], steps: int = 150) -> Model | None:
    """Logistic classifiers of all bits at once, from packed features, languages weighing alike; None without a label.

    Up to BATCH rows make one batch. Of more, each step takes the next of a shuffled order, and steps are
    added until each row was seen about 25 times.
    """
    if not rows:
        return None
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    label = np.array([number[x] for x in langs])
    code = codewords(len(names))
    share = (1 / np.bincount(label)[label] / len(names)).astype(np.float32)[:, None]
    batches = -(-len(rows) // BATCH)
    rng, order = np.random.default_rng(0), np.arange(len(rows))
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, max(steps, 25 * batches) + 1):
        turn = (t - 1) % batches
        if turn == 0 and (batches > 1 or t == 1):
            order = rng.permutation(len(rows)) if batches > 1 else order
        if batches > 1 or t == 1:
            pick = order[turn * BATCH : (turn + 1) * BATCH]
            x, y, weight = unpacked([rows[i] for i in pick]), code[label[pick]].astype(np.float32), share[pick] * (len(rows) / len(pick))
        pull = -y * weight / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        grad = x.T @ pull + 1e-6 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.2 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        b -= 0.5 * pull.sum(0)
    return Model(names, code, w, b)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded(labelled: DataFrame, kind: str, most: int) -> DataFrame:
    """Rows (doc_id, kind): of each value of `kind` at most `most` different doc_ids, those of the least hashes.

    A first draw by the hash leaves about half as many again of each, so that few are put in order.
    """
    share = labelled.groupBy(kind).agg(F.least(F.lit(1.0), F.lit(1.5 * most + 50) / F.approx_count_distinct("doc_id")).alias("share"))
    draw = F.xxhash64("doc_id", F.lit(11))
    few = labelled.select("doc_id", kind).join(F.broadcast(share), kind).where(F.shiftrightunsigned(draw, 1) < F.col("share") * float(2**63)).select("doc_id", kind).distinct()
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(draw, "doc_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", kind)


def learn(docs: DataFrame, per_lang: int = 500) -> Model | None:
    """A model from at most `per_lang` documents of each language, of all their languages.

    With over MOST_ROWS / per_lang languages each has fewer documents. Executors make the features, so
    the driver gets at most 48 KB of a document, whatever its length. A doc_id that repeats teaches once.
    """
    labelled = docs.where((F.col("lang").isNotNull()) & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    langs = labelled.select("lang").distinct().count()
    chosen = bounded(labelled, "lang", min(per_lang, max(LEAST, MOST_ROWS // max(1, langs))))
    small_batches()

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([packed(row) for part in chunks(list(batch)) for row in features(part)], dtype=object)

    texts = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "lang", of(utf8(F.col("text"))).alias("row")).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    return train([bytes(r.row) for r in rows], [r.lang for r in rows])


def guess(text: Column, model: Model | None) -> Column:
    """Struct (lang, score, ambiguous) of a text: und with score 0 where it is null or has no letter."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if model is None:
        return nothing
    small_batches()

    @F.pandas_udf(_RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            parts = [model.predict(c) for c in chunks(list(batch))]
            best, score, near = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            yield pd.DataFrame({"lang": names[best], "score": score.astype(float), "ambiguous": near})

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, of(utf8(text))).otherwise(nothing)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column `guess` of (lang, score, ambiguous).

    A null text or one without a letter is und, score 0. The prediction sees the whole text and
    nothing else, so rows alike in text get the same result whatever their other columns hold.
    """
    return docs.withColumn("guess", guess(F.col("text"), model))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket(doc_id, 5) == 0, F.lit(False))


def predictions(docs: DataFrame, per_lang: int = 500) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from rows with a lang whose crc32 of doc_id modulo 5 is not 0 (rows without a doc_id teach
    nothing). Without any such row all are und. Very long texts are counted in stretches. An empty table
    gives no rows.
    """
    model = learn(docs.where(bucket(F.col("doc_id"), 5) != 0), per_lang)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"), F.col("guess.ambiguous").alias("ambiguous"))


def accepted(docs: DataFrame, per_lang: int = 500) -> DataFrame:
    """The documents whose language the classifier tells, as they are.

    Those that are und go, and those that are ambiguous: the two nearest codewords share nearly alike. Where
    there is no language to learn, only texts without a letter go.
    """
    model = learn(docs, per_lang)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))
    told = (F.col("guess.lang") != UNKNOWN) & ~F.col("guess.ambiguous")
    return packed.withColumn("guess", guess(F.col("doc.text"), model)).where(told).select(*names)
