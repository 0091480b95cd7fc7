"""Toxicity by a convolutional text classifier, trained in numpy.

Words (and their beginnings) are hashed into an embedding table; filters of one, two and three words
slide over the text, each keeps its strongest response, and a linear layer weighs those. At scoring
time the products of table and filters are made once, so a filter's response is a sum of lookups.
Scores are shifted by language, as told by the text alone, so that 0.3 is the threshold in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import langid
from .common import small_batches, utf8, written
from .langid import bounded, bucket, chunks, joined

WIDTHS = (1, 2, 3)
FILTERS = 6
SIZE = 8
TABLE_BITS = 15
PREFIX = 5
THRESHOLD = 0.3
#: Bins of a unit of logits, between which thresholds are sought.
BINS = 100
#: Longer texts are gone through in stretches of about so many bytes, and so many words.
STRETCH, STRETCH_WORDS = 300_000, 50_000
#: Bytes of the texts that each label teaches with.
MOST_BYTES = 16_000_000
#: Characters of a text that teach at most.
TEACHES = 250_000
_PAD = 1 << TABLE_BITS
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b < 123 or b >= 128 else 0 for b in range(256)], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_OTHER = re.compile(rb"[^A-Za-z\x80-\xff]")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS = _powers(1 << 20)


def _slots(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the words and of their beginnings, two pads after each text, and where texts start.

    A long text is cut between words; of a word of over STRETCH bytes each stretch counts as a word.
    """
    if len(texts) == 1 and len(texts[0]) > STRETCH:
        parts, at = [], 0
        while at < len(texts[0]):
            end = at + STRETCH
            blank = _OTHER.search(texts[0], end, end + STRETCH)
            end = blank.start() if blank else end
            word, prefix, _ = _tokens([texts[0][at:end]])
            parts.append((word[:-2].astype(np.uint16), prefix[:-2].astype(np.uint16)))
            at = end
        pads = np.full(2, _PAD, np.uint16)
        word, prefix = (np.concatenate([*x, pads]) for x in zip(*parts))
        return word, prefix, np.array([0, len(word)])
    return _tokens(texts)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = joined(texts)
    folded = _FOLD[data]
    up, down = _POWERS if len(folded) < len(_POWERS[0]) else _powers(len(folded) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * up[: len(folded)])))
    inner = folded > 0
    before = np.concatenate(([False], inner[:-1]))
    starts_text = np.zeros(len(folded) + 1, bool)
    starts_text[offsets] = True
    start = np.flatnonzero(inner & (~before | starts_text[:-1]))
    after = np.concatenate((inner[1:], [False]))
    end = np.flatnonzero(inner & (~after | starts_text[1:])) + 1
    word = _slots((total[end] - total[start]) * down[start])
    short = np.minimum(end, start + PREFIX)
    prefix = _slots((total[short] - total[start]) * down[start] + np.uint64(1))
    counts = np.diff(np.searchsorted(start, offsets))
    place = np.arange(len(start)) + 2 * np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate(([0], np.cumsum(counts + 2)))
    out = np.full((2, first[-1]), _PAD)
    out[0, place], out[1, place] = word, prefix
    return out[0], out[1], first


def packed(texts: list[bytes]) -> list[bytes]:
    """Of each text the table rows of its words, then of their beginnings."""
    word, prefix, first = tokens(texts)
    return [word[i : j - 2].astype("<u2").tobytes() + prefix[i : j - 2].astype("<u2").tobytes() for i, j in zip(first, first[1:])]


def assembled(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of packed texts."""
    both = [np.frombuffer(r, "<u2").reshape(2, -1).astype(np.int64) for r in rows]
    pads = np.full((2, 2), _PAD)
    out = np.concatenate([np.zeros((2, 0), np.int64), *[x for b in both for x in (b, pads)]], axis=1)
    return out[0], out[1], np.concatenate(([0], np.cumsum([b.shape[1] + 2 for b in both])))


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    constant: float
    langs: langid.Model | None = None
    shift: dict[str, float] = field(default_factory=dict)

    def lookup(self) -> np.ndarray:
        """Responses of each table row at each place of each filter."""
        return np.concatenate([self.table @ self.filters[n][j] for n in WIDTHS for j in range(n)], axis=1).astype(np.float32)

    def pooled(self, word: np.ndarray, prefix: np.ndarray, first: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        """The strongest response of each filter in each text; a filter starts at each word, and 0 is a text's least."""
        each = lookup[word]
        each += lookup[prefix]
        pads = word == _PAD
        pooled, k = [], 0
        for n in WIDTHS:
            # Each text ends in two pads, so a filter of up to three words that starts at a word stays in its text.
            out = each[:, k * FILTERS : (k + 1) * FILTERS].copy()
            for j in range(1, n):
                out[:-j] += each[j:, (k + j) * FILTERS : (k + j + 1) * FILTERS]
            out[pads] = 0
            pooled.append(np.maximum.reduceat(out, first[:-1], axis=0))
            k += n
        return np.concatenate(pooled, axis=1)

    def logits(self, texts: list[bytes], lookup: np.ndarray) -> np.ndarray:
        word, prefix, first = tokens(texts)
        if len(texts) == 1 and len(word) > STRETCH_WORDS:
            # What starts in a stretch sees two words of the next; those in turn see pads here, and their words there.
            best = np.zeros((1, len(WIDTHS) * FILTERS), np.float32)
            for at in range(0, len(word) - 2, STRETCH_WORDS):
                part = slice(at, min(at + STRETCH_WORDS + 2, len(word)))
                mine = self._starts(word[part], prefix[part], lookup)
                best = np.maximum(best, mine)
        else:
            best = self.pooled(word, prefix, first, lookup)
        bias = np.concatenate([self.bias[n] for n in WIDTHS])
        return np.maximum(best + bias, 0) @ self.weights + self.constant

    def _starts(self, word: np.ndarray, prefix: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        """The strongest responses that start before the last two places."""
        each = lookup[word] + lookup[prefix]
        out, k = [], 0
        for n in WIDTHS:
            out.append(sum(each[j : len(word) - 2 + j, (k + j) * FILTERS : (k + j + 1) * FILTERS] for j in range(n)).max(0))
            k += n
        return np.concatenate(out)[None]

    def scores(self, texts: list[bytes], lookup: np.ndarray) -> np.ndarray:
        logits = self.logits(texts, lookup).astype(float)
        if self.langs and self.shift:
            best, _, _ = self.langs.predict(texts)
            by = np.array([self.shift.get(x, self.shift[""]) for x in self.langs.langs])
            logits += by[best]
        else:
            logits += self.shift.get("", 0.0)
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 6, seed: int = 0) -> Model | None:
    """A model of texts and their labels; None unless both occur."""
    return train([row for part in chunks(texts) for row in packed(part)], labels, epochs, seed)


def train(rows: list[bytes], labels: np.ndarray, epochs: int = 6, seed: int = 0, informed: bool = True) -> Model | None:
    """Trains table and filters on packed texts; None unless both labels occur.

    An informed start sets the first coordinate to each word's log-odds among toxic documents, which
    training refines: held-out AUC on the synthetic documents is given in the README for both starts.
    """
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (_PAD + 1, SIZE)).astype(np.float32)
    filters = {n: rng.normal(0, 0.2, (n, SIZE, FILTERS)).astype(np.float32) for n in WIDTHS}
    if informed:
        seen = np.zeros((2, _PAD + 1))
        for row, label in zip(rows, labels):
            seen[int(label), np.unique(np.frombuffer(row, "<u2"))] += 1
        share = (seen + 0.5) / (np.bincount(labels.astype(int), minlength=2)[:, None] + 1)
        table[:, 0] = np.where(seen[1] > 1, np.maximum(0, np.log(share[1] / share[0]) - 1) / 2, 0)
        for n in WIDTHS:
            filters[n][:, 0, 0] = 1.0
    table[_PAD] = 0
    model = Model(table, filters, {n: np.zeros(FILTERS, np.float32) for n in WIDTHS}, np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -2.0)
    moments: dict[object, list] = {}
    energy = np.full(_PAD + 1, 1e-2, np.float32)

    def step(key, value, grad, rate=0.01):
        m = moments.setdefault(key, [np.zeros_like(value), np.zeros_like(value), 0])
        m[0], m[1], m[2] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad**2, m[2] + 1
        value -= rate * (m[0] / (1 - 0.9 ** m[2])) / (np.sqrt(m[1] / (1 - 0.99 ** m[2])) + 1e-6)

    weight = np.where(labels > 0, np.sqrt(max(1.0, (labels == 0).sum() / (labels > 0).sum())), 1.0)
    constant = np.array([model.constant])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            word, prefix, first = assembled([rows[k] for k in pick])
            embedded = table[word] + table[prefix]
            pads = word == _PAD
            tops, values = [], []
            for n in WIDTHS:
                out = sum(np.concatenate((embedded[j:], np.zeros((j, SIZE), np.float32))) @ filters[n][j] for j in range(n))
                out[pads] = 0
                top = np.array([first[d] + out[first[d] : first[d + 1]].argmax(0) for d in range(len(pick))])
                tops.append(top)
                values.append(np.take_along_axis(out, top, 0) + model.bias[n])
            pooled = np.maximum(np.concatenate(values, 1), 0)
            miss = (1 / (1 + np.exp(-np.clip(pooled @ model.weights + constant[0], -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            back = miss[:, None] * model.weights[None] * (pooled > 0)
            step("w", model.weights, (pooled.T @ miss).astype(np.float32))
            step("c", constant, np.array([miss.sum()]))
            for k, n in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                step(("b", n), model.bias[n], g.sum(0))
                g = np.where(pads[tops[k]], 0, g)
                change = np.zeros_like(filters[n])
                for j in range(n):
                    at = np.minimum(tops[k] + j, len(word) - 1)
                    change[j] = np.einsum("dfs,df->sf", embedded[at], g)
                    pull = (g[:, :, None] * filters[n][j].T[None]).reshape(-1, SIZE)
                    for slots in (word[at].ravel(), prefix[at].ravel()):
                        np.add.at(energy, slots, (pull**2).sum(1))
                        np.add.at(table, slots, -0.05 * pull / np.sqrt(energy[slots])[:, None])
                step(("k", n), filters[n], change)
            table[_PAD] = 0
    model.constant = float(constant[0])
    return model


def _best_threshold(counts: list[Row]) -> float:
    """The cut with the best F1, halfway to the next logit below; counts are rows (bin, n, hits, low, high)."""
    bins: dict[int, list] = {}
    for r in counts:
        n, hits, low, high = bins.get(r.bin, (0, 0, np.inf, -np.inf))
        bins[r.bin] = [n + r.n, hits + r.hits, min(low, r.low), max(high, r.high)]
    n, hits, low, high = np.array([bins[k] for k in sorted(bins, reverse=True)], float).T
    k = int((2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())).argmax())
    below = high[k + 1] if k + 1 < len(n) else low[k] - 2
    return float(low[k] + below) / 2


def rated(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, logit, lang): of each document's whole text the logit and the number of the language that it tells, made where the text is read."""
    small_batches()

    @F.pandas_udf("logit double, lang int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = model.lookup()
        for batch in batches:
            logits, langs = [np.zeros(0)], [np.zeros(0, int)]
            for part in chunks(list(batch)):
                logits.append(model.logits(part, lookup).astype(float))
                langs.append(model.langs.predict(part)[0] if model.langs else np.zeros(len(part), int))
            yield pd.DataFrame({"logit": np.concatenate(logits), "lang": np.concatenate(langs).astype("int32")})

    return docs.select("doc_id", of(utf8(F.col("text"))).alias("made")).select("doc_id", "made.*")


def counted(rates: DataFrame) -> DataFrame:
    """Rows (lang, bin, n, hits, low, high): how many documents (doc_id, toxic, logit, lang) have a logit in each BINS-th, by language, with the least and largest logit there.

    A doc_id that repeats counts once.
    """
    made = F.struct(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), "logit")).alias("logit"), "lang")
    each = rates.groupBy("doc_id", "toxic").agg(F.min(made).alias("made")).select("toxic", "made.*")
    return each.groupBy("lang", F.floor(F.col("logit") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("logit").alias("low"), F.max("logit").alias("high"))


def calibrate(model: Model, counts: list[Row], least: int = 20) -> None:
    """Shifts that put each language's best threshold at 0.3; a language with under `least` of a label takes the common one."""
    at = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    model.shift = {"": at - _best_threshold(counts)}
    for k, lang in enumerate(model.langs.langs if model.langs else []):
        mine = [r for r in counts if r.lang == k]
        hits = sum(r.hits for r in mine)
        if min(hits, sum(r.n for r in mine) - hits) >= least:
            model.shift[lang] = at - _best_threshold(mine)


def teaching_part(text: Column) -> Column:
    """A text, or of one of over TEACHES characters eight parts at equal distances, an eighth of TEACHES each."""
    size = TEACHES // 8
    step = F.floor((F.length(text) - size) / 7).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(text, i.cast("int") * step + 1, F.lit(size)))
    return F.when(F.length(text) > TEACHES, F.array_join(parts, " ")).otherwise(text)


def learn(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model | None:
    """A model from at most `most` documents of each label, with MOST_BYTES of text, but a fifth of them.

    The thresholds come from all labelled documents that it was not trained on, that fifth and all beyond the bounds.
    """
    model, known, trained = _trained(docs, labels, most)
    if model is not None:
        _calibrated(model, rated(docs.where(bucket(F.col("doc_id"), 4) != 2), model), known, trained)
    return model


def _calibrated(model: Model, rates: DataFrame, known: DataFrame, trained: DataFrame) -> None:
    """Sets the thresholds from `rates` (see rated) of `known` documents (doc_id, toxic) but those `trained` on, or of all if these lack a label.

    Ids and numbers are joined, never texts.
    """
    rates = rates.join(known, "doc_id")
    counts = counted(rates.join(F.broadcast(trained), "doc_id", "left_anti")).collect()
    hits = sum(r.hits for r in counts)
    if hits in (0, sum(r.n for r in counts)):
        counts = counted(rates).collect()
    calibrate(model, counts)


def _trained(docs: DataFrame, labels: DataFrame, most: int) -> tuple[Model | None, DataFrame, DataFrame]:
    """A model without thresholds, the labels (doc_id, toxic) that may teach, and the doc_id of what it was trained on.

    Documents come in the order of a hash until either bound is met; one of over TEACHES characters teaches
    with parts of it, so none takes the room of many. Executors make the tokens, so the driver gets about 4
    bytes a word. A doc_id that repeats teaches once.
    """
    whole = docs
    known = bucket(F.col("doc_id"), 4) != 2
    toxic = labels.where("toxic IN (0, 1)").where(known).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.select("doc_id").where(known).join(toxic, "doc_id")
    chosen = bounded(labelled, "toxic", most)
    docs = docs.withColumn("text", teaching_part(F.col("text")))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("size").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= MOST_BYTES).select("doc_id", "toxic")
    small_batches()

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x for p in chunks(list(batch)) for x in packed(p)], dtype=object)

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "toxic", of(utf8(F.col("text"))).alias("tokens")).collect()
    rows.sort(key=lambda r: r.doc_id)
    tokens_, marks = [bytes(r.tokens) for r in rows], np.array([r.toxic for r in rows], np.float32)
    apart = np.arange(len(rows)) % 5 == 4
    model = train([t for t, a in zip(tokens_, apart) if not a], marks[~apart])
    trained = docs.sparkSession.createDataFrame([(r.doc_id,) for r, a in zip(rows, apart) if not a], docs.select("doc_id").schema)
    if model is not None and "lang" in docs.columns:
        model.langs = langid.learn(whole.where(known))
    return model, toxic, trained


def score(text: Column, model: Model | None) -> Column:
    """The toxicity of a text, 0 to 1; a null text is empty. Without a model 0."""
    if model is None:
        return F.lit(0.0)
    small_batches()

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = model.lookup()
        for batch in batches:
            parts = [model.scores(part, lookup) for part in chunks(list(batch))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return of(utf8(text))


def scored(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Learns only from labelled rows whose crc32 of doc_id modulo 4 is not 2; a doc_id with several
    labels counts as toxic if one is. Rows without a doc_id teach nothing and get a score. Unless both
    labels occur, all scores are 0. Very long texts are gone through in stretches. An empty or null text gets a low score like any text without a
    toxic word. An empty table gives no rows.
    """
    model, known, trained = _trained(docs, labels, most)
    held = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    if model is None:
        out = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), None).alias("score"))
    else:
        rates = written(rated(docs, model), "rates")
        _calibrated(model, rates.where(bucket(F.col("doc_id"), 4) != 2), known, trained)
        out = rates.select("doc_id", held.alias("held_out"), _shifted(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _shifted(model: Model) -> Column:
    """The score of (logit, lang), as Model.scores() has it."""
    shift = F.lit(model.shift[""])
    for k, lang in enumerate(model.langs.langs if model.langs else []):
        if lang in model.shift:
            shift = F.when(F.col("lang") == k, F.lit(model.shift[lang])).otherwise(shift)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("logit") + shift))))
