"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its runs of two to four UTF-8 bytes that lie in one word or touch its
ends. Each hashes to a row of an embedding table; the mean of a text's rows goes through a
linear layer and a softmax. Table and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of the labelled texts, of which only their hashed
subwords come to the driver. A part of the sample that training does not see sets a
temperature, so that the score is a calibrated probability, and the score below which a
prediction should be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, lookup, spread, table, written

#: Labelled texts taken, about: of one language and of all, but of each language at least LEAST; and bytes of their subwords in all.
PER_LANGUAGE, IN_ALL, LEAST, SAMPLE_BYTES = 800, 12_000, 10, 200 << 20
ROWS, DIMS, ORDERS = 1 << 16, 16, (2, 3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Least accuracy wanted of accepted predictions, on the calibration part of the sample.
ACCURACY = 0.99
#: Bytes of a text hashed at once.
STEP = 1 << 20
NONE = "und"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _grams(b: np.ndarray) -> np.ndarray:
    """Hashed subwords of ASCII-lower-cased bytes in which all else is a space."""
    space = b == 32
    x = b.astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) < n:
            break
        m = len(b) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ x[i : m + i]) * np.uint32(0x01000193)
        inner = space[1 : m + 1].copy() if n > 2 else None
        for i in range(2, n - 1):
            inner |= space[i : m + i]
        blank = space[:m] & space[n - 1 :]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((h >> np.uint32(16))[~(blank if inner is None else inner | blank)])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Rows of the embedding table for the whole text, in steps of bounded size."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_LOWER) + b" ", np.uint8)
    for i in range(0, max(1, len(b) - 1), STEP):
        yield _grams(b[i : i + STEP + max(ORDERS) - 1])


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(c.isalpha() for c in text[:64]) or any(map(str.isalpha, text))


class Model:
    """languages, embedding table, linear layer and bias.

    For few languages the table is multiplied by the layer beforehand, so that each subword
    has its share of the logits; for many, embeddings are averaged first, and the model's
    size does not grow with languages times subwords.
    """

    def __init__(self, languages: list[str], rows: np.ndarray, layer: np.ndarray | None, bias: np.ndarray, temperature: float, least: float):
        self.languages, self.bias, self.temperature, self.least = languages, bias, temperature, least
        self.rows, self.layer = (rows @ layer, None) if layer is not None and len(languages) <= DIMS else (rows, layer)

    def parts(self) -> tuple:
        return self.languages, self.rows, self.layer, self.bias, self.temperature, self.least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the score is high enough to accept it."""
        if not self.languages or not has_letter(text):
            return NONE, 0.0, False
        total, n = np.zeros(self.rows.shape[1]), 0
        for ids in subwords(text):
            total += self.rows[ids].sum(0)
            n += len(ids)
        mean = total / max(1, n)
        z = (mean if self.layer is None else mean @ self.layer) + self.bias
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of the whole text and the share of each: at most ROWS, whatever its length."""
    total = np.zeros(ROWS, np.int64)
    for ids in subwords(text):
        total += np.bincount(ids, minlength=ROWS)
    ids = np.nonzero(total)[0]
    return ids.astype(np.uint16), (total[ids] / max(1, total.sum())).astype(np.float32)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Trains on four fifths of the samples (label, subwords, shares) and calibrates on the rest.

    Each step goes along the gradient of one text. In the table its length is such that the
    text's mean embedding moves by RATE times its own gradient, however many subwords share in it.
    """
    languages = sorted({x for x, _, _ in samples})
    if not languages:
        return Model([], np.zeros((ROWS, DIMS), np.float32), None, np.zeros(0), 1.0, 1.0)
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x, _, _ in samples])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(samples))
    part = len(samples) // 5 if len(samples) >= 50 else 0
    held, train = order[:part] if part else order, order[part:]
    table = (rng.standard_normal((ROWS, DIMS)) / DIMS).astype(np.float32)
    layer, bias = np.zeros((DIMS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    share = np.bincount(y[train], minlength=len(languages)) / len(train)
    weight = np.minimum(1 / np.maximum(share, 1e-9) / len(languages), 20)
    steps = EPOCHS * len(train)
    for k, i in enumerate(np.concatenate([rng.permutation(train) for _ in range(EPOCHS)])):
        _, ids, w = samples[i]
        if not len(ids):
            continue
        rate = RATE * weight[y[i]] * (1 - k / steps)
        mean = w @ table[ids]
        g = softmax(mean @ layer + bias)
        g[y[i]] -= 1
        down = layer @ g
        layer -= rate * np.outer(mean, g)
        bias -= 0.1 * rate * g
        table[ids] -= rate * (w / (w @ w))[:, None] * down
    z = np.stack([(w @ table[ids]) @ layer + bias for _, ids, w in (samples[i] for i in held)])
    right = y[held]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), right], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    top, ok = p.max(1), p.argmax(1) == right
    by = np.argsort(-top, kind="stable")
    good = np.nonzero(np.cumsum(ok[by]) / np.arange(1, len(by) + 1) >= ACCURACY)[0]
    least = float(top[by][good[-1]]) if len(good) else 1.0
    return Model(languages, table, layer, bias, temperature, least)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for label, text in zip(batch["lang"].to_pylist(), batch["text"]):
            text = text.as_py()
            if has_letter(text):
                ids, share = counted(text)
                rows.append((label, ids.tobytes(), share.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary()))], names=["lang", "ids", "shares"])


def labelled_sample(docs: DataFrame, usable: Column) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, subwords, shares) of about PER_LANGUAGE texts of each label, IN_ALL in all, chosen by a hash of doc_id and text.

    Every label is learned. Where there are many, or their texts are long, fewer texts are taken of
    each, but about LEAST at least: the driver holds SAMPLE_BYTES or LEAST texts a language.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.least(F.octet_length("text"), F.lit(ROWS))).alias("wide")), "languages")
    known = counts.agg(F.count("*").alias("languages"), F.sum("wide").alias("wide")).first()
    if not known.languages:
        return []
    # a text has up to two subwords a byte besides its words, 6 bytes each
    most = max(LEAST, min(PER_LANGUAGE, IN_ALL // known.languages, int(SAMPLE_BYTES / (18 * max(1.0, known.wide)))))
    cuts = counts.select("lang", "n", F.least(F.lit(1.0), most / F.col("n")).alias("_share"))
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)) / float(2**31)
    picked = lookup(rows, cuts, "lang", F.xxhash64("doc_id", "text"), docs.count()).where(lot < F.col("_share"))
    got = picked.select("lang", "text").mapInArrow(_featured, "lang string, ids binary, shares binary").collect()
    drop(counts)
    got.sort(key=lambda r: (r.lang, bytes(r.ids), bytes(r.shares)))
    return [(r.lang, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.shares, np.float32)) for r in got]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of ``docs`` (doc_id, text, ...).

    Null texts and texts without a letter are ``und`` with score 0 and not accepted, and so
    are all texts if nothing was learned. A text of any length is judged whole, repeated rows
    are judged each, an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            rows = [model.predict(t.as_py()) for t in batch["text"]]
            lang, score, ok = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(labelled_sample(docs, ~held))
    return identified(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
