"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or nothing (-1) on each text. How
often each pattern of votes occurs in the whole corpus is all that expectation-
maximisation needs to estimate each labeller's accuracy and the share of good texts,
without any true label. The posterior of a text's votes is its training label: a linear
scorer over hashed features learns it from a bounded sample and then scores every text,
those on which no labeller votes too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, forget, spread, table

#: Texts sampled for training, about, half of each posterior class where there are enough; fewer where their features would take more than SAMPLE_BYTES on the driver.
SAMPLE, SAMPLE_BYTES = 4000, 200 << 20
#: Hashed features: byte trigrams, and one binned value of each statistic.
ROWS = 1 << 16
EPOCHS, RATE, SEED = 5, 0.5, 11
#: A text is kept unless its probability of being good, at the corpus's share of good texts, is lower.
LEAST = 0.3
#: A text of fewer words is weaker evidence; its score stays nearer the corpus's share of good texts.
ENOUGH_WORDS = 20
STEP = 1 << 20

LABELLERS = ("symbols", "repeats", "variety", "shouting", "letters", "word_length", "pieces", "runs")
MARKS = b"#*$%&|<>{}[]\\^~=+_@"


def statistics(text: bytes) -> tuple[float, ...]:
    """words, and shares: marks among words, commonest word, distinct words, capitals among ASCII letters, letters, mean word bytes, single marks, words equal to the one before."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 9
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    dense = b"".join(words)
    upper = len(dense) - len(dense.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(dense) - len(dense.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    high = len(dense) - len(dense.translate(None, bytes(range(128, 256))))
    marks = len(dense) - len(dense.translate(None, MARKS))
    single = sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum())
    return (float(n), marks / n, max(counts.values()) / n, len(counts) / n, upper / max(1, upper + lower), (upper + lower + high) / len(dense), len(dense) / n, single / n, sum(map(bytes.__eq__, words, words[1:])) / n)


def votes(s: tuple[float, ...]) -> tuple[int, ...]:
    """One vote of each labeller; thin evidence gives none."""
    n, marks, top, distinct, upper, letters, length, single, runs = s

    def band(value: float, good: float, bad: float) -> int:
        """Good up to ``good``, bad from ``bad``."""
        return 1 if value <= good else 0 if value >= bad else -1

    long = n >= 20
    return (
        band(marks, 0.1, 0.4),
        band(top, 0.15, 0.3) if long else -1,
        band(-distinct * min(1.0, n / 400), -0.25, -0.1) if n >= 60 else (band(-distinct, -0.5, -0.35) if long else -1),
        band(upper, 0.2, 0.5) if n >= 5 else -1,
        band(-letters, -0.75, -0.5) if n >= 5 else -1,
        (1 if 3 <= length <= 14 else 0 if length < 2 or length > 25 else -1) if n >= 5 else -1,
        band(single, 0.03, 0.15) if n >= 5 else -1,
        band(runs, 0.03, 0.12) if n >= 5 else -1,
    )


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        out = ["".join("01-"[v] for v in votes(statistics(t.as_py() or b""))) for t in batch["text"].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["votes"])


class LabelModel:
    """Class-conditional vote probabilities of each labeller and the share of good texts, by EM over vote patterns."""

    def __init__(self, patterns: dict[str, int], rounds: int = 100):
        seen = sorted(patterns)
        v = np.array([["01-".index(c) for c in p] for p in seen], np.int64).reshape(len(seen), len(LABELLERS))
        n = np.array([patterns[p] for p in seen], float)
        # labellers are taken to be right more often than not, which tells the classes apart
        good = (v == 1).sum(1) - 3.0 * (v == 0).sum(1)
        self.posterior = dict(zip(seen, post := 1 / (1 + np.exp(-good))))
        self.share, self.accuracy = 0.5, {}
        if not seen:
            return
        for _ in range(rounds):
            likely = np.zeros((len(seen), 2))
            for c, w in enumerate((n * (1 - post), n * post)):
                share = (w.sum() + 1) / (n.sum() + 2)
                likely[:, c] = np.log(share)
                for k in range(len(LABELLERS)):
                    p = (np.bincount(v[:, k], w, 3) + 0.1) / (w.sum() + 0.3)
                    likely[:, c] += np.log(p[v[:, k]])
            new = 1 / (1 + np.exp(np.clip(likely[:, 0] - likely[:, 1], -50, 50)))
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        self.posterior = dict(zip(seen, post.tolist()))
        self.share = float((n * post).sum() / n.sum())
        for k, name in enumerate(LABELLERS):
            said = v[:, k] < 2
            right = np.where(v[:, k] == 1, post, 1 - post)
            self.accuracy[name] = float((n * right)[said].sum() / max(1e-9, n[said].sum()))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(trigram counts by row, rows of the binned statistics)."""
    b = np.frombuffer(text.lower(), np.uint8)
    counts = np.zeros(ROWS, np.float32)
    for i in range(0, len(b), STEP):
        x = b[i : i + STEP + 2].astype(np.uint32)
        if len(x) > 2:
            h = ((x[:-2] * np.uint32(0x01000193)) ^ x[1:-1]) * np.uint32(0x01000193) ^ x[2:]
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=ROWS)
    return counts, stat_rows(statistics(text))


def stat_rows(s: tuple[float, ...]) -> np.ndarray:
    bins = [int(np.log2(s[0] + 1))] + [int(min(20, 20 * x)) for x in s[1:6]] + [int(min(30, s[6]))] + [int(min(20, 20 * x)) for x in s[7:9]]
    return np.array([ROWS // 2 + 64 * k + b for k, b in enumerate(bins)])


class Scorer:
    """Logistic regression on the mean weight of a text's trigrams plus the weights of its binned statistics."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        total, n, low = 0.0, 0, text.lower()
        for i in range(0, len(low), STEP):
            x = np.frombuffer(low[i : i + STEP + 2], np.uint8).astype(np.uint32)
            if len(x) > 2:
                h = ((x[:-2] * np.uint32(0x01000193)) ^ x[1:-1]) * np.uint32(0x01000193) ^ x[2:]
                total += float(self.weights[(h * np.uint32(0x9E3779B1)) >> np.uint32(17)].sum())
                n += len(x) - 2
        s = statistics(text)
        z = total / max(1, n) + float(self.weights[stat_rows(s)].sum())
        z = self.bias + z * min(1.0, s[0] / ENOUGH_WORDS)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def packed(text: bytes) -> tuple[bytes, bytes]:
    """(rows, values) of a text for fit(): shares of trigrams, and 1 for each binned statistic."""
    counts, rows = features(text)
    ids = np.nonzero(counts)[0]
    return np.concatenate([ids, rows]).astype(np.uint32).tobytes(), np.concatenate([counts[ids] / max(1.0, counts.sum()), np.ones(len(rows))]).astype(np.float32).tobytes()


def fit(made: list[tuple[np.ndarray, np.ndarray]], labels: list[float], corpus_share: float) -> Scorer:
    """Stochastic gradient descent with per-weight (Adagrad) steps on soft labels of (rows, values), classes balanced.

    The bias is then moved from even classes to the share of good texts in the corpus.
    """
    weights, sums, bias = np.zeros(ROWS, np.float64), np.full(ROWS, 1e-4), 0.0
    if not made:
        return Scorer(weights.astype(np.float32), 0.0)
    y = np.asarray(labels)
    share = min(0.95, max(0.05, float(y.mean())))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(made)):
            ids, x = made[i]
            p = 1 / (1 + np.exp(-np.clip(weights[ids] @ x + bias, -30, 30)))
            g = (p - y[i]) * (0.5 / share if y[i] >= 0.5 else 0.5 / (1 - share))
            step = g * x
            sums[ids] += step * step
            weights[ids] -= RATE * step / np.sqrt(sums[ids])
            bias -= 0.02 * g
    corpus = min(0.99, max(0.01, corpus_share))
    return Scorer(weights.astype(np.float32), float(bias + np.log(corpus / (1 - corpus))))


def learn(docs: DataFrame) -> tuple[LabelModel, Scorer]:
    """The label model of all texts' votes, and the scorer learned from a sample of about SAMPLE texts.

    At most 3**8 patterns of votes come to the driver, whatever the size of the corpus, and
    of the sample its hashed features.
    """
    texts = spread(docs.select("text"))
    voted = texts.mapInArrow(_vote, "votes string")
    counts = {r.votes: r["count"] for r in voted.groupBy("votes").count().collect()}
    model = LabelModel(counts)
    good = sum(n for p, n in counts.items() if model.posterior[p] >= 0.5)
    total = sum(counts.values())
    # a text has a trigram a byte at most, 8 bytes each
    wide = docs.agg(F.avg(F.least(F.octet_length("text"), F.lit(ROWS // 2)))).first()[0] or 0.0
    half = min(SAMPLE, SAMPLE_BYTES / (8 * max(1.0, wide))) / 2
    cut = {True: half / max(1, good), False: half / max(1, total - good)}
    posterior, width = model.posterior, 2**31

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.binary()):
                b = text.as_py() or b""
                key = xxhash.xxh3_128_digest(b)
                lot = int.from_bytes(key[:8], "little") % width / width
                if lot < max(cut.values()):
                    p = posterior.get("".join("01-"[v] for v in votes(statistics(b))), 0.5)
                    if lot < cut[p >= 0.5]:
                        rows.append((key, p, *packed(b)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.binary(), pa.float64(), pa.binary(), pa.binary()))], names=["key", "posterior", "rows", "values"])

    # equal texts draw the same lot, and count once: a hot copy does not fill the sample
    picked = texts.mapInArrow(pick, "key binary, posterior double, rows binary, values binary").dropDuplicates(["key"]).collect()
    picked.sort(key=lambda r: bytes(r.key))
    return model, fit([(np.frombuffer(r.rows, np.uint32), np.frombuffer(r["values"], np.float32)) for r in picked], [r.posterior for r in picked], model.share)


def classified(docs: DataFrame, scorer: Scorer, least: float = LEAST) -> DataFrame:
    """(doc_id, score, kept) for every row of ``docs`` (doc_id, text, ...): kept if the score is ``least`` or more.

    A null text is an empty one. A text of any length is scored whole, repeated rows are scored
    each, an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            score = np.array([scorer.score(t.as_py() or b"") for t in batch["text"].cast(pa.binary())], float)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64()), pa.array(score >= least, pa.bool_())], names=["doc_id", "score", "kept"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, kept boolean")


def kept_rows(docs: DataFrame, scorer: Scorer, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, that classified() keeps; nulls, long texts and repeated rows are as there."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or b"") >= least for t in batch["text"].cast(pa.binary())], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _, scorer = learn(docs)
    return classified(docs, scorer)
