"""Quality rules: base counts of every text, then bands of its zstandard ratio.

Repetitive text compresses far better than prose, noise far worse. The ratio of
compressed to raw bytes is taken of the whole document and of each fixed chunk; the
bounds depend on the length, since a short text pays the frame and has little to refer
back to. A document is rejected if its own ratio is out of its band or if more than
BAD_CHUNKS percent of its chunks are out of theirs; the last chunk ends with the text and
may overlap the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, forget, spread, table

#: (bytes up to, least ratio, most ratio) of whole documents; the last band has no end. Prose reaches
#: 0.73 up to 1 KB, 0.58 up to 8 KB, 0.45 above and 0.48 in chunks; random base64 words have 0.86, 0.76, 0.73 and 0.72 at 400 B, 1, 8 and 20 KB.
BANDS = ((256, 0.25, 0.85), (512, 0.28, 0.78), (1024, 0.28, 0.74), (8192, 0.25, 0.65), (float("inf"), 0.2, 0.65))
CHUNK_BYTES, CHUNK_BAND, BAD_CHUNKS = 4096, (0.18, 0.65), 30
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks long, chunks long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    base = len(number)
    if base < 2**21:
        windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:  # three numbers no longer fit in 63 bits: number the pairs first
        _, pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)
        windows = pairs * base + ids[2:]
    _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def out_of_band(size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for end, lo, hi in BANDS if size <= end)
    return not low <= ratio <= high


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    forget()
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        rows = []
        for value in batch["text"].cast(pa.binary()):
            text = value.as_py() or b""
            n, chars, symbols, dup, repeat = base_counts(text)
            failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
            ratio = len(packer.compress(text)) / len(text) if text else None
            chunks = list(range(0, len(text) - CHUNK_BYTES + 1, CHUNK_BYTES))
            if chunks and len(text) % CHUNK_BYTES:
                chunks.append(len(text) - CHUNK_BYTES)
            bad = sum(not CHUNK_BAND[0] <= len(packer.compress(text[i : i + CHUNK_BYTES])) / CHUNK_BYTES <= CHUNK_BAND[1] for i in chunks)
            kept = not failed and not out_of_band(len(text), ratio) and 100 * bad <= BAD_CHUNKS * len(chunks)
            rows.append((n, chars, symbols, dup, repeat, ratio, bad, len(chunks), failed, kept))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2
        columns = zip(*rows) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ...): counts, ratios and the verdict ``kept``.

    A null, empty or blank text counts as no words; it fails the base rules and has a
    null ratio only if it has no bytes. A text of any length is judged whole. Repeated
    rows are judged each, an empty table gives no rows; other columns are not read.
    """
    return spread(docs.select("doc_id", "text")).mapInArrow(_judge, SCHEMA)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that quality_rules() keeps; nulls, long texts and repeated rows are as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = pa.Table.from_batches(_judge([batch.select(["doc_id", "text"])]))["kept"]
            yield batch.filter(verdict.combine_chunks() if verdict.num_chunks else pa.array([], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
