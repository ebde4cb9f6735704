"""Token ids as length-delimited binary records, with a separate offset index.

A record is: payload length (uint64), masked CRC of those 8 bytes (uint32), payload,
masked CRC of the payload (uint32), all little-endian. The mask rotates a CRC right by
15 bits and adds a constant, so that a CRC stored beside data is not taken for data. A
payload is the document id (int64, or the least int64 for null), the bytes of a token id
(uint8: 2 if the vocabulary allows it, else 4) and the token ids.
Each data file part-N.rec has an index part-N.idx: the byte offset of each record and the
number of ids before it in the file (pairs of uint64), for reads in any order.

Files are written under a name of their own try and then renamed, so a task that
is run again replaces its file as a whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, per_worker, scratch_path, table, tidy

MASK_DELTA = 0xA282EAD8
NO_ID = -(2**63)
#: Distinct words whose ids a task keeps before it forgets all but the last ones, and bytes of text encoded together.
WORDS_KEPT, TOGETHER = 250_000, 4 << 20
#: Where a lower-cased text is cut besides white space: before such a mark after a letter or digit.
PUNCTUATION = r"([a-z0-9])([.,;:!?])"
WORD_END = "</w>"
#: Rows of a file that are read before they are handed on.
ROWS = 4096
#: The normalizer, splitter and model form under which words can be encoded one by one.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "end_of_word_suffix": WORD_END,
}


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def unframe(data, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next begins; ValueError if it is damaged."""
    head = bytes(data[at : at + 8])
    size = int.from_bytes(head, "little")
    end = at + 12 + size
    if len(head) < 8 or masked_crc(head) != int.from_bytes(data[at + 8 : at + 12], "little") or end + 4 > len(data):
        raise ValueError(f"record at byte {at}: bad length")
    payload = bytes(data[at + 12 : end])
    if masked_crc(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"record at byte {at}: bad payload")
    return payload, end + 4


class Vocabulary:
    """The library's tokenizer of a file, whether words can be encoded one by one, and which ids end a word."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        spec = json.loads(self.tokenizer.to_str())
        form = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "end_of_word_suffix": spec["model"].get("end_of_word_suffix")}
        self.by_word = form == BY_WORD and all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) and not x["normalized"] for x in spec["added_tokens"])
        self.ends = np.zeros(self.size, bool)
        for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = word.endswith(WORD_END)


class WordIds(dict):
    """Ids by the tokenizers library, as little-endian uint32 bytes; every distinct word is encoded once.

    The library's normalizer lower-cases characters and composes none across white space, its
    splitter cuts between letters or digits and such punctuation as PUNCTUATION and
    drops white space, and it holds no special string with white space. So the ids of
    a text are those of its pieces, cut at ASCII white space and before PUNCTUATION after
    an ASCII letter or digit, with A-Z lower-cased; texts in which a special string
    could stand are only cut at white space. A vocabulary of another form than BY_WORD, or with a
    special string that holds white space or does not begin with ``<|``, encodes whole texts.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokenizer, self.size, self.by_word, self.ends = vocabulary.tokenizer, vocabulary.size, vocabulary.by_word, vocabulary.ends

    def learn(self, words: set[bytes]) -> None:
        if len(self) > WORDS_KEPT:
            known = {w: self[w] for w in words.intersection(self)}
            self.clear()
            self.update(known)
        new, plain, other = words.difference(self), [], []
        for w in new:
            (plain if w.isalpha() or not w.isascii() and w.decode().isalpha() else other).append(w)
        encode = self.tokenizer.encode_batch_fast
        for i in range(0, len(plain), 256):  # words of letters: a line of them is cut where tokens end words
            part = plain[i : i + 256]
            ids = np.asarray(encode([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) == len(part):
                flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.update((w, flat[x:y]) for w, x, y in zip(part, cuts, cuts[1:]))
            else:
                other += part
        for i in range(0, len(other), 256):
            part = other[i : i + 256]
            for w, e in zip(part, encode([w.decode() for w in part], add_special_tokens=False)):
                self[w] = array("I", e.ids).tobytes()

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array, a null being empty."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64).cumsum()
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
            yield from self._ids(texts.slice(at, end - at))
            at = end

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        return self.encode_column(pa.array(list(texts), pa.binary()).cast(pa.string()))

    def _ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.by_word:
            for text in texts:
                yield np.asarray(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
            return
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), PUNCTUATION, r"\1 \2")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.cast(pa.binary()).to_pylist()
        known[:] = [w or b"" for w in known]
        self.learn(set(known) - {b""})
        got = [self.get(w, b"") for w in known]
        flat, n = np.frombuffer(b"".join(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)) // 4
        which = coded.indices.to_numpy()
        count = n[which]
        before = np.concatenate([[0], np.cumsum(count)])
        # word by word: its ids stand one after the other in ``flat``
        ids = flat[np.arange(before[-1]) + np.repeat((np.cumsum(n) - n)[which] - before[:-1], count)]
        cuts = before[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])].tolist()
        for x, y in zip(cuts, cuts[1:]):
            yield ids[x:y]


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}"
        tries = [f"{base}/.{name}-{task.taskAttemptId()}{x}" for x in (".rec", ".idx")]
        ids, end = WordIds(per_worker(("tokenizer", vocabulary), lambda: Vocabulary(vocabulary))), np.uint32(end_id)
        width = np.uint16 if max(ids.size - 1, end_id) < 2**16 else np.uint32
        rows = tokens = offset = 0
        index: list[int] = []
        with fs.open_output_stream(tries[0]) as out:
            while first is not None:
                for doc, body in zip(first["doc_id"].to_pylist(), ids.encode_column(first["text"])):
                    body = np.append(body, end).astype(width)
                    head = (NO_ID if doc is None else doc).to_bytes(8, "little", signed=True) + bytes([body.itemsize])
                    record = frame(head + body.tobytes())
                    out.write(record)
                    index += (offset, tokens)
                    rows, tokens, offset = rows + 1, tokens + len(body), offset + len(record)
                first = next(batches, None)
        with fs.open_output_stream(tries[1]) as out:
            out.write(np.asarray(index, np.uint64).tobytes())
        for x, kind in zip(tries, (".rec", ".idx")):
            fs.move(x, f"{base}/{name}{kind}")
        del ids
        tidy()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{folder}/{name}"], "docs": [rows], "tokens": [tokens]})

    return run


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Writes ``docs`` (doc_id, text, ...) in ascending doc_id order; (part, path, docs, tokens, start) of each file.

    Null ids come first, equal ids are ordered by a hash of the text (rows equal in both follow each
    other), null texts are empty and still get ``end_id``. A text of any length is one record. An
    empty table makes no files. Other columns are not read. The list of files meets in one
    task: one row a file.
    """
    spark = docs.sparkSession
    # the range bounds are sampled to the driver, so the tie-break is a hash and not the text
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = rows.mapInArrow(_write(folder, vocabulary, end_id), "part long, path string, docs long, tokens long").collect()
    before, listed = 0, []
    for f in sorted(files, key=lambda f: f.part):
        listed.append((f.part, f.path, f.docs, f.tokens, before))
        before += f.tokens
    out = spark.createDataFrame(listed, "part long, path string, docs long, tokens long, start long")
    return out.repartition(max(1, len(listed)), "part")


class RecordFile:
    """One data file with its index: records by number, in any order, each checked against its checksums."""

    def __init__(self, path: str):
        fs, where = filesystem(path)
        with fs.open_input_file(where + ".idx") as x:
            self.index = np.frombuffer(x.read(), np.uint64).reshape(-1, 2).astype(np.int64)
        self.data = fs.open_input_file(where + ".rec")
        self.ends = np.append(self.index[1:, 0], self.data.size())

    def __len__(self) -> int:
        return len(self.index)

    def __enter__(self) -> RecordFile:
        return self

    def __exit__(self, *_) -> None:
        self.data.close()

    def record(self, number: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, ids before it in the file, and its ids; IndexError if there is no such record."""
        if not 0 <= number < len(self.index):
            raise IndexError(f"record {number} of {len(self.index)}")
        offset, before = self.index[number].tolist()
        self.data.seek(offset)
        payload, _ = unframe(self.data.read(int(self.ends[number]) - offset))
        which = int.from_bytes(payload[:8], "little", signed=True)
        ids = np.frombuffer(payload, {2: np.uint16, 4: np.uint32}[payload[8]], offset=9)
        return None if which == NO_ID else which, before, ids.astype(np.uint32)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f in batch.to_pylist():
            with RecordFile(f["path"]) as file:
                if len(file) != f["docs"]:
                    raise ValueError(f"{f['path']}: {len(file)} records, {f['docs']} were written")
                for at in range(0, len(file), ROWS):
                    rows = [file.record(i) for i in range(at, min(at + ROWS, len(file)))]
                    doc, before, ids = zip(*rows)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc, pa.int64()), "start": pa.array([f["start"] + x for x in before], pa.int64()),
                        "n_tokens": pa.array(map(len, ids), pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    })


def fetch_records(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(part, record, doc_id, ids) of the ``wanted`` (part, record) of the files, as a shuffled read asks for them.

    Repeated wishes are answered each; one for a record that is not there fails. A task opens
    each file that it reads once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for w in batch.to_pylist():
                if w["path"] != path:
                    if file is not None:
                        file.data.close()
                    path, file = w["path"], RecordFile(w["path"])
                doc, _, ids = file.record(w["record"])
                rows.append((w["part"], w["record"], doc, ids.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "record", "doc_id", "ids"])

    at = wanted.select("part", "record").join(files.select("part", "path"), "part")
    return at.repartition("part").sortWithinPartitions("part", "record").mapInArrow(run, "part long, record long, doc_id long, ids binary")


def read_records(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files, each checked against its checksums."""
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "records")
    return read_records(write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2))
