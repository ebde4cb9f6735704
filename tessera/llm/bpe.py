"""Byte-level BPE with a minimal acyclic transducer as lexicon of frequent words.

Frequent words of the whole corpus are merged once, on the driver, and compiled into the
minimal acyclic automaton of their set. Each arc carries the number of words that sort
before the words through it, so a walk that ends in a final state sums up to the word's
place in sorted order, which is its place in the table of ids: a minimal perfect hash. The
automaton is a few flat arrays in one file, which executors memory-map. Words that
it does not hold are merged exactly, by rank.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, filesystem, per_worker, scratch_path, spread, table, tidy, written

#: The byte-level pattern that cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts whose characters beyond ASCII are letters all, which a plainer matcher cuts faster.
PLAIN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\u0080-\U0010ffff]+| ?[0-9]+| ?[^\sA-Za-z0-9\u0080-\U0010ffff]+|\s+(?!\S)|\s+"
#: Frequent words that the lexicon holds, and most bytes of one; results do not depend on either.
LEXICON, WORD_BYTES = 32_768, 64
#: Distinct words that a task counts, or keeps ids of, before it starts anew.
COUNTED, KEPT = 150_000, 100_000
#: Characters of text that are cut into words before their new words are looked up together, and bytes of text encoded before they are handed on.
TOGETHER, HANDED = 1 << 20, 4 << 20
#: Above every packed rank.
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def cutter() -> Callable[[str], list[str]]:
    """Cuts a text into words, as PATTERN does."""
    import regex

    every, plain, other = regex.compile(PATTERN).findall, re.compile(PLAIN, re.ASCII).findall, regex.compile(r"[^\x00-\x7f\p{L}]").search
    return lambda text: plain(text) if text.isascii() or not other(text) else every(text)


class PairTable:
    """What is known of pairs of ids, looked up for many at once: hashed to one slot, or where that is taken to one of a further table."""

    SLOTS = 18

    def __init__(self, packed: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(packed)) for x in (packed.keys(), packed.values()))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        while len(keys):
            known, value = np.full(1 << self.SLOTS, -1, np.int64), np.full(1 << self.SLOTS, NEVER, np.int64)
            slot = self._slot(keys, len(self.tables))
            known[slot], value[slot] = keys, values
            self.tables.append((known, value))
            out = known[slot] != keys  # overwritten by another
            keys, values = keys[out], values[out]

    def _slot(self, keys: np.ndarray, table: int) -> np.ndarray:
        odd = np.uint64(0x9E3779B97F4A7C15 + 2 * table * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        return (keys.view(np.uint64) * odd >> np.uint64(64 - self.SLOTS)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, NEVER where there is none."""
        out = np.full(len(keys), NEVER, np.int64)
        for i, (known, value) in enumerate(self.tables):
            slot = self._slot(keys, i)
            np.copyto(out, value[slot], where=known[slot] == keys)
        return out


class Merges:
    """The vocabulary: ids of bytes, merges of pairs, bytes of ids, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        # a << 20 | b to rank << 20 | id, so that a plain min() finds the next merge
        self.packed: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.packed.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.pair_table = PairTable(self.packed)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()

    @staticmethod
    def check(spec: dict) -> None:
        """ValueError unless the file describes plain byte-level BPE, as this module encodes it."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {
            "a normalizer": spec.get("normalizer") is None,
            "another splitter": cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"),
            "another model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "special strings that look at their neighbours": not any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }
        if wrong := [what for what, ok in plain.items() if not ok]:
            raise ValueError(f"the vocabulary has {', '.join(wrong)}; only plain byte-level BPE is encoded")

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the leftmost pair of lowest rank is merged."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.packed.get
        found = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) < NEVER:
            at = found.index(best)
            ids[at : at + 2] = [best & 0xFFFFF]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 20 | ids[at], NEVER)
            if at < len(found):
                found[at] = get(ids[at] << 20 | ids[at + 1], NEVER)
        return ids

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as uint32 bytes: in each round, every word that is not done merges one pair."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 1 < len(w) <= 64]
        for i, w in enumerate(words):
            if not 1 < len(w) <= 64:
                out[i] = array("I", self.merge(w)).tobytes()
        if not short:
            return out
        number = np.array(short)
        size = np.array([len(words[i]) for i in short])
        ids = np.array(self.byte_ids)[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        while len(number):
            start = np.cumsum(size) - size
            last = start + size - 1
            found = np.empty(len(ids), np.int64)
            found[:-1] = self.pair_table.find(ids[:-1] << 20 | ids[1:])
            found[last] = NEVER  # a word's last id has no right neighbour
            best = np.minimum.reduceat(found, start)
            done = best == NEVER
            if done.any():
                flat, of = ids.astype(np.uint32).tobytes(), np.nonzero(done)[0]
                for i, x, n in zip(number[of].tolist(), start[of].tolist(), size[of].tolist()):
                    out[i] = flat[4 * x : 4 * (x + n)]
                keep = np.repeat(~done, size)
                ids, found = ids[keep], found[keep]
                number, size, best = number[~done], size[~done], best[~done]
                if not len(number):
                    break
            word = np.repeat(np.arange(len(number)), size)
            at = np.nonzero(found == best[word])[0]
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            ids[at] = best & 0xFFFFF
            ids = np.delete(ids, at + 1)
            size = size - 1
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        n, get = len(ids), self.packed.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f >> 20, i, ids[i], ids[i + 1], f & 0xFFFFF) for i in range(n - 1) if (f := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k = new, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (f := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (f >> 20, x, ids[x], ids[y], f & 0xFFFFF))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The automaton of sorted distinct ``words`` and their id table, as flat arrays.

    States are made once for each set of suffixes, by the incremental method for sorted
    words: what follows the common prefix of two neighbours is frozen and looked up.
    """
    register: dict[tuple, int] = {}
    count: list[int] = []  # words below each frozen state
    arcs: list[tuple[int, int, int, int]] = []  # state, byte, next state, words before

    def freeze(node: list) -> int:
        key = (node[0], tuple((b, s) for b, s in node[1]))
        if key not in register:
            state, before = len(count), int(node[0])
            for b, s in node[1]:
                arcs.append((state, b, s, before))
                before += count[s]
            register[key] = state
            count.append(before)
        return register[key]

    path: list[list] = [[False, []]]  # [final, arcs] along the last word
    last = b""
    for word in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        for depth in range(len(last), same, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], freeze(node)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[depth - 1], freeze(node)))
    root = freeze(path[0])
    arcs.sort()
    final = np.zeros(len(count), np.uint8)
    for (is_final, _), state in register.items():
        final[state] = is_final
    a = np.array(arcs, np.int64).reshape(-1, 4)
    return {
        "key": a[:, 0] * 256 + a[:, 1], "to": a[:, 2], "before": a[:, 3], "final": final.astype(np.int64), "root": np.array([root]),
        "offset": np.cumsum([0, *map(len, ids)]), "ids": np.array([i for x in ids for i in x], np.int64),
    }


FIELDS = ("key", "to", "before", "final", "root", "offset", "ids")


def save_lexicon(lexicon: dict[str, np.ndarray], path: str) -> None:
    """One file: the seven lengths, then the seven arrays, all int64."""
    fs, where = filesystem(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(np.array([len(lexicon[f]) for f in FIELDS], np.int64).tobytes())
        for f in FIELDS:
            out.write(np.ascontiguousarray(lexicon[f], np.int64).tobytes())


class Lexicon:
    """A saved automaton, memory-mapped where the shared folder is mounted, else read once."""

    def __init__(self, path: str):
        from pyarrow import fs as pafs

        fs, where = filesystem(path)
        if isinstance(fs, pafs.LocalFileSystem):
            flat = np.memmap(where, np.int64, "r")
        else:
            with fs.open_input_stream(where) as f:
                flat = np.frombuffer(f.read(), np.int64)
        at = len(FIELDS)
        for name, n in zip(FIELDS, flat[: len(FIELDS)].tolist()):
            setattr(self, name, flat[at : at + n])
            at += n

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1: all words walk the automaton together, a byte at a time."""
        n = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(n) - n
        state, place = np.full(len(words), int(self.root[0])), np.zeros(len(words), np.int64)
        out = np.full(len(words), -1, np.int64)
        live = np.arange(len(words))
        depth = 0
        while len(live):
            done = n[live] == depth
            ended = live[done]
            ok = self.final[state[ended]] == 1
            out[ended[ok]] = place[ended[ok]]
            live = live[~done]
            if not len(live) or not len(self.key):
                break
            want = state[live] * 256 + flat[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            live, at = live[hit], at[hit]
            place[live] += self.before[at]
            state[live] = self.to[at]
            depth += 1
        return out

    def ids_at(self, place: int) -> bytes:
        return self.ids[self.offset[place] : self.offset[place + 1]].astype(np.uint32).tobytes()


class Encoder(dict):
    """Ids of whole texts as uint32 bytes; words met are kept, up to a bound, then only the last ones."""

    def __init__(self, merges: Merges, lexicon: str | None = None):
        import regex

        self.merges = merges
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.words = cutter()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) + ")").split if self.merges.special else None

    def learn(self, words: set[str]) -> None:
        if len(self) > KEPT:
            known = {w: self[w] for w in words.intersection(self)}
            self.clear()
            self.update(known)
        new = list(words.difference(self))
        raw = [w.encode() for w in new]
        places = self.lexicon.find(raw).tolist() if self.lexicon else [-1] * len(new)
        rare = [i for i, place in enumerate(places) if place < 0]
        self.update(zip([new[i] for i in rare], self.merges.merge_all([raw[i] for i in rare])))
        if self.lexicon:
            self.update((word, self.lexicon.ids_at(place)) for word, place in zip(new, places) if place >= 0)

    def cut(self, text: str) -> list[list[str] | bytes]:
        """The words of a text, in lists between the ids of special strings."""
        special = self.merges.special
        if not self.split or not any(s in text for s in special):
            return [self.words(text)]
        return [array("I", [special[p]]).tobytes() if p in special else self.words(p) for p in self.split(text)]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        waiting, size = [], 0
        for text in texts:
            waiting.append(self.cut(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._ids(waiting)
                waiting, size = [], 0
        yield from self._ids(waiting)

    def _ids(self, cut: list[list[list[str] | bytes]]) -> list[bytes]:
        self.learn(set().union(*[p for parts in cut for p in parts if not isinstance(p, bytes)]))
        get = self.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts]) for parts in cut]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        table = self.merges.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, np.uint32).tolist()]).decode("utf-8", "replace")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, counts = cutter(), Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch["text"]:
            counts.update(find(text.as_py() or ""))
            if len(counts) >= COUNTED:
                yield rows()
                counts.clear()
    yield rows()
    counts.clear()
    tidy()


def frequent_words(docs: DataFrame, n: int = LEXICON) -> list[bytes]:
    """The most frequent words of all texts, sorted: at most ``n``, whatever the size of the corpus.

    Counts fall into classes a tenth of an octave wide, of which there are a few hundred; the
    words of the highest classes that hold ``n`` together are taken. Words met once, and those of more
    than WORD_BYTES bytes, are left out.
    """
    counted = spread(docs.select("text")).mapInArrow(_count, "word string, n long").where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    grade = F.floor(10 * F.log2("n")).cast("int")
    counts = written(counted.where("n > 1").select("word", grade.alias("grade")), "words")
    left, least = n, None
    for r in sorted(counts.groupBy("grade").count().collect(), key=lambda r: -r.grade):
        left -= r["count"]
        if left < 0:
            break
        least = r.grade
    words = [] if least is None else sorted(r.word.encode() for r in counts.where(F.col("grade") >= least).select("word").collect())
    drop(counts)
    return words


def build_lexicon(docs: DataFrame, vocabulary: str, n: int = LEXICON) -> str:
    """Path of the lexicon of the frequent words of ``docs``."""
    merges, words = Merges(vocabulary), frequent_words(docs, n)
    path = scratch_path(docs.sparkSession, "lexicon") + "/words.bin"
    save_lexicon(compile_lexicon(words, [merges.merge(w) for w in words]), path)
    return path


def encoded(docs: DataFrame, vocabulary: str, lexicon: str | None = None, keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """The columns ``keep`` and ids, with ``decode`` also decoded, of ``docs`` (text, ...): ids as little-endian uint32 binary.

    A null or empty text has no ids. Special strings in a text become their ids. Texts of any
    length are one row. Rows stay as they are, repeated or not, and none come of an empty
    table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(per_worker(("merges", vocabulary), lambda: Merges(vocabulary)), lexicon)
        for batch in batches:
            texts, at = batch["text"], 0
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().cumsum()
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HANDED, "right")))
                ids = list(encoder.encode_all(t.as_py() or "" for t in texts.slice(at, end - at)))
                columns = [batch[c].slice(at, end - at) for c in keep] + [pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(map(encoder.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"][: len(columns)])
                at = end
        del encoder
        tidy()

    rows = docs.select(*keep, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["ids binary"] + ["decoded string"] * decode
    return spread(rows).mapInArrow(run, ", ".join(kinds))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, vocabulary = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    out = encoded(docs, vocabulary, build_lexicon(docs, vocabulary))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
