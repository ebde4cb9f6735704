"""WARC archives in Zstandard form: a dictionary in the leading skippable frame, one frame a record.

Records of equal payload are stored once: the one of the largest page id is a response,
the others revisit it and keep only the HTTP header, whose Content-Length is the full
payload's. An archive is read frame by frame; each record's header lines, block length,
payload length and digest are checked.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, join_heavy, scratch_path, table, written

#: Magic number of the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICT_BYTES, SAMPLE_BYTES = 32_768, 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
#: Bytes asked of the file at once, and records handed on together.
READ, ROWS = 1 << 20, 1024


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kept_by: int | None) -> bytes:
    """A response, or if ``kept_by`` names another page, a revisit of that page's record."""
    revisit = kept_by is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{kept_by}>", f"WARC-Profile: {PROFILE}", "WARC-Truncated: length"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload; ValueError if it isn't sound."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}  # names are case-insensitive
    if not found or first != "WARC/1.1" or not fields.get("content-length", "").isdigit():
        raise ValueError(f"not a record: {first[:40]!r}")
    missing = [x for x in ("warc-record-id", "warc-type", "warc-payload-digest", "warc-target-uri") if x not in fields]
    if missing:
        raise ValueError(f"a record without {', '.join(missing)}")
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: block of {len(rest) - 4} bytes, {size} declared")
    http, found, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")), None)
    name = lambda x: int(x) if (x := fields[x].removeprefix("<urn:page:").removesuffix(">")) else None
    kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if not found or declared is None or kind == "response" and (len(payload) != declared or digest(payload) != sha):
        raise ValueError(f"{fields['warc-record-id']}: payload does not match its header")
    return {
        "page_id": name("warc-record-id"), "url": fields["warc-target-uri"], "payload_bytes": declared, "payload_digest": sha,
        "record_type": kind, "refers_to": name("warc-refers-to") if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples, or none where they are too few or too alike."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to a stream; the dictionary is trained on the first SAMPLE_BYTES of them."""

    def __init__(self, out):
        self.out, self.packer, self.first = out, None, []

    def add(self, data: bytes) -> None:
        if self.packer:
            self.out.write(self.packer.compress(data))
            return
        self.first.append(data)
        if sum(map(len, self.first)) >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        words = dictionary(self.first)
        self.out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
        with_dict = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **with_dict)
        for data in self.first:
            self.out.write(self.packer.compress(data))
        self.first = []

    def close(self) -> None:
        if not self.packer:
            self._begin()


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one from each frame."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    words = stream.read(size)
    if len(words) != size:
        raise ValueError("the dictionary frame is cut short")
    if words[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    reader = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}))
    left = b""
    while left or (left := stream.read(READ)):
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(left))
            if one.eof:
                left = one.unused_data
                break
            if not (left := stream.read(READ)):
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.zst"
        temporary, n = f"{base}/.{name}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(temporary, compression=None) as out:
            archive = ArchiveWriter(out)
            while first is not None:
                for page, url, html, keeper in zip(*(first[c].to_pylist() for c in ("page_id", "url")), first["html"].cast(pa.binary()), first["keeper"].to_pylist()):
                    archive.add(record(page, url, html.as_py() or b"", keeper if keeper != page else None))
                    n += 1
                first = next(batches, None)
            archive.close()
        fs.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return run


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html, ...), one a task; (path, records) of each.

    A null html is an empty payload, a null url an empty one; line breaks in a url go. Of
    equal payloads of at least ``min_revisit_bytes`` bytes the largest page_id is the
    response, and so is every repeated row of it; where all ids are null, all are
    responses. A page of any length is one record. An empty table makes no archive. Other
    columns are not read.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("bytes"))
    rows = rows.withColumn("sha", F.when(F.col("bytes") >= min_revisit_bytes, F.col("sha")))
    same = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    same = written(same.where("n > 1"), "payloads")
    joined = join_heavy(rows, same, "sha", F.xxhash64("page_id"), pages.count())
    return joined.select("page_id", "url", "html", "keeper").mapInArrow(_write(folder), "path string, records long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in columns.items()], names=list(columns))

    for batch in batches:
        for f in batch.to_pylist():
            fs, path = filesystem(f["path"])
            n, rows = 0, []
            with fs.open_input_stream(path, compression=None) as stream:
                for data in read_archive(stream):
                    rows.append(parse(data))
                    rows[-1]["payload"] = None  # the digest has been checked
                    n += 1
                    if len(rows) == ROWS:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)
            if n != f["records"]:
                raise ValueError(f"{path}: {n} records, {f['records']} were written")


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the files (path, records)."""
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = written(write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")), "archives")
    return read_warc(listed.repartition(max(1, listed.count()), "path")).drop("url")


#: Base32 of a SHA-1 is its 160 bits in 32 groups of five.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
k AS (SELECT sha, max(page_id) AS keeper FROM p GROUP BY sha),
v AS (SELECT sha, list_reduce(list_transform(range(0, 40), lambda i: substr(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(sha, i + 1, 1))], 1, 4)), lambda a, b: a || b) AS bits, keeper FROM k),
d AS (SELECT sha, keeper, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0b' || substr(bits, 5 * i + 1, 5))::INT), 1)), '') AS payload_digest FROM v)
SELECT page_id, strlen(body) AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN d USING (sha)
"""
