"""WARC archives compressed record by record with a shared Zstandard dictionary.

A file begins with a skippable frame that holds the dictionary; every record
after it is one Zstandard frame of its own, so a record can be read from its
offset alone. The dictionary is built from the first records of the same file.
Records of a payload that another record holds are revisits without the payload.

Tasks write their own files through the file system of the given folder (a
temporary name, then a rename), so a repeated task replaces its files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise, scratch

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
#: Records whose bytes a dictionary is built from.
SAMPLE_BYTES = 2 << 20
#: A file is closed beyond so many payload bytes.
FILE_BYTES = 256 << 20
LEVEL = 5
_INDEX = "file string, offset long, length long, page_id long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _dictionary(samples: list[bytes]):
    import zstandard as zstd

    if len(samples) >= 16:
        try:
            return zstd.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
        except zstd.ZstdError:  # samples too short or too much alike for statistics
            pass
    return zstd.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def record(page_id, url, payload: bytes, digest: str, response_id, date: str) -> bytes:
    """One WARC record; ``response_id`` is the page a revisit refers to, None for a response."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    revisit = response_id is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
            "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(str(url).split()))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {name(response_id)}", f"X-Refers-To-Page-Id: {response_id}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _File:
    """One archive: holds records back until the dictionary can be built, then writes each as a frame."""

    def __init__(self, system, path: str):
        self.system, self.path = system, path
        self.held, self.held_bytes, self.payload_bytes = [], 0, 0
        self.out = system.open_output_stream(f"{path}.tmp", compression=None)
        self.packer = None
        self.at = 0
        self.index = []

    def add(self, page_id, raw: bytes) -> None:
        self.payload_bytes += len(raw)
        if self.packer is None:
            self.held.append((page_id, raw))
            self.held_bytes += len(raw)
            if self.held_bytes >= SAMPLE_BYTES:
                self.open()
        else:
            self.write(page_id, raw)

    def open(self) -> None:
        import zstandard as zstd

        made = _dictionary([raw[: SAMPLE_BYTES // 8] for _, raw in self.held])
        body = made.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        self.at = 8 + len(body)
        self.packer = zstd.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True)
        for page_id, raw in self.held:
            self.write(page_id, raw)
        self.held = []

    def write(self, page_id, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.index.append((self.path, self.at, len(frame), page_id))
        self.at += len(frame)

    def close(self) -> pd.DataFrame:
        if self.packer is None:
            self.open()
        self.out.close()
        self.system.move(f"{self.path}.tmp", self.path)
        return pd.DataFrame(self.index, columns=["file", "offset", "length", "page_id"]).astype({"page_id": "Int64"})


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; return the index ``(file, offset, length, page_id)``.

    Of equal payloads the row with the largest page_id is the response (rows that
    tie on it are all responses; where no row has an id, all are) and the others
    revisit it. A null html is the empty payload. Other columns are not archived.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    rows = rows.join(first.filter("n > 1").drop("n"), "digest", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        task, k, file = TaskContext.get().partitionId(), 0, None
        for part in parts:
            for page_id, link, body, refers in part.itertuples(index=False):
                if file is None:
                    file = _File(system, f"{root}/part-{task:06d}-{k:04d}.warc.zst")
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers)]
                file.add(ids[0], record(ids[0], link, body, payload_digest(body), ids[1], date))
                if file.payload_bytes >= FILE_BYTES:
                    yield file.close()
                    file, k = None, k + 1
        if file is not None:
            yield file.close()

    return materialise(rows.mapInPandas(write, _INDEX), "index")


def read_archive(system, path: str) -> Iterator[bytes]:
    """The records of one archive, frame by frame, with the dictionary of its first frame."""
    import zstandard as zstd

    with system.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path}: no dictionary frame")
        unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(f.read(size)))
        frame, out, rest = unpack.decompressobj(), [], b""
        while chunk := rest or f.read(1 << 18):
            out.append(frame.decompress(chunk))
            rest = b""
            if frame.eof:
                yield b"".join(out)
                rest = frame.unused_data
                frame, out = unpack.decompressobj(), []


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of every record.

    The digest of a response is computed from the payload that was read and must
    equal the archived one; a revisit has the archived digest and a null payload.
    """
    files = index.select("file").distinct()

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _filesystem(folder)
        for part in parts:
            for path in part["file"]:
                out, size = [], 0
                for raw in read_archive(system, path):
                    head, http, payload = parse(raw)
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and payload_digest(payload) != digest:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023,E731
                    out.append((number("X-Page-Id"), head.get("WARC-Target-URI"), int(http["Content-Length"]), digest,
                                head["WARC-Type"], number("X-Refers-To-Page-Id"), None if revisit else payload))
                    size += len(raw)
                    if size >= 8 << 20:
                        yield _frame(out)
                        out, size = [], 0
                yield _frame(out)

    return files.repartition(max(1, files.count())).mapInPandas(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
