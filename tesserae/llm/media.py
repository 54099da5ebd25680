"""Media columns: content-addressed payloads in tar shards.

Each task packs its rows' payloads, stored as 8-bit greyscale PNG images that
are 64 samples wide, into tar shards in the shared folder. A payload's name is
its SHA-256, and a shard holds it once; a row carries digest, shard, offset and
length. Shards have names of their own, so a task that runs twice leaves an
unused file and no wrong row; the rows are committed with the manifest (a
Parquet table). Metadata columns come from range reads of the first HEADER
bytes only; payloads are read back by (offset, length). Files are reached
through pyarrow's filesystems, so the shared folder may be any store that they
know. No rows are shuffled: a row points at the shard of the task that wrote
it, so a text that fills a third of the table costs one payload a shard.

Defined results: null and empty texts have 0 bytes and a payload of 64 zero
bytes. Equal texts give equal values. Repeated rows stay; other columns are
not read; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, materialize, shared_dir, texts_of

WIDTH = 64
#: Bytes of a shard after which a task begins another: bounds a shard and the digests a task remembers.
SHARD_BYTES = 256 << 20
#: zlib level of the stored images.
LEVEL = 1
BLOCK = tarfile.BLOCKSIZE
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, chunk length, chunk type and the 13 bytes of IHDR.
HEADER = 8 + 4 + 4 + 13

MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of WIDTH, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_image(media: bytes) -> bytes:
    width, height, _ = image_header(media[:HEADER])
    at, data = len(SIGNATURE), []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are stored")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, header: tuple[int, int, int]) -> str:
    """Size, sum, samples that are not 0, samples of 128 or more, and summed steps along lines."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    steps = int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum())
    return f"{header[0]}x{header[1]}x{header[2]} sum={int(x.sum(dtype=np.int64))} set={np.count_nonzero(x)} high={np.count_nonzero(x & 128)} steps={steps}"


class ShardWriter:
    """Writes one task's tar shards; ``put`` gives (shard, offset, length)."""

    def __init__(self, folder: str, task: int, most: int = SHARD_BYTES) -> None:
        self.folder, self.task, self.most = folder, task, most
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.out, self.at, self.name, self.held = None, 0, "", {}

    def put(self, digest: str, media) -> tuple[str, int, int]:
        """media: called only if the open shard does not hold the digest."""
        if digest in self.held:
            return self.held[digest]
        body = media()
        if self.out is None:
            self.name, self.at, self.held = f"shard-{self.task:06d}-{uuid.uuid4().hex}.tar", 0, {}
            self.store.create_dir(self.root, recursive=True)
            self.out = self.store.open_output_stream(posixpath.join(self.root, self.name))
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + body + b"\0" * (-len(body) % BLOCK))
        place = self.held[digest] = (self.name, self.at + len(head), len(body))
        self.at += len(head) + -(-len(body) // BLOCK) * BLOCK
        if self.at >= self.most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.out, self.held = None, {}


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """The manifest, committed as a table: doc_id, n_bytes, digest, shard, offset, length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder, TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((doc_id, n, digest, *writer.put(digest, lambda p=payload: encode_image(p))))
            yield _batch(rows, MANIFEST)
        writer.close()

    return materialize(map_batches(docs.select("doc_id", "text"), write, MANIFEST), "media-manifest")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def read_metadata(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with width, height and bits, from reads of HEADER bytes each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Shards(folder)
        for batch in batches:
            yield _batch([(*r, *image_header(files.read(r[3], r[4], HEADER))) for r in _rows(batch)], f"{MANIFEST}, width int, height int, bits int")

    return map_batches(manifest, read, f"{MANIFEST}, width int, height int, bits int")


def read_features(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes give when read back; each place is read once a run of its rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, known = Shards(folder), None, {}
        for batch in batches:
            rows = []
            for doc_id, n, digest, name, offset, length in _rows(batch):
                if name != shard:
                    shard, known = name, {}
                if offset not in known:
                    header = image_header(files.read(name, offset, HEADER))
                    media = files.read(name, offset, length)
                    payload = decode_image(media)
                    sha = hashlib.sha256(payload).hexdigest()
                    if sha != digest:
                        raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                    known[offset] = (len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, header))
                rows.append((doc_id, n, *known[offset]))
            yield _batch(rows, f"doc_id long, n_bytes long, {FEATURES}")

    return map_batches(manifest, read, f"doc_id long, n_bytes long, {FEATURES}")


def _rows(batch: pa.RecordBatch):
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


class Shards:
    """Range reads; the last shard stays open."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.store.open_input_file(posixpath.join(self.root, name))
        return self.file.read_at(length, offset)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in shards, read back and described."""
    folder = shared_dir(spark, "media")
    return read_features(write_shards(documents(spark, sf_dir), folder), folder)
