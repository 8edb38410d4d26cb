"""Token files: independent zstd frames of uint32 ids, a document index and a trailing seek table.

Layout of a file: zstd frames of little-endian uint32 ids, each of whole documents; a skippable frame with
the document index; a skippable frame with the seek table of the public zstd seekable format (compressed
size, decompressed size and the low half of XXH64 of each frame, then count, flags and magic).
A reader fetches the table and the index and then only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.encode import encoder, tokenizer_path
from factloom.llm.spread import in_order, partitions, pick, starts_of
from factloom.llm.text import slices
from factloom.session import checkpoint_folder, cut_lineage

# Fixed values of the seekable format.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, ENTRY, HEAD = struct.Struct("<IBI"), struct.Struct("<III"), struct.Struct("<II")
FRAME_IDS = 1 << 17
NO_ID = np.int64(-(2**63))


def _entry(raw: bytes, packed: bytes) -> tuple[int, int, int]:
    return len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Writes documents one after the other; memory holds one frame and the index."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.n_held, self.entries, self.docs, self.sizes, self.frames = 0, [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.frames.append(len(self.entries))
        self.n_held += len(ids)
        if self.n_held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype("<u4").tobytes()
            packed = self.pack.compress(raw)
            self.sink.write(packed)
            self.entries.append(_entry(raw, packed))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack.compress(np.array([self.docs, self.sizes, self.frames], "<i8").tobytes())
        blob = HEAD.pack(INDEX_MAGIC, len(index)) + index
        self.entries.append((len(blob), 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), WITH_CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(blob + HEAD.pack(TABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = self._at(end - FOOTER.size - count * ENTRY.size, count * ENTRY.size)
        self.entries = list(ENTRY.iter_unpack(table))
        self.places = np.cumsum([0] + [e[0] for e in self.entries])
        blob = self._at(int(self.places[-2]), self.entries[-1][0])[HEAD.size :]
        self._check(blob, len(self.entries) - 1)
        self.docs, self.sizes, self.frames = np.frombuffer(zstandard.decompress(blob), "<i8").reshape(3, -1)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _check(self, raw: bytes, k: int) -> None:
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k][2]:
            raise ValueError(f"frame {k} is damaged")

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.decompress(self._at(int(self.places[k]), self.entries[k][0]), max_output_size=max(1, self.entries[k][1]))
        self._check(raw, k)
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position in the file, ids) of all documents or of the positions ``wanted``; only their frames are read."""
        at = np.arange(len(self.docs)) if wanted is None else np.sort(wanted)
        for k in np.unique(self.frames[at]):
            ids = self.frame(int(k))
            origin = self.starts[np.searchsorted(self.frames, k)]
            for d in at[self.frames[at] == k]:
                lo = int(self.starts[d] - origin)
                yield int(d), ids[lo : lo + int(self.sizes[d])]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(df: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, order: list[Column] | None = None) -> DataFrame:
    """Encodes ``doc_id``, ``text`` and writes token files in ascending ``doc_id`` order; returns their manifest.

    Rows are dealt by range of ``doc_id`` (ties by a hash of the text, ids that are null last), one file a
    task under a fresh name, so a repeated task leaves at most a file that no manifest names. Null texts are empty;
    repeated rows are written as often as they come; an empty table gives an empty manifest. The folder
    must be one that the executors share and that pyarrow can open (file, s3, gs or hdfs); by default a
    new one beside the checkpoints. Manifest: ``part``, ``file``, ``n_docs``, ``n_ids``, ``start``.
    """
    spark = df.sparkSession
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    path = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        writer, sink, n, part, name = None, None, 0, 0, ""
        for batch in batches:
            for piece in slices(batch, "text"):
                if writer is None:
                    part = piece.column(2)[0].as_py()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)  # by its name it would be compressed once more
                    writer = Writer(sink)
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder(path).encode(piece.column(1).fill_null("")), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                    n += len(ids) + 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder.rstrip('/')}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

    rows = pick(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = in_order(rows, order or [F.col("doc_id"), F.xxhash64("text")], partitions(spark))
    manifest = cut_lineage(dealt.mapInArrow(write, "part int, file string, n_docs long, n_ids long"))
    return starts_of(manifest, "part", "n_ids").withColumnRenamed("_before", "start")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """All documents of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, on request, ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = _open(uri)
                with fs.open_input_file(base) as source:
                    reader, rows = Reader(source), []
                    for d, ids in reader.documents():
                        raw = ids.tobytes()
                        rows.append((None if reader.docs[d] == NO_ID else int(reader.docs[d]), begin + int(reader.starts[d]), len(ids), zlib.crc32(raw), raw))
                        if len(rows) >= 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(columns[: len(names)])], names)

    spark = manifest.sparkSession
    return manifest.select("file", "start").repartition(partitions(spark)).mapInArrow(read, schema)
