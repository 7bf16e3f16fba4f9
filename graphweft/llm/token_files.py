"""Token ids in binary files, in id order, and back.

File format, frame after frame: magic, counts, then the documents' ids, their lengths, the frame's
ids by falling frequency, one control byte for each four values, and the values' bytes. A value is an
id's rank in its frame, in 1 to 4 bytes as its two control bits say; frequent ids take one byte.
Frames are self-contained and bounded, so a writer holds one frame and a reader decodes one at a time.

Plan: bounds of the id ranges come from a scan of the id column alone; texts are tokenised once, the
ids (2 bytes each where the vocabulary allows) go to their range in one shuffle, are sorted there and
written. A task writes under a name of its own; the manifest, saved once the tasks are done, names the
files that count, so a repeated or lost task leaves no trace in the result. Starts come from a prefix
sum over the manifest's totals, one row per file.

Defined results: a null text has the end id alone; a null doc id sorts first; repeated doc ids are all
kept, side by side in any order; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, byte_slices, input_bytes, lean, shuffle_partitions
from .tokenizing import WordCoder, coder, vocabulary_size

_MAGIC = b"GWT1"
_HEAD = struct.Struct("<4sIQIIQ")
FRAME_IDS = 1 << 21
#: Text that one file takes; a file is written by one task and read by one.
FILE_BYTES = 256 << 20
#: Bytes of each of the four values of a control byte.
_WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Bits of a value by its bytes.
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    widths = _WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(widths, dtype=np.int64) - widths
    # four bytes from each place of the data on, of which a value has the first ones
    whole = np.ndarray((len(data),), "<u4", b"".join((data, bytes(3))), strides=(1,))
    return whole[starts] & _MASKS[widths]


def encode_frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    by_rank = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = encode_values(rank[ids])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    own = np.array([x or 0 for x in doc_ids], "<i8")
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(by_rank), len(control), len(data))
    return b"".join((head, known.tobytes(), own.tobytes(), lengths.astype("<u4").tobytes(), by_rank.tobytes(), control, data))


def decode_frames(stream):
    """(doc ids, lengths, ids) of each frame of an open file."""
    while head := stream.read(_HEAD.size):
        magic, n_docs, n_ids, n_ranks, n_control, n_data = _HEAD.unpack(head)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        known = np.frombuffer(stream.read(n_docs), np.uint8)
        own = np.frombuffer(stream.read(8 * n_docs), "<i8")
        lengths = np.frombuffer(stream.read(4 * n_docs), "<u4").astype(np.int64)
        by_rank = np.frombuffer(stream.read(4 * n_ranks), "<u4")
        control, data = stream.read(n_control), stream.read(n_data)
        yield [int(x) if k else None for x, k in zip(own, known)], lengths, by_rank[decode_values(control, data, n_ids)]


def tokenize(docs: DataFrame, path: str, end_id: int, bounds: list[int], id_col: str, text_col: str) -> DataFrame:
    """(range, doc_id, ids) with the end id appended; ids in 2 bytes each where the vocabulary allows, else 4."""
    width = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"
    edges = np.array(bounds, dtype=np.int64)

    @lean
    def run(batches):
        seen = 0
        with coder(WordCoder, path) as words:
            for whole in batches:
                for batch in byte_slices(whole, "text"):
                    ids = batch.column("doc_id")
                    own = np.asarray(ids.fill_null(np.iinfo(np.int64).min), dtype=np.int64)
                    low, high = np.searchsorted(edges, own, "left"), np.searchsorted(edges, own, "right")
                    # a doc id that fills whole ranges is dealt over all of them
                    ranges = low + (seen + np.arange(len(own))) % (high - low + 1)
                    seen += len(own)
                    flat, ends = words.encode(batch.column("text"), end_id)
                    raw = pa.py_buffer(flat.astype(width))
                    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends * np.dtype(width).itemsize), raw])
                    yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), ids, coded.cast(pa.binary())], ["range", "doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "range int, doc_id long, ids binary"), width


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes all documents in id order and returns the lazy manifest (range, path, n_docs, n_tokens): save it, then read it.

    ``folder``: a URI that pyarrow.fs and all executors can write. Without ``n_files`` there is a file for
    each shuffle partition, and more where one would take over FILE_BYTES of text.
    """
    n_files = n_files or max(shuffle_partitions(docs.sparkSession), input_bytes(docs, text_col) // FILE_BYTES)
    bounds = docs.select(F.col(id_col).cast("long").alias("x")).approxQuantile("x", [i / n_files for i in range(1, n_files)], 0.2 / n_files)
    ids, width = tokenize(docs, path, end_id, [int(x) for x in bounds], id_col, text_col)

    @lean
    def write(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        name, out, where = None, None, None
        held_ids, held, n_held, n_docs, n_tokens = [], [], 0, 0, 0

        def flush():
            lengths = np.array([len(x) for x in held], np.int64)
            out.write(encode_frame(held_ids, lengths, np.concatenate(held).astype(np.int64)))

        for batch in batches:
            for where, doc_id, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None:
                    name = f"{root}/tokens-{where:06d}-{uuid.uuid4().hex}.gwt"
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(name)
                held_ids.append(doc_id)
                held.append(np.frombuffer(raw, width))
                n_held += len(held[-1])
                n_docs += 1
                if n_held >= FRAME_IDS:
                    flush()
                    n_tokens += n_held
                    held_ids, held, n_held = [], [], 0
        if out is not None:
            if held:
                flush()
                n_tokens += n_held
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([where], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
                ["range", "path", "n_docs", "n_tokens"],
            )

    dealt = ids.repartitionById(n_files, F.col("range")).sortWithinPartitions("doc_id")
    return dealt.mapInArrow(write, "range int, path string, n_docs long, n_tokens long")


def read_token_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, ``ids_crc32`` in place of the ids with ``digest``."""
    spark = manifest.sparkSession
    kind = "ids_crc32 long" if digest else "ids array<long>"

    @lean
    def read(batches):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(path) as stream:
                    for doc_ids, lengths, ids in decode_frames(stream):
                        ends = np.cumsum(lengths)
                        ids = np.ascontiguousarray(ids, dtype="<u4")
                        parts = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                        last = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last],
                            ["doc_id", "start", "n_tokens", kind.split()[0]],
                        )
                        start += int(ends[-1])

    # One row per file: their number doesn't grow with the rows of a file.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "range")
    dealt = placed.repartitionById(shuffle_partitions(spark), F.col("range")).select("path", "start")
    return dealt.mapInArrow(read, f"doc_id long, start long, n_tokens long, {kind}")


def token_digests(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes the files in the shared folder, reads them back, and returns (doc_id, start, n_tokens, ids_crc32)."""
    tables = SharedTables(docs.sparkSession)
    folder = f"{tables.root}/tokens"
    manifest = tables.save(write_token_files(docs, folder, path, end_id), "manifest")
    return read_token_files(manifest, folder, digest=True)
