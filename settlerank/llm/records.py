"""Token ids in length-delimited binary records.

A file of the set ("shard") holds the sequences of neighbouring documents in order. A record is

    length of the payload (8 bytes) | masked crc of the length (4) | payload | masked crc of the payload (4)

little-endian, with the checksum ((crc >> 15 | crc << 17) + 0xa282ead8) of the CRC-32 in zlib. The payload is the document
id (8 bytes, signed) and the ids, in the width that the vocabulary needs (2 or 4 bytes). Beside each shard lies an
index of fixed entries (offset of the record, payload length, ids before it in the shard: 8 bytes each), with which a
reader takes records in any order.

Tasks write under names that no other attempt uses; the manifest, a Parquet table that Spark commits, lists the files
of the attempts that succeeded, so lost executors and repeated tasks leave nothing wrong behind.

Null texts count as empty: a record with the end id alone. Rows with a null id come first, under ``NULL_ID``. Repeated
rows give repeated records (ties in order of their text's hash). An empty table gives no shard and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from settlerank.llm.arrays import parts, plain
from settlerank.llm.tokens import encoder

#: Fixed values of the format.
MASK_DELTA = 0xA282EAD8
NULL_ID = -(1 << 63)
INDEX_ENTRY = "<qqq"

_MANIFEST = "shard long, file string, records long, ids long, first_id long, width int"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(stream, offset: int | None = None) -> bytes:
    """The payload of the next record, or of the one at ``offset``; an error where a checksum does not fit."""
    if offset is not None:
        stream.seek(offset)
    head = stream.read(12)
    length, crc = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("a record's length is damaged")
    body = stream.read(length + 4)
    if len(body) != length + 4 or masked_crc(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:-4]


def _open(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else \
        (fs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every text and write shards in ascending order of the id; gives the manifest.

    ``folder`` must be reachable from all executors. Texts are shuffled once, by range of the id and of a hash of the
    text, so rows of one id (or of none) spread as well.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")) \
        .withColumn("_tie", F.xxhash64("_text"))
    order = ["_id", "_tie"]
    rows = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order)
    small = _vocabulary(tokenizer_path) <= 1 << 16 and end_id < 1 << 16
    width = 2 if small else 4
    kind = "<u2" if small else "<u4"

    def write(batches):
        words = encoder(tokenizer_path, width)
        end = np.array([end_id], kind).tobytes()
        system, base = _open(folder)
        shard = TaskContext.get().partitionId()
        name, data, index = f"shard-{shard:06d}-{uuid.uuid4().hex}", None, None
        offset = records = total = 0
        first = None
        for batch in parts(batches, 500):
            if data is None and batch.num_rows:
                system.create_dir(base, recursive=True)
                data, index = (system.open_output_stream(f"{base}/{name}.{x}") for x in ("rec", "idx"))
            ids = [NULL_ID if i is None else i for i in batch.column(0).to_pylist()]
            first = ids[0] if first is None and ids else first
            for doc, found in zip(ids, words.encode(plain(batch.column(1)).to_pylist())):
                payload = struct.pack("<q", doc) + b"".join(found) + end
                record = frame(payload)
                data.write(record)
                index.write(struct.pack(INDEX_ENTRY, offset, len(payload), total))
                offset, records, total = offset + len(record), records + 1, total + (len(payload) - 8) // width
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([name]), pa.array([records], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([first], pa.int64()), pa.array([width], pa.int32())],
                ["shard", "file", "records", "ids", "first_id", "width"])

    rows.drop("_tie").mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def records_of(folder: str, file: str) -> Iterator[tuple[int, int, int, int]]:
    """The index entries of a shard: number, offset, payload length, ids before it."""
    system, base = _open(folder)
    with system.open_input_stream(f"{base}/{file}.idx") as stream:
        at = 0
        while entry := stream.read(struct.calcsize(INDEX_ENTRY)):
            yield at, *struct.unpack(INDEX_ENTRY, entry)
            at += 1


def read_one(folder: str, file: str, offset: int, width: int) -> tuple[int, np.ndarray]:
    """Document id and ids of the record at an offset, for shuffled reads."""
    system, base = _open(folder)
    with system.open_input_file(f"{base}/{file}.rec") as stream:
        payload = unframe(stream, offset)
    return struct.unpack("<q", payload[:8])[0], np.frombuffer(payload[8:], f"<u{width}")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read all shards back, one task a shard: doc_id, start, n_tokens, ids_crc32, file, offset.

    ``start`` adds the ids of earlier shards: running sums over the manifest, which has one row a shard.
    """
    manifest = read_manifest(spark, folder)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "file", "width", before.alias("before"))
    count = max(1, manifest.count())
    shards = shards.repartitionByRange(count, "shard")

    def read(batches):
        system, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                with system.open_input_stream(f"{base}/{row['file']}.rec", buffer_size=1 << 20) as stream:
                    for _, offset, length, local in records_of(folder, row["file"]):
                        payload = unframe(stream)
                        if len(payload) != length:
                            raise ValueError("the index does not fit the records")
                        ids = np.frombuffer(payload, f"<u{row['width']}", offset=8)
                        doc = struct.unpack("<q", payload[:8])[0]
                        found.append((None if doc == NULL_ID else doc, row["before"] + local, len(ids),
                                      zlib.crc32(ids.astype("<u4").tobytes()), row["file"], offset))
                        if len(found) == 5000:
                            yield _batch(found)
                            found = []
                yield _batch(found)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    columns = list(zip(*found)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["doc_id", "start", "n_tokens", "ids_crc32", "file", "offset"])
