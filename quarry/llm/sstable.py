"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of ids, in ascending order (null ids first):

    8 bytes   magic
    blocks    entries (shared, unshared and value lengths as varints, key suffix, value), each
              RESTART-th with its whole key; then the restart offsets (u32), their number (u32)
              and a crc32 of all that (u32)
    index     one entry per block: last key, offset, length
    filter    a Bloom filter of the ids: BITS_PER_KEY bits a key, PROBES probes
    footer    FOOTER: places of index and filter, entries, ids in all, bytes of an id, crc32 of
              index and filter, magic

A key is 1 byte (0: null id), the id with its sign bit flipped, big-endian, and a 4-byte number that
tells apart rows with the same id. A value is the token ids, in 2 bytes each where the vocabulary
fits, else 4. Little-endian throughout, but for keys. A look-up asks the filter, finds the block by
binary search in the index, then the restart by binary search in the block.

Shards are written under the shared folder by tasks that take a range of ids each. A task writes to
a name of its own and moves the file when whole; the written manifest names the files of the tasks
that count, so a repeated task leaves only a stray file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage, table, text_or_empty, work_dir
from quarry.llm.encoding import WordEncoder, parts

MAGIC = b"QSSTAB01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
END_ID = 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", number)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _probes(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(PROBES)]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Entries must come in ascending key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.entries = self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        values = np.frombuffer(ids, "<u4")
        value = values.astype("<u2").tobytes() if self.width == 2 else ids
        shared = 0
        if self.n % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key[:9])
        self.entries += 1
        self.ids += len(values)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if not self.n:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append((self.last, self.at, len(body)))
        self._put(body)
        self.block, self.restarts, self.n = bytearray(), [], 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        n_bits = max(64, BITS_PER_KEY * len(self.keys))
        bits = np.zeros(n_bits, np.uint8)
        for k in set(self.keys):
            bits[_probes(k, n_bits)] = 1
        bloom = struct.pack("<Q", n_bits) + np.packbits(bits, bitorder="little").tobytes()
        at = self.at
        self._put(index)
        self._put(bloom)
        self._put(FOOTER.pack(at, len(index), at + len(index), len(bloom), self.entries, self.ids, self.width, zlib.crc32(index + bloom), MAGIC))


class Shard:
    """Reads a shard: look-ups by id, and a scan in order."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.entries, self.ids, self.width, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        index, bloom = self.file.read_at(n, at), self.file.read_at(bloom_n, bloom_at)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError(f"not a whole shard: {uri}")
        self.last, self.places, i = [], [], 0
        while i < n:
            k = struct.unpack_from("<H", index, i)[0]
            self.last.append(index[i + 2 : i + 2 + k])
            self.places.append(struct.unpack_from("<QI", index, i + 2 + k))
            i += 14 + k
        self.n_bits = struct.unpack_from("<Q", bloom)[0]
        self.bits = bloom[8:]

    def _block(self, number: int) -> tuple[bytes, list[int]]:
        at, n = self.places[number]
        body = self.file.read_at(n, at)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a block is damaged")
        count = struct.unpack("<I", body[-8:-4])[0]
        end = n - 8 - 4 * count
        return body[:end], list(struct.unpack_from(f"<{count}I", body, end))

    def _entries(self, body: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            own, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, np.frombuffer(body, f"<u{self.width}", n // self.width, at)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, ids in self._entries(self._block(i)[0]):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this id."""
        low, out = key_of(doc_id), []
        if not all(self.bits[p >> 3] >> (p & 7) & 1 for p in _probes(low, self.n_bits)):
            return out
        for i in range(bisect_left(self.last, low), len(self.places)):
            body, restarts = self._block(i)
            whole = [next(self._entries(body, r))[0] for r in restarts]
            for key, ids in self._entries(body, restarts[max(0, bisect_left(whole, low) - 1)]):
                if key[:9] == low[:9]:
                    out.append(ids)
                elif key > low:
                    return out
        return out


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write all docs; returns the written manifest: shard, number, n_docs, n_tokens."""
    root = work_dir(docs.sparkSession, "sstable")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        number = TaskContext.get().partitionId()
        fs, folder = open_store(root)
        fs.create_dir(folder, recursive=True)
        name = f"shard-{number:06d}-{uuid.uuid4().hex[:8]}.sst"
        end = struct.pack("<I", end_id)
        with fs.open_output_stream(f"{folder}/.{name}") as out:
            w = Writer(out, 2 if max(encoder.vocab_size, end_id + 1) <= 1 << 16 else 4)
            last, same = object(), 0
            for b in batches:
                ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
                for i, j in parts(texts):
                    for doc_id, got in zip(ids[i:j], encoder.encode(texts[i:j]), strict=True):
                        same = same + 1 if doc_id == last else 0
                        w.add(key_of(doc_id, same), got + end)
                        last = doc_id
            w.close()
        if w.entries:
            fs.move(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [f"{root}/{name}"], "number": pa.array([number], pa.int32()), "n_docs": [w.entries], "n_tokens": [w.ids]})
        else:
            fs.delete_file(f"{folder}/.{name}")

    sorted_rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return stage(sorted_rows.mapInArrow(write, "shard string, number int, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    n = manifest.count()
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b["shard"].to_pylist(), b["first"].to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in Shard(uri).scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, min(n, 10_000))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, read back from the shards written.

    doc_id is a whole number. A null or empty text has the end id only. Rows with null ids come first; rows that repeat an id
    stand side by side, in no fixed order. Only doc_id and text are read. An empty table writes no shard.
    """
    return read_shards(write_shards(docs, tokenizer, end_id))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
