"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each with whole documents (about FRAME_IDS ids; a longer document has a frame of
its own), then one skippable frame with the first and last doc_id, documents and ids of each frame, then the seek
table of the public zstandard seekable format: compressed and decompressed size of each frame and the low 32 bits of
the XXH64 of its content. A reader finds a document's frame by the index, seeks there, and decompresses that frame alone.

A frame's content, little-endian: number of documents n (u32); n doc_ids (i64); n flags (u8, 1: doc_id is null); n
lengths (u32); all ids (u32).

Files are written to the shared folder by the URI it is named by. A task writes to a name of its own and then renames,
so a task that runs twice leaves one whole file. Documents are in ascending doc_id order (null first; equal ids by the
hash of the text, then the text) over all files.

Defined cases: a null or empty text is the end id alone; rows with a null or repeated doc_id are documents of their
own; an empty table gives no file; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .textbatch import FOLD, pieces, run_hashes

FRAME_IDS = 1 << 18
LEVEL = 3
_INDEX_MAGIC, _TABLE_MAGIC, _FOOT_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOT, _INDEX = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<qqBBIQ")


class Corrupt(ValueError):
    """A frame whose content doesn't have the checksum of the seek table."""


class FrameWriter:
    """Collects documents and writes frames to a binary file."""

    def __init__(self, file, frame_ids: int = FRAME_IDS) -> None:
        self.file, self.most, self.table, self.index, self.docs, self.held = file, frame_ids, [], [], [], 0
        self.packer = zstandard.ZstdCompressor(LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.docs and self.held + len(ids) > self.most:
            self.flush()
        self.docs.append((doc_id, ids))
        self.held += len(ids)

    def flush(self) -> None:
        if not self.docs:
            return
        keys, n = [d for d, _ in self.docs], len(self.docs)
        content = b"".join([
            struct.pack("<I", n), np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys),
            np.array([len(x) for _, x in self.docs], "<u4").tobytes(), *(np.asarray(x, "<u4").tobytes() for _, x in self.docs),
        ])
        packed = self.packer.compress(content)
        self.file.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.index.append((keys[0] or 0, keys[-1] or 0, keys[0] is None, keys[-1] is None, n, self.held))
        self.docs, self.held = [], 0

    def close(self) -> None:
        """Write the index and the seek table."""
        self.flush()
        body = b"".join(_INDEX.pack(*x) for x in self.index)
        self.file.write(struct.pack("<II", _INDEX_MAGIC, len(body)) + body)
        self.table.append((8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(_ENTRY.pack(*x) for x in self.table) + _FOOT.pack(len(self.table), 0x80, _FOOT_MAGIC)
        self.file.write(struct.pack("<II", _TABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads frames, or single documents, of a seekable binary file of the given size."""

    def __init__(self, file, size: int) -> None:
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        file.seek(size - _FOOT.size)
        n, kind, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != _FOOT_MAGIC or kind != 0x80:
            raise Corrupt("no seek table with checksums at the end of the file")
        file.seek(size - _FOOT.size - n * _ENTRY.size)
        self.table = list(_ENTRY.iter_unpack(file.read(n * _ENTRY.size)))
        self.starts = np.cumsum([0, *(x[0] for x in self.table)])
        file.seek(int(self.starts[n - 1]) + 8)
        self.index = list(_INDEX.iter_unpack(file.read(self.table[-1][0] - 8)))

    def frame(self, k: int) -> tuple[list[int | None], list[np.ndarray]]:
        """doc_ids and ids of the documents of frame k."""
        packed, full, check = self.table[k]
        self.file.seek(int(self.starts[k]))
        content = self.unpacker.decompress(self.file.read(packed), max_output_size=full)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise Corrupt(f"frame {k} has another checksum than the seek table")
        n = struct.unpack_from("<I", content)[0]
        keys, null = np.frombuffer(content, "<i8", n, 4), content[4 + 8 * n : 4 + 9 * n]
        lengths = np.frombuffer(content, "<u4", n, 4 + 9 * n)
        ids = np.frombuffer(content, "<u4", -1, 4 + 13 * n)
        return [None if z else int(k) for k, z in zip(keys, null, strict=True)], np.split(ids, np.cumsum(lengths)[:-1])

    def documents(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that id; only frames that can hold it are read."""
        found = []
        for k, (low, high, low_null, high_null, _, _) in enumerate(self.index):
            if not high_null and high >= doc_id and (low_null or low <= doc_id):
                keys, ids = self.frame(k)
                found += [x for key, x in zip(keys, ids, strict=True) if key == doc_id]
        return found


_LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(2))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~(_LETTER | _DIGIT)[33:127]


def _parts(data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that the tokenizer would never join: it divides at white space, before a mark or
    a digit that follows a letter, and around digits. Where whole is set, only white space divides.

    data ends in white space, and so does every text in it.
    """
    gap = _SPACE[data]
    starts = ~gap
    letter, digit = _LETTER[data], _DIGIT[data]
    ascii_next = letter | digit | _MARK[data]
    cut = (letter[:-1] & ~letter[1:] | digit[:-1]) & ascii_next[1:] & ~whole[1:]
    starts[1:] &= gap[:-1] | cut
    ends = ~gap
    ends[:-1] &= gap[1:] | cut
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Encoder:
    """Ids of whole texts, from the ids of their distinct parts, which are encoded once and kept while they are used.

    Parts are told apart by 64-bit hashes. Beyond most_kept parts, the half that was used last stays.
    """

    def __init__(self, path: str, most_kept: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.most, self.turn = Tokenizer.from_file(path), most_kept, 0
        self.keys, self.at, self.lengths, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1, np.uint32)  # the first is for the end

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        order = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[order])
        at = len(self.ids) + np.cumsum(lengths) - lengths
        self.keys, self.at, self.lengths = np.insert(self.keys, to, keys[order]), np.insert(self.at, to, at[order]), np.insert(self.lengths, to, lengths[order])
        self.used = np.insert(self.used, to, self.turn)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def _forget(self) -> None:
        keep = self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        self.keys, at, self.lengths, self.used = self.keys[keep], self.at[keep], self.lengths[keep], self.used[keep]
        self.at = 1 + np.cumsum(self.lengths) - self.lengths
        self.ids = np.append(self.ids[:1], self.ids[np.repeat(at - self.at, self.lengths) + 1 + np.arange(int(self.lengths.sum()))])

    def _find(self, kinds: np.ndarray) -> np.ndarray:
        at, order = np.empty(len(kinds), np.int64), np.argsort(kinds)  # a search in order stays in the cache
        at[order] = np.searchsorted(self.keys, kinds[order])
        return at

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by end_id if one is given, and where each text's ids end."""
        self.turn += 1
        if len(self.keys) > self.most:
            self._forget()
        joined = b"".join(chain.from_iterable((x, b"\n") for x in texts))
        data = np.frombuffer(joined, np.uint8)
        text_ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        whole = np.zeros(len(data), bool)  # a text that may hold a special token's string, which is matched as written
        for i in [i for i, x in enumerate(texts) if b"<|" in x] if b"<|" in joined else ():
            whole[text_ends[i] - len(texts[i]) - 1 : text_ends[i]] = True
        starts, ends = _parts(data, whole) if len(data) else (np.zeros(0, np.int64),) * 2
        keys = run_hashes(np.where(whole, data, FOLD[data])[~_SPACE[data]], ends - starts)
        kind, kinds = pd.factorize(keys)
        at = self._find(kinds)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(new):
            first = np.empty(len(kinds), np.int64)
            first[kind[::-1]] = np.arange(len(kind))[::-1]
            low = joined.decode("utf-8", "surrogatepass") if joined.isascii() else None
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(kinds[new], [low[a:b] for a, b in spans] if low is not None else [joined[a:b].decode() for a, b in spans])
            at = self._find(kinds)
        self.used[at] = self.turn
        lengths, begin = self.lengths[at][kind], self.at[at][kind]
        per_text = np.searchsorted(starts, text_ends)  # parts up to the end of each text
        if end_id is not None:  # the end is one more part of each text
            lengths, begin = np.insert(lengths, per_text, 1), np.insert(begin, per_text, 0)
            self.ids[0] = end_id
            per_text = per_text + np.arange(1, len(texts) + 1)
        to = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(begin - to[:-1], lengths) + np.arange(to[-1])]
        return ids, to[per_text]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it has learnt from one task to the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents and return the files: file (its number in order), path, documents, ids, bytes.

    folder: a URI that executors reach; a new one in the shared folder if None.
    """
    spark = documents.sparkSession
    store.ship(spark)
    folder = folder or store.new_path(spark, "tokens")
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    df = df.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash", "_text").select("doc_id", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer, file, n = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            for part in pieces(batch, "_text", 2 << 20):
                if writer is None:
                    fs, root = _file_system(folder)
                    fs.create_dir(root)
                    own = f"{root}/.writing-{uuid.uuid4().hex}"
                    file = fs.open_output_stream(own)
                    writer = FrameWriter(file)
                texts = [x or b"" for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                ids, ends = encoder(tokenizer_path).encode(texts, end_id)
                for doc_id, own_ids in zip(part.column(0).to_pylist(), np.split(ids, ends[:-1]), strict=True):
                    writer.add(doc_id, own_ids)
                n += len(texts)
        if writer is not None:
            writer.close()
            size = file.tell()
            file.close()
            fs.move(own, f"{root}/part-{number:06d}.ids.zst")
            ids = sum(x[-1] for x in writer.index)
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "path": [f"{folder}/part-{number:06d}.ids.zst"], "documents": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.int64()), "bytes": pa.array([size], pa.int64())})
        store.trim()

    return store.cut(df.mapInArrow(write, "file long, path string, documents long, ids long, bytes long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, checked frame by frame.

    start: the ids of all documents before it, over all files in order.
    """
    store.ship(files.sparkSession)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    df = files.select("path", "bytes", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), "file").repartitionByRange(max(1, files.count()), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, local = _file_system(path)
                with fs.open_input_file(local) as file:
                    reader = FrameReader(file, size)
                    for k in range(len(reader.index)):
                        keys, ids = reader.frame(k)
                        lengths = np.array([len(x) for x in ids], np.int64)
                        starts = at + np.cumsum(lengths) - lengths
                        at += int(lengths.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
