"""Token ids in files of independent zstandard frames.

A file holds, one after another: zstandard frames, each with the ids of whole documents (two bytes an id where the
vocabulary allows, else four; little-endian); a skippable frame with the index of documents (an Arrow stream: id, frame,
first token in the frame, number of tokens); and the seek table of the public seekable format as the last, skippable
frame: the sizes of all frames and the low 32 bits of the XXH64 of each one's content. A reader decompresses only the
frames of the documents that it wants, and checks them.

Documents are dealt by ranges of ids (ties by a hash of the text, so that no id is too much for a task) and written in
ascending order, nulls first. A task writes under a name of its own and reports the file in its rows; the table of files
is written before it is used, so that files of lost or repeated tasks are never read. Null text counts as empty and has
the end id alone; an empty table gives no rows; other columns are ignored.

The tokenizer drops white space and never joins across it, so each distinct word is encoded once per Python worker (up
to ``VOCABULARY`` words are remembered at a time, from task to task).
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the public formats: magic numbers of skippable frames and of the seek table's footer.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: A frame is closed once its content has so many bytes.
FRAME = 1 << 18
VOCABULARY = 1_000_000
#: A word of its own that stands between words encoded together.
MARK = b"\x01"
#: Stands for the end of a document; no UTF-8 text has this byte.
STOP = b"\xff"
#: Bytes of text encoded together.
BATCH = 8 << 20
END_ID = 1


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class WordEncoder:
    """Ids of texts, each distinct word encoded once."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.starts = np.zeros(1, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.place, self.sizes, self.flat = {STOP: 0}, np.array([1]), np.array([self.end_id], self.kind)

    def _marked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has; words are encoded hundreds at a time, a mark after each."""
        between = b" " + MARK + b" "
        lines = [(between.join(words[a : a + 500]) + between).decode() for a in range(0, len(words), 500)]
        ids = np.concatenate([np.zeros(0, self.kind), *(np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))])
        at = np.flatnonzero(ids == self.mark) if self.mark is not None else np.zeros(0, np.int64)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _learn(self, new: list[bytes]) -> None:
        # words that hold the mark come last, and are encoded one by one
        marked = [w for w in new if MARK in w] if self.mark is not None else new
        new = [w for w in new if MARK not in w] + marked if self.mark is not None else new
        n = len(new) - len(marked)
        ids, sizes = self._marked(new[:n])
        found = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in new[n:]], add_special_tokens=False)]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, found), np.int64, len(found))])
        self.flat = np.concatenate([self.flat, ids, np.fromiter((i for ids in found for i in ids), self.kind)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8), and how many belong to each; the end id closes each."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        words, codes = common.distinct_words(b"".join([t + b" " + STOP + b" " for t in texts]))
        if len(self.place) > VOCABULARY:
            self._forget()
        self._learn([w for w in words if w not in self.place])
        codes = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[codes]
        sizes = self.sizes[codes]
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[codes] - upto + sizes, sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[codes == 0], prepend=0)


@functools.cache
def encoder(path: str) -> WordEncoder:
    """The worker's own encoder, kept from task to task."""
    return WordEncoder(path)


class FileWriter:
    """Writes one file; add() takes a document's id and token ids."""

    def __init__(self, out, kind: np.dtype, id_type: pa.DataType):
        self.out, self.kind, self.id_type = out, kind, id_type
        self.codec = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.index.append((doc_id, len(self.frames), self.held, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held * self.kind.itemsize >= FRAME:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            plain = np.concatenate(self.waiting).astype(self.kind).tobytes()
            self._frame(self.codec.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
            self.waiting, self.held = [], 0

    def _frame(self, data: bytes, size: int, check: int) -> None:
        self.out.write(data)
        self.frames.append((len(data), size, check))

    def close(self) -> None:
        self._flush()
        sink = pa.BufferOutputStream()
        columns = list(zip(*self.index, strict=True)) or [()] * 4
        kinds = (self.id_type, pa.int32(), pa.int64(), pa.int64())
        table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "frame", "first", "n"])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        body = struct.pack("<B", self.kind.itemsize) + sink.getvalue().to_pybytes()
        self._frame(struct.pack("<II", SKIPPABLE + 1, len(body)) + body, 0, 0)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class FileReader:
    """Reads a file: its index of documents, and any document, of which it decompresses no more than the frame."""

    def __init__(self, uri: str):
        filesystem, path = _filesystem(uri)
        self.file = filesystem.open_input_file(path)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} does not end in a seek table")
        entries = self.file.read_at(12 * count, end - 9 - 12 * count)
        self.frames = list(struct.iter_unpack("<III", entries))
        self.starts = np.cumsum([0, *(f[0] for f in self.frames)]).tolist()
        body = self.file.read_at(self.frames[-1][0], self.starts[-2])[8:]
        self.kind = np.dtype(f"<u{body[0]}")
        self.index = pa.ipc.open_stream(body[1:]).read_all()

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.frames[k]
        plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, self.kind)

    def document(self, row: int) -> np.ndarray:
        k, first, n = (self.index.column(c)[row].as_py() for c in ("frame", "first", "n"))
        return self.frame(k)[first : first + n]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row of the index, frame, ids) of all documents, one frame at a time."""
        at, ids = -1, np.zeros(0, self.kind)
        for row, (k, first, n) in enumerate(zip(*(self.index.column(c).to_pylist() for c in ("frame", "first", "n")), strict=True)):
            if k != at:
                at, ids = k, self.frame(k)
            yield row, k, ids[first : first + n]


_FILES = "part int, path string, n_docs long, n_tokens long"


def _writer(directory: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, own, n = None, encoder(tokenizer), 0
        part = TaskContext.get().partitionId()
        uri = f"{directory}/part-{part:07d}-{uuid.uuid4().hex}.ids.zst"
        for batch in batches:
            if writer is None and batch.num_rows:
                filesystem, path = _filesystem(uri)
                filesystem.create_dir(path.rpartition("/")[0], recursive=True)
                writer = FileWriter(filesystem.open_output_stream(path, compression=None), own.kind, batch.schema.field("doc_id").type)
            sizes = np.diff(np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())]) // BATCH)
            cuts = [0, *(np.flatnonzero(sizes[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(a, b - a)
                ids, sizes = own.encode(some.column("text").to_pylist())
                for doc_id, one in zip(some.column("doc_id").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    writer.add(doc_id, one)
                n += b - a
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return run


def write(docs: DataFrame, tokenizer: str, directory: str | None = None) -> DataFrame:
    """Encode all documents into files under directory; the table of files: part, path, n_docs, n_tokens, start."""
    directory = directory or common.scratch_dir(docs.sparkSession, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"), F.octet_length(text).cast("bigint").alias("size"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", F.col("text").cast("binary").alias("text"), "size")
    files = common.written(rows.mapInArrow(_writer(directory, tokenizer), _FILES), "token-files").toPandas().sort_values("part")
    # a row for each file: where its first document begins among all ids
    files["start"] = files["n_tokens"].cumsum() - files["n_tokens"]
    return docs.sparkSession.createDataFrame(files, _FILES + ", start long")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for path, start in zip(files["path"], files["start"], strict=True):
            reader = FileReader(path)
            rows = [(k, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for _, k, ids in reader.documents()]
            frame, n, check = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pd.DataFrame({"doc_id": reader.index.column("doc_id").to_pandas(integer_object_nulls=True), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": check, "path": path, "frame": frame})


def read(spark: SparkSession, files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Every document of the files, as it was read back: doc_id, start, n_tokens, ids_crc32, path, frame."""
    n = max(1, files.count())
    return files.repartition(n).mapInPandas(_reader, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, path string, frame int")
