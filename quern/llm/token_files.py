"""Token ids as Arrow IPC files of equal-length sequences.

Every file holds record batches with a fixed-size list of ids and a fixed-size list of mask bits
for each sequence; sequences follow one another without gaps, documents run on across them, and
only the end of a file is filled up, with mask 0. Opened as a memory map, any sequence or mask is
read in place. Beside each file an index file holds where its documents begin. Files are written by
tasks, in shared storage, under names of their own; only those in the manifest count, so a task
that is lost or run twice leaves no trace in the result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pieces import WORD_PIECES, PieceMemory, is_plain
from .workspace import materialize, shared_dir, small_batches, tidy

SEQUENCE = 2048
BATCH_SEQUENCES = 128
#: Documents whose new words are encoded together.
TOGETHER = 64
END_ID = 2

_MANIFEST = "part int, ids_file string, index_file string, documents long, tokens long"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids by the tokenizers library, which sees a word once as long as it is remembered; the worker's next task finds it known."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids_type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = PieceMemory(self._learn, 400_000)

    def _learn(self, words: list[str]) -> list[bytes]:
        kind = "H" if self.ids_type.itemsize == 2 else "I"
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian; words that are new to the texts go through the library together."""
        words = [None if not is_plain(x) or any(y in x for y in self.special) else WORD_PIECES.findall(x.lower()) for x in texts]
        self.memory.learn_all(chain.from_iterable(x for x in words if x is not None))
        return [self._learn([text])[0] if own is None else b"".join(self.memory(own)) for text, own in zip(texts, words)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SequenceWriter:
    """Writes ids to an Arrow file of fixed-size lists."""

    def __init__(self, sink, ids_type: np.dtype, length: int = SEQUENCE):
        self.length, self.ids_type = length, ids_type
        kind = pa.from_numpy_dtype(ids_type)
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.sink = sink
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.bytes = 0

    def write(self, ids: bytes) -> None:
        self.held.append(ids)
        self.bytes += len(ids)
        step = self.length * BATCH_SEQUENCES * self.ids_type.itemsize
        if self.bytes >= step:
            data = b"".join(self.held)
            whole = len(data) - len(data) % step
            for i in range(0, whole, step):
                self._batch(np.frombuffer(data, self.ids_type, step // self.ids_type.itemsize, i))
            self.held, self.bytes = [data[whole:]], len(data) - whole

    def _batch(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.length
        mask = np.ones(len(ids) + short, bool)
        mask[len(ids) :] = False
        ids = np.concatenate([ids, np.zeros(short, self.ids_type)]) if short else ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.bytes:
            self._batch(np.frombuffer(b"".join(self.held), self.ids_type))
        self.file.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, length: int = SEQUENCE, make: Callable[[str], WordEncoder] = encoder) -> DataFrame:
    """Writes the documents' ids in ascending order of their ids; the manifest has a row for each pair of files.

    A null text counts as empty and gives the end id alone. Null document ids come first. An empty
    table gives no files. tokenizer_path must exist on every executor; out is a folder that all
    share, as a URI.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], encode.ids_type).tobytes()
        part, fs, files = TaskContext.get().partitionId(), None, None
        ids, starts, sizes, at = [], [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            if fs is None:
                fs, folder = pyarrow.fs.FileSystem.from_uri(out)
                fs.create_dir(folder, recursive=True)
                files = [f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.{x}.arrow" for x in ("ids", "index")]
                writer = SequenceWriter(fs.open_output_stream(files[0]), encode.ids_type, length)
            for i in range(0, len(batch), TOGETHER):
                some = batch.iloc[i : i + TOGETHER]
                for name, found in zip(some["doc_id"], encode.many([x or "" for x in some["text"]])):
                    writer.write(found + end)
                    ids.append(name)
                    starts.append(at)
                    sizes.append(len(found + end) // encode.ids_type.itemsize)
                    at += sizes[-1]
        if fs is not None:
            writer.close()
            index = pa.table({"doc_id": pa.array(ids, from_pandas=True), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
            with fs.open_output_stream(files[1]) as sink, pa.ipc.new_file(sink, index.schema) as file:
                file.write_table(index)
            yield pd.DataFrame({"part": [part], "ids_file": [files[0]], "index_file": [files[1]], "documents": [len(ids)], "tokens": [at]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    small_batches(docs.sparkSession)
    return materialize(rows.mapInPandas(tidy(run), _MANIFEST))


def _slices(file: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The ids of a file, batch by batch, in place."""
    for i in range(file.num_record_batches):
        yield file.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)


def read_token_files(spark: SparkSession, manifest: DataFrame, out: str, id_type: str = "bigint") -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it, ids_crc32 is over the ids as little-endian
    unsigned 32-bit integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(out)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        for batch in batches:
            for ids_file, index_file, first in zip(batch["ids_file"], batch["index_file"], batch["first"]):
                with (pa.memory_map(ids_file) if local else fs.open_input_file(ids_file)) as source, fs.open_input_file(index_file) as beside:
                    index = pa.ipc.open_file(beside).read_all()
                    slices = _slices(pa.ipc.open_file(source))
                    sums, held, left = [], np.empty(0, np.uint16), 0
                    for size in index["n_tokens"].to_pylist():
                        crc, left = 0, size
                        while left:
                            if not len(held):
                                held = next(slices)
                            crc = zlib.crc32(held[:left].astype("<u4"), crc)
                            left, held = left - len(held[:left]), held[left:]
                        sums.append(crc)
                    yield pd.DataFrame({"doc_id": index["doc_id"].to_pandas(integer_object_nulls=True), "start": index["start"].to_numpy() + first, "n_tokens": index["n_tokens"].to_numpy(), "ids_crc32": sums})

    upto = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # one row per file
    placed = materialize(manifest.withColumn("first", upto - F.col("tokens")))
    files = placed.count()
    return placed.repartition(max(1, files), "part").mapInPandas(tidy(run), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_file_rows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents to token files in shared storage and reads them back, one row per document."""
    spark = docs.sparkSession
    out = shared_dir(spark)
    manifest = write_token_files(docs, tokenizer_path, out, id_col, text_col)
    return read_token_files(spark, manifest, out, docs.schema[id_col].dataType.simpleString())
