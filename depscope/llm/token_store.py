"""Tokenise documents, store their ids as files of shuffled planes in id order, and read them back.

Documents are range-partitioned by id and sorted; each task encodes its range and streams it to
files (``planes``). A file appears under its final name in one move when it is complete, so a task
that is lost, repeated or run twice leaves whole files, the same ones. A long range is several files. The manifest,
a row for each file with its number of ids, is a table beside them; the position of a file's first id is the
sum of those before it. Reading uses Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depscope.llm.common import ship, written
from depscope.llm.planes import PlaneFile, PlaneWriter, crc32
from depscope.llm.pretokens import Memo, Splitter

#: Appended to every document.
END_ID = 0


class LibraryEncoder:
    """Ids by the ``tokenizers`` library, which is asked once for each different match of the pattern
    that the memo does not hold. Strings of added tokens in a text are ordinary text."""

    def __init__(self, tokenizer_json: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.split, self.memo = Splitter(pattern), Memo(self._encode, 1_000_000)

    def _encode(self, match: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([match], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join([self.memo.ids(part) for part in self.split(text)])


class AddedTokenEncoder(LibraryEncoder):
    """The ids that the library gives for whole texts: strings of added tokens get their own ids.

    The library cuts a text at its added tokens first, the leftmost and then the longest, and encodes
    what is between them piece by piece. Added tokens that ask for more than their string (white space
    around them, whole words, normalised text) are left to the library, text by text.
    """

    def __init__(self, tokenizer_json: str, pattern: str):
        super().__init__(tokenizer_json, pattern)
        self.tokenizer.encode_special_tokens = False
        known = json.loads(tokenizer_json)
        added = [t for t in known.get("added_tokens") or [] if t["content"]]
        self.ids = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")") if added else None
        self.whole = any(t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and known.get("normalizer")) for t in added)

    def encode(self, text: str | None) -> bytes:
        if not text or self.cut is None:
            return super().encode(text)
        if self.whole:
            return self._encode(text)
        parts = self.cut.split(text)  # every second one is an added token
        return b"".join([self.ids[p] if i % 2 else super(AddedTokenEncoder, self).encode(p) for i, p in enumerate(parts)])


_encoders: dict = {}


def _encoder(shared) -> AddedTokenEncoder:
    """One per Python worker and tokenizer, so that its memo lasts from task to task."""
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = AddedTokenEncoder(*shared.value)
    return _encoders[key]


def _write(batches, shared, folder: str, file_ids: int, options: dict, rows: int = 256):
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    encoder, writer, files = _encoder(shared), None, 0
    part = TaskContext.get().partitionId()
    end = struct.pack("<I", END_ID)

    def finish():
        writer.close()
        writer.stream.close()
        name = f"part-{part:08d}-{files:05d}.ids"
        fs.move(hidden, f"{base}/{name}")
        values = ([part], [files], [name], [len(writer.docs)], [writer.n_ids])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["part", "file", "name", "n_docs", "n_ids"])

    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            batch = whole.slice(i, rows)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    hidden = f"{base}/.part-{part:08d}-{uuid.uuid4().hex}"
                    writer = PlaneWriter(fs.open_output_stream(hidden), **options)
                writer.add(doc, np.frombuffer(encoder.encode(text) + end, "<u4"))
                if writer.n_ids + writer.n_waiting >= file_ids:
                    yield finish()
                    writer, files = None, files + 1
    if writer is not None:
        yield finish()


def _partitions(rows: DataFrame, task_bytes: int) -> int | None:
    """Number of ranges for tables too large for the session's number of shuffle partitions, by the size of what is read."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if rows.sparkSession.conf.get("spark.sql.shuffle.partitions") is None or size > 1 << 60:  # unknown
        return None
    n = -(-size // task_bytes)
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, file_ids: int = 1 << 26, task_bytes: int = 1 << 29, **options) -> DataFrame:
    """Write all documents to ``folder`` and return the manifest: part, file, name, n_docs, n_ids, start.

    A string of an added token in a text is that token, as in the library. A file ends with the document that brings it
    to ``file_ids`` ids, so it has 256 MB of ids and one document at most before compression; a task reads about ``task_bytes``
    bytes of the table. ``options`` go to ``PlaneWriter``. Null text counts as empty: such a document has the end id
    only. Rows that repeat an id stand next to each other, ordered by a hash of their text. Rows with a null id
    come first. Only the two columns named are read. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((f.read(), pattern))
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = _partitions(rows, task_bytes)
    # The hash deals rows that share an id, such as those without one, to several ranges.
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order, "text")
    schema = "part long, file long, name string, n_docs long, n_ids long"
    files = written(rows.mapInArrow(lambda batches: _write(batches, shared, folder, file_ids, options), schema), f"{folder}/manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _read(batches):
    names = ["name", "id", "first", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name = path.as_py().rsplit("/", 1)[1]
            rows = [(name, doc, start, len(ids), crc32(ids)) for doc, start, ids in PlaneFile(content.as_buffer()).documents()]
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of ``folder``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    rows = files.mapInArrow(_read, "name string, id long, first long, n_tokens long, ids_crc32 long")
    rows = rows.join(manifest.select("name", "start"), "name")
    return rows.select("id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
