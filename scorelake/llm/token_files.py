"""Token ids of documents in Arrow files of equal-length sequences, and reading them back by place.

Documents are ordered by id across the cluster (a range partition per file) and encoded; each one's
ids are followed by END_ID. The ids of a file's documents run on through its sequences: a file is an
Arrow IPC file whose batches hold fixed-size lists, SEQUENCE a row: `ids` (uint16 if the vocabulary
allows, else uint32), and as bits `mask` (an id, not padding) and `last` (a document's last id). Only a
file's last sequence is padded. As every row has one size, the place of an id gives its batch, row and
column by division, and a file that can be mapped into memory is read without copies or decoding.
A sidecar index (Parquet) has a row per document: its file, first place in the file, and length.

Each task writes under a name of its own and renames the finished file, so a repeated task leaves
whole files with the same bytes. The driver sees one number per file.

Encoding is done in units: a text is cut before single spaces between two characters that are no
white space. A byte-level pre-tokenizer always cuts there and has nothing to merge across, so a unit
has the same ids wherever it stands; a Python worker remembers the first MEMO units that it meets, which
are the common ones, and encodes others whenever they come. The new units of a text are encoded as the
lines of one text, which cuts in the same way.
A tokenizer with a normaliser, a post-processor or another pre-tokenizer encodes whole texts instead.

Defined cases: a NULL or empty text has the end alone. A NULL id comes first. Rows that repeat an id
follow one another by a hash of their texts, and a group of them may span files; equal rows are
interchangeable. Very long texts are encoded in pieces of about PIECE code points and written as
they come. An empty table gives no files and no rows. Only the id and the text are read, whatever
other columns are called.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.warc import _finish, _folders, _opened

SEQUENCE = 2048
#: Sequences of a record batch.
BATCH = 64
END_ID = 0
PIECE = 1 << 20
MEMO = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_INDEX = "file string, doc_id long, place long, n_tokens long"


def _cut(text: str) -> list[str]:
    """The units of a text, without the spaces they are cut at."""
    if text[:1] != " " and text[-1:] != " " and not any(x in text for x in ("  ", " \n", "\n ")):
        if text.replace("\n", "").isprintable():  # so spaces and line ends are its only white space
            return text.split(" ")
    return _CUT.split(text)


def _schema(sequence: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("last", pa.list_(pa.bool_(), sequence))])


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Encoder:
    """Texts to little-endian uint32 ids, by a tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel ones
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        t = self.tokenizer
        plain = t.normalizer is None and t.post_processor is None
        level = t.pre_tokenizer if isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) else None
        self.by_unit = plain and level is not None and level.use_regex and not level.add_prefix_space
        self.kind = pa.uint16() if t.get_vocab_size() <= 1 << 16 else pa.uint32()
        line = t.encode("\n", add_special_tokens=False).ids
        self.by_unit = self.by_unit and len(line) == 1
        self.line_end = line[0] if line else -1
        self.memo: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    def _new(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each unit (one that follows a space) with its ids; most are encoded as one text, a line each."""
        lines = [unit for unit in units if "\n" not in unit and not unit[-1].isspace()]
        ids = np.frombuffer(self._encoded([" " + "\n ".join(lines)])[0], "<u4") if lines else np.empty(0, "<u4")
        ends = np.flatnonzero(ids == self.line_end).tolist()
        if len(ends) != max(0, len(lines) - 1):
            lines = []
        packed = ids.tobytes()
        for unit, start, end in zip(lines, [0, *(e + 1 for e in ends)], [*ends, len(ids)]):  # noqa: B905
            yield unit, packed[4 * start : 4 * end]
        alone = [unit for unit in units if not lines or "\n" in unit or unit[-1].isspace()]
        yield from zip(alone, self._encoded([" " + unit for unit in alone]), strict=True)

    def _units(self, text: str) -> bytes:
        """The ids of a text. Units after the first are remembered without the space they start with."""
        first, *others = _cut(text)
        found = list(map(self.memo.get, others))
        missing = [at for at, ids in enumerate(found) if ids is None]
        if missing:
            new = dict(self._new(list({others[at] for at in missing})))
            for at in missing:
                found[at] = new[others[at]]
            if len(self.memo) < MEMO:
                self.memo.update(new)
        start = self.firsts.get(first)
        if start is None:
            start = self._encoded([first])[0]
            if len(self.firsts) < MEMO // 16 and len(first) < 64:
                self.firsts[first] = start
        found.insert(0, start)
        return b"".join(found)

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in pieces of bounded size where it can be cut."""
        if not self.by_unit:
            yield from self._encoded([_whole(text)])
            return
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = cut.start() if cut else len(text)
            yield self._units(_whole(text[at:end]))
            at = end


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker, which its later tasks use too."""
    return Encoder(path)


def _whole(text: str) -> str:
    """A text without lone surrogates, which no UTF-8 has."""
    return text.encode("utf-8", "replace").decode()


class _Writer:
    """Appends ids to sequences of one file."""

    def __init__(self, stream, sequence: int, kind: pa.DataType) -> None:
        self.schema = _schema(sequence, kind)
        self.out = pa.ipc.new_file(stream, self.schema)
        self.sequence, self.cells, self.kind = sequence, sequence * BATCH, kind.to_pandas_dtype()
        self.ids: list[np.ndarray] = []
        self.ends: list[int] = []
        self.written = self.place = 0

    def add(self, ids: bytes, last: bool) -> None:
        self.ids.append(np.frombuffer(ids, "<u4").astype(self.kind))
        self.place += len(self.ids[-1])
        if last:
            self.ends.append(self.place - 1)
        if self.place - self.written >= self.cells:
            ids = np.concatenate(self.ids)
            whole = len(ids) - len(ids) % self.cells
            for at in range(0, whole, self.cells):
                self._batch(ids[at : at + self.cells])
            self.ids = [ids[whole:].copy()]

    def _batch(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.sequence
        mask, last = np.zeros((2, len(ids) + pad), bool)
        mask[: len(ids)] = True
        ends = np.array(self.ends, np.int64) - self.written
        last[ends[ends < len(ids)]] = True
        self.ends = [e for e in self.ends if e - self.written >= len(ids)]
        self.written += len(ids)
        columns = (np.concatenate([ids, np.zeros(pad, self.kind)]), mask, last)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in columns]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.concatenate(self.ids)
        if len(rest):
            self._batch(rest)
        self.out.close()


class TokenFile:
    """Random access to the sequences and ids of one file, without copies where it can be mapped."""

    def __init__(self, uri: str) -> None:
        system, path = _opened(uri)
        self.stream = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.stream)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.number, self.columns = -1, None

    def __len__(self) -> int:
        """Sequences in the file."""
        n = self.file.num_record_batches
        return (n - 1) * BATCH + self.file.get_batch(n - 1).num_rows if n else 0

    def _flat(self, number: int) -> tuple[pa.Array, ...]:
        if number != self.number:
            batch = self.file.get_batch(number)
            self.columns, self.number = tuple(batch.column(i).flatten() for i in range(3)), number
        return self.columns

    def row(self, number: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Ids, mask and last marks of a sequence, all of them views."""
        at = number % BATCH * self.sequence
        ids, mask, last = (c.slice(at, self.sequence) for c in self._flat(number // BATCH))
        return ids.to_numpy(zero_copy_only=True), mask, last

    def span(self, place: int, n: int) -> Iterator[tuple[np.ndarray, pa.BooleanArray]]:
        """Ids and last marks of n places, views for each batch they lie in."""
        cells = self.sequence * BATCH
        while n > 0:
            ids, _, last = self._flat(place // cells)
            at = place % cells
            some = min(n, len(ids) - at)
            if some <= 0:
                raise ValueError(f"the file ends before place {place}")
            yield ids.slice(at, some).to_numpy(zero_copy_only=True), last.slice(at, some)
            place, n = place + some, n - some

    def close(self) -> None:
        self.columns = self.file = None
        self.stream.close()


def write_files(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE
) -> DataFrame:
    """Writes docs in ascending order of their ids to folder/files; returns the index that is written beside them.

    folder is a URI that executors reach, tokenizer a file that every machine has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer, stream = TaskContext.get(), encoder_of(tokenizer), None, None
        name = f"part-{task.partitionId():06d}.arrow"
        system, base = _opened(folder)
        made = f"{base}/work/{name}.{task.taskAttemptId()}"
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            places, lengths = [], []
            for value in batch.column(1):
                if writer is None:
                    stream = system.open_output_stream(made)
                    writer = _Writer(stream, sequence, encoder.kind)
                places.append(writer.place)
                for piece in encoder.pieces(value.as_py() or ""):
                    writer.add(piece, False)
                writer.add(end, True)
                lengths.append(writer.place - places[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(places), pa.string()), batch.column(0), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                names=["file", "doc_id", "place", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            stream.close()
            _finish(system, made, f"{base}/files/{name}")

    _folders(folder, "work", "files")
    # The last key deals out a group of equal rows; the one before gives rows of one id an order.
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"),
        (F.monotonically_increasing_id() % 4096).alias("seat"),
    )
    keys = (F.asc_nulls_first("doc_id"), "tie", "seat")
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ordered.mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """Per document of an index: doc_id, start (ids before it in all files), n_tokens and ids_crc32, from the files."""
    spark = index.sparkSession
    totals = sorted((r.file, r.n) for r in index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals], dtype=np.int64)])
    starts = [(file, int(b)) for (file, _), b in zip(totals, before)]  # noqa: B905
    offsets = spark.createDataFrame(starts, "file string, before long")
    rows = index.join(F.broadcast(offsets), "file").repartition(max(1, len(starts)), "file").sortWithinPartitions("file", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            sums = []
            for file, place, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if file != name:
                    if opened:
                        opened.close()
                    name, opened = file, TokenFile(f"{folder}/files/{file}")
                crc, ends, last = 0, 0, None
                for ids, last in opened.span(place, n):
                    crc, ends = zlib.crc32(ids.astype("<u4", copy=False), crc), ends + last.true_count
                if ends != 1 or not last[-1].as_py():
                    raise ValueError(f"{file}: no document of {n} ids at place {place}")
                sums.append(crc)
            start = np.add(batch.column(2).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(start, pa.int64()), batch.column(3), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if opened:
            opened.close()

    columns = ("file", "doc_id", "place", "n_tokens", "before")
    return rows.select(*columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
