"""Token ids in Arrow files of equal-length sequences.

Documents in id order are encoded, ended by one id each and laid end to end. A shard (one
range of ids) is a row of Arrow IPC files; the record batches of a file hold nothing but ``ids``
and ``mask`` as fixed-size lists, all batches but the last with as many rows, so that sequence
``k`` is row ``k mod R`` of batch ``k div R`` and is read from a memory map without a copy.
Beside each file a second one of the same kind lists its documents: id, start in the file, length.

Scale: ids are dealt by range, so that shards follow one another; a task streams its shard and
holds one batch of sequences. A file ends with the document that brings it to ``FILE_TOKENS``,
so however many tokens a shard has, a file has at most those and one document. Files are read by
batch, one task a file. They get their names by rename, and a task that runs again writes the
same bytes. The only thing put in order in one place is one row per file.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.words import slices, tidy
from lodestone.operators.staging import Stage

SEQUENCE = 1024
BATCH_ROWS = 256
#: Tokens from which on a file is closed.
FILE_TOKENS = 1 << 26
#: Most tasks that read files.
READERS = 10_000

#: Beyond these characters libraries can disagree on what is a letter, a number or a space.
ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ԯ]")


def _characters(kind: str) -> str:
    """The characters of a general category up to the last that ``ODD`` leaves, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x530) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _characters("L"), _characters("N"), r"\t\n\x0b\x0c\r \x85\xa0"
#: The published pattern of byte-level BPE pre-tokenization for texts that ``ODD`` does not match, the commonest case first.
BYTE_LEVEL = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pieces in a cache, about 150 bytes each; a full cache keeps those that came again since it was last full.
CACHE_PIECES = 250_000


class Pieces(dict):
    """Numbers of pieces as they come; ``known`` lists them."""

    def __init__(self, known: list[str]):
        super().__init__(zip(known, range(len(known))))
        self.known = known

    def __missing__(self, piece: str) -> int:
        out = self[piece] = len(self.known)
        self.known.append(piece)
        return out


class Encoder:
    """Ids of whole texts, exactly as the library's ``encode(text, add_special_tokens=False)``.

    With byte-level pre-tokenization and no normalizer, pieces are encoded independently of
    each other, so each distinct piece is encoded once; texts with special tokens or unusual
    characters go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_space[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.line = vocabulary.get("\u010a")
        self._keep(np.empty(0, np.int64))

    def _keep(self, numbers: np.ndarray) -> None:
        """Forget all pieces but these."""
        pieces = Pieces([self.pieces.known[i] for i in numbers.tolist()] if len(numbers) else [])
        flat, start, size = (self._ids(numbers), *self.places[:, numbers]) if len(numbers) else (np.empty(0, self.dtype), *np.zeros((2, 0), np.int64))
        self.pieces, self.flat, self.used = pieces, flat, len(flat)
        self.places = np.stack([np.cumsum(size) - size, size])  # start and length of each piece's ids
        self.hits = np.zeros(len(numbers), np.int64)

    def _put(self, numbers: list[int], ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> None:
        if len(heads) != len(numbers):
            raise ValueError("pieces and words differ")
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat) // 2, len(ids)), self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.places[0, numbers] = self.used + heads
        self.places[1, numbers] = sizes
        self.used += len(ids)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.fromiter(got.ids, self.dtype, len(got))

    def _learn(self, first: int) -> None:
        """Encode the pieces from a number on. Words are encoded many to a text, where they stay pieces of their own: those
        after a space end to end, as a token that starts with the space starts a word, others a line each."""
        known, step = self.pieces.known, 2000
        new = np.zeros((2, len(known) - first), np.int64)
        self.places = np.concatenate([self.places, new], axis=1)
        self.hits = np.concatenate([self.hits, new[0]])
        words, lines, rest = [], [], []
        for i in range(first, len(known)):
            p = known[i]
            (lines if self.line is not None and p.isalpha() else words if p[0] == " " and p[1:].isalpha() else rest).append(i)
        parts = [words[i : i + step] for i in range(0, len(words), step)]
        for part, ids in zip(parts, self._encode(["".join([known[i] for i in p]) for p in parts])):
            heads = np.flatnonzero(self.after_space[ids])
            self._put(part, ids, heads, np.diff(heads, append=len(ids)))
        parts = [lines[i : i + step] for i in range(0, len(lines), step)]
        for part, ids in zip(parts, self._encode(["\n".join([known[i] for i in p]) for p in parts])):
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            heads = np.append(0, ends[:-1] + 1)
            self._put(part, ids, heads, ends - heads)
        for i in range(0, len(rest), 4096):
            own = list(self._encode([known[j] for j in rest[i : i + 4096]]))
            sizes = np.array([len(x) for x in own], np.int64)
            self._put(rest[i : i + 4096], np.concatenate(own), np.cumsum(sizes) - sizes, sizes)

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces, end to end."""
        start, size = self.places[:, numbers]
        return self.flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        first, get = len(self.pieces), self.pieces.__getitem__
        split, lengths = [], []
        for text in texts:
            text = text or ""
            if not self.by_piece or ODD.search(text) or any(s in text for s in self.special):
                lengths.append(-1)
                continue
            found = BYTE_LEVEL.findall(text)
            split.append(np.fromiter(map(get, found), np.int64, len(found)))
            lengths.append(len(found))
        if len(self.pieces) > first:
            self._learn(first)
        out, at = [], 0
        numbers = np.concatenate(split) if split else np.empty(0, np.int64)
        self.hits += np.bincount(numbers, minlength=len(self.hits))
        flat = self._ids(numbers)
        ends = np.append(0, np.cumsum(self.places[1, numbers]))
        for text, n in zip(texts, lengths):
            if n < 0:
                out.append(np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, self.dtype))
            else:
                out.append(flat[ends[at] : ends[at + n]])
                at += n
        if len(self.pieces) > CACHE_PIECES:
            again = np.flatnonzero(self.hits > 1)
            self._keep(again if len(again) <= CACHE_PIECES * 3 // 4 else again[:0])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """A worker's encoder, with what it has cached, serves its later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


class _File:
    """Streams documents into a file and its list of documents."""

    def __init__(self, folder: str, name: str, attempt: int, dtype: np.dtype, length: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.names = [(f"{root}/.{kind}-{name}.{attempt}", f"{root}/{kind}-{name}.arrow") for kind in ("docs", "shard")]
        self.dtype, self.length = dtype, length
        schemas = (DOCS, file_schema(dtype, length))
        self.streams = [self.fs.open_output_stream(own) for own, _ in self.names]
        self.writers = [pa.ipc.new_file(stream, schema) for stream, schema in zip(self.streams, schemas)]
        self.parts: list[np.ndarray] = []
        self.held = self.written = self.n_docs = 0
        self.docs: list[tuple] = []  # (id, start in the file, number of tokens)

    @property
    def tokens(self) -> int:
        return self.written + self.held

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        self.n_docs += 1
        if self.held >= self.length * BATCH_ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        step, at = self.length * BATCH_ROWS, 0
        while len(flat) - at >= step or (last and at < len(flat)):
            piece = flat[at : at + step]
            rows = -(-len(piece) // self.length)
            ids = np.zeros(rows * self.length, self.dtype)
            ids[: len(piece)] = piece
            mask = np.arange(rows * self.length) < len(piece)
            self.writers[1].write_batch(
                pa.record_batch(
                    [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
                    schema=file_schema(self.dtype, self.length),
                )
            )
            self.written += len(piece)
            at += step
        self.parts = [flat[at:]] if at < len(flat) else []
        self.held = max(0, len(flat) - at)
        if self.docs:
            self.writers[0].write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.docs)], schema=DOCS))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        for writer, stream, (own, name) in zip(self.writers, self.streams, self.names):
            writer.close()
            stream.close()
            self.fs.move(own, name)


def _open(uri: str) -> pa.ipc.RecordBatchFileReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


class TokenFile:
    """Random access to a file: its sequences, and the ids from any place on; views, where a memory map holds it."""

    def __init__(self, uri: str):
        self.reader = _open(uri)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0))

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, row = self.reader.get_batch(k // self.rows), k % self.rows
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """``n`` ids from a place on, batch by batch."""
        step = self.rows * self.length
        while n > 0:
            i, at = divmod(start, step)
            if self.last[0] != i:
                self.last = (i, self.reader.get_batch(i).column("ids").flatten().to_numpy())
            piece = self.last[1][at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    length: int = SEQUENCE,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the files into ``folder`` (a URI that every executor reaches); returns one row per file.

    A null text is an empty one and has the end id alone. Documents are ordered by id, null
    first, then by the text's hash and text; repeated rows are written as often as they occur. An empty table writes
    no file. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder = encoder_for(vocabulary)
        end = np.array([end_id], encoder.dtype)
        number, part, file = context.partitionId(), 0, None

        def finish() -> pa.RecordBatch:
            file.close()
            row = {"shard": number, "part": part, "file": f"{folder}/shard-{name(part)}.arrow", "n_docs": file.n_docs, "n_tokens": file.tokens}
            return pa.RecordBatch.from_pylist([row])

        def name(part: int) -> str:
            return f"{number:06d}-{part:04d}"

        for batch in slices(batches, "text", 2 << 20):
            ids = batch.column("id").to_pylist()
            for doc_id, got in zip(ids, encoder(batch.column("text").to_pylist())):
                file = file or _File(folder, name(part), context.taskAttemptId(), encoder.dtype, length)
                file.add(doc_id, np.concatenate([got, end]))
                if file.tokens >= file_tokens:
                    yield finish()
                    file, part = None, part + 1
        if file is not None:
            yield finish()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # The range bounds are sampled from ids and hashes; texts decide among equal hashes only.
    return (
        rows.repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h", "text")
        .select("id", "text")
        .mapInArrow(tidy(encode), "shard long, part long, file string, n_docs long, n_tokens long")
    )


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document in the files (``file``, ``base``: the tokens before it): id, ``start``, ``n_tokens``, ``ids_crc32``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(batch.column(c).to_pylist() for c in ("file", "base"))):
                tokens = TokenFile(uri)
                listed = _open(uri.replace("/shard-", "/docs-"))
                for i in range(listed.num_record_batches):
                    docs = listed.get_batch(i)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n").to_pylist()):
                        crc = 0
                        for piece in tokens.pieces(start, n):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        sums.append(crc)
                    ids, start, n = docs.columns
                    yield pa.RecordBatch.from_arrays([ids, pc.add(start, base), n, pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "base").mapInArrow(tidy(decode), "id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", **more) -> DataFrame:
    """Write the files, read them back: id, ``start`` over all shards, ``n_tokens``, ``ids_crc32``."""
    spark = docs.sparkSession
    files = Stage(spark, "token-shards").write(write_token_files(docs, folder, vocabulary, id_col, **more))
    count = files.count()
    if not count:
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return read_token_files(based.repartition(min(count, READERS))).withColumnRenamed("id", id_col)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Stage(spark, "token-files").path
    return token_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json")
    )
