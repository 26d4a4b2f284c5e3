"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

Documents are range-partitioned and sorted by id; each partition is written as files of up to
FILE_IDS ids or FILE_DOCS documents. A file is

    magic | blocks | block starts | document ids, null flags, token counts | lengths | magic

A block holds up to BLOCK ids: the block's minimum is subtracted, the differences are packed at a
width that WIDTH_PERCENTILE of them fit in, and the outliers' high bits follow as an exception
list (positions, then values). Blocks go out as they fill and are read one run at a time, so a
task holds a file's index and one document. Files are written under a temporary name and
renamed; the table of rows that the writers return is the manifest. A task that is run again
writes the same bytes.

Defined results: null text is empty and has the end id alone. Null ids sort first. Rows that
repeat an id (or have none) follow each other in the order of their texts' hashes and may fall into
several files. A very long text is one document of one file. An empty table gives no file.
Columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .shared import materialise, open_fs, range_sorted, shared_dir, shuffle_width, tidy
from .words import slices, text_buffers

MAGIC = b"PFR1"
BLOCK, WIDTH_PERCENTILE = 1024, 95
#: A file ends after so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 22, 1 << 14
_HEAD = struct.Struct("<IIBH")  # values, minimum, width, exceptions
_FOOT = struct.Struct("<QQQ")  # blocks, documents, ids


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after the other."""
    if not width or not len(values):
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    common = int(np.partition(rest, k := (len(rest) - 1) * WIDTH_PERCENTILE // 100)[k])
    width = common.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    out = [_HEAD.pack(len(ids), low, width, len(odd)), pack(rest, width)]
    return b"".join([*out, odd.astype("<u2").tobytes(), (rest[odd] >> np.uint32(width)).astype("<u4").tobytes()])


def decode_block(raw: bytes, at: int) -> np.ndarray:
    n, low, width, odd = _HEAD.unpack_from(raw, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    rest = unpack(raw[at : at + size], n, width)
    at += size
    if odd:
        where = np.frombuffer(raw, "<u2", odd, at)
        rest[where] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd) << np.uint32(width)
    return rest + np.uint32(low)


class TokenFile:
    """Writes one file block by block to an open stream."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self._write(MAGIC)

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= 64 * BLOCK:
            self._blocks(self.n_pending // BLOCK * BLOCK)

    def _blocks(self, end: int) -> None:
        ids = np.concatenate(self.pending).astype(np.uint32) if self.pending else np.empty(0, np.uint32)
        for i in range(0, end, BLOCK):
            self.starts.append(self.at)
            self._write(encode_block(ids[i : min(end, i + BLOCK)]))
        self.pending, self.n_pending = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._blocks(self.n_pending)
        self._write(np.array(self.starts, "<u8").tobytes())
        self._write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self._write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        self._write(np.array(self.counts, "<u8").tobytes())
        self._write(_FOOT.pack(len(self.starts), len(self.doc_ids), self.n_ids))
        self._write(MAGIC)
        self.out.close()


class TokenReader:
    """Reads parts of a file that is open for random access."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._bytes(size - 4 - _FOOT.size, _FOOT.size + 4)
        if self._bytes(0, 4) != MAGIC or tail[-4:] != MAGIC:
            raise ValueError("not a token-block file")
        blocks, docs, self.n_ids = _FOOT.unpack_from(tail)
        index = size - 4 - _FOOT.size - 17 * docs - 8 * blocks
        raw = self._bytes(index, 8 * blocks + 17 * docs)
        starts = np.frombuffer(raw, "<u8", blocks).astype(np.int64)
        self.starts = np.append(starts, index)
        ids, nulls = np.frombuffer(raw, "<i8", docs, 8 * blocks), np.frombuffer(raw, np.uint8, docs, 8 * (blocks + docs))
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids [first, end) of the file, from the blocks that hold them."""
        if end <= first:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, (end - 1) // BLOCK
        base = int(self.starts[a])
        raw = self._bytes(base, int(self.starts[b + 1]) - base)
        ids = np.concatenate([decode_block(raw, int(self.starts[i]) - base) for i in range(a, b + 1)])
        return ids[first - a * BLOCK : end - a * BLOCK]


#: Signs that end a chunk and are split off a letter or digit before them.
_SIGNS = "!\"#$%&()*+,-./:;=?@[]_{|}~"
#: ASCII and Latin letters, whose lower case does not depend on what surrounds them.
_PLAIN = re.compile("[^\\x21-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u024f]")


_BYTE_CHARS = byte_chars()


class _Known(dict):
    """Ids of chunks; a chunk that is not in it is learned when it is looked up."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(chunk)


class ChunkTokenizer:
    """Ids of texts by a tokenizers file that lower-cases, drops white space and splits words from signs.

    Such a tokenizer encodes white-space chunks independently, and a chunk's trailing signs apart
    from its words. Each distinct piece goes through the library once, at its first use; `exact` turns the
    shortcuts off and hands whole texts to the library.
    """

    CHUNKS, PIECES, LONG = 900_000, 700_000, 128
    # The normaliser and the splitter for which the shortcuts hold.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, exact: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        split = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        known = parts["normalizer"] == self.NORMALIZER and split.get("type") == "Split" and split["pattern"] == {"Regex": self.SPLIT} and split["invert"]
        self.exact = exact or not known or parts["post_processor"] is not None
        self.known = _Known(self._learn)
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        if not self.exact:  # each piece comes once, so the model's own cache would only be filled
            self.model._resize_cache(0)
        # the model alone is enough for a plain word if it agrees with the whole tokenizer
        probes = ["the", "straße", "été", "nightingale"]
        self.direct = [*map(self._word, probes)] == [*self._ids(probes)]

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case word of plain letters, straight from the byte-level model."""
        mapped = word if word.isascii() else "".join(map(_BYTE_CHARS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, np.uint32).tobytes()

    @staticmethod
    def _parts(chunk: str) -> tuple[str, str]:
        """(word, trailing signs): lower-cased where that is sure to be what the tokenizer does."""
        word = chunk.rstrip(_SIGNS)
        if not word or not word[-1].isalnum() or "<|" in chunk or _PLAIN.search(chunk):
            return chunk, ""
        return word.lower(), chunk[len(word) :]

    def _piece(self, piece: str) -> bytes:
        plain = self.direct and piece.isalpha() and piece == piece.lower() and (piece.isascii() or not _PLAIN.search(piece))
        ids = self._word(piece) if plain else next(self._ids([piece]))
        if len(piece) <= self.LONG:
            self.pieces[piece] = ids
        return ids

    def _learn(self, chunk: str) -> bytes:
        word, signs = self._parts(chunk)
        ids = (self.pieces.get(word) or self._piece(word)) if word else b""
        if signs:
            ids += self.pieces.get(signs) or self._piece(signs)
        if len(chunk) <= self.LONG:
            self.known[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.exact:
            return [np.frombuffer(x, np.uint32) for x in self._ids(texts)]
        if len(self.known) > self.CHUNKS or len(self.pieces) > self.PIECES:
            self.known.clear()
            self.pieces.clear()
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, t.replace("\n", " ").replace("\t", " ").split(" "))), np.uint32) for t in texts]


_tokenizers: dict[str, ChunkTokenizer] = {}


def chunk_encoder(path: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """A factory, called in the worker, of the encoder for a tokenizer file."""

    def make() -> Callable[[list[str]], list[np.ndarray]]:
        if path not in _tokenizers:
            _tokenizers[path] = ChunkTokenizer(path)
        return _tokenizers[path].encode

    return make


_TEXT_BYTES = 1 << 20


def write_tokens(docs: DataFrame, folder: str, encoder: Callable, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the files; returns the manifest: (part, roll, path, n_docs, n_ids, start), in order of part and roll.

    start: ids of all files before. The encoder's ids must be below 2^32 and the end id closes
    each document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = range_sorted(rows, rows.select("id", "h"), ["text"]).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], np.uint32)
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        part, saved, now = TaskContext.get().partitionId(), [], None

        def close() -> None:
            file, temporary, name = now
            file.close()
            fs.move(temporary, f"{root}/{name}")
            saved.append((part, len(saved), f"{folder}/{name}", len(file.doc_ids), file.n_ids))

        for b in batches:
            for i, j in slices(text_buffers(b.column(1))[1], _TEXT_BYTES):
                some = b.slice(i, j - i)
                encoded = encode([t or "" for t in some.column(1).to_pylist()])
                for d, e in zip(some.column(0).to_pylist(), encoded, strict=True):
                    if now and (now[0].n_ids >= file_ids or len(now[0].doc_ids) >= file_docs):
                        close()
                        now = None
                    if not now:
                        name = f"{part:08d}-{len(saved):06d}.tok"
                        temporary = f"{root}/.{name}-{uuid.uuid4().hex}.tmp"
                        now = TokenFile(fs.open_output_stream(temporary)), temporary, name
                    now[0].add(d, np.concatenate([e, end]))
        if now:
            close()
        cols = [*zip(*saved, strict=True)] if saved else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "roll", "path", "n_docs", "n_ids"])

    manifest = materialise(rows.mapInArrow(tidy(run), "part int, roll int, path string, n_docs long, n_ids long"), "token-manifest")
    # ids before each part, then within the part: no window holds more than a part's files or one row a part
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("roll").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("before")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids as little-endian uint32 bytes) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, doc_ids, starts, parts in _files(batches):
            for i in range(0, len(doc_ids), 64):
                raw = [p.astype("<u4").tobytes() for p in parts(i, i + 64)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i : i + 64], pa.int64()), pa.array(starts[i : i + 64], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "start", "ids"])

    return _by_file(manifest).mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def token_checksums(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc_ids, starts, parts in _files(batches):
            got = [(len(p), zlib.crc32(p.astype("<u4").tobytes())) for i in range(0, len(doc_ids), 64) for p in parts(i, i + 64)]
            n, crc = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _by_file(manifest).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _by_file(manifest: DataFrame) -> DataFrame:
    return manifest.select("path", "start").repartition(shuffle_width(manifest.sparkSession), "path")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(path, document ids, starts, function of a range of documents that gives their ids) of each file."""
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, at = open_fs(path)
            with fs.open_input_file(at) as f:
                reader = TokenReader(f, f.size())
                counts, ends = reader.counts, np.cumsum(reader.counts)

                def parts(i: int, j: int, reader=reader, counts=counts, ends=ends) -> list[np.ndarray]:
                    j = min(j, len(counts))
                    first = int(ends[i] - counts[i])
                    return np.split(reader.ids(first, int(ends[j - 1])), ends[i : j - 1] - first)

                yield path, reader.doc_ids, (start + ends - counts).tolist(), parts


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs' token files into a new shared folder; returns the manifest."""
    return write_tokens(docs, shared_dir(docs.sparkSession, "token-blocks"), chunk_encoder(tokenizer_path), end_id)
