"""Token-ID / binary output: independent zstandard frames with a trailing seek table.

*Format.* A file holds documents in ascending order of their ids. Each document is one zstandard frame of
its own: a 12-byte head (id, and whether it has one), then the token ids as little-endian unsigned 32-bit
numbers. Then come two skippable frames: the document ids (for look-up by binary search), and the public
seek table of zstandard's seekable format: compressed size, size and checksum (the low half of xxHash64)
of every frame, their number, and the magic number. A reader takes the tail, finds a document's frame and
decompresses that frame alone; any zstandard tool can decompress the whole file.

*Write.* One range shuffle sorts the documents by id; each task encodes its range and streams a file to
the shared folder under a name of its own attempt. Only files that a successful task has returned are in
the manifest, so a lost executor or a second attempt leaves nothing wrong. *Read.* Each file is read back
frame by frame, checksums verified.

*Encoding.* The byte-level pre-tokenizer never joins text across a single blank between two characters
that are no white space, nor letters with the mark behind them, so texts are cut there and the tokenizer sees each
distinct piece once per worker (bounded cache); a batch's ids are gathered by piece number. Letters alone are one unit of the
pre-tokenizer, so they go to the tokenizer's model straight away, in its byte letters. Texts with other white space at such a
cut are encoded whole. The ids are the same as of whole texts (tested), at several times the speed.

Bounds. The manifest has a row per file. Nothing else meets in one task.

Defined cases. Null or empty text: only the end id. Null id: sorted first, ``doc_id`` null again when
read. Repeated ids: ordered by the text's hash, then text. Empty table: no file, empty result. Other
columns are ignored.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm.shipping import shipped
from tillwise.llm.workers import kept, trim
from tillwise.session import derived_path

SKIPPABLE, SEEK_MAGIC, IDS_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CACHE_PIECES, LEVEL = 500_000, 3
#: Marks that end a run of letters without being part of a contraction; a run of them is one unit of the pre-tokenizer.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LONGEST_TAIL = 8
_HEAD = struct.Struct("<qI")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Encoder:
    """Token ids of texts as bytes (unsigned 32-bit, little endian), by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # ids of pieces that stand after a blank, those used lately and those used before (see encode); b"" where a text cannot
        # be cut, and of words that stand after a line break
        self.rest: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_ids = np.array(self.line, "<u4").tobytes()
        self.tails: dict[str, bytes] = {"": b""}  # of marks behind letters
        # the byte-level pre-tokenizer stands for a byte by its own Latin-1 character if that is printable, else by the next one from 256 on
        plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
        self.byte_letters = np.zeros(256, "<u2")
        self.byte_letters[plain] = plain
        self.byte_letters[self.byte_letters == 0] = 256 + np.arange(256 - len(plain))
        # straight to the model only where it gives what the whole tokenizer gives, whatever file that was read from
        trial = ["a", "the", "Straße", "été", "\u4e2d\u6587", "zzqxjv"]
        self.direct = False
        self.direct = all(self._letters(trial, blank) == self.whole([blank + x for x in trial]) for blank in ("", " "))

    def _letters(self, words: list[str], blank: str) -> list[bytes]:
        """Ids of words of letters only, each one unit of the pre-tokenizer, by the tokenizer's model."""
        mapped = self.byte_letters[np.frombuffer(("\n" + blank).join(["", *words]).encode(), np.uint8)].tobytes().decode("utf-16-le")
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(x)] for x in mapped.split(chr(self.byte_letters[10]))[1:]]
        heads = np.cumsum([0, *map(len, ids)]).tolist()
        raw = np.fromiter(chain.from_iterable(ids), "<u4", heads[-1]).tobytes()
        return [raw[4 * x:4 * y] for x, y in zip(heads[:-1], heads[1:], strict=True)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str], blank: str) -> list[bytes]:
        """Ids of pieces without white space, as lines of one text: a line break between two of them is a token of its own."""
        ids = np.array(self.tokenizer.encode_batch_fast([("\n" + blank).join(["", *pieces, ""])], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.line[0])
        if len(self.line) != 1 or len(at) != len(pieces) + 1:
            return self.whole([blank + p for p in pieces])
        raw = ids.tobytes()
        return [raw[4 * x + 4:4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[marks] = self.whole([marks])[0]
        return self.tails[marks]

    @staticmethod
    def _lines(piece: str) -> list[tuple[str, str]]:
        """A piece's words, one a line, and their letters; empty if it is not made of letters with marks behind them."""
        lines = [(x, x.rstrip(MARKS)) for x in piece.split("\n")]
        return lines if all(c.isalpha() and len(x) - len(c) <= LONGEST_TAIL for x, c in lines) else []

    def _learn(self, pieces: list[str]) -> None:
        """Adds distinct pieces that are not in ``rest``."""
        if len(self.bare) > CACHE_PIECES:
            self.bare = {}
        rest, old, letters, plain, bare, inside, marked, built = self.rest, self.old, set(), [], set(), [], [], []

        def need(core: str) -> None:
            """Learns letters that a piece begins with."""
            if core not in rest:
                if core in old:
                    rest[core] = old[core]
                else:
                    letters.add(core)

        for p in pieces:
            if p in old:
                rest[p] = old[p]
            elif p.isalpha():
                letters.add(p)
            elif (core := p.rstrip(MARKS)).isalpha() and len(p) - len(core) <= LONGEST_TAIL:
                marked.append((p, core))  # the pre-tokenizer ends a run of letters at the mark, so the ids of both stand side by side
                need(core)
            elif not p or p[0].isspace() or p[-1].isspace():
                rest[p] = b""  # no cut next to other white space
            elif "\n" in p and (lines := self._lines(p)):
                built.append((p, lines))  # words, one a line: a single line break between them is a token of its own
                need(lines[0][1])
                bare.update(c for _, c in lines[1:])
            elif p.isprintable() and not p.startswith("<|"):
                plain.append(p)
            else:
                inside.append(p)
        alone = self._letters if self.direct else self._many
        for known, found, blank, ids in ((rest, list(letters), " ", alone), (self.bare, list(bare - self.bare.keys()), "", alone), (rest, plain, " ", self._many)):
            for i in range(0, len(found), 4096):
                known.update(zip(found[i:i + 4096], ids(found[i:i + 4096], blank), strict=True))
        rest.update(zip(inside, self.whole([" " + p for p in inside]), strict=True))
        for p, core in marked:
            rest[p] = rest[core] + self._tail(p[len(core):])
        for p, lines in built:
            ids = [rest[lines[0][1]], self._tail(lines[0][0][len(lines[0][1]):])]
            for x, core in lines[1:]:
                ids += [self.line_ids, self.bare[core], self._tail(x[len(core):])]
            rest[p] = b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Pieces are told apart once a batch; their ids are gathered by position, not piece by piece."""
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        which, known = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del cut, coded
        heads = [known[i] for i in which[at[:-1]].tolist()]  # nothing stands before them
        which[at[:-1]] = len(known) + np.arange(len(texts))
        if len(self.rest) > CACHE_PIECES:  # what was not used since the last time is forgotten
            self.rest, self.old = {}, self.rest
        ids = list(map(self.rest.get, known))
        new = [i for i, x in enumerate(ids) if x is None]
        self._learn([known[i] for i in new])
        for i in new:
            ids[i] = self.rest[known[i]]
        ids += [b"" if not h or h[-1].isspace() else x for h, x in zip(heads, self.whole(heads), strict=True)]
        empty = np.fromiter(map(len, ids), np.int64, len(ids)) == 0
        odd = np.logical_or.reduceat(empty[which], at[:-1])
        joined = pa.array(ids, pa.large_binary()).take(pa.array(which))
        _, ends, out = joined.buffers()
        border = np.frombuffer(ends, np.int64)[:len(joined) + 1][at].tolist()
        out = memoryview(out) if out is not None else b""
        done = [bytes(out[lo:hi]) for lo, hi in zip(border[:-1], border[1:], strict=True)]
        again = np.flatnonzero(odd).tolist()
        for i, x in zip(again, self.whole([texts[i] for i in again]), strict=True):
            done[i] = x
        return done


def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so its cache serves them all, until another operator works there."""
    encoders = kept("token_output")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow can open: file, hdfs, s3, gs."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if re.match(r"[a-z0-9]+:", uri) else (pafs.LocalFileSystem(), uri)


class Writer:
    """Writes documents as frames; ``close`` adds the ids and the seek table."""

    def __init__(self, out):
        self.out, self.entries, self.ids, self.tokens = out, [], [], 0
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        raw = _HEAD.pack(doc_id or 0, doc_id is not None) + ids
        frame = self.codec.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id if doc_id is not None else -(1 << 63))
        self.tokens += len(ids) // 4

    def close(self) -> None:
        ids = self.codec.compress(np.array(self.ids, "<i8").tobytes())
        self.out.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to a file of :class:`Writer`. ``source``: a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(size - 17 - 12 * n)
        head = struct.unpack("<II", source.read(8))
        if head != (SKIPPABLE, 12 * n + 9):
            raise ValueError("broken seek table")
        self.entries = np.frombuffer(source.read(12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.entries[:, 0], dtype=np.int64)))
        self.codec = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def ids(self) -> np.ndarray:
        """Document ids in file order (ascending)."""
        self.source.seek(int(self.starts[-1]))
        magic, size = struct.unpack("<II", self.source.read(8))
        if magic != IDS_MAGIC:
            raise ValueError("no document ids")
        return np.frombuffer(self.codec.decompress(self.source.read(size)), "<i8")

    def frame(self, i: int) -> tuple[int | None, bytes]:
        """(document id, token ids) of one frame; only that frame is read and decompressed."""
        self.source.seek(int(self.starts[i]))
        raw = self.codec.decompress(self.source.read(int(self.entries[i, 0])))
        if len(raw) != self.entries[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[i, 2]:
            raise ValueError(f"frame {i} does not match its checksum")
        doc_id, has = _HEAD.unpack_from(raw)
        return (doc_id if has else None), raw[_HEAD.size:]

    def get(self, doc_id: int) -> list[bytes]:
        """Token ids of the documents with that id."""
        ids = self.ids()
        lo, hi = np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")
        return [self.frame(i)[1] for i in range(lo, hi)]


def _write(batches: Iterable[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    fs, root = filesystem(folder)
    encoder, writer, done = None, None, 0
    end = struct.pack("<I", end_id)
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            rows = b.slice(lo, 1024)
            if not rows.num_rows:
                continue
            if writer is None:
                encoder, writer = encoder_of(path), Writer(fs.open_output_stream(f"{root}/{name}", compression=None))
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for doc_id, ids in zip(rows.column("did").to_pylist(), encoder.encode(texts), strict=True):
                writer.add(doc_id, ids + end)
            done += 1
            if done % 16 == 0:
                trim()
    trim()
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)]), pa.array([writer.tokens])],
                                         ["part", "path", "documents", "tokens"])


def _read(batches: Iterable[pa.RecordBatch], rows_out: int = 4096) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "path", "frame"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            fs, place = filesystem(path)
            with fs.open_input_file(place) as source:
                reader, rows = Reader(source), []
                for i in range(len(reader)):
                    doc_id, ids = reader.frame(i)
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), path, i))
                    start += len(ids) // 4
                    if len(rows) == rows_out:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the files to ``folder`` (default: a new one in the shared folder) and returns the manifest:
    part, path, documents, tokens, start (ids in all files before)."""
    spark = docs.sparkSession
    folder = folder or derived_path(spark, "tokens")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = shipped(docs).select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("did").sortWithinPartitions(F.asc_nulls_first("did"), F.xxhash64("text"), "text")
    manifest = materialize_table(ordered.mapInArrow(partial(_write, folder=folder, path=tokenizer or tokenizer_path(), end_id=end_id),
                                                    "part int, path string, documents long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, path, frame."""
    n = manifest.count()  # a task per file: their rows are tiny, so Spark would otherwise join the tasks
    files = manifest.repartitionByRange(max(n, 1), "part").select("path", "start")
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, frame long")
