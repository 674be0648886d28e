"""Operator 6: token ids in files of bit or byte planes with a chunk index."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import filesystem, lean, new_folder, partitions, stored


MAGIC, TAIL = b"BRNDTOK1", struct.Struct("<QQI8s")
BLOCK = 1 << 16
WORDS_KEPT = 300_000
#: Texts encoded at once.
STEP = 1024
#: ASCII and Latin-1 letters, then ASCII punctuation; such letters are in normal form.
_PLAIN_RUN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: The definition whose texts may be taken apart at blanks, all of it but for the vocabulary.
_PLAIN_PARTS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_PLAIN_MODEL = {
    "type": "BPE",
    "dropout": None,
    "unk_token": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": "</w>",
    "fuse_unk": False,
    "byte_fallback": False,
    "ignore_merges": False,
}
#: Added tokens that no plain run holds, and no blank is part of: punctuation first, a letter behind it.
_APART = re.compile(r"[!-/:-@\[-`{-~][!-~]*[A-Za-z][!-~]*")
END_ID = 1
_TOKENIZERS: dict[int, Encoder] = {}


def understood(parts: dict) -> bool:
    """Whether all parts of a definition are the known ones, and its added tokens stand apart from plain runs."""
    model = {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")}
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    apart = all(_APART.fullmatch(t["content"]) and not any(t.get(f) for f in flags) for t in parts.get("added_tokens") or [])
    return apart and model == _PLAIN_MODEL and _PLAIN_PARTS == {k: parts.get(k) for k in _PLAIN_PARTS}


class Encoder:
    """Ids of whole texts, through a bounded memory of the ids of white-space-free runs.

    Nothing in the known definition looks across ASCII white space, so the ids of a text
    are those of its runs in order. A run of plain letters with punctuation behind it
    goes straight to the library's model; other runs are encoded whole, many at a time.
    With any other definition the library encodes each text whole. Truncation and
    padding that a definition asks for are turned off.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # ids of lower-cased letter runs of late, and of before; what is used again moves to the front
        self.letters: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # ids of other runs, and of punctuation
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str | None, bytes] = {None: b"", "": b""}
        self.plain = understood(json.loads(definition))
        self.one = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.plain:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        if not texts:
            return []
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))  # blank, \t, \n, \v, \f, \r
        coded = words.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, pattern=_PLAIN_RUN)
        letters = pc.utf8_lower(pc.struct_field(parts, "letters")).dictionary_encode()
        marks = pc.struct_field(parts, "marks").dictionary_encode()
        head = pa.array(self._letters(letters.dictionary.to_pylist()), pa.binary()).take(letters.indices)
        tail = pa.array([self._marks(m) for m in marks.dictionary.to_pylist()], pa.binary()).take(marks.indices)
        other = parts.is_null()
        others = self._others(coded.dictionary.filter(other).view(pa.binary()).to_pylist())
        ids = pc.replace_with_mask(pc.binary_join_element_wise(head, tail, b""), other, pa.array(others, pa.binary()))
        ids = ids.take(coded.indices)
        _, cuts, data = ids.buffers()
        raw = memoryview(data or b"")
        ends = np.frombuffer(cuts, np.int32)[words.offsets.to_numpy()].tolist() if cuts else [0] * (len(texts) + 1)
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]

    def _letters(self, runs: list[str]) -> list[bytes]:
        if len(self.letters) > WORDS_KEPT // 2:
            self.old, self.letters = self.letters, {}
        known, before, one, tokenize = self.letters, self.old.get, self.one, self.tokenizer.model.tokenize
        for w in runs:
            if w not in known:
                ids = before(w)
                if ids is None:
                    ids = b"".join([one[t.id] for t in tokenize(w if w.isascii() else w.translate(self.level))])
                known[w] = ids
        return [known[w] for w in runs]

    def _marks(self, marks: str | None) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > WORDS_KEPT // 2:
                self.marks = {None: b"", "": b""}
            self.marks[marks] = b"".join([self.one[i] for i in self.tokenizer.encode(marks, add_special_tokens=False).ids])
        return self.marks[marks]

    def _others(self, runs: list[bytes]) -> list[bytes]:
        """Runs that are not plain, encoded whole; what stands between blanks at an end is empty."""
        if len(self.known) > WORDS_KEPT // 2:
            self.known = {}
        known = self.known
        rest = [w for w in runs if w not in known]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            got = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)) * 4
            raw = ids.tobytes()
            known.update((w, raw[a:b]) for w, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return [known[w] for w in runs]


def encoder(definition: str) -> Encoder:
    """The worker's encoder; kept while the worker lives."""
    key = zlib.crc32(definition.encode())
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Encoder(definition)
    return _TOKENIZERS[key]


def pack_block(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """Planes of a block: byte k, or bit k, of every id; only as many as the largest id needs."""
    pack = zstandard.ZstdCompressor(level=level).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if kind == "byte":
        wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [pack(np.ascontiguousarray(wide[:, k]).tobytes()) for k in range((bits + 7) // 8)]
    return [pack(np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes()) for k in range(bits)]


def unpack_block(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(unpack(plane), np.uint8)
        part = raw if kind == "byte" else np.unpackbits(raw, count=n)
        ids |= part.astype("<u4") << np.uint32(8 * k if kind == "byte" else k)
    return ids


class TokenWriter:
    """A file: magic, the planes of the blocks, an index (blocks, documents), a tail that finds and checks the index."""

    def __init__(self, stream, kind: str = "byte", block: int = BLOCK) -> None:
        if kind not in ("byte", "bit"):
            raise ValueError(f"planes are 'byte' or 'bit', not {kind!r}")
        self.out, self.kind, self.block = stream, kind, block
        self.out.write(MAGIC)
        self.at, self.waiting, self.n_waiting, self.ids = len(MAGIC), [], 0, 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc, len(ids) // 4))
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.ids += len(ids) // 4
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        at = 0
        while len(ids) - at >= self.block or (all_ and at < len(ids)):
            part = ids[at : at + self.block]
            planes = pack_block(part, self.kind)
            self.chunks.append((len(part), self.at, [len(p) for p in planes]))
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            at += len(part)
        rest = ids[at:].tobytes()
        self.waiting, self.n_waiting = [rest], len(rest) // 4

    def close(self) -> int:
        self._flush(True)
        head = struct.pack("<BQQ", self.kind == "bit", len(self.chunks), len(self.docs))
        table = b"".join(struct.pack(f"<IQB{len(p)}I", n, at, len(p), *p) for n, at, p in self.chunks)
        names = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([d is None for d, _ in self.docs], "u1").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes()
        index = zstandard.ZstdCompressor(level=3).compress(head + table + names)
        self.out.write(index)
        self.out.write(TAIL.pack(self.at, len(index), zlib.crc32(index), MAGIC))
        return self.at + len(index) + TAIL.size


class TokenReader:
    """Reads documents in file order, holding the blocks of one document at a time."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        at, n, crc, magic = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        index = self._read(at, n)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a token file, or its index is damaged")
        raw = zstandard.ZstdDecompressor().decompress(index)
        bit, n_chunks, n_docs = struct.unpack_from("<BQQ", raw)
        self.kind, p, self.chunks = "bit" if bit else "byte", 17, []
        for _ in range(n_chunks):
            count, offset, k = struct.unpack_from("<IQB", raw, p)
            self.chunks.append((count, offset, struct.unpack_from(f"<{k}I", raw, p + 13)))
            p += 13 + 4 * k
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, p)
        self.missing = np.frombuffer(raw, "u1", n_docs, p + 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<u8", n_docs, p + 9 * n_docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        count, at, planes = self.chunks[k]
        raw, out, p = self._read(at, sum(planes)), [], 0
        for n in planes:
            out.append(raw[p : p + n])
            p += n
        return unpack_block(out, count, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, "<u4"), 0
        for doc, none, n in zip(self.doc_ids.tolist(), self.missing.tolist(), self.sizes.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if none else doc, held[:n]
            held = held[n:]


_FILES = pa.schema([("part", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
_FILES_DDL = "part int, path string, bytes long, docs long, ids long"


def _writer(folder: str, shared, end_id: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        task = TaskContext.get()
        part, tag = (task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}") if task else (0, "000000-0")
        code, end, out, writer = encoder(shared.value), struct.pack("<I", end_id), None, None
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/part-{tag}.tok", compression=None)
                writer = TokenWriter(out, kind)
            ids, docs = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, STEP):
                texts = [t or b"" for t in docs.slice(at, STEP).to_pylist()]
                for doc, raw in zip(ids.slice(at, STEP).to_pylist(), code.encode(texts), strict=True):
                    writer.add(doc, raw + end)
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{tag}.tok"], "bytes": [size], "docs": [len(writer.docs)], "ids": [writer.ids]}, schema=_FILES)

    return write


def write_tokens(df: DataFrame, definition: str, folder: str | None = None, end_id: int = END_ID, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write its ids, with ``end_id`` behind, in ascending id order.

    Range partitions become files; returns them (part, path, bytes, docs, ids). Null ids
    come first, equal ids stand in the order of their texts' md5, a null text is empty
    and has only the end id. File names carry the task attempt and only files of attempts
    that ended are listed. An empty table lists no files.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    text = F.col(text_col).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.md5(F.coalesce(text, F.lit(b""))).alias("digest"))
    ranged = rows.repartitionByRange(partitions(spark), "doc", "digest").sortWithinPartitions("doc", "digest").select("doc", "text")
    shared = spark.sparkContext.broadcast(definition)  # one tokenizer file, some MB
    return stored(ranged.mapInArrow(lean(_writer(folder, shared, end_id, kind)), _FILES_DDL), "token-files")


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            for uri, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    for doc, ids in TokenReader(file, size).documents():
                        raw = ids.tobytes()
                        for column, v in zip(rows, (doc, start, len(ids), zlib.crc32(raw), raw if with_ids else None), strict=True):
                            column.append(v)
                        start += len(ids)
                        held += 64 + len(raw) * with_ids
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ROWS.types, strict=True)], schema=_ROWS)
                            rows, held = [[], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ROWS.types, strict=True)], schema=_ROWS)

    return read


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian 32 bit).

    One total per file crosses to the driver; there is a file per range partition.
    """
    spark = files.sparkSession
    starts, total = [], 0
    for part, n in sorted(files.select("part", "ids").collect()):
        starts.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    placed = files.join(base, "part").select("path", "bytes", "start", "part").repartition(partitions(spark), "part").drop("part")
    return placed.mapInArrow(lean(_reader(with_ids)), _ROWS_DDL)


def tokenizer_file(path: str | None = None) -> str:
    """The definition of a public tokenizer; its place is a parameter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, tokenizer_file()), with_ids=False).drop("ids")
