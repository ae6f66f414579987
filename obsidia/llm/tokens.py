"""Token ids of whole texts, and a binary record format for them.

A record file is a run of records, each framed so that a reader can check and skip it:
8 bytes length, 4 bytes masked crc32 of the length, the payload, 4 bytes masked crc32 of the payload.
A payload is 8 bytes document id, 1 byte whether there is an id, 1 byte id width, then the ids, little-endian.
Each file NAME.rec has an index NAME.idx: per record its offset and its size, 8 bytes each, for reads in any order.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Words that a worker remembers the ids of, the characters that they may hold, and the characters of texts that it takes in one go.
REMEMBERED, HELD, SLICE = 600_000, 12_000_000, 4_000_000
#: Rows that come to the encoder at once.
ENCODED_ROWS = 1024
#: Stands between words in one call of the library; words that hold it are encoded one by one.
PART = " \x01 "
# The steps of the vocabulary file that words are parted by. A file with others is read by the library alone.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_END = "</w>"
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<qBB")
#: Small letters that the first steps leave as they are; marks after them, but for the apostrophe, which may be a part of letters.
_SMALL, _MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_LETTERS, _TAIL = f"^[{_SMALL}]+$", f"([{_SMALL}])([{_MARKS}]+)( |$)"


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other: of each its start and as many as it counts."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library.

    A vocabulary whose steps are those stated above never joins what a space or a line feed parts, nor letters and marks. So each
    distinct word is encoded once and its ids are remembered, in bounded memory. Words of small letters go to the library's merges
    without the steps that leave them as they are. Any other vocabulary, and texts that may hold a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        steps = json.loads(self.tokenizer.to_str())
        before = (steps["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
        known = (
            (steps["normalizer"] or {}).get("normalizers") == _NORMALIZER and before[0].get("pattern") == {"Regex": _SPLIT} and before[0].get("behavior") == "Removed"
            and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space") and not before[1].get("use_regex")
            and len(before) == 2 and steps["model"]["type"] == "BPE" and steps["model"]["end_of_word_suffix"] == _END
        )
        known = known and all("<|" in x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        part = self.tokenizer.encode(PART, add_special_tokens=False).ids
        self.part_id = part[0] if known and len(part) == 1 and self.tokenizer.encode(f"a{PART}a", add_special_tokens=False).ids.count(part[0]) == 1 else None
        self.known = known
        if known:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(_END)]] = True
        self._forget()

    def _forget(self) -> None:
        """Known words by number; the ids of one are counts[number] of flat from starts[number] on."""
        self.words = pa.array([], pa.string())
        self.starts, self.counts, self.recent = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.flat = np.zeros(0, self.dtype)

    def _trim(self, last: np.ndarray) -> None:
        """Keeps what was used since this last dropped words, or in the last slice alone, in as many words and characters as may be held."""
        if len(self.words) <= REMEMBERED and self.words.nbytes <= HELD:
            return
        for keep in (np.flatnonzero(self.recent), np.unique(last)):
            if len(keep) <= REMEMBERED // 2:
                break
        keep = keep[: REMEMBERED // 2]
        sizes = pc.binary_length(self.words).to_numpy()[keep]
        keep = keep[(sizes <= 40) & (np.cumsum(sizes) <= HELD // 2)]
        self.flat = self.flat[gathered(self.starts[keep], self.counts[keep])]
        self.words = self.words.take(pa.array(keep))
        self.counts = self.counts[keep]
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.recent = np.zeros(len(keep), bool)

    def _general(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words by all steps of the library, many to a call: a word of its own between them comes back as the one id where they part."""
        if self.part_id is None or any(PART.strip() in w for w in words):
            found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([i for x in found for i in x], self.dtype), np.array([len(x) for x in found], np.int64)
        ids, counts = [], []
        for e in self.tokenizer.encode_batch_fast([PART.join(words[at : at + 64]) for at in range(0, len(words), 64)], add_special_tokens=False):
            found = np.array(e.ids, self.dtype)
            parts = found == self.part_id
            ends = np.flatnonzero(parts)
            counts.append(np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1)
            ids.append(found[~parts])
        return np.concatenate(ids), np.concatenate(counts)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Small letters alone: each word is one run of merges and its last id has the mark of a word's end."""
        joined = [" ".join(words[at : at + 512]) for at in range(0, len(words), 512)]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            return self._general(words)
        return ids, np.diff(np.concatenate([[-1], ends]))

    def _learn(self, fresh: pa.StringArray) -> None:
        small = pc.match_substring_regex(fresh, _LETTERS)
        parts = [(fresh.filter(small), self._letters), (fresh.filter(pc.invert(small)), self._general)]
        ids, counts = [self.flat], []
        for words, by in parts:
            for at in range(0, len(words), 16_384):
                found, n = by(words[at : at + 16_384].to_pylist())
                ids.append(found)
                counts.append(n)
        self.words = pa.concat_arrays([self.words, *(w for w, _ in parts)])
        self.flat = np.concatenate(ids)
        self.counts = np.concatenate([self.counts, *counts])
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.recent = np.concatenate([self.recent, np.zeros(len(fresh), bool)])

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, the texts being few enough to be taken in one go."""
        if any("<|" in t for t in texts):  # may hold a special token, which is looked for in the text as it is
            for t in texts:
                if "<|" in t:
                    yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
                else:
                    yield from self._slice([t])
            return
        clean = pc.ascii_lower(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "))
        words = pc.split_pattern(pc.replace_substring_regex(clean, _TAIL, r"\1 \2\3"), " ")
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary
        numbers = pc.index_in(distinct, self.words)
        if numbers.null_count:
            self._learn(distinct.filter(numbers.is_null()))
            numbers = pc.index_in(distinct, self.words)
        numbers = numbers.to_numpy()
        self.recent[numbers] = True
        used = numbers[coded.indices.to_numpy()]
        counts = self.counts[used]
        ids = self.flat[gathered(self.starts[used], counts)]
        at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[words.offsets.to_numpy()].tolist()
        self._trim(numbers)
        for a, b in zip(at, at[1:], strict=False):
            yield ids[a:b].tobytes()

    def encode(self, texts: list[str], end_id: int) -> Iterator[bytes]:
        """The ids of each text and then end_id, as little-endian integers of self.dtype. A long text is taken in parts between words."""
        end = np.array([end_id], self.dtype).tobytes()
        if not self.known:
            for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes() + end
            return
        held: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > SLICE and held:
                yield from (x + end for x in self._slice(held))
                held, size = [], 0
            if len(text) > SLICE:
                yield b"".join(x for part in _cut(text) for x in self._slice([part])) + end
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from (x + end for x in self._slice(held))


def _cut(text: str) -> Iterator[str]:
    """A long text in parts of about SLICE characters that end where a space or line feed does; what has none stays whole."""
    at = 0
    space = re.compile("[ \n]")
    while at < len(text):
        found = space.search(text, at + SLICE)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkEncoder:
    """The worker's own encoder: what it remembers serves its later tasks too."""
    return ChunkEncoder(path)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text in ascending order of doc_id (nulls first, equal ids by how their texts begin), a range of them in each partition.

    Rows with one and the same id, however many, are dealt to several partitions: by the start of the text, then by place in the input.
    """
    n = common.partitions(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.substring(F.col(text_col), 1, 16).alias("head"), F.monotonically_increasing_id().alias("at"))
    keys = ["doc_id", "head", "at"]
    return docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def masked(crc: int) -> int:
    """A checksum of data that holds checksums: rotated and moved, as record formats do."""
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframe(read, where: str) -> Iterator[bytes]:
    """The payloads of a file, from read(n). A damaged or cut file raises ValueError."""
    while head := read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise ValueError(f"{where}: cut within a record's head")
        length, crc = _HEAD.unpack(head)
        if masked(zlib.crc32(head[:8])) != crc:
            raise ValueError(f"{where}: a record's length is damaged")
        payload, tail = read(length), read(4)
        if len(payload) < length or len(tail) < 4 or masked(zlib.crc32(payload)) != struct.unpack("<I", tail)[0]:
            raise ValueError(f"{where}: a record is cut or damaged")
        yield payload


def payload_of(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return _DOC.pack(doc_id or 0, doc_id is not None, width) + ids


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each document's ids to record files under path, in ascending order of ids; returns the manifest: file, part, records, tokens, size.

    A null text is an empty one: its ids are end_id alone. Rows with equal or null ids are documents of their own. An empty table
    gives no file. A file is written under a name of its task attempt and only the attempts in the returned manifest count, so a task
    that runs again after a lost executor does no harm. The manifest, a row a file, comes from the driver. Other columns of docs are ignored.
    """
    spark = docs.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:05d}-{uuid.uuid4().hex}"
        encoder = out = None
        at = tokens = records = 0
        index = array("Q")
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = encoder_of(tokenizer)
                fs, local = _open(f"{name}.rec")
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(local)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(common.texts_of(batch), end_id), strict=True):
                framed = frame(payload_of(doc_id, encoder.dtype.itemsize, ids))
                out.write(framed)
                index.extend((at, len(framed)))
                at += len(framed)
                tokens += len(ids) // encoder.dtype.itemsize
                records += 1
        if out is not None:
            out.close()
            with fs.open_output_stream(_index(local)) as f:
                f.write(np.array(index, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"file": [f"{name}.rec"], "part": [part], "records": [records], "tokens": [tokens], "size": [at]})

    schema = "file string, part long, records long, tokens long, size long"
    with common.batches(spark, ENCODED_ROWS):
        return spark.createDataFrame(ordered(docs, id_col, text_col).mapInArrow(write, schema).collect(), schema)


#: Bytes of record files that a task reads, at least, if there are as many.
READ_BYTES = 64 << 20


def files_of(manifest: DataFrame) -> DataFrame:
    """Rows of files and starts: the record files, in order, in as many partitions as READ_BYTES make, and the ids of all files before each."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r.part)
    groups: list[tuple[list[str], list[int]]] = []
    start = size = 0
    for r in rows:
        if not groups or size >= READ_BYTES:
            groups.append(([], []))
            size = 0
        groups[-1][0].append(r.file)
        groups[-1][1].append(start)
        start, size = start + r.tokens, size + r.size
    return spark.createDataFrame(groups, "files array<string>, starts array<long>").coalesce(1).repartition(max(1, len(groups)))


def records_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Of each record of files_of(): how many ids are before it, its document's id and its own ids."""
    for batch in batches:
        for files, starts in zip(batch.column("files").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            for file, start in zip(files, starts, strict=True):
                fs, local = _open(file)
                with fs.open_input_stream(local, buffer_size=1 << 20) as f, fs.open_input_stream(_index(local), buffer_size=1 << 16) as index:
                    place = 0
                    while entry := index.read(16):
                        at, size = struct.unpack("<QQ", entry)
                        if at != place:
                            raise ValueError(f"{file}: its index is not of it")
                        doc_id, ids = _parsed(next(unframe(io.BytesIO(f.read(size)).read, file)))
                        yield start, doc_id, ids
                        place, start = at + size, start + len(ids)


def read_at(file: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the offset index."""
    fs, local = _open(file)
    with fs.open_input_file(_index(local)) as f:
        f.seek(16 * record)
        at, size = struct.unpack("<QQ", f.read(16))
    with fs.open_input_file(local) as f:
        f.seek(at)
        return _parsed(next(unframe(io.BytesIO(f.read(size)).read, file)))


def _index(file: str) -> str:
    return file.removesuffix(".rec") + ".idx"


def _parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, there, width = _DOC.unpack_from(payload)
    return doc_id if there else None, np.frombuffer(payload, f"<u{width}", offset=_DOC.size)


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Each record of the manifest's files: doc_id, start (ids of all records before it), n_tokens, ids_crc32 and, if with_ids, ids.

    The manifest's totals are summed up on the driver and each file starts where those before it end.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for start, doc_id, ids in records_in(batches):
            out.append((doc_id, start, len(ids), crc_of_ids(ids), *[ids.astype("<i4")] * with_ids))
            if len(out) == 1024:
                yield _table(out)
                out = []
        yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return files_of(manifest).mapInArrow(read, schema)
