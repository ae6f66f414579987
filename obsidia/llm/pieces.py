"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a chunk the table holds the one token that the prefix's encoding ends with. A token that ends there is that one
if it and the token that its own start's prefix ends with stay two tokens when encoded together. Candidates come from an automaton
over all pieces; the ids are then read off backwards. No merge queue runs over the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

SPACE = "▁"
#: Chunks that a worker remembers, the bytes that they and what is known of them may hold, remembered pairs, and characters taken in one go.
REMEMBERED, HELD, PAIRS, SLICE = 800_000, 64_000_000, 1_000_000, 4_000_000
#: Rows that the encoder takes at once, from as many batches.
ROWS = 1024
#: Stands between chunks; texts that hold it are taken chunk by chunk.
PART = "\x00"
_LETTERS, _MARKS = "A-Za-z", r"!\"#$%&'()*+,./:;<=>?@\[\]^_`{|}~-"


class PrefixTable:
    """The encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        spec = model.normalizer_spec
        inner = any(SPACE in p.lstrip(SPACE) for _, p, _ in normal)
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or inner or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces) or not any(p.type == 6 for p in model.pieces):
            raise ValueError("only a BPE model with an identity normaliser, a dummy prefix, spaces at the start of pieces and byte fallback is supported")
        self.ids = {p: i for i, p, _ in normal}
        self.score = {p: s for _, p, s in normal}
        self.text = {i: p for i, p, _ in normal}
        self.size = {i: len(p) for i, p in self.text.items()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.alone = {p for p in self.ids if self._merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.alone:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        in_longer = {c for p in self.ids if len(p) > 1 for c in p}
        apart = "".join(c for c in "\n\t" if c not in in_longer)
        self.split = re.compile(f"[{apart}]|{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        # A letter and a mark that follow each other in no piece never become one, so they part a chunk.
        together = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if re.match(f"[{_LETTERS}]", p[i])}
        marks = "".join(c for c in map(chr, range(33, 127)) if re.match(f"[{_MARKS}]", c) and c not in together)
        self.parted = [("( +)", rf"{PART}\1")] + [(f"([{apart}])", rf"{PART}\1{PART}")] * bool(apart) + [(f"([{_LETTERS}])([{re.escape(marks)}])", rf"\1{PART}\2")] * bool(marks)
        self.pair: dict[int, bool] = {}
        self.decoded = {i: p.replace(SPACE, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.of_byte.items()}
        self._forget()

    def _forget(self) -> None:
        """Known chunks by number: how many ids each has, their decimal forms with a comma after each, and the bytes that they decode to."""
        self.known, self.shown, self.bytes = pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.binary())
        self.counts, self.recent = np.zeros(0, np.int64), np.zeros(0, bool)

    def _merged(self, text: str) -> list[str]:
        """The merge rule itself, for texts as long as two pieces: join the neighbours whose piece scores best, the leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces, by their ids, stay two when they are encoded together."""
        pair = [self.text[left], self.text[right]]
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        got = self.pair[left << 32 | right] = self._merged("".join(pair)) == pair
        return got

    def _ids(self, chunk: str) -> list[int]:
        """The chunk's ids. last[end]: the one piece that the encoding of the first `end` characters ends with, None where a character has none.

        Matches come in order of their ends, so what stands before a piece is known when it is tested; nothing joins a character without a piece.
        """
        last: list[int | None] = [None] * (len(chunk) + 1)
        known = self.pair.get
        for end, (size, piece) in self.automaton.iter(chunk):
            end += 1
            if last[end] is None:
                start = end - size
                before = last[start]
                if not start or before is None:
                    last[end] = piece
                else:
                    fits = known(before << 32 | piece)
                    if fits or fits is None and self.compatible(before, piece):
                        last[end] = piece
        out: list[int] = []
        at, size = len(chunk), self.size
        while at:
            piece = last[at]
            if piece is None:
                at -= 1
                out += [self.byte[b] for b in reversed(chunk[at].encode())]
            else:
                out.append(piece)
                at -= size[piece]
        out.reverse()
        return out

    def _learn(self, fresh: list[str]) -> None:
        found = [self._ids(c.replace(" ", SPACE)) for c in fresh]
        self.known = pa.concat_arrays([self.known, pa.array(fresh, pa.string())])
        self.shown = pa.concat_arrays([self.shown, pa.array(["".join([f"{i}," for i in ids]).encode() for ids in found], pa.binary())])
        self.bytes = pa.concat_arrays([self.bytes, pa.array([self.surface(ids) for ids in found], pa.binary())])
        self.counts = np.concatenate([self.counts, np.array([len(ids) for ids in found], np.int64)])
        self.recent = np.concatenate([self.recent, np.zeros(len(fresh), bool)])

    def _trim(self, last: np.ndarray) -> None:
        """Keeps what was used since this last dropped chunks, or in the last slice alone, in as many chunks and bytes as may be held."""
        held = (self.known, self.shown, self.bytes)
        if len(self.known) <= REMEMBERED and sum(x.nbytes for x in held) <= HELD:
            return
        for keep in (np.flatnonzero(self.recent), np.unique(last)):
            if len(keep) <= REMEMBERED // 2:
                break
        keep = keep[: REMEMBERED // 2]
        sizes = sum(pc.binary_length(x).to_numpy() for x in held)[keep] + 12
        keep = keep[(sizes <= 400) & (np.cumsum(sizes) <= HELD // 2)]
        at = pa.array(keep)
        self.known, self.shown, self.bytes = (x.take(at) for x in held)
        self.counts, self.recent = self.counts[keep], np.zeros(len(keep), bool)

    def _slice(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        parted = pa.array([f" {t}" if t else "" for t in texts], pa.string())
        for pattern, to in self.parted:
            parted = pc.replace_substring_regex(parted, pattern, to)
        chunks = pc.split_pattern(parted, PART)
        coded = chunks.values.dictionary_encode()
        numbers = pc.index_in(coded.dictionary, self.known)
        if numbers.null_count:
            self._learn(coded.dictionary.filter(numbers.is_null()).to_pylist())
            numbers = pc.index_in(coded.dictionary, self.known)
        numbers = numbers.to_numpy()
        self.recent[numbers] = True
        used = numbers[coded.indices.to_numpy()]
        ends = chunks.offsets.to_numpy()
        total = np.concatenate([[0], np.cumsum(self.counts[used])])[ends]
        at, shown, plain = pa.array(used), *([x.cast(pa.large_binary()) for x in (self.shown, self.bytes)])
        parts = []
        for of in (shown.take(at), plain.take(at)):
            data = memoryview(of.buffers()[2] or b"")
            parts.append((data, np.frombuffer(of.buffers()[1], np.int64, len(of) + 1)[ends].tolist()))
        self._trim(numbers)
        (ids, id_at), (out, out_at) = parts
        for i, n in enumerate(np.diff(total).tolist()):
            yield n, bytes(ids[id_at[i] : id_at[i + 1]]), bytes(out[out_at[i] : out_at[i + 1]])

    def coded(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text how many ids it has, their decimal forms with a comma after each, and the bytes that they decode to.

        Each distinct chunk is encoded once, as long as it is remembered. A text that is longer than a slice is taken in parts between chunks.
        """
        held: list[str] = []
        size = 0
        for text in texts:
            odd, long = PART in text or SPACE in text, len(text) > SLICE
            if held and (odd or size + len(text) > SLICE):
                yield from self._slice(held)
                held, size = [], 0
            if odd or long:
                ids = [i for c in self.chunks(text) for i in self._ids(c)]
                yield len(ids), "".join([f"{i}," for i in ids]).encode(), self.surface(ids)
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._slice(held)

    def surface(self, ids: list[int]) -> bytes:
        return b"".join([self.decoded.get(i, b" \xe2\x81\x87 ") for i in ids])

    def chunks(self, text: str) -> list[str]:
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self._ids(c)]

    def decode(self, ids: list[int]) -> str:
        return self.surface(ids).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def table_of(path: str) -> PrefixTable:
    """The worker's own table: what it remembers serves its later tasks too."""
    return PrefixTable(path)


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about ROWS rows and at most a slice of text, or one batch."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if held and (rows >= ROWS or size + batch.nbytes > SLICE):
            yield held
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield held


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row doc_id, n_tokens and ids and decoded, or with digests ids_sha256 and decoded_sha256 in their place.

    A null text is an empty one: no ids, an empty decoded text. Rows with equal or null ids each give a row. No shuffle. Other columns
    of docs are ignored.
    """
    common.small_batches(docs.sparkSession)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for held in _together(batches):
            ids, counts, decoded = [], [], []
            for n, shown, plain in table.coded([t for batch in held for t in common.texts_of(batch)]):
                joined, plain = shown.removesuffix(b","), plain.removeprefix(b" ")
                counts.append(n)
                ids.append(hashlib.sha256(joined).hexdigest() if digests else [int(x) for x in joined.split(b",") if x])
                decoded.append(hashlib.sha256(plain).hexdigest() if digests else plain.decode("utf-8", "replace"))
            doc_id = pa.concat_arrays([batch.column("doc_id") for batch in held])
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", *names])

    kind = "string" if digests else "array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} {kind}, {names[1]} string")
