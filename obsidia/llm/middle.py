"""Fill-in-the-middle: texts are cut in three at unit boundaries and put together in another order, all rows of a batch at once.

A batch's texts are one run of UTF-8 bytes, as Arrow holds them. A lookup table gives each byte's class; where two adjacent bytes lie on
either side of a unit's end, or of a text's, a mask is set; the mask's sum, reset at each text, numbers the units of every text. The cuts of
all rows are then places in that sum, which one binary search finds together. The three pieces of each row are the same bytes under other
offsets, so they are not copied before they are put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Bytes of texts that one pass of the kernel takes; a longer text is a pass of its own.
PASS_BYTES = 4 << 20
# Classes of bytes.
_OTHER, _ENDS = 0, 1


@dataclass(frozen=True)
class Settings:
    """ends: bytes after which a unit ends. rate: per cent of texts that are cut; spm: per cent of those in which the suffix leads. seed: before the id in its hash."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    ends: bytes = b"\n"
    rate: int = 100
    spm: int = 50
    seed: int = 7

    def __post_init__(self):
        marks = self.marks
        for i, a in enumerate(marks):
            if not a or any(a.endswith(b[:k]) for b in marks for k in range(1, len(b)) if k < len(a)) or any(a in b for j, b in enumerate(marks) if i != j):
                raise ValueError("no mark may be empty, hold another or end as another begins: their places in an output would not be sure")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def classes(self) -> np.ndarray:
        table = np.full(256, _OTHER, np.uint8)
        table[list(self.ends)] = _ENDS
        return table


LINES = Settings()


def _draws(id_col: Column, seed: int) -> list[Column]:
    """The first four numbers of 32 bits in the SHA-256 of seed:id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def _sums(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])


def _pieces(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The same bytes as an array of the strings between the offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(flat))


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))


def cut(texts: pa.Array, h: list[np.ndarray], settings: Settings) -> pa.RecordBatch:
    """n, form, prefix_chars, middle_chars and output of each text; h: its four draws."""
    flat, at = _buffers(texts)
    begin, end = at[:-1], at[1:]
    kind = settings.classes()[flat]
    starts = np.zeros(len(flat), bool)
    starts[1:] = kind[:-1] == _ENDS
    starts[begin[begin < end]] = True
    units = _sums(starts)  # units that start before each byte; less those before its text: the text's own
    before = units[begin]
    n = units[end] - before
    chars = _sums(flat & 0xC0 != 0x80)
    a, b = (x % (n + 1) for x in h[:2])
    # A cut stands where the unit behind it starts, the first byte with so many units upto it, or at the text's end.
    first, second = (np.minimum(np.searchsorted(units[1:], before + k + 1), end) for k in (np.minimum(a, b), np.maximum(a, b)))
    held = np.zeros(len(n), bool)
    for mark in settings.marks:
        held |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (begin == end) | held | (h[2] % 100 >= settings.rate)
    turned = ~plain & (h[3] % 100 < settings.spm)
    form = np.where(plain, "plain", np.where(turned, "spm", "psm"))
    pieces = _pieces(flat, np.concatenate([np.stack([begin, first, second], axis=1).ravel(), at[-1:]]))
    rows = np.arange(len(n)) * 3
    prefix, middle, suffix = (pieces.take(pa.array(rows + k)) for k in range(3))
    p, s, m = settings.marks
    output = pc.case_when(
        pc.make_struct(pa.array(plain), pa.array(turned)), texts.cast(pa.large_string()), _joined(s, suffix, p, prefix, m, middle), _joined(p, prefix, s, suffix, m, middle)
    )
    sizes = [pa.array(np.where(plain, 0, chars[hi] - chars[lo]), mask=plain) for lo, hi in ((begin, first), (first, second))]
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(form.tolist(), pa.string()), *sizes, output.cast(pa.string())], ["n", "form", "prefix_chars", "middle_chars", "output"])


def _found(flat: np.ndarray, mark: str) -> np.ndarray:
    """Where a mark begins in the bytes: adjacent bytes that are its own."""
    of = np.frombuffer(mark.encode(), np.uint8)
    n = len(flat) - len(of) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.logical_and.reduce([flat[k : k + n] == of[k] for k in range(len(of))]))


def rebuilt(output: pa.Array, form: pa.Array, settings: Settings) -> pa.Array:
    """The texts that outputs were made of, from outputs and forms alone."""
    plain = pc.equal(form, "plain").to_numpy(zero_copy_only=False)
    out = [output.filter(pa.array(plain)).cast(pa.large_string())]
    for name, order in (("psm", (0, 1, 2)), ("spm", (1, 0, 2))):
        flat, at = _buffers(output.filter(pc.equal(form, name)))
        marks = [settings.marks[k] for k in order]
        places = [_found(flat, m) for m in marks]  # one of each in each row, and in this order
        bounds = np.stack([x for m, f in zip(marks, places, strict=True) for x in (f, f + len(m.encode()))], axis=1).ravel()
        held = _pieces(flat, np.concatenate([bounds, at[-1:]]))
        parts = [held.take(pa.array(np.arange(len(at) - 1) * 6 + 1 + 2 * k)) for k in range(3)]
        of = dict(zip(order, parts, strict=True))
        out.append(_joined(of[0], of[2], of[1]))
    where = np.concatenate([np.flatnonzero(plain), *(np.flatnonzero(pc.equal(form, name).to_numpy(zero_copy_only=False)) for name in ("psm", "spm"))])
    return pa.concat_arrays(out).take(pa.array(np.argsort(where))).cast(pa.string())


def _passes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch's rows in runs of about PASS_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + PASS_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def transform(docs: DataFrame, settings: Settings = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row.

    n: the text's units, each up to and with the byte that ends it. The smaller of h1 % (n + 1) and h2 % (n + 1) units are the prefix, the
    others up to the larger the middle. form is plain, and the two counts null, where the text is empty, holds a mark or is not drawn. A
    null text is an empty one. Rows with equal or null ids and repeated rows each give a row, cut alike where id and text are alike.
    An empty table gives none. Other columns are ignored, whatever their names.
    """
    common.small_batches(docs.sparkSession)
    row_id = F.col(f"`{id_col}`").cast("long")
    drawn = docs.select(row_id.alias("doc_id"), *_draws(row_id, settings.seed), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _passes(batch, "text"):
                made = cut(part.column("text"), [part.column(f"h{i}").to_numpy() for i in range(1, 5)], settings)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made.columns], ["doc_id", *made.schema.names])

    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, settings: Settings = LINES) -> DataFrame:
    """The rows of transform() with the column restored: the text as it was, from output and form."""
    common.small_batches(made.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _passes(batch, "output"):
                yield pa.RecordBatch.from_arrays([*part.columns, rebuilt(part.column("output"), part.column("form"), settings)], [*part.schema.names, "restored"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in made.dtypes)
    return made.mapInArrow(run, f"{kinds}, restored string")


def digests(docs: DataFrame, settings: Settings = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """transform() and restore() with the SHA-256 of what they give in place of it."""
    both = restore(transform(docs, settings, id_col, text_col), settings)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
