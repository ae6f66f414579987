"""Packing documents into training sequences: concatenate and cut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from obsidia.llm import common
from obsidia.llm.tokens import crc_of_ids, files_of, records_in, write_records

#: Pieces that a task holds before it puts them out.
PIECES = 1024


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, ids.

    All documents' ids, in ascending order of doc_id, form one line that is cut every `length` ids; only the last sequence can be
    short. First pass: each partition, a range of ids, is encoded into a record file. The partitions' totals, one number each, are
    summed up on the driver. Second pass: each document's place in the line is its file's start and its place there; pieces end
    where windows do, so a document across a boundary has a record on both sides.

    A null text is an empty one and gives end_id alone. Rows with equal or null ids are documents of their own. An empty table
    gives no piece. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    manifest = write_records(docs, common.scratch(spark, "pack"), tokenizer, end_id, id_col, text_col)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in [*fields, "ids"]}
        for first, doc_id, ids in records_in(batches):
            at = 0
            while at < len(ids):
                sequence, offset = divmod(first + at, length)
                size = min(len(ids) - at, length - offset)
                piece = ids[at : at + size]
                for k, v in zip(fields, (doc_id, at, size, crc_of_ids(piece), len(ids), sequence, offset), strict=True):
                    out[k].append(v)
                if with_ids:
                    out["ids"].append(piece.astype("<i4"))
                at += size
                if len(out["doc_id"]) >= PIECES:
                    yield table(out)
                    out = {k: [] for k in out}
        yield table(out)

    def table(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in fields] + [pa.array(out["ids"], pa.list_(pa.int32()))] * with_ids, fields + ["ids"] * with_ids)

    return files_of(manifest).mapInArrow(cut, ", ".join(f"{k} long" for k in fields) + ", ids array<int>" * with_ids)
