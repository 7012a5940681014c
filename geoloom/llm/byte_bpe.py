"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is built from a rank file: bytes are shown as printable characters, and every pair of tokens whose joined
bytes are a token is a merge. Decoding reverses the byte table. Nothing is shuffled; each batch stands alone, so a lost
executor costs its running batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.arrow import append, utf8
from geoloom.llm.subword import encoder, read_ranks


class ByteTable:
    """Bytes of every id: one flat array, and where each id's bytes start."""

    def __init__(self, path: str):
        tokens = read_ranks(path)
        of = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, rank in tokens.items():
            of[rank] = token
        self.size = np.fromiter(map(len, of), np.int64, len(of))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(of), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each id's bytes start and end."""
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(ends[-1], np.uint8)
        for a in range(0, len(ids), 500_000):
            part = ids[a:a + 500_000]
            into = ends[a:a + len(part) + 1] - ends[a]
            out[ends[a]:ends[a] + into[-1]] = self.flat[np.repeat(self.at[part] - into[:-1], n[a:a + len(part)])
                                                        + np.arange(into[-1])]
        return out, ends


_tables: dict[str, ByteTable] = {}


def byte_table(path: str) -> ByteTable:
    if path not in _tables:
        _tables[path] = ByteTable(path)
    return _tables[path]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ``ids array<int>`` to every row, and with ``offsets`` also ``char_starts array<int>``.

    ``char_starts`` gives each id's first character in the text. An id that begins inside a character (one split over
    several ids) gets that character's place. Null and empty texts have no ids. A column named like an added one is
    replaced; other columns stay.
    """
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(text)
        ids, rows = encoder("ranks", ranks_path, pattern).encode(texts)
        out = {"ids": pa.ListArray.from_arrays(rows.astype(np.int32), pa.array(ids.astype(np.int32)))}
        if offsets:
            data, starts = utf8(texts)
            opens = np.cumsum((data & 0xC0) != 0x80)          # characters begun up to and with each byte
            before = np.concatenate([[0], np.cumsum(byte_table(ranks_path).size[ids])])[:-1]
            row = np.repeat(np.arange(len(starts) - 1), np.diff(rows))
            base = np.concatenate([[0], opens])[starts[:-1]]
            chars = opens[before] - 1 - base[row] if len(ids) else np.empty(0)
            out["char_starts"] = pa.ListArray.from_arrays(rows.astype(np.int32), pa.array(chars.astype(np.int32)))
        return out
    return append(docs, one, "ids array<int>" + (", char_starts array<int>" if offsets else ""))


def decode_ids(docs: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded binary`` (exact bytes) and ``decoded_text string`` (U+FFFD where the ids end inside a character).

    A null list decodes to no bytes.
    """
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(ids)
        flat, rows = list_values(column)
        data, ends = byte_table(ranks_path).decode(flat)
        at = ends[rows]
        raw = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        return {"decoded": pa.array(raw, pa.binary()),
                "decoded_text": pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())}
    return append(docs, one, "decoded binary, decoded_text string")


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column of integers, and where each row starts and ends; null lists are empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, its number of ids, and digests of its ids and of the bytes they decode to.

    Encoding and decoding happen in one pass, so ids never leave the worker. Null and empty texts have no ids and digest
    the empty string; a null key stays null; repeated rows give repeated results; an empty table gives no rows.
    """
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, rows = encoder("ranks", ranks_path, pattern).encode(batch.column(1))
        data, ends = byte_table(ranks_path).decode(ids)
        at, raw = ends[rows], ids.astype("<u4", copy=False)
        return {"n_tokens": pa.array(np.diff(rows)),
                "ids_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(rows[:-1], rows[1:])], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())}
    columns = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return append(columns, one, "n_tokens long, ids_sha256 string, decoded_sha256 string").drop("text")
