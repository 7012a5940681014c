"""Subword ids for Arrow string columns with the tokenizers library, one call per distinct unit of text.

A text is cut at places no token can cross, equal units of a batch are encoded once, and the ids of whole texts are put
together by index. A bounded memo keeps frequent units from batch to batch; it changes the time taken, never the ids.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import base64  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Regex, Tokenizer, models, pre_tokenizers  # noqa: E402

from geoloom.llm.arrow import utf8  # noqa: E402

MEMO_UNITS = 400_000
ENCODE_AT_ONCE = 20_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def from_file(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A byte-level tokenizer that always joins the pair whose joined bytes have the lowest rank.

    Every way to split a token into two tokens becomes a merge, in the order of the joined token's rank.
    """
    shown = byte_chars()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(name[token[:i]], name[token[i:]])
              for token in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(token))
              if token[:i] in ranks and token[i:] in ranks]
    t = Tokenizer(models.BPE(vocab={name[token]: rank for token, rank in ranks.items()}, merges=merges))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


def _table(values) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(values)] = True
    return t


# A space may open a unit if a character that is surely no white space follows: visible ASCII, or a first byte under which
# Unicode has no white space (it has some under these four).
_OPENS = _table({*range(0x21, 0x7F), *range(0xC3, 0xF5)} - {0xE1, 0xE2, 0xE3})
_BLANK = _table(b" \t\n\r\x0b\x0c")
_ASCII_LETTER = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _table(b".,;:!?|)")


def _mark_after_letter(data: np.ndarray) -> np.ndarray:
    """Where punctuation follows a letter (ASCII or Latin-1); no token of the patterns used here goes on there."""
    out = np.zeros(len(data) + 1, bool)
    letter = _ASCII_LETTER[data[:-1]]
    latin = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    letter[1:] |= latin
    out[1:-1] = letter & _MARK[data[1:]]
    return out


def space_led_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts for vocabularies whose tokens may begin with one space and never go on past it: before such a space."""
    cut = _mark_after_letter(data)
    cut[:-2] |= (data[:-1] == 32) & _OPENS[data[1:]]
    cut[offsets[1:] - 1] = False          # the byte after a text's last one belongs to the next text
    cut[offsets] = True
    return cut


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts for vocabularies that drop white space: where a word follows white space."""
    blank = _BLANK[data]
    cut = _mark_after_letter(data)
    cut[1:-1] |= blank[:-1] & ~blank[1:]
    cut[offsets] = True
    return cut


class UnitEncoder:
    """Ids of whole texts; ``cuts`` marks the byte positions at which a text may be cut without changing them."""

    def __init__(self, tokenizer: Tokenizer, cuts=space_led_cuts, memo_units: int = MEMO_UNITS):
        self.tokenizer, self.cuts, self.memo_units = tokenizer, cuts, memo_units
        self.memo: dict[str, bytes] = {}

    def _ids_of(self, units: list[str]) -> list[bytes]:
        got = list(map(self.memo.get, units))
        missing = [i for i, x in enumerate(got) if x is None]
        for a in range(0, len(missing), ENCODE_AT_ONCE):
            part = missing[a:a + ENCODE_AT_ONCE]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([units[i] for i in part], add_special_tokens=False)):
                got[i] = np.array(e.ids, "<u4").tobytes()
                if len(self.memo) < self.memo_units and len(units[i]) < 64:
                    self.memo[units[i]] = got[i]
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column one after the other, and where each row's ids start and end."""
        data, offsets = utf8(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = np.flatnonzero(self.cuts(data, offsets)[:-1])
        ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), ends, pa.py_buffer(data)).dictionary_encode()
        held = self._ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        at = np.concatenate([[0], np.cumsum(size)])
        flat, which = np.frombuffer(b"".join(held), np.uint32), coded.indices.to_numpy()
        del held
        ids_before = np.concatenate([[0], np.cumsum(size[which])])
        rows = ids_before[np.searchsorted(starts, offsets)]
        out = np.empty(rows[-1], np.uint32)
        for a in range(0, len(which), 500_000):
            w = which[a:a + 500_000]
            n, first = size[w], ids_before[a]
            into = ids_before[a:a + len(w) + 1] - first
            out[first:first + into[-1]] = flat[np.repeat(at[w] - into[:-1], n) + np.arange(into[-1])]
        return out, rows


_encoders: dict = {}


def encoder(kind: str, path: str, pattern: str | None = None) -> UnitEncoder:
    """One encoder per worker process: ``byte_json``, ``word_json`` (tokenizers files) or ``ranks`` (a rank file)."""
    key = (kind, path, pattern)
    if key not in _encoders:
        t = from_ranks(read_ranks(path), pattern) if kind == "ranks" else from_file(path)
        _encoders[key] = UnitEncoder(t, word_cuts if kind == "word_json" else space_led_cuts)
    return _encoders[key]
