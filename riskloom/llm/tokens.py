"""Token ids as the tokenizers library gives them, fast enough for whole corpora.

A vocabulary that drops white space (the default one) encodes each run between ASCII white
space on its own, so a text's ids are those of its words in order. Words are found, hashed and
counted once a batch with numpy; each Python worker keeps a table of the ids of words it has
met, of a fixed size. New words of plain shape (Latin letters, then ASCII punctuation) go
through the same byte-pair merges as in the library, for all words of a batch at a time; every
other word, and vocabularies that keep white space, go through the library itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskloom.llm.shingles import word_spans

VOCABULARY = "word_bpe_49k.json"
TABLE_WORDS = 1_500_000
LONGEST_PLAIN = 32
_NO_RANK = np.int32(2**31 - 1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class Merges:
    """Byte-pair merges for many words at a time."""

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.inner = np.array([vocab[n] for n in names], np.int32)
        self.last = np.array([vocab[n + end] for n in names], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.slots: list[tuple[np.uint32, np.ndarray, np.ndarray]] = []
        left = np.arange(len(keys))
        multiplier = 0x9E3779B1
        while len(left):  # keys whose slot is taken go to one more table
            at = self._slot(keys[left], np.uint32(multiplier))
            _, first = np.unique(at, return_index=True)
            key, rank = np.full(1 << 20, 0xFFFFFFFF, np.uint32), np.full(1 << 20, _NO_RANK, np.int32)
            key[at[first]], rank[at[first]] = keys[left[first]], left[first]
            self.slots.append((np.uint32(multiplier), key, rank))
            left = np.delete(left, first)
            multiplier = (multiplier * 0x85EBCA6B + 2) & 0xFFFFFFFF | 1

    @staticmethod
    def _slot(keys: np.ndarray, multiplier: np.uint32) -> np.ndarray:
        return ((keys ^ (keys >> np.uint32(15))) * multiplier) >> np.uint32(12)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        out = np.full(keys.shape, _NO_RANK, np.int32)
        for multiplier, key, rank in self.slots:
            at = self._slot(keys, multiplier)
            np.copyto(out, rank[at], where=key[at] == keys)
        out[(a < 0) | (b < 0)] = _NO_RANK
        return out

    def encode(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of data (lower-cased), each one run of letters or of punctuation:
        (all ids, how many for each piece)."""
        counts = np.zeros(len(begin), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in (6, 10, 16, LONGEST_PLAIN):
            which = np.flatnonzero((length > low) & (length <= width))
            low = width
            for part in np.array_split(which, max(1, len(which) // 8192)):
                if len(part):
                    symbols = self._merged(data, begin[part], length[part], width)
                    counts[part] = (symbols >= 0).sum(1)
                    found.append((part, symbols))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for part, symbols in found:
            row, col = np.nonzero(symbols >= 0)
            flat[starts[part][row] + col] = symbols[row, col]
        return flat, counts

    def _merged(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
        cols = np.arange(width, dtype=np.int64)
        raw = data[np.minimum(begin[:, None] + cols, len(data) - 1)]
        s = np.where(cols < length[:, None], self.inner[raw], -1).astype(np.int32)
        rows = np.arange(len(s))
        s[rows, length - 1] = self.last[raw[rows, length - 1]]
        out, live = s.copy(), rows
        r = np.full(s.shape, _NO_RANK, np.int32)
        r[:, :-1] = self.ranks(s[:, :-1], s[:, 1:])
        while len(live):
            at = r.argmin(1)
            best = r[np.arange(len(r)), at]
            go = best != _NO_RANK
            if not go.all():
                out[live[~go]] = s[~go]
                live, s, r, at, best = live[go], s[go], r[go], at[go], best[go]
                if not len(live):
                    break
            i = np.arange(len(s))
            s[i, at] = self.made[best]
            later = cols[None, :] > at[:, None]
            s[:, :-1] = np.where(later[:, :-1], s[:, 1:], s[:, :-1])
            s[:, -1] = -1
            r[:, :-1] = np.where(later[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = _NO_RANK
            right = np.where(at + 1 < width, s[i, np.minimum(at + 1, width - 1)], -1)
            r[i, at] = self.ranks(s[i, at], right)
            has = at > 0
            r[i[has], at[has] - 1] = self.ranks(s[i[has], at[has] - 1], s[i[has], at[has]])
        return out


def _plain(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data with letters lower-cased (A-Z, U+00C0 to U+00DE), for each word the number of bytes
    of its leading letters, and whether its shape is letters, then punctuation."""
    out = data.copy()
    upper = (data >= 65) & (data <= 90)
    out[upper] += 32
    letter = upper | ((data >= 97) & (data <= 122))
    punct = ((data >= 33) & (data <= 47) & (data != 39)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        letter[lead] = True
        letter[lead + 1] = True
        out[lead[data[lead + 1] <= 0x9E] + 1] += 32
    total = np.concatenate(([0], np.cumsum(letter)))
    marks = np.concatenate(([0], np.cumsum(punct)))
    letters = total[end] - total[begin]
    fits = (total[begin + letters] - total[begin] == letters) & (marks[end] - marks[begin] == end - begin - letters)
    return out, letters, fits & (letters <= LONGEST_PLAIN) & (end - begin - letters <= LONGEST_PLAIN)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Encoder:
    """Encodes a string column to ids; null is an empty text."""

    def __init__(self, path: str, drops_space: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.drops_space = drops_space
        self.merges = self._merges(path) if drops_space else None
        self._clear()

    def _merges(self, path: str) -> Merges | None:
        """The merges, if this is a vocabulary of the shape that Merges knows."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        kinds = [x["type"] for x in before.get("pretokenizers", [])], [x["type"] for x in normal.get("normalizers", [])]
        known = model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("ignore_merges") and kinds == (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"])
        return Merges(model) if known and self.size <= 1 << 16 else None

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _by_library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, flat = [], []
        for at in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts[at : at + 4096]], add_special_tokens=False):
                flat += e.ids
                counts.append(len(e.ids))
        return np.array(flat, self.dtype), np.array(counts, np.int64)

    def _new_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.merges is None:
            raw = data.tobytes()
            return self._by_library([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        low, letters, plain = self.plain_of(data, begin, end)
        p = np.flatnonzero(plain)
        piece_begin = np.stack((begin[p], begin[p] + letters[p]), 1).ravel()
        piece_length = np.stack((letters[p], end[p] - begin[p] - letters[p]), 1).ravel()
        ids, n = self.merges.encode(low, piece_begin, piece_length)
        counts = np.zeros(len(begin), np.int64)
        counts[p] = n.reshape(-1, 2).sum(1)
        o = np.flatnonzero(~plain)
        raw = data.tobytes() if len(o) else b""
        other, counts[o] = self._by_library([raw[a:b] for a, b in zip(begin[o].tolist(), end[o].tolist(), strict=True)])
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), self.dtype)
        flat[_ragged(starts[p], counts[p])] = ids
        flat[_ragged(starts[o], counts[o])] = other
        return flat, counts

    plain_of = staticmethod(_plain)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row)."""
        if not self.drops_space:
            return self._by_library([t or b"" for t in column.cast(pa.large_binary()).to_pylist()])
        with np.errstate(over="ignore"):
            hashes, rows, begin, end, data = word_spans(column, lower=False)
            if not len(hashes):
                return np.zeros(0, self.dtype), np.zeros(len(column), np.int64)
            if len(self.hash) > TABLE_WORDS:
                self._clear()
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hash, unique), max(0, len(self.hash) - 1))
            new = np.flatnonzero(self.hash[at] != unique) if len(self.hash) else np.arange(len(unique))
            if len(new):
                flat, counts = self._new_words(data, begin[first[new]], end[first[new]])
                starts = len(self.pool) + np.cumsum(counts) - counts
                self.pool = np.concatenate((self.pool, flat))
                where = np.searchsorted(self.hash, unique[new])
                self.hash, self.start, self.count = np.insert(self.hash, where, unique[new]), np.insert(self.start, where, starts), np.insert(self.count, where, counts)
                at = np.searchsorted(self.hash, unique)
            at = at[inverse]
            counts = self.count[at]
            per_row = np.bincount(rows, weights=counts, minlength=len(column)).astype(np.int64)
            return self.pool[_ragged(self.start[at], counts)], per_row


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool = True) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core
    return Encoder(path, drops_space)


def encoded_batches(batches, path: str, drops_space: bool, rows: int = 4096, most_bytes: int = 2 << 20):
    """(column 0, ids of all rows, number of ids of each row) for slices of batches (id, text)."""
    coder = encoder(path, drops_space)
    for batch in batches:
        at = 0
        lengths = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), np.int64))
        while at < batch.num_rows:
            done = lengths[at - 1] if at else 0
            most = int(np.searchsorted(lengths[at : at + rows], done + most_bytes)) + 1
            part = batch.slice(at, min(rows, most))
            yield part.column(0), *coder.encode(part.column(1))
            at += part.num_rows
