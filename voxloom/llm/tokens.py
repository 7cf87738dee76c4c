"""Whole-text token ids through the tokenizers library, with a bounded per-worker cache.

A text is cut into pieces at places where the tokenizer never joins two pieces: between
letters, digits and marks, and at the blank before them. Each distinct piece is encoded
once by the library, and the ids of a text are the concatenation over its pieces. Which
places are safe follows from the tokenizer file itself; a file of another kind is used on
whole texts. tests/llm/test_operators.py holds this against encoding whole texts.

Pieces are known by a 64-bit hash of their bytes; nothing but numbers is kept. The cache is
bounded by its pieces and by their ids, so by bytes whatever the script: pieces used least go
first, and long ones (paragraphs of a script without blanks) are encoded as they come and never
kept. Results don't depend on it.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .common import ranges, span_hash, text_chunks, text_column

#: Pieces that a worker keeps (24 bytes each: 15 MB); beyond it the rarely used ones go.
CACHE_PIECES = 600_000
#: Ids of all kept pieces (4 bytes each: 32 MB).
CACHE_IDS = 8 << 20
#: Longer pieces (in bytes) aren't kept.
LONG_PIECE = 256
#: Bytes of text whose new pieces are learnt together.
TOGETHER = 1 << 20
#: New pieces that go to the library as one text.
JOINED = 20_000

_open: dict[str, "Encoder"] = {}

# Classes of bytes: letters (ASCII and the two-byte Latin ones), digits, marks other than the apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[ord(c) for c in ".,;:!?*$%&#()-"]] = 3
_LATIN = np.zeros(256, bool)  # second bytes of À to ÿ without the signs × and ÷
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte, 0 for none."""
    out = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    out[lead] = out[lead + 1] = 1
    return out


def cut_words(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces for a tokenizer that drops white space: runs without ASCII white space, cut between classes."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | ((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[head] = inside[head]
    start = np.flatnonzero(first)
    # a piece ends at the next piece's start, less the white space before it
    blank = np.append(np.flatnonzero(~inside), len(data))
    end = np.minimum(np.append(start[1:], len(data)), blank[np.searchsorted(blank, start)])
    return start, end


def cut_bytes(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a tokenizer that keeps white space and draws one space to the word after it.

    Cuts lie between classes, before a space that a class follows, and around a single line
    break between classes.
    """
    known = kind > 0
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    first[1:] |= (kind[1:] != kind[:-1]) & known[1:] & known[:-1]
    spaced = (data[:-1] == 32) & known[1:]
    spaced[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False  # what follows is another text
    first[:-1] |= spaced
    line = (data[1:] == 10) & known[:-1]
    first[1:] |= line
    first[2:] |= line[:-1] & known[2:]
    start = np.flatnonzero(first)
    return start, np.append(start[1:], len(data))


def kind_of(path: str) -> str | None:
    """words, bytes or None: how texts may be cut for this tokenizer."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, before, normal = told["model"], told.get("pre_tokenizer") or {}, told.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or not (t["content"].startswith("<|") and t["content"].endswith("|>")) for t in told.get("added_tokens", ())):
        return None
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None and not model.get("end_of_word_suffix"):
        return "bytes"
    steps = before.get("pretokenizers", ())
    words = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed"]
    plain = [s for s in steps if s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space")]
    known = [n.get("type") in ("NFC", "Lowercase") or n.get("type") == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in (normal or {}).get("normalizers", ())]
    if words == ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"] and len(plain) == 1 and len(steps) == 2 and known and all(known) and model.get("end_of_word_suffix"):
        return "words"
    return None


class Encoder:
    """Ids of whole texts for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind_of(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix if self.kind == "words" else None
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # what ends a piece, or the line break put between pieces
        for token, k in vocabulary.items():
            self.ends[k] = token.endswith(suffix) if suffix else token == "Ċ"
        self.pieces = _Store()

    def ids(self, text: str) -> np.ndarray:
        return self.encode(pa.array([text]))[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and where each text's begin (one more at the end)."""
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        texts = text_column(texts)
        for lo, hi, data, offsets in text_chunks(texts, TOGETHER):
            if self.kind:
                ids, n = self._pieced(data, offsets)
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[lo:hi].to_pylist(), add_special_tokens=False)]
                ids, n = np.array([k for x in found for k in x], np.uint32), np.array([len(x) for x in found], np.int64)
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.append(0, np.cumsum(np.concatenate(counts)))

    def _pieced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = classes(data)
        start, end = (cut_words if self.kind == "words" else cut_bytes)(data, kind, offsets)
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        lo = 0
        while lo < len(start):  # a text of any length goes by parts
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + TOGETHER)))
            ids, n = self._part(data, kind, start[lo:hi], end[lo:hi])
            flat.append(ids)
            sizes.append(n)
            lo = hi
        upto = np.cumsum(np.concatenate(sizes))
        return np.concatenate(flat), np.diff(upto[np.searchsorted(start, offsets)])

    def _part(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces, one behind the other, and the number of each."""
        long = end - start > LONG_PIECE
        if not long.any():
            return self._known(data, kind, start, end)
        short = ~long
        some, n_some = self._known(data, kind, start[short], end[short])
        raw = [data[a:b].tobytes().decode() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        rest, n_rest = self._each(raw)
        size = np.zeros(len(start), np.int64)
        size[short], size[long] = n_some, n_rest
        own = np.repeat(long, size)
        out = np.empty(len(own), np.uint32)
        out[own], out[~own] = rest, some
        return out, size

    def _known(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same through the cache."""
        keys, some, where = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        at = self.pieces.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            most = int((end - start)[some[new]].sum())  # an id stands for a byte at least
            if self.pieces.n + len(new) > CACHE_PIECES or self.pieces.filled + most > CACHE_IDS:
                self.pieces = self.pieces.often_used(CACHE_PIECES // 2, CACHE_IDS // 2)
                new = np.flatnonzero(self.pieces.find(keys) < 0)
            self._learn(data, kind, keys[new], start[some[new]], end[some[new]])
            at = self.pieces.find(keys)
        self.pieces.used[at] += np.bincount(where, minlength=len(keys)).astype(np.int32)
        slots = at[where]
        return self.pieces.gather(slots), self.pieces.size[slots].astype(np.int64)

    def _learn(self, data: np.ndarray, kind: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        base = int(start.min(initial=len(data)))
        raw = data[base : int(end.max(initial=base))].tobytes()
        texts = [raw[a - base : b - base] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        # a piece of one class is one word to the tokenizer, but for digits where each is a word
        kind, start, end = kind[base : base + len(raw)], start - base, end - base
        odd = np.append(0, np.cumsum(kind == 0))
        led = (data[start + base] == 32) & (end - start > 1) if self.kind == "bytes" else np.zeros(len(start), bool)
        plain = (odd[end] - odd[start] == led) & ((self.kind == "bytes") | (kind[start] != 2))
        ids, sizes = self._each([x.decode() for x, p in zip(texts, plain, strict=True) if not p])
        order, flat, count = [np.flatnonzero(~plain)], [ids], [sizes]
        together = np.flatnonzero(plain)
        for lo in range(0, len(together), JOINED):
            some = together[lo : lo + JOINED]
            ids, sizes = self._joined([texts[k] for k in some.tolist()])
            order.append(some)
            flat.append(ids)
            count.append(sizes)
        self.pieces.put(keys[np.concatenate(order)], np.concatenate(flat), np.concatenate(count))

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []
        return np.array([k for ids in found for k in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces encoded as one text, which the library does faster, and told apart by what ends a piece."""
        words = self.kind == "words"
        text = (b" " if words else b"\n").join(pieces).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        end = self.ends[ids]
        at = np.flatnonzero(end) if words else np.append(np.flatnonzero(end), len(ids))
        if len(at) != len(pieces):
            return self._each([x.decode() for x in pieces])
        if words:
            return ids, np.diff(at, prepend=-1)
        return ids[~end], np.diff(at, prepend=-1) - 1


class _Store:
    """Id arrays under 64-bit keys: sorted keys, and the place and number of each key's ids."""

    def __init__(self):
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n = self.filled = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each of the sorted keys, -1 where it isn't held."""
        if not self.n:
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.key, keys), self.n - 1)
        return np.where(self.key[at] == keys, self.slot[at], np.int32(-1))

    def put(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New keys, their ids in one array and how many belong to each."""
        n = len(keys)
        while self.n + n > len(self.start):
            self.start, self.size, self.used = (np.concatenate([v, np.zeros_like(v)]) for v in (self.start, self.size, self.used))
        if self.filled + len(ids) > len(self.flat):
            more = max(len(self.flat) // 2, len(ids))
            self.flat = np.concatenate([self.flat, np.zeros(more, np.uint32)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.start[self.n : self.n + n], self.size[self.n : self.n + n] = self.filled + np.cumsum(sizes) - sizes, sizes
        order = np.argsort(keys)
        place = np.searchsorted(self.key, keys[order])
        self.key = np.insert(self.key, place, keys[order])
        self.slot = np.insert(self.slot, place, (self.n + order).astype(np.int32))
        self.n, self.filled = self.n + n, self.filled + len(ids)

    def often_used(self, most: int, most_ids: int) -> "_Store":
        """A store with at most so many of the keys and ids: those used most often."""
        times, size, least = self.used[: self.n], self.size[: self.n], 2
        while (times >= least).sum() > most or size[times >= least].sum(dtype=np.int64) > most_ids:
            least *= 2
        keep = times[self.slot] >= least
        slots, out = self.slot[keep], _Store()
        out.put(self.key[keep], self.gather(slots), self.size[slots].astype(np.int64))
        out.used[: len(slots)] = times[slots] // 2
        return out

    def gather(self, slots: np.ndarray) -> np.ndarray:
        size = self.size[slots].astype(np.int64)
        return self.flat[np.repeat(self.start[slots].astype(np.int64), size) + ranges(size)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; made once and kept with its cache."""
    if path not in _open:
        _open.clear()  # one file's cache at a time
        _open[path] = Encoder(path)
    return _open[path]
