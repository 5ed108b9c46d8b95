"""Token ids of whole texts, exactly as the tokenizers library gives them, through a memo of segments.

A text is cut before a space or line feed that follows a visible ASCII character or a two-byte letter, and before
ASCII punctuation that follows an ASCII letter. The pre-tokenizers of the supported vocabularies (byte-level and
word-end byte-pair encodings) never join characters across such a place, so the ids of the text are those of its
segments in order. A text that holds the string of an added token (such as ``<|endoftext|>``) is not cut: the library
gets it whole and gives the token's own id. A worker remembers segments of up to MOST bytes in a direct-mapped table
by a 64-bit hash, compares a remembered segment's bytes before it uses its ids, and gives all others to the library.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from .textbytes import CONTINUATION, PUNCTUATION, Hasher, mix

SLOT_BITS = 22
LOAD = 0.48  # segments a slot after which a worker starts afresh: two million with SLOT_BITS
MOST = 64  # bytes of a remembered segment
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class SegmentTokenizer:
    def __init__(self, path: str, bits: int = SLOT_BITS) -> None:
        self.bits, self.most = bits, int(LOAD * (1 << bits))
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.begins = np.zeros(1 << self.bits, np.uint64)  # the first eight bytes of the segment in each slot
        self.long = np.zeros(1 << self.bits, np.uint8)  # its length, 0 if there is none
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.where = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.bytes = np.zeros(1 << 16, np.uint8)  # of all entries, each with eight zeros after it
        self.first = np.zeros(1 << 14, np.int64)  # where an entry's bytes begin
        self.length = np.zeros(1 << 14, np.int32)
        self.used = self.known = self.written = 0

    def _learn(self, segments: list[bytes]) -> None:
        for k in range(0, len(segments), 4096):
            part = segments[k : k + 4096]
            ids = [x.ids for x in self.library.encode_batch_fast([s.decode("utf-8", "replace") for s in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            raw = np.frombuffer(b"".join(s + bytes(8) for s in part), np.uint8)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            first, total = self.known, int(sizes.sum())
            while len(self.where) < first + len(part):
                self.where, self.size, self.first, self.length = (np.resize(x, 2 * len(x)) for x in (self.where, self.size, self.first, self.length))
            while len(self.flat) < self.used + total:
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            while len(self.bytes) < self.written + len(raw):
                self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), self.dtype, total)
            self.bytes[self.written : self.written + len(raw)] = raw
            own = slice(first, first + len(part))
            self.where[own] = self.used + np.cumsum(sizes) - sizes
            self.first[own] = self.written + np.cumsum(lengths + 8) - lengths - 8
            self.size[own], self.length[own] = sizes, lengths
            self.used += total
            self.written += len(raw)
            self.known += len(part)

    def _same(self, text: Hasher, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which segments have the very bytes of their entries."""
        same = self.length[entry] == size
        live = np.flatnonzero(same)
        ours = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        at, other, left = start[live], self.first[entry[live]], size[live]
        while len(live):
            equal = text.chunk(at, left) == ours[other]  # zeros follow both
            same[live[~equal]] = False
            more = equal & (left > 8)
            live, at, other, left = live[more], at[more] + 8, other[more] + 8, left[more] - 8
        return same

    def _whole(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold an added token's string."""
        rows = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[row + 1]
                if inside:
                    rows.add(row)
                at = raw.find(token, int(offsets[row + 1]) if inside else at + 1)
        return np.array(sorted(rows), np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text)."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(rows, np.int64)
        cut = np.zeros(len(data), bool)
        before = data[:-1]
        visible = (before > 0x20) & (before < 0x7F)
        letter = np.zeros(len(before), bool)
        letter[1:] = CONTINUATION[before[1:]] & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
        cut[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & (visible | letter) | PUNCTUATION[data[1:]] & _LETTER[before]
        raw = data.tobytes()
        for row in self._whole(raw, offsets):
            cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        if self.known > self.most:
            self._forget()
        text, size = Hasher(data), end - start
        begins = text.chunk(start, size)
        key = mix(begins ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        longer = np.flatnonzero(size > 8)
        key[longer] = text.spans(start[longer], end[longer])
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = self.entry[slot]
        hit = (self.begins[slot] == begins) & (self.long[slot] == size)  # up to eight bytes, that is all of it
        longer = longer[hit[longer]]
        hit[longer] = self._same(text, start[longer], size[longer], entry[longer])
        new = np.flatnonzero(~hit)
        if len(new):
            _, sample, kind = np.unique(key[new], return_index=True, return_inverse=True)
            sample = new[sample]
            first = self.known
            entry[new] = first + kind
            self._learn([raw[x:y] for x, y in zip(start[sample].tolist(), end[sample].tolist(), strict=True)])
            small = np.flatnonzero(size[sample] <= MOST)
            place = slot[sample[small]]
            self.begins[place], self.long[place], self.entry[place] = begins[sample[small]], size[sample[small]], first + small
            # where two of them share a slot, the last one stands, in all three tables
            odd = new[~self._same(text, start[new], size[new], entry[new])]
            if len(odd):  # equal hashes, other bytes
                entry[odd] = self.known + np.arange(len(odd))
                self._learn([raw[x:y] for x, y in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
        sizes = self.size[entry].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.where[entry] - (ends - sizes), sizes) + np.arange(ends[-1])]
        before_segment = np.append(ends - sizes, ends[-1])
        edges = before_segment[np.searchsorted(start, offsets)]
        return ids, np.diff(edges)


@lru_cache(maxsize=2)
def tokenizer(path: str, bits: int = SLOT_BITS) -> SegmentTokenizer:
    return SegmentTokenizer(path, bits)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id after each text's."""
    out = np.full(len(ids) + len(sizes), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1
