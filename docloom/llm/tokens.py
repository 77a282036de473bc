"""Token ids of whole texts, batch by batch, with a public tokenizer file.

A byte-level tokenizer first cuts a text into pieces and never merges across
them. It always cuts before a single space or line feed between two characters
that are not white space, and before punctuation (but for the apostrophe) that
follows a letter or digit. Texts are cut at such places only, every distinct
part is encoded once per task by the tokenizers library, many new ones in one
text, and the ids are put together again: the same ids as encoding each text at
once, for a fraction of the work. Tokens that the tokenizer's file adds, such as ``<|endoftext|>``, are
parts of their own: the text between them is cut as if each stretch were a text.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docloom.llm.common import spans, strings, utf8

#: Parts whose ids a task keeps between steps, and bytes of both; beyond either the memory is emptied.
HELD_PARTS = 400_000
HELD_BYTES = 48 << 20
#: Bytes of new parts that are encoded as one text, if they may be.
JOINED_BYTES = 1 << 16
#: Text bytes that are encoded at once.
ENCODE_BYTES = 4 << 20
END = 0

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
# Lead bytes of the characters among which Unicode has further white space.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, bool)
_POINT[[b for b in range(33, 127) if not _ALNUM[b] and b != 0x27]] = True
# Second bytes of the Latin letters whose first byte is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def cuts(off: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Byte positions at which the texts may be cut, the begin of each text included."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    lead, white = _LEADS[buf], _WHITE[buf]
    before = ~white  # may this byte end a part before a gap?
    before[1:] &= ~lead[:-1]
    before[2:] &= ~lead[:-2]
    gap = _GAP[buf]
    gap[1:] &= before[:-1]
    gap[:-1] &= ~(white | lead)[1:]
    gap[-1] = False
    gap[off[1:][off[1:] > 0] - 1] = False  # at the end of a text the next byte is another text's
    letter = _ALNUM[buf]
    letter[1:] |= _LATIN[buf[1:]] & (buf[:-1] == 0xC3)
    point = _POINT[buf[1:]]
    gap[1:] |= point & letter[:-1]
    gap[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(gap)


class Encoder:
    """One tokenizer in one task."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The longest first, as the library takes them.
        listed = b"|".join(map(re.escape, sorted(filter(None, added), key=len, reverse=True)))
        self.added = re.compile(listed) if listed else None
        self.bytes_of = self.lengths()
        self.forget()

    def lengths(self) -> np.ndarray | None:
        """Bytes that each id of a byte-level tokenizer stands for: a character of its token is a byte."""
        if type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel" or self.tokenizer.normalizer is not None:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        found = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        found[list(vocabulary.values())] = list(map(len, vocabulary))
        return found

    def borders(self, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of texts, stretches and added tokens; begin and end of these tokens, as rows."""
        raw = memoryview(np.ascontiguousarray(buf))
        if self.added is None or not self.added.search(raw):
            return off, np.zeros((0, 2), np.int64)
        ends = off.tolist()
        found = [m.span() for a, b in zip(ends, ends[1:]) for m in self.added.finditer(raw[:b], a)]
        held = np.array(found, np.int64).reshape(-1, 2)
        return np.union1d(off, held.reshape(-1)), held

    def forget(self) -> None:
        self.held = pa.array([], pa.string())
        self.ids_of = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers from fewer, longer texts: neighbours that ``cuts`` would part again are one.

        A token stands for a known number of bytes, which tells where the ids of each text end;
        None if these numbers do not fit the texts.
        """
        off, buf = utf8(texts)
        if self.added is not None and self.added.search(memoryview(np.ascontiguousarray(buf))):
            return None
        first = off[:-1] // JOINED_BYTES != np.append(-1, off[:-2] // JOINED_BYTES)
        first |= ~np.isin(off[:-1], cuts(off[[0, -1]], buf))
        ends = off[1:][np.append(first[1:], True)]
        got = self.tokenizer.encode_batch_fast(strings(ends, buf).to_pylist(), add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        if not len(flat) or flat.max() >= len(self.bytes_of):
            return None
        stop = np.cumsum(self.bytes_of[flat])
        after = np.searchsorted(stop, off[1:], "right")
        if stop[-1] != off[-1] or not np.array_equal(stop[after - 1], off[1:]):
            return None
        return flat, np.diff(after, prepend=0)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind another, and how many each has."""
        found = self.joined(texts) if self.bytes_of is not None else None
        if found is None:
            got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            ids = [e.ids for e in got]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            found = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size
        return found

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids held, and where those of each of these distinct texts begin and how many they are."""
        if len(self.held) > HELD_PARTS or self.held.nbytes + self.ids_of.nbytes > HELD_BYTES:
            self.forget()
        place = pc.index_in(texts, self.held)
        unknown = place.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if unknown.any():
            new = texts.filter(pa.array(unknown))
            at[unknown] = np.arange(len(new)) + len(self.held)
            flat, size = self.encoded(new)
            self.held = pa.concat_arrays([self.held, new])
            self.ids_of = np.concatenate((self.ids_of, flat))
            self.sizes = np.concatenate((self.sizes, size))
        size = self.sizes
        return self.ids_of, (np.cumsum(size) - size)[at], size[at]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's ids stop."""
        off, buf = utf8(texts)
        border, added = self.borders(off, buf)
        cut = cuts(border, buf)
        if len(added):  # never within an added token
            at = np.searchsorted(added[:, 0], cut) - 1
            cut = cut[(at < 0) | (cut >= added[at, 1])]
        if not len(cut):
            return np.full(len(off) - 1, END, np.uint32), np.arange(1, len(off))
        coded = strings(np.append(cut[1:], len(buf)), buf).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        held, base, size = self.parts(coded.dictionary.cast(pa.string()))
        size = size[code]
        flat = held[spans(base[code], size)]
        total = np.concatenate(([0], np.cumsum(size)))
        stops = total[np.searchsorted(cut, off[1:])]
        return np.insert(flat, stops, np.uint32(END)), stops + np.arange(1, len(stops) + 1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of this Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def checksums(ids: np.ndarray, stops: np.ndarray) -> list[int]:
    """CRC-32 of each run of ids as little-endian unsigned 32-bit numbers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    begin = np.concatenate(([0], stops[:-1])) * 4
    return [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (stops * 4).tolist())]
