"""Token ids of a word-level byte BPE of the tokenizers library: pre-tokens are found for a stretch of text at once, the
different ones of a stretch are looked up, and their ids are gathered by place."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: White space ends every pre-token, so what lies between bytes of ASCII white space, a chunk, can be encoded by itself.
#: Chunks of printable ASCII and the letters of Latin-1, whose lower-casing and composition are plain, are split here;
#: others are odd and go to the library.
_SPACE = re.compile(rb"[\t-\r ]")
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KINDS = np.full(256, ODD, dtype=np.uint8)
KINDS[0x21:0x7F] = SIGN
for _bytes, _kind in ((b"\t\n\v\f\r ", SPACE), (b"0123456789", DIGIT), (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER)):
    KINDS[list(_bytes)] = _kind
#: Bytes of text that are looked at together; a longer chunk is a stretch by itself. It bounds memory only.
STRETCH = 1 << 21
#: Entries of a cache before it becomes the old one and a new one begins; it bounds memory only.
CACHE = 200_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE has for each byte: printable Latin-1 for itself, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Cache(dict):
    """Two generations: what is used again outlives the turn."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: set) -> list:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys - self.keys():
            if k in self.old:
                self[k] = self.old[k]
            else:
                out.append(k)
        return out


class Memo(dict):
    """What ``make`` gives for each key, in two generations as in ``Cache``; one lookup for a known key."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _values(column: pa.BinaryArray) -> list[bytes]:
    """The values of a column without nulls that starts at the start of its buffers; ``to_pylist`` makes an Arrow scalar of each."""
    _, offsets, data = column.buffers()
    at, data = np.frombuffer(offsets, dtype=np.int32)[: len(column) + 1].tolist(), data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.codes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.letters = dict(enumerate(byte_letters()))
        self.chunks, self.parts = Memo(CACHE, self._chunk), Memo(CACHE, self._part)
        specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, specials))) if specials else re.compile(rb"(?!)")

    def _part(self, part: bytes) -> bytes:
        """Ids of a pre-token in small letters."""
        letters = part.decode() if part.isascii() else part.decode("latin-1").translate(self.letters)
        return b"".join([self.codes[t.id] for t in self.model.tokenize(letters)])

    def _chunk(self, chunk: bytes) -> bytes:
        return np.array(self.library.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text the ids the library gives for it, as little-endian 32-bit integers."""
        raw = b" ".join([*texts, b""])
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
        found, at, total, begin = [], np.zeros(len(texts) + 1, dtype=np.int64), 0, 0
        while begin < len(raw):
            stop = _SPACE.search(raw, min(begin + STRETCH, len(raw)) - 1).end()
            ids, starts, before = self._stretch(raw[begin:stop])
            low, high = np.searchsorted(ends, [begin, stop])
            at[low + 1 : high + 1] = total + before[np.searchsorted(starts, ends[low:high] - begin)]
            found.append(ids)
            total, begin = total + len(ids), stop
        every = np.concatenate(found).tobytes() if found else b""
        return [every[4 * i : 4 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _stretch(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text that ends with white space, where its parts start, and the ids before each part. Parts are
        pre-tokens, odd chunks and single bytes of white space."""
        low, kinds = self._plain(raw)
        starts = self._starts(low, kinds)
        odd = np.flatnonzero(kinds[starts] == ODD)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        codes = [b"" if k[0] == 0x20 else self.parts[k] for k in _values(parts.dictionary)]
        codes += [self.chunks[raw[i:j]] for i, j in zip(starts[odd].tolist(), offsets[odd + 1].tolist(), strict=True)]
        place = parts.indices.to_numpy().copy()
        place[odd] = np.arange(len(parts.dictionary), len(codes))
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        first = np.cumsum(sizes) - sizes
        n = sizes[place]
        before = np.cumsum(n) - n
        ids = np.frombuffer(b"".join(codes), dtype="<u4")[np.repeat(first[place] - before, n) + np.arange(n.sum())]
        return ids, starts, before

    def _plain(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes in small letters, with spaces for all white space and odd chunks, and the kind of each byte."""
        low = np.frombuffer(bytearray(raw.lower()), dtype=np.uint8)
        kinds = KINDS[low]
        lead = np.flatnonzero(low == 0xC3)
        if len(lead):  # the letters of Latin-1, without the signs × and ÷
            lead = lead[(low[lead + 1] != 0x97) & (low[lead + 1] != 0xB7)]
            kinds[lead] = kinds[lead + 1] = LETTER
            capital = lead[low[lead + 1] < 0x9F] + 1
            low[capital] += 0x20
        for m in self.special.finditer(raw):
            kinds[m.start() : m.end()] = ODD
        space = kinds == SPACE
        odd = np.flatnonzero(kinds == ODD)
        if len(odd):
            spaces = np.flatnonzero(space)
            chunk = np.unique(np.searchsorted(spaces, odd))
            edge = np.zeros(len(raw) + 1, dtype=np.int8)
            edge[np.where(chunk, spaces[chunk - 1] + 1, 0)] = 1
            edge[spaces[chunk]] = -1
            inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            kinds[inside] = ODD
            low[inside] = 0x20
        low[space] = 0x20
        return low, kinds

    @staticmethod
    def _starts(low: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where parts start: where the kind changes, at each digit and white space, and after contractions."""
        new = np.empty(len(kinds), dtype=bool)
        new[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
        new |= (kinds == DIGIT) | (kinds == SPACE)
        quote = np.flatnonzero((low == 0x27) & (kinds == SIGN) & new)
        quote = quote[kinds[quote + 1] == LETTER]
        if len(quote):
            one, two = low[quote + 1], low[np.minimum(quote + 2, len(low) - 1)]
            short = quote[np.isin(one, list(b"stmd"))]
            long = quote[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)]
            new[short + 1] = new[long + 1] = False
            new[short + 2] = new[long + 3] = True
        return np.flatnonzero(new)
