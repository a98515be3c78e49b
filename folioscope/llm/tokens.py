"""Token ids of whole texts, word by word.

A tokenizer cuts a text into words before it merges anything, so a text can be
cut at places where every such tokenizer cuts too (between white space and the
rest, behind a run of plain letters that punctuation or white space follows)
and each piece encoded alone.  Pieces repeat far more often than texts do:
each distinct one is encoded once per worker and then looked up.  The cuts of all
texts of a batch are found at once, from the classes of their bytes.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# plain letters; not U+0130, which becomes a letter and a mark in lower case
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
# White space but for its last character, words, anything else up to white space, that last character.
PIECE = re.compile(
    f"[{_SPACE}]+(?![^{_SPACE}])| ?[{_LETTER}]+(?![^{_SPACE}.,;:!?])| ?[^{_SPACE}]+|[{_SPACE}]")
SENTENCE_END = re.compile(f"[.!?][\"')]*$|^[{_SPACE}]*\\n[{_SPACE}]*$")
# Pieces a worker remembers, and their characters, before it starts anew.
REMEMBERED = 600_000
REMEMBERED_CHARS = 12_000_000


# Classes of characters, as the bytes of a text show them; no byte of UTF-8 is 255, which closes a text.
_OTHER, _BLANK, _WHITE, _PLAIN, _MARK, _CLOSE = range(6)
CLOSE = b"\xff"


def _classes() -> np.ndarray:
    out = np.zeros(0x3002, np.uint8)
    for pattern, kind in ((f"[{_SPACE}]", _WHITE), (f"[{_LETTER}]", _PLAIN), ("[.,;:!?]", _MARK), (" ", _BLANK)):
        out[[i for i in range(0x3001) if re.match(pattern, chr(i))]] = kind
    return out


_CLASSES = _classes()
_BYTES = np.concatenate([_CLASSES[:128], np.zeros(127, np.uint8), np.array([_CLOSE], np.uint8)])


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where the pieces of texts in UTF-8, each closed by ``CLOSE``, begin; ``CLOSE`` is a piece.  As ``PIECE`` cuts them."""
    kind = _BYTES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xFF))
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        following = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2)]
        first = data[lead].astype(np.int32)
        code = np.where(size == 2, (first & 0x1F) << 6 | following[0], np.where(size == 3, (first & 0x0F) << 12 | following[0] << 6 | following[1], 0x3001))
        its = _CLASSES[np.minimum(code, 0x3001)]
        # all bytes of a character have its class
        for k in range(4):
            kind[lead[size > k] + k] = its[size > k]
    middle = (data & 0xC0) == 0x80
    white, letter, closes = (kind == _BLANK) | (kind == _WHITE), kind == _PLAIN, kind == _CLOSE
    starts = np.zeros(len(data), bool)
    starts[0] = True
    before = white[:-1]
    starts[1:] = closes[1:] | closes[:-1]
    # white space begins a piece, and what follows white space but for a blank
    starts[1:] |= white[1:] & ~before
    starts[1:] |= before & ~white[1:] & (kind[:-1] != _BLANK)
    # the last one of several that a word follows
    last = np.flatnonzero(before & ~white[1:] & ~closes[1:])
    while (inside := middle[last]).any():
        last[inside] -= 1
    starts[last[(last > 0) & white[last - 1]]] = True
    # a mark behind letters that began behind white space
    begin = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    end = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    first = (begin == 0) | white[begin - 1] | closes[begin - 1]
    starts[end[first & (kind[end] == _MARK)]] = True
    return np.flatnonzero(starts)


class PieceEncoder:
    """Encodes lists of texts with one tokenizer file; one per Python worker."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # literals that the tokenizer takes out of a text before it cuts words
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.literals = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.added = [x.encode() for x in added]
        self._forget()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; a literal of the tokenizer is a piece, and parts what is before it from what follows."""
        if self.literals is None or not self.literals.search(text):
            return PIECE.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.literals.split(text)):
            out += [part] if i % 2 else PIECE.findall(part)
        return out

    def _forget(self) -> None:
        self.known, self.used, self.chars = {CLOSE: 0}, 1, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.ends = (np.zeros(1 << 14, t) for t in (np.int32, np.int32, bool))
        self.lengths[0] = 1

    def _learn(self, fresh: list[str]) -> None:
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int32, len(coded))
        flat = np.fromiter((i for x in coded for i in x), np.uint32, int(lengths.sum()))
        used, stop = self.used, len(self.known)
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while stop > len(self.starts):
            self.starts, self.lengths, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.ends))
        self.ids[used:used + len(flat)] = flat
        at = slice(stop - len(fresh), stop)
        self.lengths[at] = lengths
        self.starts[at] = used + np.cumsum(lengths) - lengths
        self.ends[at] = [SENTENCE_END.search(x) is not None for x in fresh]
        self.used += len(flat)
        self.chars += sum(map(len, fresh))

    def _cut(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts in UTF-8, and which of them close a text."""
        data = CLOSE.join([*(t.encode() if t else b"" for t in texts), b""])
        if any(x in data for x in self.added):
            pieces: list[bytes] = []
            closing = []
            for text in texts:
                if text:
                    pieces += [x.encode() for x in self.pieces(text)]
                closing.append(len(pieces))
                pieces.append(CLOSE)
            return pa.array(pieces, pa.binary()), np.array(closing, np.int64)
        flat = np.frombuffer(data, np.uint8)
        starts = piece_starts(flat)
        bounds = pa.py_buffer(np.append(starts, len(flat)).astype(np.int64))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]), np.flatnonzero(flat[starts] == 255)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, offsets, sentence_ends)`` of the texts, each closed by ``end_id``.

        A null text is an empty one.  ``sentence_ends`` are positions in
        ``ids`` behind which a sentence of a text ends.
        """
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        if not texts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)
        cut, closing = self._cut(texts)
        coded = pc.dictionary_encode(cut)
        pieces = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int32, len(pieces))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            fresh = [pieces[i] for i in new.tolist()]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self._learn([x.decode() for x in fresh])
        which = numbers[np.asarray(coded.indices)]
        lengths = self.lengths[which]
        stops = np.cumsum(lengths)
        place = np.arange(int(stops[-1]))
        place += np.repeat(self.starts[which] - (stops - lengths), lengths)
        ids = self.ids[place]
        closed = stops[closing]
        ids[closed - 1] = end_id
        return ids, np.concatenate([[0], closed]), stops[self.ends[which]]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(tokenizer_file: str) -> PieceEncoder:
    """The encoder of this worker for a tokenizer file."""
    # a worker has one core, and the tokenizer's own threads cost more than they do
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]
