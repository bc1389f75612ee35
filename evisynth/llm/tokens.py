"""Encoding whole texts inside tasks: texts are cut at white space where no token can cross, and each chunk's ids are kept in the worker.

A chunk's ids do not depend on its neighbours, as neither pre-tokenizer joins text across the cuts made here. A text in
which that could fail (added-token strings, for byte-level vocabularies also unusual white space) is encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

#: Chunks that a worker keeps, half of them in each of two generations; about 200 bytes each.
KEPT_CHUNKS = 700_000
#: Bytes of text that are looked up at a time.
GROUP_BYTES = 4 << 20
_SPACE = rb"\x20\x09-\x0d"
_CHUNK = re.compile(rb" ?[^%b]+|[%b]+(?![^%b])|[%b]+" % ((_SPACE,) * 4))
#: How white space beyond ASCII begins in UTF-8 (other characters may begin so too).
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Latin letters that no normaliser joins or widens; ASCII punctuation. A word of such letters and punctuation behind it are two pre-tokens that the model can take as they are.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands before chunks that no blank precedes, among those that one does.
_MARK = b"\x01"
#: A text with any of these is cut by the expression: white space of several characters, and the mark itself.
_UNUSUAL = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", _MARK)


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Known(dict):
    """Chunks with their ids, young ones; a chunk that is missing is taken over from the old ones or learnt."""

    def __init__(self, old: dict[bytes, object], learn):
        self.old, self.learn = old, learn

    def __missing__(self, chunk: bytes):
        found = self.old.get(chunk)
        if found is None:
            found = self.learn(self, chunk)
        self[chunk] = found
        return found


class ChunkEncoder:
    """Texts as arrays of ids (4-byte little-endian, as bytes), or as numbers of ids if lengths_only."""

    def __init__(self, path: str, lengths_only: bool, frequent: dict[bytes, object] | None = None, kept: int = KEPT_CHUNKS):
        self.tok, self.lengths_only, self.kept = tokenizer(path), lengths_only, kept
        self.tokenize = self.tok.model.tokenize
        added = self.tok.get_added_tokens_decoder()
        self.added = [x.content.encode() for x in added.values()]
        #: White space never becomes a token of its own, so a text is no more than its words.
        self.drops_space = not self.tok.encode(" \n ", add_special_tokens=False).ids
        self.lower = str.lower if self.drops_space else str
        self.frequent = frequent or {}
        #: Ids of punctuation behind words.
        self.tails: dict[bytes, object] = {}
        #: Chunks as they stand, and chunks that a blank precedes. Full young ones become the old ones; a hit among those moves up.
        self.plain, self.spaced = Known(self.frequent, self._learn_plain), Known({}, self._learn_spaced)

    def _packed(self, ids: list[int]):
        return len(ids) if self.lengths_only else struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: bytes):
        return self._packed(self.tok.encode(text.decode(), add_special_tokens=False).ids)

    def _tail(self, tail: bytes):
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._packed([t.id for t in self.tokenize(tail.decode())])
        return self.tails[tail]

    def _learn(self, known: Known, chunk: bytes, marked: int, lead: bytes, blank: str):
        """A plain word's ids by the library's model alone, punctuation behind it apart; any other chunk's by the whole library."""
        base = chunk.rstrip(_PUNCTUATION)
        tail = chunk[len(base) :]
        if tail and base[-1:].isalnum():  # behind an ASCII letter or digit, punctuation begins a pre-token
            return known[base] + self._tail(tail)
        word = base[marked:]
        if word.isalpha():  # of bytes: ASCII letters only
            found = [t.id for t in self.tokenize(blank + self.lower(word.decode()))]
        elif word and not word.isascii() and _LETTERS.fullmatch(text := word.decode()):
            found = [t.id for t in self.tokenize(blank + self.lower(text).encode().decode("latin-1").translate(_byte_letters()))]
        else:
            return self.whole(lead + chunk[marked:])
        return self._packed(found) + self._tail(tail) if tail else self._packed(found)

    def _learn_plain(self, known: Known, chunk: bytes):
        if (found := self.frequent.get(chunk)) is not None:
            return found
        return self._learn(known, chunk, 0, b"", "")

    def _learn_spaced(self, known: Known, chunk: bytes):
        marked = chunk[:1] == _MARK
        return self._learn(known, chunk, int(marked), b"" if marked else b" ", "" if marked else _byte_letters()[32])

    def _chunks(self, text: bytes) -> tuple[list[bytes], list[bytes]] | None:
        """(chunks as they stand, chunks that a blank precedes, or the mark), or None for a text to encode whole."""
        if any(a in text for a in self.added):
            return None
        if self.drops_space:
            return text.split(), []
        if not text.isascii() and any(x in text for x in _WIDE_SPACE):
            return None
        if any(x in text for x in _UNUSUAL) or text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n"):
            return _CHUNK.findall(text), []
        # a line end between other characters is a pre-token of its own, and the chunk behind it has no blank before it
        first, *rest = text.replace(b"\n", b" \x01\n \x01").split(b" ")
        return [first] if first else [], rest

    def encode(self, texts: list[bytes]) -> list:
        out: list = []
        together = sum if self.lengths_only else b"".join
        for text in texts:
            cut = self._chunks(text)
            if cut is None:
                out.append(self.whole(text))
                continue
            plain, spaced = cut
            found = together(map(self.plain.__getitem__, plain))
            out.append(found + together(map(self.spaced.__getitem__, spaced)) if spaced else found)
            if len(self.plain) + len(self.spaced) > self.kept // 2:
                self.plain, self.spaced = Known(self.plain, self._learn_plain), Known(self.spaced, self._learn_spaced)
                self.plain.old.old, self.spaced.old.old = {}, {}
        return out


@functools.lru_cache(maxsize=2)
def id_encoder(path: str, kept: int = KEPT_CHUNKS) -> ChunkEncoder:
    """One for each worker process: its chunks serve all tasks that the worker runs."""
    return ChunkEncoder(path, lengths_only=False, kept=kept)
