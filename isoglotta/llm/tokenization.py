"""Token ids of whole texts, by the tokenizers library, with a bounded cache of white-space pieces.

Both public vocabularies used here treat a piece of text between single spaces alike wherever it stands,
so ids of a text are ids of its pieces in order. Pieces are cached as little-endian 32-bit ids in two
generations of ``limit`` entries (and those of one text), which bounds memory. Texts for which that split isn't certain (special
token strings, spaces beside other white space) go through ``Tokenizer.encode`` as a whole.
"""

from __future__ import annotations

import functools
import os
import struct

import numpy as np
import regex

#: White space as Unicode and the tokenizers see it.
_ODD = regex.compile(r"[\x00\x1c-\x1f]|\s\s|^ $|^[^\S\n ]|\s(?<!\n)$")
_STOPS = frozenset(".,;:!?")
_SPLIT_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPLIT_BYTE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class _Odd(Exception):
    """A piece that may not be split from its text."""


class _Pieces(dict):
    """Ids by piece; a piece that isn't there is made, so that a text is one pass of lookups.

    Keys are "word" for a space and the word, "\\0word" for the word alone, "\\nword" for a line end and the word.
    """

    __slots__ = ("make",)

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        v = self.make(key)
        if len(key) < 64 and key[0] != "\n":  # a line's first word is kept by itself
            self[key] = v
        return v


class CachedTokenizer:
    """``ids(text)``: the ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.limit, self.new, self.old = Tokenizer.from_file(path), limit, {}, {}
        self.model, letters = self.tok.model, _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.coded = [struct.pack("<I", i) for i in range(self.tok.get_vocab_size())]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: A character of each special string; texts without these have none, which is told faster.
        self.marks = sorted({next((c for c in s if not c.isalnum()), s[0]) for s in self.special if s})
        normalizer, pre = type(self.tok.normalizer).__name__, type(self.tok.pre_tokenizer).__name__
        self.kind = {("Sequence", "Sequence"): "word", ("NoneType", "ByteLevel"): "byte"}.get((normalizer, pre), "")
        if self.kind == "byte":
            self.new = _Pieces(self._make)
        if self.kind and not self._agrees():
            self.kind = ""

    def _agrees(self) -> bool:
        """Does the short way match the library on a sample of spellings? Otherwise it isn't used."""
        sample = "Ab'll c3po, élan-Ñu. x\ny² \"don't\" ÀÉ/ß 12ab? ...and\nµ 'S #1"
        return self.ids(sample) == self.whole(sample)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, p: str) -> bytes:
        """Ids of one piece; Latin-1 pieces take the vocabulary's own split, and their parts share the cache."""
        if p.isascii():
            if self.kind == "word":
                p = p.lower()
            body = p[1:] if p[0] == " " else p
            if body.isalpha():
                return self._model(p)
            if p[-1] in ".,;:!?" and body[:-1].isalpha():
                return self._part(p[:-1]) + self._part(p[-1])
        else:
            try:
                p.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(p)
        low = p.lower() if self.kind == "word" else p
        if self.kind == "word" and (len(low) != len(p) or not p.isprintable()):
            return self.whole(p)
        body = low[1:] if low[0] == " " else low
        if body.isalpha():
            return self._part(low)
        if body[:-1].isalpha() and body[-1] in ".,;:!?":
            return self._part(low[:-1]) + self._part(low[-1])
        return b"".join(map(self._part, (_SPLIT_WORD if self.kind == "word" else _SPLIT_BYTE).findall(low)))

    def _part(self, x: str) -> bytes:
        key = x
        if self.kind == "byte":  # a word's key is the piece's; no piece has the others'
            key = x[1:] if x[0] == " " and x[1:].isalpha() else "\0" + x if x.isalpha() else "\0\0" + x
        v = self.new.get(key)
        if v is None:
            v = self.old.get(key)
            v = self._keep(key, self._model(x) if v is None else v)
        return v

    def _model(self, x: str) -> bytes:
        if x.isascii() and x.isprintable():
            s = self.letters[32] + x[1:] if x[0] == " " else x
        else:
            s = x.encode().decode("latin-1").translate(self.letters)
        found = self.model.tokenize(s)
        return self.coded[found[0].id] if len(found) == 1 else b"".join([self.coded[t.id] for t in found])

    def _keep(self, p: str, v: bytes) -> bytes:
        if len(p) < 64:
            if len(self.new) >= self.limit and self.kind == "word":  # the other kind changes generations between texts
                self.old, self.new = self.new, {}
            self.new[p] = v
        return v

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.kind or any(c in text for c in self.marks) and any(s in text for s in self.special):
            return self.whole(text)
        if self.kind == "byte":
            return self._byte_ids(text)
        pieces = text.replace("\n", " ").split(" ")
        out = list(map(self.new.get, pieces))
        places = [i for i, v in enumerate(out) if v is None]
        if not places:
            return b"".join(out)
        found = {"": b""}
        for p in {pieces[i] for i in places}:
            if p:
                v = self.old.get(p)
                found[p] = self._keep(p, self.piece(p) if v is None else v)
        for i in places:
            out[i] = found[pieces[i]]
        return b"".join(out)

    def _byte_ids(self, text: str) -> bytes:
        if "\0" in text:
            return self.whole(text)
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, _Pieces(self._make)
        # white space beside other white space shows as an empty piece or a lone line end; neither is ever kept
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\0" + pieces[0]
        try:
            return b"".join(map(self.new.__getitem__, pieces))
        except _Odd:
            return self.whole(text)

    def _make(self, key: str) -> bytes:
        """Ids of a key of ``_Pieces``, from the older generation or made."""
        v = self.old.get(key)
        if v is not None:
            return v
        if key.isascii():
            if key.isalpha():
                found = self.model.tokenize(self.letters[32] + key)
                return self.coded[found[0].id] if len(found) == 1 else b"".join([self.coded[t.id] for t in found])
            if key[-1:] in _STOPS and key[:-1].isalpha():
                return self.new[key[:-1]] + self._part(key[-1])
        first = key[:1]
        if first == "\n":
            if len(key) == 1:
                raise _Odd
            return self._part("\n") + self.new["\0" + key[1:]]
        p = key[1:] if first == "\0" else " " + key
        plain = key.isalnum() or key[:-1].isalnum() and key[-1] in _STOPS
        if not plain and (p in ("", " ") or _ODD.search(p)):
            raise _Odd
        return self.piece(p)


@functools.cache
def cached_tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker, so that its cache serves all the worker's tasks."""
    return CachedTokenizer(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
