"""Token ids of whole texts with a public tokenizer's file.

A text is cut only where the tokenizers' own pre-tokenizers always cut (a white-space character
after another character), so the ids of the pieces, joined, are the ids of the whole text. Pieces
are encoded by the library once and then looked up; the tables of known pieces are bounded in bytes.
Texts that hold one of the file's added tokens (end of text and the like) go through the library
whole, as it finds these before it cuts anything.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from operator import attrgetter

#: Unicode white space, as the tokenizers' patterns see it (fixed values)
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
_SOLID = re.compile(f"[^{WS}]+")
_SPACES = re.compile(f"[{WS}]").findall(re.sub("(.)-(.)", lambda m: "".join(
    map(chr, range(ord(m[1]), ord(m[2]) + 1))), WS))  # each of them
#: the byte-level pre-tokenizer's pattern for a word of Latin-1 characters after a space
_LETTERS, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^ {_LETTERS}{_DIGITS}]+")
_BARE = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the tokenizers
PUNCTUATION = string.punctuation
KNOWN_BYTES = 96 << 20  # what a worker's tables of known pieces may hold together
ENTRY = 200  # bytes of an entry besides its characters and ids
LONGEST = 48  # characters of a kept piece


def _odd(text: str) -> bool:
    """Whether a space doesn't follow a solid character."""
    return text.startswith(" ") or "  " in text or any(
        c in text and c + " " in text for c in (_SPACES[:5] if text.isascii() else _SPACES) if c != " ")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for
    the characters from 256 on."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return out


class _Known(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, room: list):
        self.encode, self.room = encode, room  # bytes left, shared by the encoder's tables

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if self.room[0] > 0 and len(piece) <= LONGEST:
            self[piece] = ids
            self.room[0] -= ENTRY + len(piece) + len(ids)
        return ids


class Encoder:
    """``ids(text)``: the ids as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        t = self.t = Tokenizer.from_file(path)
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        # letter case is left open: a tokenizer may fold it before it looks
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.mark = re.split(r"\w", os.path.commonprefix(added))[0] if added else ""  # what all of them start with
        # white space is dropped by tokenizers whose words carry an end mark
        self.drops_space = drops = bool(getattr(t.model, "end_of_word_suffix", None))
        model, norm, pre, letters = t.model, t.normalizer, t.pre_tokenizer, _byte_letters()

        id_of, tokenize, space = attrgetter("id"), model.tokenize, "" if drops else letters[32]

        def pack(part: str) -> bytes:  # of one pre-token, in the byte-level alphabet
            return array("I", map(id_of, tokenize(part))).tobytes()

        def piece(p: str) -> bytes:
            if len(p) > 1000:
                return array("I", t.encode(p, add_special_tokens=False).ids).tobytes()
            if norm is not None:
                p = norm.normalize_str(p)
            return b"".join(pack(s) for s, _ in pre.pre_tokenize_str(p))

        def word(core: str) -> bytes:
            return pack(space + (core if core.isascii() else core.encode().decode("latin-1").translate(letters)))

        room = [KNOWN_BYTES]
        tails = _Known(pack, room)

        # the fixed pattern is only that of a byte-level pre-tokenizer by itself
        byte_level = (not drops and norm is None and isinstance(pre, ByteLevel) and pre.use_regex
                      and not pre.add_prefix_space)

        def common(p: str) -> bytes:
            """A word (with its space, where spaces count): one pre-token of letters, then one of
            punctuation, if any. Words of Latin-1 characters are cut here, those that a line end or
            the like joins are taken one by one, other pieces take the library's whole way."""
            core = p.rstrip(PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100") and len(p) < 1000:
                own = core.lower() if drops else core
                if own == p:
                    return word(p)
                return self.words[own] + tails[p[len(core):]] if len(core) < len(p) else self.words[own]
            if byte_level and len(p) < 1000 and (parts := _CHUNKS.findall(p)) and parts[0][0] not in _SPACES:
                if len(parts) > 1:
                    return self.words[parts[0]] + b"".join(map(self.plain.__getitem__, parts[1:]))
                if max(p) < "\u0100":
                    return b"".join([
                        self.words[s[1:]] if s[0] == " " and s[1:].isalpha() else
                        tails[s.encode().decode("latin-1").translate(letters)] for s in _LATIN.findall(" " + p)])
            return piece(p if drops else " " + p)

        def chunk(p: str) -> bytes:
            """Solid characters, after white space or none. The white space is a pre-token but for
            its last character, which is one of its own."""
            body = p.lstrip("\t\n\r")
            if byte_level and body and body[0] not in _SPACES and len(p) < 1000 and max(body) < "\u0100":
                lead = p[:len(p) - len(body)]
                return b"".join([tails[s.encode().decode("latin-1").translate(letters)]
                                 for s in (lead[:-1], lead[-1:], *_LATIN.findall(body)) if s])
            return piece(p)

        self.words = _Known(common, room)
        self.plain = _Known(chunk, room)

    def ids(self, text: str) -> bytes:
        if self.added and self.mark in text and self.added.search(text):
            return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()
        if self.drops_space:
            words = _SOLID.findall(text) if _BARE.search(text) else text.split()
            return b"".join(map(self.words.__getitem__, words))
        if _odd(text):
            return b"".join(map(self.plain.__getitem__, _CHUNKS.findall(text)))
        parts = text.split(" ")
        head = b"".join(map(self.plain.__getitem__, _CHUNKS.findall(parts[0])))
        return head + b"".join(map(self.words.__getitem__, parts[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
