"""Whole-text encoding with the tokenizers library, one library call for each distinct piece rather than each text.

Texts are cut before white space and, where a Latin letter or a digit comes before ASCII punctuation, between the two.
Both byte-level pre-tokenizers in use end a token at these places whatever follows, so the ids of a text are the ids of
its pieces one after another. Arrow cuts a whole batch, numbers its distinct pieces and puts their ids together; only
distinct pieces are looked up one by one, in a dictionary that lives as long as its worker. Whether the cuts give the
library's ids is tried on a few texts when the encoder is made; without that, texts are encoded in one call each.
A piece that is a word of Latin letters is one pre-token (two after a line's end), so the library's model encodes it
without the steps before it; that is tried on a few words too. A text is encoded in one call if it holds the mark used
for cutting, white space that the library's patterns may see otherwise beside a place to cut, or one of the vocabulary's
special tokens, so that those get the ids that the library gives them.

Cases: an empty text has no ids; null texts are the caller's to replace; a text of any length is encoded whole; ids
that the chosen type can't hold raise an error.
"""

from __future__ import annotations

import os
import sys
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; later ones are encoded anew each time.
REMEMBERED = 500_000
#: Bytes of text that are cut at once, a larger text alone.
AT_ONCE = 8 << 20
#: Where a piece begins; no text that holds it is cut.
MARK = "\x01"
SPACES = " \n\r\t"
_OTHER_SPACE = r"\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = rf"{MARK}|[{_OTHER_SPACE}][{SPACES}]"
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}"  # below LATIN_END, whose lower case ends in a mark
_BEFORE_STOP = rf"([{_LETTERS}0-9])([!-/:-@\[-`{{-~])"
_TRIED = ["For the, end.\nAnd it's 8%%% of 12,5.", "a.b_c IT'S\n\nd-e  f\t'll \u00c9!\r\n(x)'s", " \n x\"y\"'ve ", "\u00fcx..'m A1's $$$ \n.z\u00a0w"]
_ENCODERS: dict = {}
#: Letters beyond which words always take the library's full path.
LATIN_END = "\u0130"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: its own where it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """encode() gives each text's ids as little-endian bytes of the given dtype."""

    def __init__(self, path: str, dtype: str = "<u4", remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if t.content and not t.normalized]
        self.folded = [t.content.lower() for t in added if t.content and t.normalized]  # found after the text is normalised
        self.room = REMEMBERED if remembered is None else remembered
        self.dtype = np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        spaced = self._ids([" a", "a"])
        self.lead = " " if spaced[0] != spaced[1] else ""
        self.line = self._ids(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.folds = self._ids(["A"]) == self._ids(["a"])
        self.table = {b: c for b, c in enumerate(self.letters)}
        tried = ["a", "The", "strasse", "Straße", "ÉTÉ", "niñoñ", "QUÆÐ", "øystein", "x" * 300, "ªºµ"]
        self.direct = all([self._word(f + w) for w in tried] == self._ids([f + w for w in tried]) for f in ("", " ", "\n"))
        cut = [p.split(MARK) for p in self._marked(pa.array(_TRIED)).to_pylist()]
        self.cuts = [b"".join(self._ids(p)) for p in cut] == self._ids(_TRIED)

    def _has_special(self, text: str) -> bool:
        return any(t in text for t in self.special) or (bool(self.folded) and any(t in text.lower() for t in self.folded))

    def _packed(self, ids: list[int]) -> bytes:
        found = array(self.code, ids)  # several times faster than numpy for a few ids
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _word(self, piece: str) -> bytes:
        """Ids of a word of Latin letters, at a text's start or after a space or a line's end, from the model alone."""
        lead, before = "", b""
        if piece[0] == " ":
            piece, lead = piece[1:], self.lead
        elif piece[0] == "\n":
            piece, before = piece[1:], self.line
        if self.folds:
            piece = piece.lower()
        if piece.isascii():
            mapped = self.letters[32] + piece if lead else piece
        else:
            mapped = (lead + piece).encode().decode("latin-1").translate(self.table)
        return before + self._packed([t.id for t in self.library.model.tokenize(mapped)])

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1000):
            out += [self._packed(e.ids) for e in self.library.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that aren't known."""
        found, others = [], []
        for n, piece in enumerate(pieces):
            stem = piece[1:] if piece[:1] in (" ", "\n") else piece
            if self.direct and stem.isalpha() and (stem.isascii() or (max(stem) < LATIN_END and is_normalized("NFC", stem))):
                found.append(self._word(piece))
            else:
                found.append(b"")
                others.append(n)
        for n, ids in zip(others, self._ids([pieces[n] for n in others])):
            found[n] = ids
        room = max(0, self.room - len(self.known))
        self.known.update(zip(pieces[:room], found[:room]))
        return found

    @staticmethod
    def _marked(texts: pa.Array) -> pa.Array:
        """Texts with the mark before every piece but the first."""
        for space in SPACES:
            texts = pc.replace_substring(texts, space, MARK + space)
        for space in SPACES:  # white space stays together
            texts = pc.replace_substring(texts, space + MARK, space)
        return pc.replace_substring_regex(texts, _BEFORE_STOP, rf"\1{MARK}\2")

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded in one call."""
        found = pc.match_substring_regex(texts, _UNSAFE)
        for token in self.special:
            found = pc.or_(found, pc.match_substring(texts, token))
        found = found.to_numpy(zero_copy_only=False)
        if self.folded:
            found = found | np.array([self._has_special(t) for t in texts.to_pylist()], bool)
        return found | (not self.cuts)

    def _encode(self, texts: pa.Array) -> list[bytes]:
        whole = self._whole(texts)
        entire = self._ids(texts.filter(pa.array(whole)).to_pylist())
        parts = pc.split_pattern(self._marked(pc.if_else(pa.array(whole), "", texts)), MARK)
        numbered = parts.flatten().dictionary_encode()
        joined = pa.ListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int32()), numbered.dictionary)
        pieces = pc.binary_join(joined, pa.scalar(MARK, pa.large_string()))[0].as_py().split(MARK)  # several times faster than to_pylist
        ids = list(map(self.known.get, pieces))
        missing = [n for n, i in enumerate(ids) if i is None]
        for n, i in zip(missing, self._learn([pieces[n] for n in missing])):
            ids[n] = i
        taken = pa.array(ids, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[parts.offsets.to_numpy()].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        out = [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        for n, i in zip(np.flatnonzero(whole).tolist(), entire):
            out[n] = i
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        out, at, room = [], 0, AT_ONCE
        for n, size in enumerate(pc.binary_length(texts).to_pylist()):
            if n > at and size > room:
                out += self._encode(texts.slice(at, n - at))
                at, room = n, AT_ONCE
            room -= size
        return out + self._encode(texts.slice(at)) if at < len(texts) else out

    def forget(self) -> None:
        self.known.clear()


def encoder(path: str, dtype: str = "<u4", remembered: int | None = None) -> Encoder:
    """One encoder for each worker process and number of pieces that it may remember."""
    key = (path, dtype, remembered)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, dtype, remembered)
    return _ENCODERS[key]
