"""Token ids of whole texts with a file of the tokenizers library (byte-level or word-end BPE).

A text is cut before every blank or line break that a visible character follows: these tokenizers start a new piece there, so the
ids of the parts, joined, are the ids of the text. Texts are cut together, so that equal parts of a batch are asked for once. A worker remembers the ids of parts it has seen, up to a bound. A new part of
letters, with or without a closing run of stops, goes to the library's BPE model directly, since its pieces are known;
any other part goes through the library's whole encoder. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import gc
import os
import string
from array import array

import numpy as np
import pyarrow as pa

#: First bytes after a blank at which a new part may start: visible ASCII, and lead bytes whose characters hold no white space.
SAFE = bytes([*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])
_IS_SAFE = [b in SAFE for b in range(256)]
_IS_MARK = np.isin(np.arange(256), [0x20, 0x0A])
#: A run of these behind letters is one piece.
STOPS = ".,!?;:%&*$#"
_LOADED: dict[str, Encoder] = {}


class _Joined(Exception):
    """A part that can not start after a blank."""


def _alphabet() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Parts(dict):
    """Ids of parts, found when first asked for: a word with a blank before it, or a line break and a word. The older half is
    dropped when `remembered` new parts have come."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            encoder = self.encoder
            # bytes are letters to isalpha() in ASCII only
            if word.isalpha() and encoder.ascii:
                ids = array("I", [t.id for t in encoder.tokenize(encoder.blank + encoder.ascii(word.decode()))]).tobytes()
            elif word[-1:] in (b".", b",") and word[:-1].isalpha() and encoder.ascii:
                return self[word[:-1]] + encoder.stop_ids(word[-1:].decode())  # the word alone is remembered
            elif not word or not _IS_SAFE[word[0]] and (word[0] != 0x0A or len(word) == 1 or not _IS_SAFE[word[1]]):
                raise _Joined
            else:
                ids = encoder.part(word)
        if len(word) <= 64:
            if len(self) >= self.encoder.remembered:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """remembered: parts of each half, some 200 bytes each, so 96 MB for both halves."""

    def __init__(self, path: str, remembered: int = 240_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remembered, self.known, self.stops = remembered, _Parts(self), {}
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.tokenize = self.model.tokenize
        self.letters = _alphabet()
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self._normal(" ab" + STOPS))]
        #: What stands for the blank before a word's letters; None if the pieces of such a part are not the letters and the stops.
        self.blank = {("Ġab", STOPS): "Ġ", ("ab", STOPS): ""}.get(tuple(pieces))
        lines = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self._normal("ab\ncd"))]
        #: Ids of a line break before a visible character; None if it is no piece of its own.
        self.line = {("ab", "Ċ", "cd"): self.whole(b"\n"), ("ab", "cd"): b""}.get(tuple(lines))
        ascii_letters = string.ascii_letters
        #: How ASCII letters come out of the normalizer: as they are, in lower case, or otherwise (None).
        self.ascii = {ascii_letters: str, ascii_letters.lower(): str.lower}.get(self._normal(ascii_letters)) if self.blank is not None else None
        #: Letters that meet no other when normalised (no marks, no Hangul), each as it comes out of the normalizer.
        self.alone = {c: self._normal(chr(c)) for c in range(0x250) if chr(c).isalpha()}

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def whole(self, text: bytes) -> bytes:
        """Ids of a text by the library alone."""
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def part(self, word: bytes) -> bytes:
        """Ids of a blank and a word, or of a line break and a word."""
        after_line = word[0] == 0x0A
        text = word.decode("utf-8", "replace")
        if after_line:
            text = text[1:]
        plain = text.isascii()
        core = text.rstrip(STOPS)
        if plain and self.ascii:
            text = self.ascii(text)
        elif core.isalpha() and max(core) < "\u0250":
            text = text.translate(self.alone)
        else:
            text = self._normal(text)
        core = text.rstrip(STOPS)
        if self.blank is None or not core.isalpha() or not _IS_SAFE[core.encode()[0]] or after_line and self.line is None:
            return self.whole(word if after_line else b" " + word)
        if after_line and not self.blank:
            return self.line + self.known[text.encode()]
        if len(core) < len(text):
            return self.known[(b"\n" if after_line else b"") + core.encode()] + self.stop_ids(text[len(core) :])
        if not plain:
            core = core.encode().decode("latin-1").translate(self.letters)
        return self.line + self._ids(core) if after_line else self._ids(self.blank + core)

    def stop_ids(self, stops: str) -> bytes:
        """Ids of a run of stops behind letters."""
        if stops not in self.stops:
            if len(self.stops) > 1000:
                self.stops.clear()
            self.stops[stops] = self._ids(stops)
        return self.stops[stops]

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of texts that lie end to end, offsets[0] to offsets[-1]: equal parts of all texts are asked for once."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        marks = np.flatnonzero(_IS_MARK[data]).astype(np.int32)
        # a row's parts: what stands before its first mark, then each mark and what follows it
        starts = np.sort(np.concatenate((offsets[:-1].astype(np.int32), marks)), kind="stable")
        first = np.arange(len(offsets)) + np.searchsorted(marks, offsets)
        bounds = np.append(starts, len(data)).astype(np.int32)
        del marks
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        del starts, bounds
        ids, joined = [], []
        known, whole = self.known, self.whole
        for k, part in enumerate(cut.dictionary.to_pylist()):
            mark = part[:1]
            try:
                ids.append(known[part[1:]] if mark == b" " else known[part] if mark == b"\n" else whole(part) if part else b"")
            except _Joined:
                ids.append(b"")
                joined.append(k)
        found = pa.array(ids, pa.large_binary()).take(cut.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[first] if len(found) else np.zeros(len(offsets), np.int64)
        values = memoryview(found.buffers()[2] or b"")
        out = [bytes(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        if joined:
            at = np.flatnonzero(np.isin(cut.indices.to_numpy(), joined))
            for i in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                out[i] = self._encode_joined(data[offsets[i] : offsets[i + 1]].tobytes())
        return out

    def _encode_joined(self, text: bytes) -> bytes:
        """Where white space runs stand: words that may not start a part stay with the part before."""
        head, *words = text.split(b" ")
        out, own, joined = [], [head], True
        for w in words:
            if w and _IS_SAFE[w[0]]:
                out.append(self._joined_part(own, joined))
                own, joined = [w], False
            else:
                if not joined:
                    own.insert(0, b"")
                own.append(w)
                joined = True
        out.append(self._joined_part(own, joined))
        return b"".join(out)

    def _joined_part(self, own: list[bytes], joined: bool) -> bytes:
        """A run of text that is no single part goes to the library, a word that holds no line break is remembered."""
        if joined or b"\n" in own[0]:
            text = b" ".join(own if joined else [b"", *own])
            return self.whole(text) if text else b""
        return self.known[own[0]]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; what it remembers serves all tasks of the worker, up to its bound."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def release_encoders() -> None:
    """Let the worker's encoders and what they remember go. Spark gives a worker that has encoded to the next job's steps; one that needs
    memory of its own calls this first."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()  # an encoder and its parts know each other
