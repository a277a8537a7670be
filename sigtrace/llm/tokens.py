"""Token ids of whole texts with a public vocabulary file, by way of the pieces between ASCII white space."""

from __future__ import annotations

import importlib.util
import json
import os
import re
import sys
from array import array

import numpy as np

#: Pieces up to this many bytes are remembered, this many in each of two generations.
CACHED_BYTES, CACHED_PIECES = 48, 250_000

#: Between an ASCII letter (1) and such a mark (2) the vocabulary always splits, so white space there changes no id.
_KIND = bytes(1 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" else 2 if chr(c) in ".,!?;:" else 0 for c in range(256))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file where the installed package keeps it."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        raise FileNotFoundError("give the path of a vocabulary file: the package public_tokenizers is not installed")
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


#: Steps of a vocabulary that lowers case, drops white space and splits around it: its texts may be cut there.
_LOWERS = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_white_space(vocabulary: dict) -> bool:
    """Whether a vocabulary file's normaliser and splitter are those that Encoder's shortcut is right for."""
    steps = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (vocabulary.get("normalizer") or {}).get("normalizers", [])]
    first = ((vocabulary.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return steps == _LOWERS and (first.get("pattern") or {}).get("Regex") == _SPLITS and first.get("behavior") == "Removed" and first.get("invert") is True


#: Letters in lower case that are composed already: normaliser and splitter leave a piece of them as it is.
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary names each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


def keeps_letters(vocabulary: dict) -> bool:
    """Whether a piece of such letters alone goes byte by byte to the model of a vocabulary, so that the other steps may be left out."""
    rest = ((vocabulary.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[1:]
    plain = len(rest) == 1 and all(n.get("type") == "ByteLevel" and not n.get("add_prefix_space", True) and not n.get("use_regex", True) for n in rest)
    model = vocabulary.get("model") or {}
    whole = model.get("type") == "BPE" and not model.get("dropout") and not vocabulary.get("truncation") and not vocabulary.get("padding")
    return drops_white_space(vocabulary) and plain and whole and not any(t["content"].isalpha() for t in vocabulary.get("added_tokens") or [])


def spaced(text: bytes) -> bytes:
    """The text with a space between each ASCII letter and a mark behind it."""
    kind = np.frombuffer(text.translate(_KIND), np.uint8)
    at = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1))
    if not len(at):
        return text
    kept = np.ones(len(text) + len(at), bool)
    kept[at + np.arange(1, len(at) + 1)] = False
    out = np.full(len(kept), 32, np.uint8)
    out[kept] = np.frombuffer(text, np.uint8)
    return out.tobytes()


def _as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian numbers of four bytes."""
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


class _Pieces(dict):
    """Ids by piece; a missing piece is found by a function."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, piece: bytes) -> bytes:
        return self.find(piece)


class Encoder:
    """ids(text) equals the tokenizer's own ids, without special tokens added.

    A vocabulary that lowers case, drops white space and never joins across it gives a text the ids of its pieces between
    ASCII white space, one after another; pieces of lower letters alone go to its model
    directly. Frequent pieces are looked up, in two generations of bounded size: when the
    younger is full it becomes the older, and what is still in use moves up. With any other vocabulary whole texts are
    encoded. Invalid UTF-8 counts as replacement characters.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.by_pieces = drops_white_space(vocabulary)
        self.model = self.tokenizer.model if keeps_letters(vocabulary) else None
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        self.known, self.older = _Pieces(self.found), {}

    def encoded(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        if self.model is not None and _LETTERS(text):
            named = text if text.isascii() else piece.decode("latin-1").translate(_BYTE_LETTERS)
            return _as_bytes([t.id for t in self.model.tokenize(named)])
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def found(self, piece: bytes) -> bytes:
        """The ids of a piece that the younger generation lacks; it is remembered unless it is long."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoded(piece)
        if len(piece) <= CACHED_BYTES:
            self.known[piece] = ids
        return ids

    def ids(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        if not self.by_pieces:
            return np.frombuffer(self.encoded(text), "<u4")
        if b"<|" not in text:  # special strings are told apart by case
            text = text.lower()
        joined = b"".join(map(self.known.__getitem__, spaced(text).split()))
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = _Pieces(self.found), self.known
        return np.frombuffer(joined, "<u4")


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder per worker process, vocabulary and treatment of special strings."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(path, plain_specials)
    return _encoders[key]


def forget() -> None:
    """Drops this process's encoders; called where a worker turns to work without tokens."""
    _encoders.clear()
