"""Token ids and pre-tokens of texts by public tokenizers, unit by unit.

A *unit* is a stretch of text whose tokens do not depend on what stands beside it: a word
with the space before it, as a rule. Neither kind of tokenizer used here joins what stands
before a space that follows a non-blank with what comes from that space on. Texts repeat
their units, so each is encoded once and remembered. Ids always come from the library of
the file: ``tokenizers`` for ``.json``, ``sentencepiece`` for ``.model``.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard

# Anything one of the libraries might take for white space.
BLANK = r"\s\u180e\u200b\ufeff"
TOUCHING = re.compile(rf" [{BLANK}]|[{BLANK}] ")
PLAIN_UNITS = re.compile(" [^ ]*|[^ ]+")
# A space and a word: such units may stand in a row without changing each other's tokens.
REGULAR = re.compile(rf" [^{BLANK}](?:.*[^{BLANK}])?", re.DOTALL)
ROW_CHARS = 8_192
BEFORE_SPACE = re.compile(rf"(?<=[^{BLANK}])(?= )")
SPACE_MARK = "\u2581"


def units(text: str) -> list[str]:
    """Stretches that are encoded apart; joined they are the text."""
    if TOUCHING.search(text):
        return [u for u in BEFORE_SPACE.split(text) if u]
    return PLAIN_UNITS.findall(text)


class JsonTokenizer:
    """A ``tokenizers`` file. ``plain_specials``: special strings in texts are plain text."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as spec:
            added = json.load(spec)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        specials = [] if plain_specials else [re.escape(t["content"]) for t in added]
        self.specials = re.compile("|".join(sorted(specials, key=len, reverse=True))) if specials else None

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of them there are."""
        if not self.specials or not self.specials.search(text):
            return [text], 0
        parts = self.specials.split(text)
        return parts, len(parts) - 1

    def ids(self, many: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(many, add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id of a byte-level vocabulary."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        out = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            out[i] = bytes(byte_of[c] for c in token)
        return out

    def pre_tokens(self, unit: str) -> list[str]:
        """The library's own pre-tokens, in the alphabet of the vocabulary."""
        if self.library.normalizer is not None:
            unit = self.library.normalizer.normalize_str(unit)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)]

    def n_pieces(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))


class ModelTokenizer:
    """A ``sentencepiece`` file. Units start with the space that the library puts first."""

    def __init__(self, path: str, plain_specials: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in map(self.library.id_to_piece, range(len(self.library)))):
            raise ValueError("pieces that span words are not supported")
        self.before = len(self.library.encode("x"))

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text with the library's own space; the mark of spaces is a space to it."""
        return ([" " + text.replace(SPACE_MARK, " ")] if text else []), 0

    def ids(self, many: list[str]) -> list[list[int]]:
        return [i[self.before :] for i in self.library.encode(["x" + u for u in many], num_threads=1)]

    def token_bytes(self) -> list[bytes]:
        model = self.library
        return [
            bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
            for i in range(len(model))
        ]

    def pre_tokens(self, unit: str) -> list[str]:
        return [unit]

    def n_pieces(self, pre_token: str) -> int:
        return len(self.ids([pre_token])[0])


def load(path: str, plain_specials: bool = False) -> JsonTokenizer | ModelTokenizer:
    """The library's tokenizer of a ``.json`` or ``.model`` file."""
    return (ModelTokenizer if path.endswith(".model") else JsonTokenizer)(path, plain_specials)


def chunks(rows: Iterable[tuple], text_at: int, most_chars: int, most_rows: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``most_chars`` characters and at most ``most_rows`` rows."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at] or "")
        if chars >= most_chars or len(held) >= most_rows:
            yield held
            held, chars = [], 0
    if held:
        yield held


def expanded(which: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the elements of list ``which[i]`` for all i, and the i of each.

    List j holds positions ``ends[j]`` up to ``ends[j + 1]`` of some array.
    """
    n = ends[which + 1] - ends[which]
    owner = np.repeat(np.arange(len(which)), n)
    first = np.repeat(ends[which] - (np.cumsum(n) - n), n)
    return first + np.arange(len(owner)), owner


def rows_of_units(units: list[str]) -> list[str]:
    """Regular units put together to texts of bounded size."""
    rows, start, size = [], 0, 0
    for i, u in enumerate(units):
        size += len(u)
        if size >= ROW_CHARS:
            rows.append("".join(units[start : i + 1]))
            start, size = i + 1, 0
    return rows + ["".join(units[start:])] if start < len(units) else rows


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, compressed; bytes of equal weight lie together."""
    planes = [np.ascontiguousarray(np.asarray(c, "<i8").view(np.uint8).reshape(-1, 8).T) for c in columns]
    body = zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())
    return struct.pack("<II", len(columns[0]), len(body)) + body


def unpacked(data: bytes, at: int, n_columns: int) -> tuple[list[np.ndarray], int]:
    """Columns of the block at ``at``, and where the next block starts."""
    n, size = struct.unpack_from("<II", data, at)
    at += 8
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.uint8).reshape(n_columns, 8, n)
    return [np.ascontiguousarray(c.T).view("<i8").ravel() for c in flat], at + size
