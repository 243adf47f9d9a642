"""Byte-level BPE by pre-token, shared by the token counter and the token file writer.

A byte-level BPE never merges across pre-tokens, so the ids of a text are the
ids of its pre-tokens in order. Pre-tokens repeat; each is merged once per
worker and looked up after that. The merges themselves are the library's own
(``Tokenizer.model``); only the splitting is done here, and the tests compare
it with the library on every assigned code point.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Pre-tokens remembered by a worker beyond the vocabulary; then it starts afresh.
MEMORY = 400_000

# The two published splitting patterns. The white space property is written out (a bare
# \s would also match U+001C to U+001F, which the library doesn't count as white space), and letters
# come first: no contraction starts with one.
_GPT = r""" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_WORD = r"""\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\p{White_Space}\p{L}\p{N}]+"""
# The same on ASCII, where plain character ranges do.
_ASCII_GPT = r""" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
_ASCII_WORD = r"""[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\ra-z0-9]+"""


@lru_cache(maxsize=1)
def _unsettled() -> tuple[regex.Pattern, regex.Pattern]:
    """(quick test, exact test) for code points that are letters or numbers only in newer Unicode versions.

    The libraries may differ on those; texts with one of them are left to the library as a whole.
    """
    known = regex.compile(r"[\p{L}\p{N}]")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    if not points:
        return regex.compile(r"(?!)"), regex.compile(r"(?!)")
    return regex.compile(f"[\\U{points[0]:08X}-\\U0010FFFF]"), regex.compile("[" + "".join(f"\\U{c:08X}" for c in points) + "]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Splits texts as the library would for this tokenizer file and encodes single pre-tokens."""

    def __init__(self, spec: str) -> None:
        conf = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self._model = self.tokenizer.model
        self._letters = {chr(b): c for b, c in _byte_letters().items()}
        self._table = str.maketrans(self._letters)
        self._back = {c: ord(b) for b, c in self._letters.items()}
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in conf["added_tokens"])
        kind = conf["pre_tokenizer"]["type"]
        if not plain or (kind, conf["normalizer"] is None) not in (("ByteLevel", True), ("Sequence", False)):
            raise ValueError("this tokenizer file needs a splitting rule that isn't built in")
        self.folds = kind == "Sequence"
        self._split_any = regex.compile(_WORD if self.folds else _GPT).findall
        self._split_ascii = re.compile(_ASCII_WORD if self.folds else _ASCII_GPT).findall
        self._marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _fold(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # the library lowers each character by itself; str.lower() has one rule that looks around it
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def _split(self, text: str) -> list[str]:
        return self._split_ascii(text) if text.isascii() else self._split_any(text)

    def unsettled(self, text: str) -> bool:
        """Must this text be left to the library?"""
        if text.isascii():
            return False
        quick, exact = _unsettled()
        return quick.search(text) is not None and exact.search(text) is not None

    def library_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def segments(self, text: str) -> list[tuple[list[str], str | None]]:
        """(pre-tokens, special string that follows or None) in order."""
        if self._marks is None or "<" not in text:
            return [(self._split(self._fold(text) if self.folds else text), None)]
        cut = self._marks.split(text)
        return [(self._split(self._fold(s) if self.folds else s), cut[i + 1] if i + 1 < len(cut) else None) for i, s in enumerate(cut) if not i % 2]

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self._model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._table))]

    def surface(self, token: str) -> str | None:
        """The text that a vocabulary string stands for, None if its bytes aren't whole characters."""
        try:
            return bytes(self._back[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None

    def whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings proved to encode alone as their single id: a pre-token equal
        to one of them needs no merging."""
        found = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            text = self.surface(token.removesuffix("</w>") if self.folds else token)
            if text and self._split(text) == [text] and self.piece_ids(text) == [i]:
                found[text] = i
        return found


class PieceCounts(dict):
    """Pre-token -> number of tokens. Starts from the proved whole tokens, merges what is missing."""

    def __init__(self, encoder: PieceEncoder) -> None:
        self._encoder = encoder
        self._whole = dict.fromkeys(encoder.whole_tokens(), 1)
        super().__init__(self._whole)

    def __missing__(self, piece: str) -> int:
        if len(self) >= len(self._whole) + MEMORY:
            self.clear()
            self.update(self._whole)
        n = len(self._encoder.piece_ids(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class PieceBytes(dict):
    """Pre-token -> its ids as little-endian integers of ``width`` bytes."""

    def __init__(self, encoder: PieceEncoder, width: int) -> None:
        super().__init__()
        self._encoder, self._width = encoder, width

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        out = b"".join(i.to_bytes(self._width, "little") for i in self._encoder.piece_ids(piece))
        if len(piece) <= 64:
            self[piece] = out
        return out


# One per worker process: a function of the module, so that tasks find what earlier tasks have merged.
@lru_cache(maxsize=4)
def counting(spec: str) -> tuple[PieceEncoder, PieceCounts]:
    """Encoder and count table of this tokenizer file."""
    encoder = PieceEncoder(spec)
    return encoder, PieceCounts(encoder)


@lru_cache(maxsize=4)
def encoding(spec: str, width: int) -> tuple[PieceEncoder, PieceBytes]:
    """Encoder and id table of this tokenizer file."""
    encoder = PieceEncoder(spec)
    return encoder, PieceBytes(encoder, width)
