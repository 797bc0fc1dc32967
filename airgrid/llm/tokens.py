"""Token ids of whole texts by a public word-level BPE vocabulary.

The vocabulary's pre-tokenizer drops white space and never joins across it, so a
text's ids are those of its chunks between ASCII spaces and line feeds, in order.
Each worker remembers the ids of chunks (up to a number; frequent ones come early).
A chunk of printable Latin characters is split by the vocabulary's own pattern and
merged by a byte-pair merger whose ranks are the vocabulary's ids; a last byte
stands for the word-end mark.  Any other chunk goes to the ``tokenizers`` library
itself, and tests hold both against each other.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

_CACHE_CHUNKS = 150_000
_LAST_LATIN = "ɏ"
_END = b"\x01"


def default_vocabulary() -> str:
    """The path of the public word-level BPE vocabulary; never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """Little-endian unsigned 32-bit ids of each chunk, found when first asked for."""

    def __init__(self, find):
        super().__init__({"": b""})
        self._find = find

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self._find(chunk))
        if sys.byteorder == "big":
            ids.byteswap()
        raw = ids.tobytes()
        if len(self) < _CACHE_CHUNKS and len(chunk) < 64:
            self[chunk] = raw
        return raw


class Encoder:
    """Encodes texts in one Python worker."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self._whole = Tokenizer.from_file(path).encode
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern).findall
        # For lower-cased ASCII the letters are a-z and the numbers 0-9.
        self._split_ascii = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        suffix, byte = told["model"]["end_of_word_suffix"], _byte_of()
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {}
        for token, i in told["model"]["vocab"].items():
            if token not in special:
                word, end = (token[: -len(suffix)], _END) if token.endswith(suffix) else (token, b"")
                ranks[bytes(byte[c] for c in word) + end] = i
        self._merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._marks = tuple(t[:2] for t in special)
        self._known = _Chunks(self._find)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _find(self, chunk: str) -> list[int]:
        ascii_ = chunk.isascii()
        if not chunk.isprintable() or not (ascii_ or max(chunk) <= _LAST_LATIN) or any([m in chunk for m in self._marks]):
            return self._whole(chunk, add_special_tokens=False).ids
        low = chunk.lower() if ascii_ else unicodedata.normalize("NFC", chunk).lower()
        if low.isalpha():
            return self._merge(low.encode() + _END)
        found = self._split_ascii(low) if ascii_ else self._split(low)
        return [i for w in found for i in self._merge(w.encode() + _END)]

    def raw(self, text: str | None) -> bytes:
        """All ids of the text as little-endian unsigned 32-bit integers; null and empty give none."""
        return b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def count(self, text: str | None) -> int:
        return len(self.raw(text)) // 4
