"""Token ids of texts by a public tokenizer's file, with a cache of words."""

from __future__ import annotations

import json
import re

import numpy as np

#: Words and word pieces that a worker keeps, at most; the cache starts anew beyond.
CACHE = 300_000
#: Texts with other characters, or with what looks like a special token, go to the tokenizer itself.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧]|<\\|")
# Fixed value: the pattern that cuts a text into pieces in the file with word ends.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same cut among the characters that aren't unsafe.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def byte_names() -> list[str]:
    """Byte-level vocabularies spell a byte as itself if it prints in Latin-1, else as the next character from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Subwords:
    """Same ids as the tokenizer's own encode(text, add_special_tokens=False).

    The file's pre-tokenizer drops white space and cuts what is left into pieces that are encoded each on its own,
    so a word's ids can be kept. That holds for files with lower-casing, the known pattern and byte-level pieces,
    which is checked; any other file is used without the cache.
    """

    _loaded: dict[str, Subwords] = {}

    @classmethod
    def load(cls, path: str) -> Subwords:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.narrow = self.size <= 1 << 16
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.words = steps == ["NFC", "Replace", "Lowercase"] and cut[0].get("pattern", {}).get("Regex") == KNOWN and cut[0].get("behavior") == "Removed" and cut[0].get("invert") is True and cut[1].get("type") == "ByteLevel" and cut[1].get("add_prefix_space") is False
        self.tokenize = self.tokenizer.model.tokenize
        self.names = byte_names()
        self.cache: dict[str, bytes] = {}

    def _own(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else "".join([self.names[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelt)])

    def _learn(self, words: list[str]) -> None:
        cache = self.cache
        for word in words:
            pieces = PIECES.findall(word)
            for p in pieces:
                if p not in cache:
                    cache[p] = self._piece(p)
            if len(pieces) != 1:
                cache[word] = b"".join([cache[p] for p in pieces])

    def release(self) -> None:
        """Forget the words: a worker that is used again for other work doesn't keep them."""
        self.cache.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null counts as empty."""
        if not self.words:
            return [self._own(t or "") for t in texts]
        out = []
        for text in texts:
            text = text or ""
            if UNSAFE.search(text):
                out.append(self._own(text))
                continue
            words = text.lower().split()
            found = list(map(self.cache.get, words))
            if None in found:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                self._learn([w for w in dict.fromkeys(words) if w not in self.cache])
                found = [self.cache[w] for w in words]
            out.append(b"".join(found))
        return out
