"""Encoding texts with a public tokenizer, a word at a time through a bounded cache."""

from __future__ import annotations

import os
import struct
import unicodedata


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [c for _, c in sorted([(b, chr(b)) for b in shown] + [(b, chr(256 + i)) for i, b in enumerate(hidden)])]


class _Words(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, worked out on first use."""

    def __init__(self, tokenizer, most: int):  # noqa: ANN001
        super().__init__()
        self.tokenizer, self.model, self.most, self.held = tokenizer, tokenizer.model, most, 0
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
        if not stem or stem == word:
            ids = self._unit(word)
        else:
            s = stem.decode("utf-8", "replace")
            # letters are always cut off from punctuation, except after an apostrophe
            ids = self[stem] + self[word[len(stem) :]] if s.isalpha() and max(s) < "ƀ" else self._unit(word)
        if self.held < self.most:  # words met later than that are worked out each time
            self[word] = ids
            self.held += len(word) + len(ids) + 120
        return ids

    def _unit(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one word of the model
            low = word.lower()
            if low != word:
                return self[low]
            ids = [t.id for t in self.model.tokenize(low.decode())]
        else:
            s = word.decode("utf-8", "replace")
            low = s.lower()
            if s.isalpha() and max(s) < "ƀ" and max(low) < "ƀ" and unicodedata.is_normalized("NFC", s):
                if low != s:
                    return self[low.encode()]
                ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word]))]
            else:
                ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Little-endian unsigned 32-bit ids of whole texts.

    For byte-level BPE that drops white space, cuts letters from all else and
    lower-cases, the ids of a text are those of its words in a row, so each
    distinct word is encoded once while it is in the cache. Special tokens'
    strings are ordinary text. Texts with a letter whose lower case is longer
    than itself are encoded whole.
    """

    def __init__(self, path: str | None = None, most_bytes: int = 40 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.tokenizer.encode_special_tokens = True
        self.words = _Words(self.tokenizer, most_bytes)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A bytes object of ids for each text; null counts as empty."""
        get, out = self.words.__getitem__, []
        for text in texts:
            if text and "İ" in text:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(b"".join(map(get, text.encode("utf-8", "replace").split())) if text else b"")
        return out


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """This process's encoder; a reused Python worker keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
