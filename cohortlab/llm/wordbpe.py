"""Word-wise use of a public BPE vocabulary: split like the tokenizers library, encode each distinct word once.

``WordEncoder.split`` gives the pre-tokens ("words") of a text exactly as the library's normalizer and pre-tokenizer do.
Texts of ASCII and precomposed Latin letters take a regular expression with the same meaning; any other text, and any text
that could hold a special token, goes through the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
from tokenizers import Tokenizer

# Spark has a task on every core; threads of the library's own would only compete with them, and keep memory each.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words whose encoding a Python task keeps; beyond it the cache starts anew.
CACHE = 400_000
#: Characters of text that are split at once.
SLICE = 1 << 20

# Latin letters and signs for which NFC is the identity and lower-casing is one character to one character.
_SAFE = re.compile("[\\t-\\r -~¡-įı-ſ]*")
_LETTERS = "a-zªµºß-öø-ÿā-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r {_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    """Loaded once a worker process: each load would leave some of its memory behind."""
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def id_to_piece(path: str) -> list[str]:
    """The vocabulary's table of pieces by id, added tokens included (from the file alone)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    pieces = {i: piece for piece, i in data["model"]["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    return [pieces.get(i, "") for i in range(max(pieces) + 1)]


class WordEncoder:
    """Encodes words to ids with a vocabulary file; keeps what it has encoded."""

    def __init__(self, path: str):
        self.path = path
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded when first needed: splitting plain texts does without it."""
        return load_tokenizer(self.path)

    @cached_property
    def special(self) -> dict[str, int]:
        return {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    @cached_property
    def _specials(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @cached_property
    def _letters(self) -> dict[int, str]:
        return _byte_letters()

    def split(self, text: str) -> list[str]:
        if "<|" not in text and _SAFE.fullmatch(text):
            return _WORDS.findall(text.lower())
        words: list[str] = []
        for part in self._specials.split(text):
            if part in self.special:
                words.append(part)
            elif part:
                clean = self.tokenizer.normalizer.normalize_str(part)
                words += [clean[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
        return words

    def encode_words(self, words: list[str], dtype: str = "<u4") -> list[bytes]:
        """Ids of each word as packed little-endian integers, straight from the model's merges."""
        out, width, letters, merge = [], np.dtype(dtype).itemsize, self._letters, self.tokenizer.model.tokenize
        for w in words:
            if w in self.special:
                out.append(self.special[w].to_bytes(width, "little"))
            else:
                spelled = w if w.isascii() and w.isprintable() and " " not in w else "".join([letters[b] for b in w.encode("utf-8")])
                out.append(b"".join([t.id.to_bytes(width, "little") for t in merge(spelled)]))
        return out

    def encode_texts(self, texts: list[str | None], dtype: str = "<u4") -> list[bytes]:
        """Ids of each text as packed little-endian integers; each new distinct word is encoded once."""
        out: list[bytes] = []
        begin, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= SLICE or i == len(texts) - 1:
                out += self._encode_slice(texts[begin : i + 1], dtype)
                begin, held = i + 1, 0
        return out

    def _encode_slice(self, texts: list[str | None], dtype: str) -> list[bytes]:
        split = [self.split(t or "") for t in texts]
        new = list(set().union(*split).difference(self.cache)) if split else []
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(set().union(*split))
        self.cache.update(zip(new, self.encode_words(new, dtype), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]
