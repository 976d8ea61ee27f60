"""Pre-tokenization shared by the token operators: special strings, normalization, words, bounded word caches."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import regex

#: Entries that one worker keeps; beyond it the cache starts anew.  It only saves work and never changes a result.
CACHE_WORDS = 600_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def resolved(vocab: str) -> str:
    """A vocabulary file by its name in public_tokenizers, or an absolute path as it is."""
    return vocab if vocab.startswith("/") else vocabulary_path(vocab)


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file: ids, merge ranks, special strings, and how it splits text into words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        self.table = {b: s for b, s in enumerate(self.symbols)}
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        split = json.dumps(spec["pre_tokenizer"])
        # Fixed patterns of the two public vocabularies (stated in their files or by their byte-level pre-tokenizer).
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if "Split" in split
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        # The same patterns for texts below U+0250, with their classes written out; they take half the time.
        letter, number, space = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t\n\v\f\r \x85\xa0"
        self.latin = re.compile(
            rf"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+" if "Split" in split
            else rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.beyond = re.compile("[^\x00-ɏ]")
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is not treated apart)."""
        if not self.lowers:
            return text
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.pattern if self.beyond.search(text) else self.latin).findall(text)

    def words(self, text: str) -> list[str]:
        """The words of a whole text in order; a special string is a word of its own, kept as it is."""
        if "<|" not in text:
            return self.split(text)
        out: list[str] = []
        for i, piece in enumerate(self.special_pattern.split(text)):
            if i % 2:
                out.append("\0" + piece)  # no word holds NUL beside other characters of a special string
            elif piece:
                out += self.split(piece)
        return out

    def is_special(self, word: str) -> bool:
        return word[0] == "\0" and word[1:] in self.special

    def spelled(self, word: str) -> str:
        """The word in byte symbols."""
        return word.encode("utf-8").decode("latin-1").translate(self.table)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordCache:
    """word -> value; fill computes the values of new words in one call."""

    def __init__(self, fill: Callable[[list[str]], Iterable]) -> None:
        self.fill, self.known = fill, {}

    def ready(self, lists: list[list[str]]) -> dict:
        new = set().union(*lists) - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS and self.known:
            self.known = {}
            new = set().union(*lists)
        if new:
            new = list(new)
            self.known.update(zip(new, self.fill(new), strict=True))
        return self.known
