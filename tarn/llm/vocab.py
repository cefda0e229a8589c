"""A byte-level BPE vocabulary with word ends, read from a public tokenizer file.

Each symbol is one character: a byte by the byte-level alphabet or, as the last
of a word, the same byte marked by an offset into the private-use area. Tokens
are strings of symbols, so prefixes and suffixes are plain slices.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import regex

END = 0xE000
#: Characters that str.split() takes for white space and the tokenizer does not.
ODD_SPACES = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """ids of tokens, how each is merged, and the pieces that a word falls into."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix):
                body = token[: -len(suffix)]
                return body[:-1] + chr(END + ord(body[-1]))
            return token

        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        size = max(self.names) + 1
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        for r, (a, b) in enumerate(model["merges"]):
            x, y = symbols(a), symbols(b)
            pair, new = (self.ids[x], self.ids[y]), self.ids[x + y]
            self.rank[pair], self.merged[pair] = r, new
            if self.made[new] < 0:
                self.left[new], self.right[new], self.made[new] = *pair, r
        #: Tokens that merging their own symbols gives back; no other can occur.
        self.proper = {s: i for s, i in self.ids.items() if self.merge(s) == [i]}
        self.longest = max(map(len, self.proper))

    def symbol(self, code: int) -> str:
        """The symbol of a byte or, from 256 on, of a byte that ends a word."""
        return self.alphabet[code] if code < 256 else chr(END + ord(self.alphabet[code - 256]))

    def merge(self, symbols: str) -> list[int]:
        """Exact merging: the lowest-ranked pair first, the leftmost of equals first."""
        parts = [self.ids[s] for s in symbols]
        rank, none = self.rank, 1 << 60
        while len(parts) > 1:
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [self.merged[parts[at], parts[at + 1]]]
        return parts

    def pieces(self, word: str) -> list[str]:
        """The lower-case pieces of a chunk without white space or special tokens."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        word = word.lower()
        return [word] if word.isalpha() else self.piece.findall(word)

    def parts(self, chunk: str) -> list[tuple[str, int]]:
        """A chunk without white space as (piece, -1) and, for special tokens, ("", id)."""
        if "<|" not in chunk:
            return [(p, -1) for p in self.pieces(chunk)]
        out: list[tuple[str, int]] = []
        for part in self.special_split.split(chunk):
            out += [("", self.special[part])] if part in self.special else [(p, -1) for p in self.pieces(part)]
        return out


def chunks(text: str | None) -> list[str]:
    """The runs of a text without white space. No piece or special token spans two of them."""
    if not text:
        return []
    return text.split() if not ODD_SPACES.search(text) else [w for w in WHITE.split(text) if w]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once for each worker."""
    return Vocabulary(path)
