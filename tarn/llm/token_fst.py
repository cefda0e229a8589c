"""Token counts by a finite-state transducer compiled from the tokenizer.

Inside a word, the state after i symbols is the longest suffix that may still
grow into a token, together with the last token of the encoding before each
place inside it where a token may begin; this fixes every later step, so the
states are finite. They are determinised as they are met. A transition carries the
change of the token count, so that counting a word is a walk with additions and never
builds tokens.

What a chunk of symbols does is a map from the state at its left edge to the state at
its right edge and a count. White space resets the transducer: the map of a block of
text that is cut there is a count alone, whatever stands before it. A word longer than
CHUNK symbols is cut anywhere: each chunk is walked once from the start state, and the
walk from any other state follows only until it falls in with that one, which fixes its
end and count as well. Maps compose associatively, neighbours first, in as many rounds
as a prefix scan has; the chunks' own walks, nearly all of the work, wait for nothing.

Defined results: null counts as the empty text with no bytes and no tokens;
special strings count as their special token; repeated rows are counted alike;
input columns named like an output, in whatever case, are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from tarn.llm.common import map_texts
from tarn.llm.vocab import Vocabulary, chunks, vocabulary

#: Characters of a block of text; symbols of a chunk inside a word, and chunks whose maps are composed at a time.
BLOCK, CHUNK, STRETCH = 1 << 16, 4096, 64
MAX_STATES = 150_000
#: Words whose counts are remembered, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 300_000, 200
EDGE = regex.compile(r"\p{White_Space}")


class Transducer:
    """Deterministic over 512 symbols; arcs[state << 9 | symbol] = next state << 8 | change of the count + 128."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.grows = {t[:k] for t in vocab.proper for k in range(1, len(t))}
        self.symbols = [vocab.symbol(c) for c in range(512)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        # A state: the open suffix; at each of its places where a token may begin, the last
        # token before it (-1 at a word's start) and how much lower the count is there.
        start = ("", ((-1, 0),))
        self.states, self.number, self.arcs = [start], {start: 0}, {}

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the symbols of both leaves the two tokens."""
        if (found := self.pairs.get((a, b))) is None:
            v = self.vocab
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            until_a = until_b = 1 << 59
            x, y, found = a, b, True
            while True:
                rank = v.rank.get((x, y), 1 << 60)
                if rank < until_a and rank <= until_b:
                    found = False
                    break
                if v.made[x] < 0 and v.made[y] < 0:
                    break
                if v.made[x] > v.made[y]:
                    until_a, x = v.made[x], v.right[x]
                else:
                    until_b, y = v.made[y], v.left[y]
            self.pairs[a, b] = found
        return found

    def arc(self, state: int, code: int) -> int:
        """Compiles one transition."""
        suffix, places = self.states[state]
        grown, get, grows = suffix + self.symbols[code], self.vocab.proper.get, self.grows
        for at, place in enumerate(places):  # of the tokens that end here, one fits what stands before it
            if place and (token := get(grown[at:])) is not None and (place[0] < 0 or self.apart(place[0], token)):
                break
        delta = 1 - place[1]
        keep = next((k for k in range(len(grown)) if places[k] and grown[k:] in grows), len(grown))
        left = [(p[0], p[1] + delta) if (p := places[k]) and grown[k:] in grows else None for k in range(keep, len(grown))]
        target = (grown[keep:], (*left, (token, 0)))
        if (n := self.number.get(target)) is None:
            n = self.number[target] = len(self.states)
            self.states.append(target)
        out = self.arcs[state << 9 | code] = n << 8 | delta + 128
        return out

    def step(self, state: int, code: int) -> tuple[int, int]:
        found = self.arcs.get(state << 9 | code) or self.arc(state, code)
        return found >> 8, (found & 255) - 128

    def count(self, piece: str, chunk: int = CHUNK) -> int:
        """Tokens of one piece, whose last byte is the symbol that ends a word."""
        if len(self.states) > MAX_STATES:
            self.clear()
        data = piece.encode()
        if len(data) > chunk:
            return self.count_long(data, chunk)
        state, total, get = 0, 0, self.arcs.get
        for code in data[:-1]:
            found = get(state << 9 | code) or self.arc(state, code)
            state = found >> 8
            total += (found & 255) - 128
        return total + self.step(state, data[-1] + 256)[1]

    def count_long(self, data: bytes, chunk: int) -> int:
        codes = [*data[:-1], data[-1] + 256]
        state, total = self.states[0], 0
        for at in range(0, len(codes), chunk * STRETCH):
            if len(self.states) > MAX_STATES:
                self.clear()
            part = codes[at : at + chunk * STRETCH]
            whole = scan([StateMap(self, part[i : i + chunk]) for i in range(0, len(part), chunk)])
            if (number := self.number.get(state)) is None:  # the states were cleared since
                number = self.number[state] = len(self.states)
                self.states.append(state)
            end, count = whole(number)
            state, total = self.states[end], total + count
        return total


#: A map from states to the state and the count that a chunk makes of them.
Map = Callable[[int], tuple[int, int]]


class StateMap:
    """The map of one chunk, whose walk from the start state is made at once."""

    def __init__(self, transducer: Transducer, codes: list[int]):
        self.transducer, self.codes = transducer, codes
        self.path, self.counts, state, total = [], [], 0, 0
        for code in codes:
            state, change = transducer.step(state, code)
            total += change
            self.path.append(state)
            self.counts.append(total)
        self.known = {0: (state, total)}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            now, total = state, 0
            for i, code in enumerate(self.codes):
                now, change = self.transducer.step(now, code)
                total += change
                if now == self.path[i]:  # from here on both walks are one
                    now, total = self.path[-1], total + self.counts[-1] - self.counts[i]
                    break
            self.known[state] = now, total
        return self.known[state]


def composed(a: Map, b: Map) -> Map:
    def both(state: int) -> tuple[int, int]:
        middle, x = a(state)
        end, y = b(middle)
        return end, x + y

    return both


def scan(maps: list[Map]) -> Map:
    """All maps composed, neighbours first, in as many rounds as the tree is deep."""
    while len(maps) > 1:
        maps = [composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.transducer = Transducer(self.vocab)
        self.known: dict[str, int] = {}
        self.known_pieces: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        if len(piece) > CACHE_LENGTH:
            return self.transducer.count(piece)
        if (n := self.known_pieces.get(piece)) is None:
            n = self.known_pieces[piece] = self.transducer.count(piece)
        return n

    def word(self, word: str) -> int:
        """Tokens of a chunk of text without white space."""
        return sum([self.piece(p) if p else 1 for p, _ in self.vocab.parts(word)])

    def words(self, words: list[str]) -> int:
        total = 0
        if missing := set(words).difference(self.known):
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known.clear()
                self.known_pieces.clear()
                missing = set(words)
            if any(len(w) > CACHE_LENGTH for w in missing):
                total = sum(self.word(w) for w in words if len(w) > CACHE_LENGTH)
                words = [w for w in words if len(w) <= CACHE_LENGTH]
            for w in missing:
                if len(w) <= CACHE_LENGTH:
                    self.known[w] = self.word(w)
        return total + sum(map(self.known.__getitem__, words))

    def count(self, text: str | None, block: int = BLOCK) -> int:
        text, at, total = text or "", 0, 0
        while at < len(text):
            edge = EDGE.search(text, at + block) if at + block < len(text) else None
            end = edge.start() if edge else len(text)
            total += self.words(chunks(text[at:end]))
            at = end
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs without the text but with n_bytes, n_tokens and over_limit of each whole text."""

    def make():
        counter = Counter(path)

        def run(texts):
            n = [counter.count(t) for t in texts]
            return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return run

    return map_texts(docs, make, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, text)
