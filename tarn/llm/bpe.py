"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge only what fails.

For the distinct words of a batch, greedy longest match proposes tokens; a
vectorised test asks of every adjacent pair whether merging could have left it
apart; a word all of whose pairs pass is encoded, as pairwise compatible tokens
are the one result of merging. Only the other words are merged exactly.

Words are remembered up to CACHE_WORDS in each task, then forgotten: memory is
bounded at any vocabulary of the corpus. No shuffle; each row stands for itself.

Defined results: null counts as the empty text, which has no tokens; special
strings inside a text give their special ids; repeated rows are encoded alike;
input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.common import map_texts
from tarn.llm.vocab import Vocabulary, chunks, vocabulary

CACHE_WORDS = 300_000
FIELDS = {"n_tokens": "bigint", "ids": "array<bigint>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


class Table:
    """Whole numbers by key pairs: open addressing, looked up for whole arrays."""

    def __init__(self, entries: dict[tuple[int, int], tuple[int, ...]], width: int):
        self.bits = max(8, (4 * len(entries)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full((width, size + 1), -1, dtype=np.int64)
        keys = np.array([a << 20 | b for a, b in entries], dtype=np.int64)
        values = np.array(list(entries.values()), dtype=np.int64).reshape(-1, width)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):  # a free slot takes the first that asks for it, the others move on
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at[won]], self.values[:, at[won]] = keys[won], values[won].T
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair's values stand; the last place, which holds -1, for unknown pairs."""
        keys = a << 20 | b
        at = self.slot(keys)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen[open_] = self.keys[at[open_]]
            open_ = open_[(seen[open_] != keys[open_]) & (seen[open_] != -1)]
        at[seen != keys] = -1
        return at


NEVER = 1 << 59


class Tokens:
    """The vectorised parts: greedy proposals, the test of pairs, exact merging."""

    def __init__(self, vocab: Vocabulary):
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in (vocab.left, vocab.right, vocab.made))
        self.base = np.array([vocab.ids[vocab.symbol(c)] for c in range(512)], dtype=np.int64)
        self.pairs = Table({p: (r, vocab.merged[p]) for p, r in vocab.rank.items()}, 2)
        self.ranks = self.pairs.values[0].copy()
        self.ranks[self.ranks < 0] = NEVER
        code = {vocab.symbol(c): c for c in range(512)}
        edges, accept, nodes = {}, [-1], {"": 0}
        for token, i in vocab.proper.items():
            at = 0
            for k in range(1, len(token) + 1):
                child = nodes.get(token[:k])
                if child is None:
                    child = nodes[token[:k]] = len(accept)
                    accept.append(-1)
                    edges[at, code[token[k - 1]]] = (child,)
                at = child
            accept[at] = i
        self.trie, self.accept = Table(edges, 1), np.array(accept, dtype=np.int64)

    def propose(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens in order, and the word of each."""
        begin = np.concatenate([[0], ends[:-1]])
        at, node = begin.copy(), np.zeros(len(ends), dtype=np.int64)
        token, token_end = node.copy(), node.copy()
        live, out_word, out_token = np.arange(len(ends)), [], []
        while len(live):
            place = at[live]
            inside = place < ends[live]
            child = self.trie.values[0, self.trie.find(node[live], codes[np.minimum(place, len(codes) - 1)])]
            go = inside & (child >= 0)
            on = live[go]
            node[on], at[on] = child[go], place[go] + 1
            found = self.accept[child[go]]
            hit = found >= 0
            token[on[hit]], token_end[on[hit]] = found[hit], at[on[hit]]
            stop = live[~go]
            out_word.append(stop)
            out_token.append(token[stop])
            at[stop], node[stop] = token_end[stop], 0
            go |= at[live] < ends[live]
            live = live[go]
        words, tokens = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(words, kind="stable")
        return tokens[order], words[order]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether adjacent tokens stay apart when their joint symbols are merged.

        Undoes the later of the two tokens' merges again and again. Two tokens that
        face each other would merge if their rank comes before either is swallowed
        by its own side; of equal ranks the left one is first.
        """
        ok = np.ones(len(a), dtype=bool)
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks[self.pairs.find(x, y)]
            joins = (rank < until_a[live]) & ((rank < until_b[live]) | (rank == until_b[live]) & (rank < NEVER))
            ok[live[joins]] = False
            more = ~joins & ((self.made[x] >= 0) | (self.made[y] >= 0))
            live = live[more]
            x, y = x[more], y[more]
            undo_left = self.made[x] > self.made[y]
            one, two = live[undo_left], live[~undo_left]
            until_a[one], a[one] = self.made[x[undo_left]], self.right[x[undo_left]]
            until_b[two], b[two] = self.made[y[~undo_left]], self.left[y[~undo_left]]
        return ok

    def merge(self, codes: np.ndarray) -> np.ndarray:
        """Exact merging of rows of codes, closed by -1: the lowest rank first, the leftmost of equals first."""
        n, wide = codes.shape
        tokens = np.where(codes >= 0, self.base[codes], -1)
        if wide < 2:
            return tokens
        done = tokens.copy()
        rows, cols = np.arange(n), np.arange(wide)

        def ranks_of(x, y):
            at = self.pairs.find(np.maximum(x, 0), np.maximum(y, 0))
            at[(x < 0) | (y < 0)] = -1
            return self.ranks[at], self.pairs.values[1, at]

        rank, new = ranks_of(tokens[:, :-1].ravel(), tokens[:, 1:].ravel())
        rank, new = rank.reshape(n, -1), new.reshape(n, -1)
        while len(rows):
            best = rank.argmin(axis=1)
            own = np.arange(len(rows))
            live = rank[own, best] < NEVER
            if not live.all():
                done[rows[~live]] = tokens[~live]
                rows, tokens, rank, new, best = rows[live], tokens[live], rank[live], new[live], best[live]
                own = np.arange(len(rows))
                if not len(rows):
                    break
            tokens[own, best] = new[own, best]
            shift = np.minimum(cols + (cols > best[:, None]), wide - 1)
            tokens = np.take_along_axis(tokens, shift, axis=1)
            tokens[:, -1] = -1
            shift = np.minimum(cols[:-1] + (cols[:-1] >= best[:, None]), wide - 2)
            rank, new = np.take_along_axis(rank, shift, axis=1), np.take_along_axis(new, shift, axis=1)
            rank[:, -1] = NEVER
            for at in (best - 1, best):  # the two pairs that the new token is part of
                some = np.flatnonzero((at >= 0) & (at < wide - 1))
                where = at[some]
                rank[some, where], new[some, where] = ranks_of(tokens[some, where], tokens[some, where + 1])
        return done


class Encoder:
    """Encodes chunks of text; keeps the ids and the decoded text of words it has met."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.tokens = Tokens(self.vocab)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.known_pieces: dict[str, bytes] = {}
        self.names = {i: t.encode() for i, t in self.vocab.names.items()}
        self.tried = self.failed = 0

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([len(r) for r in raw])
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        codes[ends - 1] += 256
        flat, owner = self.tokens.propose(codes, ends)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        good = self.tokens.apart(pairs >> 20, pairs & 0xFFFFF)[back] if len(pairs) else np.ones(0, dtype=bool)
        wrong = np.unique(owner[inner[~good]])
        self.tried, self.failed = self.tried + len(pieces), self.failed + len(wrong)
        data, stops = flat.astype("<u4").tobytes(), np.searchsorted(owner, np.arange(len(pieces) + 1)) * 4
        out = [data[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        if len(wrong):
            begin = np.concatenate([[0], ends[:-1]])
            size = ends - begin
            wrong = wrong[np.argsort(size[wrong], kind="stable")]
            at = 0
            while at < len(wrong):  # words of like length together, in blocks of a bounded area
                rows = max(1, min(4096, (1 << 18) // int(size[wrong[at]])))
                some = wrong[at : at + rows]
                some = some[size[some] <= 2 * size[some[0]] + 2]
                at += len(some)
                wide = int(size[some].max())
                cols = np.arange(wide)
                there = cols < size[some][:, None]
                block = np.where(there, codes[np.minimum(begin[some][:, None] + cols, len(codes) - 1)], -1)
                for i, row in zip(some.tolist(), self.tokens.merge(block).astype("<u4"), strict=True):
                    out[i] = row[row != 0xFFFFFFFF].tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        parts = {w: self.vocab.parts(w) for w in words}
        if missing := list({p for ps in parts.values() for p, _ in ps if p}.difference(self.known_pieces)):
            self.known_pieces |= zip(missing, self.encode_pieces(missing), strict=True)
        for w, ps in parts.items():
            own = b"".join([self.known_pieces[p] if p else special.to_bytes(4, "little") for p, special in ps])
            self.known[w] = (own, decode(memoryview(own).cast("I"), self.names))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text, its ids as little-endian 32-bit integers and its decoded text in UTF-8."""
        words = [chunks(t) for t in texts]
        distinct = set().union(*words)
        if missing := distinct.difference(self.known):
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known.clear()
                self.known_pieces.clear()
                missing = distinct
            self.learn(missing)
        out = []
        for own in words:
            found = [self.known[w] for w in own]
            out.append((b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[0]])))
        return out


def decode(ids, names: dict[int, bytes]) -> bytes:
    """The tokens' names joined by blanks, as a tokenizer without a decoder gives them."""
    return b" ".join([names[i] for i in ids])


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), text: str = "text") -> DataFrame:
    """docs without the text but with the outputs, of FIELDS, for each whole text."""

    def make():
        encoder = Encoder(path)
        of = {
            "n_tokens": lambda ids, said: len(ids) // 4,
            "ids": lambda ids, said: np.frombuffer(ids, dtype="<u4").astype(np.int64),
            "decoded": lambda ids, said: said.decode(),
            "ids_sha256": lambda ids, said: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda ids, said: hashlib.sha256(said).hexdigest(),
        }

        def run(texts):
            found = encoder.encode(texts)
            return {name: [of[name](*x) for x in found] for name in outputs}

        return run

    return map_texts(docs, make, {n: FIELDS[n] for n in outputs}, text)


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df without ids but with decoded; null ids decode to the empty text."""

    def make():
        names = {i: t.encode() for i, t in vocabulary(path).names.items()}
        return lambda lists: {"decoded": [decode(x or [], names).decode() for x in lists]}

    return map_texts(df, make, {"decoded": "string"}, ids)
