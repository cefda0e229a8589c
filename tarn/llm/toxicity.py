"""Toxicity by weak supervision.

Voters look at different evidence: a fixed seed list; words, and word beginnings of
several lengths, mined from a bounded sample of labelled rows; how many such entries
there are, how often, how densely and over how many lines; whether somebody is
addressed beside one; and patterns that need no list: masked words, symbols or digits
inside words, shouting, exclamations, stretched letters. A generative label model
explains all documents' votes by one hidden class: given the class balance, the
off-diagonal covariances of the votes are a product of the voters' strengths, solved
by medians over triplets of voters whose covariance is beyond chance; what they leave
over estimates the correlations of voters given the class, and correlated voters share
their weight. Its posterior labels the sample, and a linear classifier learned from
them scores every whole text.

The vote moments cover all documents: one small matrix for each task. Labels are
read only from rows of the training folds, SAMPLE of them at most, taken by a
hash of their id, one row for each id; the sample has that bound at every size of
the input. Its distinct evidence, a few numbers a row, is all that is gathered.

Defined results: null and empty texts get the score of a document without votes;
rows with null labels or ids teach nothing; of an id's labels the largest counts, and
of its texts the one with the least hash; repeated rows are scored alike; with no
usable labels the seed list and the patterns alone vote; input columns named like an
output, in whatever case, are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, map_texts

#: Labelled rows that are read at most.
SAMPLE = 20_000
#: Lexicon entries that are mined at most; the toxic documents that must hold one, the share of those, and the precision at least.
MINED, LEAST_DOCS, LEAST_SHARE, LEAST_PRECISION = 256, 5, 0.005, 0.9
STARTS = (4, 5, 6, 7, 8)
#: Words that a worker remembers, if one text holds no more.
KNOWN_WORDS = 300_000
FOLDS = 5

# The seed lexicon, plain insults.
SEED = "bastard bitch clown creep cretin dimwit disgusting dumb dumbass filth fool freak garbage idiot idiots imbecile jerk loser losers lowlife moron morons pathetic pig psycho scum stupid trash ugly vermin worthless".split()

EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_~`/\\"
# Words that address somebody, in the supported languages.
ADDRESS = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton vous votre eres usted tú ti vosotros".split())

MASKED = regex.compile(r"\p{L}\*{2,}\p{L}")
INSIDE = re.compile(r"[^\W\d_][0134578@#$*]+[^\W\d_]")
STRETCHED = re.compile(r"([a-z])\1\1\1")
VOTERS = ("seed", "mined word", *(f"mined beginning of {k}" for k in STARTS), "several entries", "three occurrences", "dense", "several lines", "address", "masked", "inside a word", "shouting", "exclamations", "stretched")
#: The last of the voters are patterns, which need no list.
PATTERNS = 5


def fold(doc_id: Column) -> Column:
    """0 for held-out rows, 1 to 4 for those that may teach; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Lexicon:
    """Entries are whole words, or word beginnings marked by a closing hyphen; the first `seeds` of them are the seed list."""

    def __init__(self, entries: list[str], seeds: int = len(SEED)):
        self.entries = entries
        self.number = {e: i for i, e in enumerate(entries)}
        kinds = {k: 2 + i for i, k in enumerate(STARTS)}
        #: The voter that an entry counts for.
        self.kind = np.array([0 if i < seeds else kinds[len(e) - 1] if e.endswith("-") else 1 for i, e in enumerate(entries)], dtype=np.int64)
        #: Entries by their words and by their beginnings, and the first letters of all.
        self.words = {e: i for e, i in self.number.items() if not e.endswith("-")}
        self.begins = {e[:-1]: i for e, i in self.number.items() if e.endswith("-")}
        self.heads = {e[: STARTS[0]] for e in (*self.words, *self.begins)}
        #: Of each word that was met: its entries and patterns, or None for a plain one.
        self.known: dict[str, tuple[tuple[int, ...], tuple[bool, ...]] | None] = {}

    @property
    def width(self) -> int:
        """The classifier's inputs: votes, any hit, log hits, log share, entries."""
        return len(VOTERS) + 3 + len(self.entries)

    def of(self, word: str) -> tuple[tuple[int, ...], tuple[bool, ...]] | None:
        """A word's entries, and which of the patterns it shows: masked, inside a word, shouting, exclamations, stretched."""
        w = word.lower().strip(EDGES)
        found: tuple[int, ...] = ()
        if w[: STARTS[0]] in self.heads:
            begins = [self.begins.get(w[:k]) for k in STARTS if len(w) > k]
            found = tuple(i for i in (self.words.get(w), *begins) if i is not None)
        stretched = bool(STRETCHED.search(word))
        if word.isalpha():
            patterns = (False, False, word.isupper(), False, stretched)
        else:
            patterns = (bool(MASKED.match(word)), bool(INSIDE.search(word)), word.isupper(), "!!" in word or "!?" in word, stretched)
        return (found, patterns) if found or any(patterns) else None

    def evidence(self, text: str | None) -> np.ndarray:
        """Words that hold an entry, lines that do (2 at most), all words (0 without a hit), address, the patterns; then the entries found."""
        text = text or ""
        words, known = text.split(), self.known
        if new := set(words).difference(known):
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.of(w)
        odd = [(i, k) for i, k in enumerate(map(known.__getitem__, words)) if k]
        hits = [i for i, (found, _) in odd if found]
        found = sorted({e for _, (own, _) in odd for e in own})
        lines = address = 0
        if hits:
            near = {w.lower().strip(EDGES) for i in hits for w in words[max(0, i - 3) : i + 4]}
            address = int(not ADDRESS.isdisjoint(near))
            held = {words[i] for i in hits}
            for line in text.split("\n"):
                lines += not held.isdisjoint(line.split())
                if lines == 2:
                    break
        shown = [sum(p[j] for _, (_, p) in odd) for j in range(PATTERNS)]
        shown[2] = 10 * shown[2] > 3 * len(words)
        return np.array([len(hits), lines, len(words) if hits else 0, address, *map(bool, shown), *found], dtype=np.int32)

    def votes(self, evidence: np.ndarray) -> np.ndarray:
        holding, lines, n, address = evidence[:4].tolist()
        found = evidence[4 + PATTERNS :]
        out = np.zeros(len(VOTERS))
        out[self.kind[found]] = 1
        out[2 + len(STARTS) :] = [len(found) >= 2, holding >= 3, 100 * holding > n, lines >= 2, address, *evidence[4 : 4 + PATTERNS]]
        return out

    def features(self, evidence: np.ndarray) -> np.ndarray:
        holding, n = int(evidence[0]), int(evidence[2])
        own = np.zeros(len(self.entries))
        own[evidence[4 + PATTERNS :]] = 1
        return np.concatenate([self.votes(evidence), [holding > 0, np.log1p(holding), np.log1p(1000 * holding / max(1, n))], own])


def forms(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:k] + "-" for k in STARTS if len(word) > k]] if word else []


@dataclass
class LabelModel:
    """P(y), and P(vote | y) of each voter, with the weight that its correlations leave it."""

    balance: float
    if_toxic: np.ndarray
    if_clean: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    @classmethod
    def fit(cls, n: float, sums: np.ndarray, products: np.ndarray, balance: float) -> LabelModel:
        """From the number of documents, the votes' sums and the sums of their products."""
        mean = sums / max(n, 1)
        cov = products / max(n, 1) - np.outer(mean, mean)
        m, strength = len(mean), np.zeros(len(mean))
        # Voters that agree more often than chance would have it.
        chance = 4 * np.sqrt(np.outer(np.diag(cov), np.diag(cov)).clip(1e-18) / max(n, 1))
        agree = cov > chance
        for i in range(m):
            found = [np.sqrt(cov[i, j] * cov[i, k] / cov[j, k]) for j in range(m) for k in range(j + 1, m) if i not in (j, k) and agree[j, k] and agree[i, j] and agree[i, k]]
            if found:
                strength[i] = np.median(found)
        spread = np.sqrt(balance * (1 - balance))
        gap = np.clip(strength / spread, 0, None)
        if_toxic, if_clean = (np.clip(x, 1e-4, 1 - 1e-4) for x in (mean + (1 - balance) * gap, mean - balance * gap))
        rest = cov - np.outer(strength, strength)
        sd = np.sqrt(np.clip(balance * if_toxic * (1 - if_toxic) + (1 - balance) * if_clean * (1 - if_clean), 1e-9, None))
        correlation = np.clip(rest / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(correlation, 0)
        strong = np.where(correlation > 0.1, correlation, 0)
        return cls(balance, if_toxic, if_clean, 1 / (1 + strong.sum(axis=1)), correlation)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) for rows of votes. A voter that finds nothing abstains."""
        yes = np.log(self.if_toxic / self.if_clean)
        odds = np.log(self.balance / (1 - self.balance)) + (votes * yes) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_linear(blocks: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], width: int, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last of them the bias, of a logistic model.

    blocks() gives the rows in bounded blocks: inputs, soft labels and how often each row occurs.
    """
    w, penalty = np.zeros(width + 1), np.full(width + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.diag(penalty), -penalty * w
        for x, y, times in blocks():
            x = np.hstack([x, np.ones((len(x), 1))])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve += (x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x
            slope += x.T @ (times * (y - p))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """text and toxic of SAMPLE labelled rows of the training folds at most, one for each id."""
    taught = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id")
    return work.table(rows.agg(F.min_by(F.struct("text"), F.xxhash64("text"))["text"].alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "sample")


def mine(sample: DataFrame) -> list[str]:
    """Entries found in toxic documents of the sample and hardly in clean ones."""

    def count(only: set[str] | None):
        def run(batches):
            import pyarrow as pa

            found: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    own = {f for w in set((text or "").split()) for f in forms(w.lower().strip(EDGES))}
                    found.update(own if only is None else own & only)
            yield pa.RecordBatch.from_pydict({"e": list(found), "n": list(found.values())}, schema=pa.schema([("e", pa.string()), ("n", pa.int64())]))

        return run

    schema = "e string, n long"
    least = max(LEAST_DOCS, LEAST_SHARE * sample.where("toxic = 1").count())
    toxic = sample.where("toxic = 1").select("text").mapInArrow(count(None), schema).groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    often = {r["e"]: r["n"] for r in toxic.orderBy(F.desc("n"), "e").limit(100 * MINED).collect()}
    clean = sample.where("toxic = 0").select("text").mapInArrow(count(set(often)), schema).groupBy("e").agg(F.sum("n").alias("n"))
    against = {r["e"]: r["n"] for r in clean.collect()}
    good = [e for e, n in often.items() if n >= LEAST_PRECISION * (n + against.get(e, 0))]
    return good[:MINED]


def vote_moments(docs: DataFrame, entries: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all documents: their number, the sums of votes and of products of votes."""
    m = len(VOTERS) + 1

    def run(batches):
        import pyarrow as pa

        own, total = Lexicon(entries), np.zeros((m, m))
        for batch in batches:
            votes = np.array([[*own.votes(own.evidence(t.as_py())), 1.0] for t in batch.column(0)]).reshape(-1, m)
            total += votes.T @ votes
        flat = total.ravel()
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(flat)), "x": flat}, schema=pa.schema([("at", pa.int32()), ("x", pa.float64())]))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select("text").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(m * m)
    for r in rows:
        total[r["at"]] = r["x"]
    total = total.reshape(m, m)
    return float(total[-1, -1]), total[-1, :-1], total[:-1, :-1]


@dataclass
class Model:
    entries: list[str]
    label_model: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, work: Workspace) -> Model:
    sample = labelled_sample(docs, labels, work)
    entries = list(dict.fromkeys([*SEED, *mine(sample)]))
    n, toxic = sample.agg(F.count("toxic"), F.sum("toxic")).first()
    balance = min(0.5, max(0.01, ((toxic or 0) + 1) / (n + 10)))
    model = LabelModel.fit(*vote_moments(docs, entries), balance)

    def make():
        own = Lexicon(entries)
        return lambda texts: {"x": [own.evidence(t).tobytes() for t in texts]}

    seen = [(bytes(r["x"]), r["n"]) for r in map_texts(sample.select("text"), make, {"x": "binary"}).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()]
    lexicon = Lexicon(entries)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(seen), 500):
            part = seen[at : at + 500]
            x = np.array([lexicon.features(np.frombuffer(e, dtype=np.int32)) for e, _ in part])
            yield x, model.posterior(x[:, : len(VOTERS)]), np.array([times for _, times in part], dtype=float)

    weights = fit_linear(blocks, lexicon.width) if seen else np.concatenate([np.full(lexicon.width, 1.0), [-4.0]])
    return Model(entries, model, weights)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text but with score and predicted."""
    entries, weights = model.entries, model.weights

    def make():
        own = Lexicon(entries)

        def run(texts):
            x = np.array([own.features(own.evidence(t)) for t in texts]).reshape(-1, len(weights) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            return {"score": p.tolist(), "predicted": (p >= 0.5).astype(int).tolist()}

        return run

    return map_texts(docs, make, {"score": "double", "predicted": "int"}, text)
