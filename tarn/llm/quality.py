"""Quality rules: counts over whole texts, then divergence from language references.

Native DataFrame expressions only, no shuffle and one pass: features() counts inside
each row, verdict() compares the character-class and common-word histograms of each
document with its language's reference by Jensen-Shannon distance. The bound on the
word distance follows from each reference: it lies below the distance of a text that
holds none of the common words.

The references are fixed values, so a corpus full of junk does not move them;
references() fits others on documents that are known to be good.

Defined results: a null text counts as empty; empty and short texts fail the
base rules; a null or empty language is held against the nearest reference, and a
language without a reference is judged by the base rules alone; texts under the
length guards are not judged by distance; repeated rows are judged alike, each on
its own. Input columns that share a name with an output column, in whatever case,
are replaced by it; no other input column is touched, whatever its name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SPACES, let, packed, unpacked

# Frequent function words of each supported language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in that is was for it with as his on be at by this are or".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au elle".split(),
}
# Mean shares of the documents labelled good at scale factor 0.1, 3,409 rows. First upper case, digits, white
# space, symbols, punctuation and all else among the characters; then the common words, in order, and all else among the words.
REFERENCES = {
    "de": (
        [0.0132, 0.0008, 0.1546, 0.0, 0.0221, 0.8094],
        [0.0497, 0.0259, 0.0207, 0.0156, 0.0136, 0.0105, 0.009, 0.0086, 0.0074, 0.0069, 0.0058, 0.006, 0.0044, 0.0045, 0.0042, 0.0036, 0.0042, 0.0043, 0.0033, 0.0001, 0.7917],
    ),
    "en": (
        [0.0144, 0.0009, 0.1664, 0.0, 0.0243, 0.794],
        [0.0501, 0.0261, 0.0217, 0.0158, 0.0108, 0.0083, 0.0097, 0.0063, 0.0072, 0.0073, 0.0052, 0.0049, 0.0, 0.0061, 0.0045, 0.0038, 0.0044, 0.0039, 0.0041, 0.0022, 0.7977],
    ),
    "es": (
        [0.0143, 0.0009, 0.1615, 0.0, 0.0237, 0.7995],
        [0.0515, 0.0252, 0.0205, 0.0147, 0.0132, 0.0103, 0.0, 0.0093, 0.0079, 0.0067, 0.0076, 0.006, 0.0063, 0.0052, 0.0047, 0.0046, 0.0042, 0.0045, 0.0038, 0.004, 0.7897],
    ),
    "fr": (
        [0.0146, 0.0019, 0.1663, 0.0, 0.0244, 0.7929],
        [0.0502, 0.0267, 0.0199, 0.015, 0.0123, 0.0117, 0.01, 0.0087, 0.0073, 0.0064, 0.006, 0.0058, 0.0057, 0.0046, 0.0047, 0.004, 0.0, 0.0039, 0.0041, 0.0019, 0.7914],
    ),
}
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"-()"
GRAM = 5


@dataclass(frozen=True)
class QualityParams:
    """min_words and max_repeat_percent are the base rules; the rest is the divergence verdict.

    max_word_share is a share of the word distance that a text without common words has.
    references has a language's character and word shares, the words those of common_words.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    guard_chars: int = 200
    guard_words: int = 60
    max_char_distance: float = 0.31
    max_word_share: float = 0.85
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)
    references: dict = field(default_factory=lambda: REFERENCES)


def _count(text: Column, chars: str) -> Column:
    """Occurrences of the one-byte characters in chars."""
    each = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in chars]
    return reduce(lambda a, b: a + b, each)


def _words(text: Column) -> Column:
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES.strip(" "), text)
    return F.array_remove(F.split(spaced, " "), "")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""

    def spread(pos):  # starts, ascending: each covers 5 words, less where the next begins sooner
        last = F.size(pos) - 1
        each = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.least(F.lit(GRAM), F.coalesce(F.get(pos, k + 1) - F.get(pos, k), F.lit(GRAM))),
        )
        return F.when(last < 0, F.lit(0)).otherwise(F.aggregate(each, F.lit(0), lambda a, x: a + x))

    def starts(pairs):
        same = lambda k, j: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, j)["h"], F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(found, lambda k: F.get(pairs, k)["i"]))

    def repeated(grams):
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(let(pairs, starts), spread)
        )

    hashes = F.transform(
        F.slice(words, 1, F.size(words) - GRAM + 1),
        lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, GRAM)]),
    )
    return F.when(F.size(words) < GRAM, F.lit(0)).otherwise(let(hashes, repeated))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _shares(counts: Column) -> Column:
    """Counts as shares of their sum; null for an empty histogram."""
    return let(counts, lambda a: F.when(_total(a) > 0, F.transform(a, lambda x: x / _total(a))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two share arrays of one length."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda x, y: x + y))), 6)


def wordless_distance(shares: list[float]) -> float:
    """js_distance of a text without common words from a reference's word shares, the last of them for all other words."""
    rest = shares[-1]
    common = sum(shares) - rest
    return sqrt(max(0.0, (log2(2 / (1 + rest)) + common + (rest * log2(2 * rest / (1 + rest)) if rest else 0.0)) / 2))


def features(docs: DataFrame, keep: list[str], params: QualityParams = QualityParams(), text: str = "text", lang: str = "lang") -> DataFrame:
    """row (the columns in keep), the counts, and two histograms: hist_chars and, for each language, hist_<lang>.

    hist_chars: upper case, digits, white space, symbols, punctuation, all else.
    hist_<lang>: the language's common words, then all other words; null where
    the document is marked as another language.
    """
    every = sorted({w for ws in params.common_words.values() for w in ws})
    t = F.col("_t")
    df = docs.select(packed(docs.select(*[F.col(f"`{x}`") for x in keep])), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.nullif(F.col(lang), F.lit("")).alias("_lang"))
    df = df.withColumn("_words", _words(t))
    w = F.col("_words")
    padded = F.concat(F.lit("  "), F.array_join(F.filter(w, lambda x: x.isin(*every)), "  "), F.lit("  "))
    # Without lower-case letters and blanks little is left to count in.
    df = df.withColumns({"_rest": F.regexp_replace(t, r"[\p{Ll} ]+", ""), "_n": F.length(t), "word_chars": F.length(F.array_join(w, "")).cast("long")})
    rest, n = F.col("_rest"), F.col("_n")
    df = df.withColumns({"n_symbols": _count(rest, SYMBOLS).cast("long"), "_spaces": n - F.col("word_chars").cast("int")})
    df = df.select(
        "row",
        "_lang",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        _dup_lines(t).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        "_n",
        F.array(F.length(F.regexp_replace(rest, r"\P{Lu}+", "")), _count(rest, "0123456789"), F.col("_spaces"), F.col("n_symbols").cast("int"), _count(rest, PUNCTUATION)).alias("_c"),
        padded.alias("_found"),
    )
    found = F.col("_found")
    hists = {}
    for name, common in params.common_words.items():
        each = [((F.octet_length(found) - F.octet_length(F.replace(found, F.lit(f" {x} ")))) / F.lit(len(x.encode()) + 2)).cast("int") for x in common]
        counts = let(F.array(*each), lambda a: F.concat(a, F.array(F.col("n_words").cast("int") - _total(a))))
        hists[f"hist_{name}"] = F.when(F.coalesce(F.col("_lang") == name, F.lit(True)), counts)
    df = df.withColumns({"hist_chars": F.concat(F.col("_c"), F.array(F.col("_n") - _total(F.col("_c")))), **hists})
    return df.drop("_c", "_found")


def references(found: DataFrame, params: QualityParams = QualityParams()) -> dict:
    """{lang: (character shares, word shares)}: means over every document above the length guards, to replace REFERENCES.

    found: of features(). One row for each language of params reaches the driver.
    """
    # Not a filter, which would be pushed below the counts and have them evaluated twice.
    guard = (F.col("n_words") >= params.guard_words) & (F.col("_n") >= params.guard_chars)
    out = {}
    wide = {x: len(ws) + 1 for x, ws in params.common_words.items()}
    own = F.coalesce(*[F.col(f"hist_{x}") for x in wide])
    shares = found.where(F.col("_lang").isin(*wide)).select("_lang", F.when(guard, _shares(F.col("hist_chars"))).alias("c"), F.when(guard, _shares(own)).alias("w"))
    means = [F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(6)] + [F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(max(wide.values()))]
    for row in shares.groupBy("_lang").agg(*means).collect():
        name = row["_lang"]
        if row["c0"] is None:  # no document above the guards
            continue
        out[name] = ([round(row[f"c{i}"], 6) for i in range(6)], [round(row[f"w{i}"], 6) for i in range(wide[name])])
    return out


def verdict(found: DataFrame, refs: dict, params: QualityParams = QualityParams()) -> DataFrame:
    """found with char_distance, word_distance, base_failed and kept, without the histograms."""
    n, known = F.col("n_words"), [x for x in params.common_words if x in refs]

    def literal(shares) -> Column:
        return F.array(*[F.lit(float(x)) for x in shares])

    def nearest(distance, most) -> Column:
        """The distance d from the nearest reference, and the most that it allows."""

        def measured(x) -> Column:
            return let(distance(x), lambda d: F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(most(x)).alias("most"))))

        none = F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("most"))
        each = {x: measured(x) for x in known}
        if not each:
            return F.lit(None).cast("struct<d:double,most:double>")
        own = reduce(lambda c, x: c.when(F.col("_lang") == x, each[x]), known[1:], F.when(F.col("_lang") == known[0], each[known[0]]))
        return own.when(F.col("_lang").isNull(), F.least(*each.values(), none, none))

    def most_words(x) -> float:
        # A reference without common words says nothing about them.
        return params.max_word_share * wordless_distance(refs[x][1]) or 1.0

    char_d = let(_shares(F.col("hist_chars")), lambda c: nearest(lambda x: js_distance(c, literal(refs[x][0])), lambda x: params.max_char_distance))
    word_d = nearest(lambda x: js_distance(_shares(F.col(f"hist_{x}")), literal(refs[x][1])), most_words)
    out = found.withColumns(
        {
            "_char": F.when(F.col("_n") >= params.guard_chars, char_d),
            "_word": F.when(n >= params.guard_words, word_d),
            "base_failed": (n < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * n),
        }
    )
    far = [F.coalesce(F.col(c)["d"] > F.col(c)["most"], F.lit(False)) for c in ("_char", "_word")]
    kept = ~F.col("base_failed") & ~far[0] & ~far[1]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = {c: F.col(c) for c in counts} | {"char_distance": F.col("_char")["d"], "word_distance": F.col("_word")["d"], "base_failed": F.col("base_failed"), "kept": kept}
    return unpacked(out, made)


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all, if not given) with counts, distances, base_failed and kept."""
    return verdict(features(docs, docs.columns if keep is None else keep, params, text, lang), params.references, params)


def kept_rows(judged: DataFrame) -> DataFrame:
    """The kept rows of quality_rules().

    A filter on the verdict would be pushed below the counts, which would then be
    spelled out, and evaluated, again and again inside it; row numbers hold it back.
    """
    names = judged.columns
    return judged.select(F.struct("*").alias("judged"), F.monotonically_increasing_id().alias("at")).where("judged.kept AND at >= 0").select(*[F.col("judged").getField(c).alias(c) for c in names])
