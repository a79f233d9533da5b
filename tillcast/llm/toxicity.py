"""Toxicity scores on deobfuscated text: a noisy channel over character lattices, then a lexicon score.

A written token is read as a noisy form of a word: letters may be replaced by look-alike digits and signs,
letters repeated, or separated by signs or blanks. Its lattice holds every reading of every character with
a channel cost, and the Viterbi algorithm finds the likeliest path under a four-gram character language
model. A token of plain letters without runs has one path only, itself. The language model is counted over
all documents of the corpus (four-grams of folded letters, a bounded number of cells).

Words of restored text score by a lexicon: words and word beginnings that are far more frequent in texts
labelled toxic, fitted on at most ``docs_per_class`` training texts of each label, drawn by a hash of the
id, whole. A logistic curve on the evidence of a text, fitted on the same texts, gives the score.

Null, empty and wordless texts score as texts without evidence. Texts are read whole; repeated rows have
one result each; labels with null or conflicting values for one id count as given per row. Without labels
of both kinds every text scores 0. Empty tables give empty results; a column called ``score`` is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.tables import held_out, staged, without

CLASSES = 28  # 0: between words, 1-26: a-z without accents, 27: any other letter
# Look-alikes and the letters they stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
REPLACED, DROPPED, SQUEEZED, KEPT_RUN = -1.0, -1.5, -0.6, -0.6  # log channel costs
RUN = re.compile(r"(.)\1\1")
EDGES = "\"'`.,;:?()[]{}<>«»“”„¿…-–—_#%&/\\=~^"
# Signs between blanks of any width; the first and the last may carry punctuation.
SPACED = re.compile(rf"(?<!\S)[{re.escape(EDGES)}]*\S(?:\s+\S){{2,}}[{re.escape(EDGES)}!]*(?!\S)")
PARTS = re.compile(r"[^\W\d_]+")
CACHE = 400_000
MAX_BROADCAST_BYTES = 32 << 20
PREFIXES = (4, 5, 6)


def _fold_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            table[code] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


FOLD = _fold_table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(FOLD), FOLD[np.minimum(codes, len(FOLD) - 1)], 27)


@lru_cache(maxsize=1 << 16)
def _class_of(letter: str) -> int:
    return int(classes_of(letter)[0])


def gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n``: four-grams of letter classes over all texts, each text between blanks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES ** 4, np.int64)
        for frame in frames:
            line, size = [], 0
            for value in frame["text"]:
                if value:
                    line.append(value)
                    size += len(value)
                if size > 1 << 20:
                    total += _grams("   ".join(line))
                    line, size = [], 0
            if line:
                total += _grams("   ".join(line))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some.astype(np.int32), "n": total[some]})

    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(run, "gram int, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def _grams(text: str) -> np.ndarray:
    c = classes_of("   " + text + " ").astype(np.int32)
    codes = ((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:]
    # The gap between words counts once, however long, and whichever texts are met together.
    return np.bincount(codes[(c[2:-1] > 0) | (c[3:] > 0)], minlength=CLASSES ** 4)


class CharacterModel:
    """log P(class | three classes before), interpolated down to single letters. ``counts`` has 28^4 cells."""

    def __init__(self, counts: np.ndarray, weight: float = 8.0):
        four = counts.reshape((CLASSES,) * 4).astype(np.float64)
        three, two, one = four.sum(axis=0), four.sum(axis=(0, 1)), four.sum(axis=(0, 1, 2))
        p = (one + 1) / (one.sum() + CLASSES)
        for level in (two, three, four):
            p = (level + weight * p) / (level.sum(axis=-1, keepdims=True) + weight)
        self.log = np.log(p).astype(np.float32)

    def best_reading(self, lattice: list[list[tuple[str, float]]]) -> str:
        """Viterbi over a lattice: one list of (text, cost) choices per place. Linear in its length."""
        log = self.log
        states = {(0, 0, 0): 0.0}
        back: list[dict[tuple, tuple[tuple, str]]] = []
        for choices in [*lattice, [(" ", 0.0)]]:
            spelled = [(piece, cost, [_class_of(letter) for letter in piece]) for piece, cost in choices]
            grown: dict[tuple, float] = {}
            came: dict[tuple, tuple[tuple, str]] = {}
            for state, score in states.items():
                for piece, cost, classes in spelled:
                    value, (x, y, z) = score + cost, state
                    for d in classes:
                        value += float(log[x, y, z, d])
                        x, y, z = y, z, d
                    old = grown.get((x, y, z))
                    if old is None or value > old:
                        grown[(x, y, z)] = value
                        came[(x, y, z)] = state, piece
            states = grown
            back.append(came)
        at, path = max(states, key=states.get), []
        for came in reversed(back):
            at, piece = came[at]
            path.append(piece)
        return "".join(reversed(path)).strip()


def lattice_of(token: str) -> list[list[tuple[str, float]]]:
    """Readings of every run of equal characters of a token."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        letters = [(c, 0.0)] if c.isalpha() else [(x, REPLACED) for x in LOOK_ALIKE.get(c, "")]
        choices = []
        for letter, cost in letters:
            if n == 1:
                choices.append((letter, cost))
            else:
                choices += [(letter * 2, cost * n + (KEPT_RUN if n > 2 else 0.0)), (letter, cost * n + SQUEEZED * (n > 2) + 2 * SQUEEZED * (n == 2))]
        if not c.isalpha():
            choices.append(("", DROPPED))
        out.append(choices)
        i = j
    return out


class Restorer:
    """Tokens to restored words, each token decoded once."""

    def __init__(self, model: CharacterModel):
        self.model = model

    def words(self, token: str) -> tuple[str, ...]:
        """The words a token may stand for: its decoded form and its letter parts."""
        plain = token.strip(EDGES)
        bare = plain.rstrip("!")
        if bare.isalpha() and not RUN.search(bare):
            return (bare,)
        parts = tuple(PARTS.findall(plain))
        if not any(c.isalpha() for c in plain) or (plain.isalpha() and not RUN.search(plain)):
            return parts
        decoded = self.model.best_reading(lattice_of(plain))
        # A sign at the end may be punctuation or a letter.
        trimmed = self.model.best_reading(lattice_of(bare)) if bare != plain else decoded
        return tuple(dict.fromkeys(x for x in (decoded, trimmed, *parts) if x))

    def readings(self, token: str) -> tuple[str, ...]:
        """The words a token may stand for, and the word that a token of look-alikes only may spell."""
        plain = token.strip(EDGES)
        if len(plain) < 3 or not all(c in LOOK_ALIKE for c in plain):
            return self.words(token)
        # Every sign is a letter here, so none is dropped.
        spelled = ([[c for c in choices if c[0]] for choices in lattice_of(t)] for t in (plain, plain.rstrip("!")))
        return tuple(dict.fromkeys(x for x in map(self.model.best_reading, spelled) if x))

    def in_context(self, text: str | None) -> dict[str, str]:
        """Every restored word of a text with the token before its first occurrence."""
        lowered = (text or "").lower()
        found, before = {}, ""
        for token in lowered.split():
            for word in self.words(token):
                found.setdefault(word, before)
            before = token
        for run in SPACED.findall(lowered):
            for word in self.spaced(run):
                found.setdefault(word, "")
        return found

    def spaced(self, run: str) -> tuple[str, ...]:
        """Words written letter by letter; the lattice may also keep a blank as a word's end."""
        first, *inner, last = run.split()
        token = "".join([first[-1], *inner, last[0]])
        lattice = []
        for choices in map(lattice_of, token):
            lattice += [*choices, [("", 0.0), (" ", REPLACED)]]
        return (*self.model.best_reading(lattice[:-1]).split(), *([token] if token.isalpha() else []))


class Scorer:
    """Evidence of tokens under a lexicon of words and beginnings, and the curve from evidence to score."""

    def __init__(self, model: CharacterModel, lexicon: dict[str, float], slope: float = 0.0, bias: float = 0.0):
        self.restorer, self.lexicon, self.slope, self.bias = Restorer(model), lexicon, slope, bias
        self.known: dict[str, tuple] = {}

    def __getstate__(self):
        return self.restorer.model, self.lexicon, self.slope, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def word_evidence(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(word, 0.0), *[get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n], 0.0)

    def token_evidence(self, token: str) -> float:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > CACHE:
                self.known = {}
            found = self.known[token] = max((self.word_evidence(w) for w in self.restorer.readings(token)), default=0.0)
        return found

    def evidence(self, text: str | None) -> float:
        lowered = (text or "").lower()
        found = [e for e in map(self.token_evidence, set(lowered.split())) if e]
        for run in SPACED.findall(lowered):
            found += [e for e in map(self.word_evidence, self.restorer.spaced(run)) if e]
        found.sort()
        return found[-1] + 0.1 * sum(found[-4:-1]) if found else 0.0

    def score(self, text: str | None) -> float:
        if not self.lexicon:
            return 0.0
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * self.evidence(text) + self.bias))))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", docs_per_class: int = 6000, least_docs: int = 8,
        least_odds: float = 2.5, lexicon_size: int = 20_000) -> Scorer:
    """``docs`` has ``doc_id, text``; only labels of ids that are not held out are read."""
    spark = docs.sparkSession
    counts = np.zeros(CLASSES ** 4, np.int64)
    for r in gram_counts(docs).collect():  # at most 28^4 cells
        counts[r.gram] = r.n
    model = CharacterModel(counts)
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1))
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Scorer(model, {})
    grain = 1 << 20
    chance = {y: int(min(1.0, docs_per_class / n) * grain) for y, n in sizes.items()}
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < F.when(F.col("y") == 1, chance[1]).otherwise(chance[0]))
    # The drawn ids are bounded by the sample, so texts are picked without a shuffle of the corpus.
    drawn = staged(drawn.distinct(), "toxicity-drawn")
    if drawn.count() * 16 <= MAX_BROADCAST_BYTES:
        drawn = F.broadcast(drawn)
    shared = spark.sparkContext.broadcast(model)

    @F.udf("array<struct<word:string,before:string>>", useArrow=True)
    def words_of(value):
        return sorted(Restorer(shared.value).in_context(value).items())

    texts = staged(docs.select("doc_id", "text").join(drawn, "doc_id"), "toxicity-sample")
    # A word counts once for each word before it, so that copies of a text count as one.
    seen = texts.select("y", F.explode(words_of("text")).alias("x")).groupBy("x.word", "x.before").agg(F.max("y").alias("n1"), F.min("y").alias("n0"))
    words = staged(seen.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum(1 - F.col("n0")).alias("n0")), "toxicity-words")
    drawn_sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = drawn_sizes.get(1, 0), drawn_sizes.get(0, 0)
    if not n1 or not n0:
        return Scorer(model, {})
    starts = [F.when(F.length("word") >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in PREFIXES]
    terms = words.select(F.explode(F.array_compact(F.array("word", *starts))).alias("term"), "n1", "n0")
    odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
    # A beginning tells something of its own only if several words share it.
    best = (terms.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(F.col("n1") > 0).alias("words"))
            .where((F.col("n1") >= least_docs) & (~F.col("term").endswith("*") | (F.col("words") >= 3)))
            .select("term", odds.alias("odds")).where(F.col("odds") >= least_odds).orderBy(F.desc("odds"), "term").limit(lexicon_size))
    lexicon_terms = {r.term: r.odds for r in best.collect()}
    # Where readings compete, the words that matter weigh more than their share of the corpus.
    whole = [t for t in lexicon_terms if not t.endswith("*")]
    for word in whole:
        counts += _grams(word) * (counts.sum() // (20 * len(whole)) + 1)
    scorer = Scorer(CharacterModel(counts), lexicon_terms)
    lexicon = spark.sparkContext.broadcast(scorer)

    @F.udf("double", useArrow=True)
    def evidence_of(value):
        return lexicon.value.evidence(value)

    # Evidence in steps of a tenth: a bounded table for the curve.
    step = F.round(evidence_of("text"), 1)
    table = texts.select(step.alias("e"), "y").groupBy("e").agg(F.sum("y").alias("n1"), F.count("*").alias("n")).collect()
    scorer.slope, scorer.bias = _logistic([(r.e, r.n1 / n1, (r.n - r.n1) / n0) for r in table])
    return scorer


def _logistic(table: list[tuple[float, float, float]], ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and bias by Newton's method; both labels weigh the same."""
    e, w1, w0 = (np.array(x, np.float64) for x in zip(*table))
    slope, bias = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * e + bias, -30, 30)))
        miss, curve = w1 * (1 - p) - w0 * p, (w1 + w0) * p * (1 - p)
        gradient = np.array([(miss * e).sum() - ridge * slope, miss.sum() - ridge * bias])
        hessian = np.array([[(curve * e * e).sum() + ridge, (curve * e).sum()], [(curve * e).sum(), curve.sum() + ridge]])
        move = np.linalg.solve(hessian, gradient)
        slope, bias = slope + move[0], bias + move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(bias)


def score_texts(docs: DataFrame, scorer: Scorer, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    docs = without(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.udf("double", useArrow=True)
    def judge(value):
        return shared.value.score(value)

    return docs.withColumn("score", judge(F.col(f"`{text}`")))
