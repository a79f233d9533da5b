"""Language identification with segmentation-marginalised unigrams over a fixed public vocabulary.

A language gives every vocabulary piece a probability. The probability of a word is the sum over all its
segmentations into pieces, computed by the forward algorithm; a text's is the product over its words. The
prediction is the language with the highest probability, its score the posterior under equal priors.

Piece probabilities are fitted by expectation maximisation (forward-backward) on the words of a bounded
sample: about ``docs_per_language`` training texts a language, drawn by a hash of the id, whole. Words are
counted and iterated on in Spark; the driver holds one number per piece and language. Scoring reads every
text whole; a worker computes a word once and keeps a bounded table of word scores.

Words are runs of letters in lower case; runs beyond 256 letters are cut every 256. Null texts and texts
without letters are ``und`` with score 0; with nothing to learn from, so is every text. Ties go to the
language first in order. Letters outside the vocabulary count alike in every language. Repeated rows have
one result each, empty tables give empty results; columns called ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

import re
from itertools import groupby
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.tables import free_name, held_out, staged, without

WORD = re.compile(r"[^\W\d_]{1,256}")
START = "▁"  # marks the begin of a word in the vocabulary
SCALE = 16.0  # per letter, keeps the products near one
RESCALE = 16  # positions between exact rescalings
UNKNOWN = 1e-9
CELLS = 100_000  # letters of one batch of words
CACHE = 500_000  # words a worker keeps
WORDS_AT_ONCE = 200_000  # words of the texts scored together


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letter_pieces(path: str) -> list[str]:
    """The pieces of a public vocabulary that are made of letters, in lower case, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == START or p.removeprefix(START).isalpha())


def letter_runs(text: str) -> list[str]:
    """Runs of letters in lower case; signs such as fractions and Roman numerals are no letters."""
    found = []
    for word in WORD.findall(text.lower()):
        found += [word] if word.isalpha() else ["".join(run) for letters, run in groupby(word, str.isalpha) if letters]
    return found


class Trie:
    """The vocabulary's pieces by their letters: sorted keys (node, letter), looked up for many places at once."""

    def __init__(self, pieces: list[str]):
        children: dict[tuple[int, int], int] = {}
        piece_of = [0]
        for number, piece in enumerate(pieces, 1):
            node = 0
            for c in piece:
                key = (node, ord(c))
                if key not in children:
                    children[key] = len(piece_of)
                    piece_of.append(0)
                node = children[key]
            piece_of[node] = number
        keys = np.array([(n << 21) | c for n, c in children] or [0], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(children.values()) or [0], np.int64)[order]
        self.piece_of = np.array(piece_of, np.int32)
        self.longest = max(map(len, pieces), default=1)

    def pieces_at(self, letters: np.ndarray) -> np.ndarray:
        """``out[w, i, k]``: the piece of word ``w`` that covers ``k + 1`` letters from ``i`` on; -1: none.

        A single letter that is no piece is piece 0. ``letters`` is padded with zeros.
        """
        n, size = letters.shape
        out = np.full((n, size, self.longest), -1, np.int32)
        padded = np.concatenate((letters, np.zeros((n, self.longest), letters.dtype)), axis=1)
        w, i = np.nonzero(letters)
        node = np.zeros(len(w), np.int64)
        out[w, i, 0] = 0
        for k in range(self.longest):
            key = (node << 21) | padded[w, i + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[at] == key
            w, i, node = w[alive], i[alive], self.nodes[at[alive]]
            piece = self.piece_of[node]
            some = piece > 0
            out[w[some], i[some], k] = piece[some]
            if not len(w):
                break
        return out


class Lattice:
    """All segmentations of many words: piece ``pid`` of word ``w`` leads from letter ``start`` to ``end``."""

    def __init__(self, words: list[str], trie: Trie):
        self.lengths = np.array([len(x) + 1 for x in words], np.int64)
        self.longest = trie.longest
        letters = np.zeros((len(words), int(self.lengths.max())), np.int64)
        line = START + START.join(words)
        letters[np.arange(letters.shape[1]) < self.lengths[:, None]] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = trie.pieces_at(letters)

    def log_probability(self, prob: np.ndarray) -> np.ndarray:
        """The forward algorithm, letter by letter over all words at once."""
        n, size, longest = self.at.shape
        table = np.concatenate((prob, np.zeros((1, prob.shape[1]))))  # row -1: no piece
        tables = [table * SCALE ** (k + 1) for k in range(longest)]
        used = [[k for k in range(longest) if k <= e and (self.at[:, e - k, k] >= 0).any()] for e in range(size)]
        value = [np.ones((n, prob.shape[1]))]
        total, scale = np.zeros((n, prob.shape[1])), np.zeros((n, prob.shape[1]))
        for e in range(size):
            now = np.zeros((n, prob.shape[1]))
            for k in used[e]:
                now += value[e - k] * tables[k][self.at[:, e - k, k]]
            value.append(now)
            if (e + 1) % RESCALE == 0:
                back = range(max(0, e + 1 - longest), e + 2)
                top = np.maximum.reduce([value[i] for i in back])
                top[top == 0] = 1.0
                for i in back:
                    value[i] = value[i] / top
                scale = scale + np.log(top)
            ends = self.lengths == e + 1
            if ends.any():
                with np.errstate(divide="ignore"):
                    total[ends] = np.log(value[e + 1][ends]) + scale[ends]
        return total - (self.lengths * np.log(SCALE))[:, None]

    def _steps(self) -> None:
        self.w, self.start, k = np.nonzero(self.at >= 0)
        self.pid, self.end = self.at[self.w, self.start, k].astype(np.int64), self.start + k + 1

    def _sums(self, prob: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values at every letter, the logs of their scales, and the log of each word's total."""
        n, langs, size = len(self.lengths), prob.shape[1], int(self.lengths.max())
        value = np.zeros((n, size + 1, langs))
        scale = np.zeros((n, size + 1, langs))
        now = np.zeros((n, langs))
        rows = np.arange(n)
        at, other = (self.end, self.start) if forward else (self.start, self.end)
        # Backward sums run over the distance to the word's end.
        at = at if forward else self.lengths[self.w] - at
        other = other if forward else self.lengths[self.w] - other
        order = np.lexsort((self.w, at))
        w, at, other, pid = self.w[order], at[order], other[order], self.pid[order]
        weight = prob[pid] * (SCALE ** np.abs(self.end - self.start)[order])[:, None]
        bounds = np.searchsorted(at, np.arange(1, size + 2))
        value[:, 0] = 1.0
        for step in range(1, size + 1):
            lo, hi = bounds[step - 1], bounds[step]
            ws = w[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], ws[1:] != ws[:-1]))) if hi > lo else np.empty(0, np.int64)
            if hi > lo:
                value[ws[first], step] = np.add.reduceat(value[ws, other[lo:hi]] * weight[lo:hi], first)
            if step % RESCALE == 0:
                back = slice(max(0, step - self.longest), step + 1)
                top = value[:, back].max(axis=1)
                top[top == 0] = 1.0
                value[:, back] /= top[:, None]
                now = now + np.log(top)
                scale[:, back] = now[:, None]
            else:
                scale[:, step] = now
        total = np.log(value[rows, self.lengths]) + scale[rows, self.lengths]
        return value, scale, total

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in ``counts`` occurrences of the words, by language."""
        self._steps()
        alpha, a_scale, total = self._sums(prob, True)
        beta, b_scale, _ = self._sums(prob, False)
        rest = self.lengths[self.w] - self.end
        log_scale = a_scale[self.w, self.start] + b_scale[self.w, rest] - total[self.w]
        used = alpha[self.w, self.start] * beta[self.w, rest] * prob[self.pid] * (SCALE ** (self.end - self.start))[:, None] * np.exp(log_scale) * counts[self.w]
        return np.stack([np.bincount(self.pid, used[:, k], len(prob)) for k in range(prob.shape[1])], axis=1)


def batches_of_words(words: list[str]) -> Iterator[list[str]]:
    """Words of similar length together, at most ``CELLS`` letters at a time."""
    words = sorted(words, key=len)
    first = 0
    for i in range(len(words)):
        if (i - first + 1) * (len(words[i]) + 1) > CELLS and i > first:
            yield words[first:i]
            first = i
    if words:
        yield words[first:]


class Model:
    """``langs`` and per-language piece probabilities; row 0 of ``prob`` is a letter outside the vocabulary."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, prob
        self._ready()

    def _ready(self) -> None:
        self.trie = Trie(self.pieces)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def __getstate__(self):
        return self.langs, self.pieces, self.prob

    def __setstate__(self, state):
        self.langs, self.pieces, self.prob = state
        self._ready()

    def word_scores(self, words: list[str]) -> np.ndarray:
        return Lattice(words, self.trie).log_probability(self.prob)

    def learn_words(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if self.known and len(self.known) + len(fresh) > CACHE:
            self.known, self.table, fresh = {}, np.zeros((0, len(self.langs))), list(words)
        new = [self.table]
        for batch in batches_of_words(fresh):
            self.known.update(zip(batch, range(len(self.known), len(self.known) + len(batch))))
            new.append(self.word_scores(batch))
        if len(new) > 1:
            self.table = np.concatenate(new)

    def text_scores(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Prediction and score of every text; the new words of many texts are computed together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(letter_runs(text or ""))
            size += len(held[-1])
            if size > WORDS_AT_ONCE:
                yield from self._scored(held)
                held, size = [], 0
        yield from self._scored(held)

    def _scored(self, held: list[list[str]]) -> Iterator[tuple[str, float]]:
        if self.langs:
            self.learn_words(set().union(*held))
        for words in held:
            if not words or not self.langs:
                yield "und", 0.0
                continue
            places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            logs = self.table[places].sum(axis=0)
            best = int(logs.argmax())
            yield self.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def fit(docs: DataFrame, path: str | None = None, *, docs_per_language: int = 2000, iterations: int = 4,
        doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows that are not held out and have a language; the sample is bounded by ``docs_per_language``."""
    spark = docs.sparkSession
    pieces = letter_pieces(path or vocabulary_path())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    prob = np.full((len(pieces) + 1, max(1, len(langs))), 1.0 / max(1, len(pieces)))
    if not langs:
        return Model([], pieces, prob)
    grain = 1 << 20
    wanted = F.lit(False)
    for name, n in sizes.items():
        wanted = wanted | ((F.col("lang") == name) & (F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(min(1.0, docs_per_language / n) * grain)))

    @F.udf("array<string>", useArrow=True)
    def words_of(value):
        return letter_runs(value)

    drawn = rows.where(wanted).select("lang", F.explode(words_of("text")).alias("word"))
    counted = drawn.groupBy("word").agg(*[F.count_if(F.col("lang") == name).cast("double").alias(f"n{i}") for i, name in enumerate(langs)])
    words = staged(counted, "language-words")
    for _ in range(iterations):
        prob = _maximise(_expected(spark, words, Model(langs, pieces, prob)))
    if START in pieces:  # a bare begin says nothing, so words of unknown letters count alike everywhere
        prob[pieces.index(START) + 1] = prob[pieces.index(START) + 1].mean()
    return Model(langs, pieces, prob)


def _expected(spark: SparkSession, words: DataFrame, model: Model) -> np.ndarray:
    shared = spark.sparkContext.broadcast(model)
    columns = [f"n{i}" for i in range(len(model.langs))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        total = np.zeros_like(own.prob)
        for frame in frames:
            counts = dict(zip(frame["word"], frame[columns].to_numpy()))
            for batch in batches_of_words(list(counts)):
                total += Lattice(batch, own.trie).expected(own.prob, np.stack([counts[w] for w in batch]))
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"pid": used, **{c: total[used, i] for i, c in enumerate(columns)}})

    schema = "pid long, " + ", ".join(f"{c} double" for c in columns)
    sums = words.mapInPandas(run, schema).groupBy("pid").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    total = np.zeros_like(model.prob)
    for r in sums:
        total[r.pid] = [r[c] for c in columns]
    return total


def _maximise(used: np.ndarray, share: float = 0.01) -> np.ndarray:
    """Probabilities from expected uses, mixed with a little of the mean over languages."""
    used = used.copy()
    used[0] = 0
    common = used.sum(axis=1) + 0.1
    own = used / np.maximum(used.sum(axis=0), 1e-300)
    prob = (1 - share) * own + share * (common / common.sum())[:, None]
    prob[0] = UNKNOWN
    return prob


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = without(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.text_scores(texts), columns=["lang_pred", "score"])

    judged = free_name(docs, "judged")
    return docs.withColumn(judged, judge(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns], f"{judged}.lang_pred", f"{judged}.score")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """``docs`` without texts that have no language (``und``) or only a doubtful one."""
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = [c.lower() for c in columns].index("text")
    sure = identify(renamed, model, text=f"c{at}").where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return sure.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
