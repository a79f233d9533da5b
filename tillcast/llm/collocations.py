"""Collocations by dynamic itemset counting: phrases of all lengths are counted in one cyclic scan.

The documents are dealt to ``SHARDS`` shards, and a step scans one of them, in turn. Words are counted from the first step
on. A phrase is active from the step after both its subphrases, one word shorter at either end, have reached the
threshold; it is counted for exactly one cycle of shards, wherever that begins, so that its count is exact. Lengths are
thus interleaved: while late words are still counted, phrases of two and three words already are. The scan ends
one cycle after the last phrase reached the threshold.

No candidates are listed. The step at which a phrase reached the threshold is kept in a table of ``2 ** SLOT_BITS`` one-byte
slots by its hash, the only thing that is broadcast, of the same size for any corpus. Phrases that share a slot take the
earlier step: such a phrase is counted sooner, or though it is rare, but for one cycle as any other, and no count
changes. Phrases themselves are compared as strings. Counts that are complete leave the running totals: frequent ones
are kept, rare ones dropped before they are written, so a step adds up open phrases only. From the second cycle on
a step gives ids only to the words of active phrases.

Null texts have no words; a null language is ``und``. Repeated rows count each. Ties are broken by phrase in UTF-8 order.
Empty tables give an empty result. Texts are read whole, long ones in pieces cut at separators. Only language and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillcast.llm.tables import staged

MIN_COUNT = 30
LONGEST = 4
SHARDS = 4
SLOT_BITS = 24
TOP = 2000
COVERED = 80  # per cent of a phrase's occurrences that lie in one longer phrase
SCORE_SCALE = 2_000_000
NEVER = 255
CHUNK_BYTES = 4 << 20

# A-Z in lower case, separators of pieces as line breaks, tabs as blanks.
_FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FIRST, _NEXT, _LAST = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWER = 0x9E3779B1


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[list[bytes], list[str]]]:
    texts: list[bytes] = []
    langs: list[str] = []
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, folded, first = lang.as_py(), text.as_py().translate(_FOLD), 0
            while first < len(folded):
                last = folded.find(b"\n", first + chunk_bytes) + 1 or len(folded)
                texts.append(folded[first:last])
                langs.append(lang)
                held, first = held + last - first, last
                if held >= chunk_bytes:
                    yield texts, langs
                    texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


class Tokens:
    """The words of some texts: ``ids`` (equal for equal language and word), ``piece`` and hashes of phrases.

    Hashes are taken from the bytes and need no dictionary. Without ``whole`` there are no ids until ``encode`` gives them
    to the words at some places.
    """

    def __init__(self, texts: list[bytes], langs: list[str], whole: bool = True):
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        is_word = (self.data != 10) & (self.data != 32)
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        bounds = np.concatenate(([0] if is_word[:1].any() else [], edge, [len(is_word)] if is_word[-1:].any() else [])).astype(np.int64)
        self.starts, self.ends = bounds[::2], bounds[1::2]
        breaks = np.flatnonzero(self.data == 10)
        self.piece = np.searchsorted(breaks, self.starts)
        self.langs, of_text = np.unique(np.array(langs, object), return_inverse=True)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.lang = np.repeat(of_text.reshape(-1), np.diff(np.searchsorted(self.starts, begin)))
        lang_hash = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)
        self.hashes = lang_hash[self.lang] * _FIRST ^ self._word_hashes() if len(self.starts) else np.zeros(0, np.uint64)
        if whole:
            self.encode(np.arange(len(self.starts)))

    def _word_hashes(self) -> np.ndarray:
        """Polynomials in the bytes of each word, from running sums that wrap at 32 bits, then mixed."""
        power, back = (np.multiply.accumulate(np.full(len(self.data), x, np.uint32), dtype=np.uint32) for x in (_POWER, pow(_POWER, -1, 1 << 32)))
        upto = np.zeros(len(self.data) + 1, np.uint32)
        np.cumsum((self.data + np.uint32(1)) * power, dtype=np.uint32, out=upto[1:])
        # As if every word began where the data begin.
        whole = ((upto[self.ends] - upto[self.starts]) * back[self.starts]).astype(np.uint64) * _LAST
        return (whole ^ whole >> np.uint64(32)) * _NEXT

    def encode(self, places: np.ndarray) -> None:
        """``ids`` of the words at ``places``, which are distinct; other words have none."""
        starts, length = self.starts[places], self.ends[places] - self.starts[places]
        offsets = np.concatenate(([0], np.cumsum(length)))
        letters = self.data[np.repeat(starts - offsets[:-1], length) + np.arange(offsets[-1])]
        words = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.ids = np.full(len(self.starts), -1)
        self.ids[places] = self.lang[places] * len(self.words) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n_ids = max(1, len(self.langs) * len(self.words))

    def phrase_hashes(self, longest: int) -> Iterator[np.ndarray]:
        """For lengths 1, 2, ...: the hash of the phrase that begins at each place."""
        whole = self.hashes
        for k in range(1, longest + 1):
            yield whole[:max(0, len(self.hashes) - k + 1)]
            whole = (whole[:-1] ^ whole[:-1] >> np.uint64(29)) * _NEXT + self.hashes[k:]

    def counted(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases of a length among those that begin at ``places``: one place of each, and their numbers."""
        code, bound = self.ids[places], self.n_ids
        for k in range(1, length):
            if bound * self.n_ids >= 1 << 63:
                known, code = np.unique(code, return_inverse=True)
                bound = len(known)
            code, bound = code * self.n_ids + self.ids[places + k], bound * self.n_ids
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else order
        return places[order[first]], np.diff(np.append(first, len(code)))

    def keys(self, places: np.ndarray, length: int) -> pa.Array:
        """Language and phrase, parted by a line break, which no phrase holds."""
        lang = self.lang_names().take(pa.array(self.ids[places] // len(self.words)))
        parts = [self.words.take(pa.array(self.ids[places + k] % len(self.words))) for k in range(length)]
        phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        return pc.binary_join_element_wise(lang, phrase, pa.scalar(b"\n", pa.binary())).cast(pa.string())

    def lang_names(self) -> pa.Array:
        return pa.array([x.encode() for x in self.langs], pa.binary())


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ hashes >> np.uint64(31)) * _LAST
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


# ``key`` is language, line break, phrase; ``tag`` is 16 times the step of activation, plus the length.
COUNTS = "key string, tag int, n bigint"
TAGS = 16


def count_step(docs: DataFrame, step: int, shards: int, longest: int, slot_bits: int, chunk_bytes: int, reached) -> DataFrame:
    """``COUNTS``, in parts, of the active phrases in ``docs`` (``lang, text``); length 0 is the number of words.

    ``reached`` is a broadcast array: per slot the step from which its phrases count as frequent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(reached.value, np.uint8)
        for texts, langs in _chunks(batches, chunk_bytes):
            tokens = Tokens(texts, langs, whole=step < shards)
            if not len(tokens.hashes):
                continue
            if step < shards:
                lang, n = np.unique(tokens.lang, return_counts=True)
                yield _rows(pa.array([tokens.langs[i] + "\n" for i in lang], pa.string()), np.zeros(len(lang)), n)
                places, n = tokens.counted(np.arange(len(tokens.ids)), 1)
                yield _rows(tokens.keys(places, 1), np.ones(len(n)), n)
            shorter, active = None, []
            for k, hashes in enumerate(tokens.phrase_hashes(longest), 1):
                if k > 1:
                    since = np.maximum(shorter[:-1], shorter[1:])
                    places = np.flatnonzero((since <= step) & (since > step - shards) & (since != NEVER))
                    places = places[tokens.piece[places] == tokens.piece[places + k - 1]]
                    if len(places):
                        active.append((k, places, since))
                if k < longest:
                    shorter = table[slots_of(hashes, slot_bits)]
            if active and step >= shards:
                # Once words are counted, only those of active phrases are told apart.
                used = np.zeros(len(tokens.hashes), bool)
                for k, places, _ in active:
                    for i in range(k):
                        used[places + i] = True
                tokens.encode(np.flatnonzero(used))
            for k, places, since in active:
                found, n = tokens.counted(places, k)
                yield _rows(tokens.keys(found, k), since[found].astype(np.int64) * TAGS + k, n)

    return docs.mapInArrow(run, COUNTS)


def _rows(key: pa.Array, tag: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(tag.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "tag", "n"])


def _slots(phrases: DataFrame, longest: int, bits: int) -> np.ndarray:
    """The distinct slots of the phrases in ``key``: at most ``2 ** bits`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [x.rsplit("\n", 1) for x in batch.column(0).to_pylist()]
            tokens = Tokens([phrase.encode() for _, phrase in parts], [lang for lang, _ in parts], whole=False)
            begin = np.flatnonzero(np.diff(tokens.piece, prepend=-1))
            length = np.diff(np.append(begin, len(tokens.hashes)))
            found = [slots_of(h[begin[length == k]], bits) for k, h in enumerate(tokens.phrase_hashes(longest), 1) if (length == k).any()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int32) if found else [], pa.int32())], names=["slot"])

    return phrases.select("key").mapInArrow(run, "slot int").distinct().toArrow().column(0).to_numpy()


def frequent_phrases(docs: DataFrame, *, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST,
                     shards: int = SHARDS, slot_bits: int = SLOT_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``lang, length, phrase, n``: all phrases up to ``longest`` words with ``min_count`` occurrences or more; length 0 has all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    dealt = staged(rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), "phrase-shards", by="shard")
    table = np.full(1 << slot_bits, NEVER, np.uint8)
    complete, running, step, last = [], None, 0, 0
    while step < last + shards:
        reached = spark.sparkContext.broadcast(table.tobytes())
        scanned = dealt.where(F.col("shard") == step % shards).select("lang", "text")
        found = count_step(scanned, step, shards, longest, slot_bits, chunk_bytes, reached)
        # One exchange a step: what was found joins the running totals before either is added up.
        found = found if running is None else found.union(running)
        step += 1
        length, since = F.col("tag") % TAGS, F.floor(F.col("tag") / TAGS)
        ended, enough = since + shards <= step, (F.col("n") >= min_count) | (length == 0)
        found = staged(found.groupBy("key", "tag").agg(F.sum("n").alias("n")).where(~ended | enough), "phrase-counts")
        reached.destroy()
        # The few that matter from here on are read from a table of their own.
        frequent = staged(found.where(enough), "phrase-frequent")
        complete.append(frequent.where(ended))
        running = found.where(~ended)
        slots = _slots(frequent.where(length.between(1, longest - 1)), longest, slot_bits)
        fresh = slots[table[slots] == NEVER]
        if len(fresh):
            table[fresh] = last = step
    out = complete[0]
    for more in complete[1:]:
        out = out.union(more)
    phrase = F.substring_index("key", "\n", -1)
    named = out.select(phrase.alias("phrase"), "key", (F.col("tag") % TAGS).alias("length"), "n")
    name = F.substr("key", F.lit(1), F.length("key") - F.length("phrase") - 1)
    return staged(named.select(name.alias("lang"), "length", "phrase", "n"), "frequent-phrases")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST,
                 covered: int = COVERED, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    A phrase of ``a`` occurrences is as good as its worst cut into a first part (``l``) and a rest (``r``):
    floor(SCORE_SCALE * a / (l + r)). Phrases that lie to ``covered`` per cent inside one longer phrase are left out.
    """
    counts = frequent_phrases(docs, lang=lang, text=text, min_count=min_count, longest=longest, shards=shards)
    words = counts.where("length = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    known = counts.where("length > 0")
    phrases = known.where("length > 1").select("lang", "phrase", "length", F.col("n").alias("a"))

    def part(first, length):
        return F.concat_ws(" ", F.slice(F.split("phrase", " "), first, length))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("length") - size + 1), lambda first: part(first, size))))
    inside = phrases.where("length > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("outer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    free = phrases.join(inside, ["lang", "phrase"], "left").where(f"outer is null or 100 * outer < {covered} * a").drop("outer")

    cuts = free.select("lang", "phrase", "a", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr(f"cast({SCORE_SCALE} as decimal(20,0)) * a div (l + r)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = scored.withColumn("cut", F.row_number().over(Window.partitionBy("lang", part_of).orderBy(*order))).where(F.col("cut") <= top).drop("cut")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
