"""Quality rules whose cutoffs are chosen under a limit on false rejections.

Each rule reads one measure of a text in steps of a fixed grid; a higher level is worse. Labelled documents that pass the
base checks are split by a hash of their id. The tuning part orders, stratum by stratum, all (rule, level) pairs
that reject bad documents at over ``LIFT`` times the rate of good ones, most precise first: a ladder, each rung of
which rejects all that the rungs below it do. The holdout certifies rungs from below: with n good documents of
which k are rejected, a rung passes if Bin(n, ``limit``) gives k or fewer with a probability of at most the stratum's
share of ``risk``, which is the exact (Clopper-Pearson) bound. The first rung that fails ends the ladder. Fixed order
needs no correction within a stratum; between strata ``risk`` is divided (Bonferroni). So with probability
``1 - risk`` no stratum loses more than ``limit`` of its good documents to the rules. A stratum with too few
labelled documents certifies nothing, and keeps all that passes the base checks.

Null text: no words. Null or empty stratum: ``und``. A null quality, or a label without a document, is no evidence; an id
with several labels is good if one of them is. Repeated rows have one result each; empty tables give empty
results, and without labels only the base checks decide. Texts are read whole; a long one costs n log n of its words.
Columns called like an output column, in any case, are replaced; all others are kept as they are. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillcast.llm.tables import free_name, held_out, staged, without

LIMIT = 0.02
RISK = 0.05
LIFT = 2
MIN_WORDS = 50
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MAX_BROADCAST_STRATA = 10_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines")

# Per rule: measure as a whole number, cutoffs from mild to severe, and whether small values are the bad ones.
RULES: tuple[tuple[str, str, tuple[int, ...], bool], ...] = (
    ("few_words", "n_words", (200, 150, 120, 100, 90, 80, 70, 60), True),
    ("short_words", "100 * word_chars div n_words", (500, 450, 425, 400, 375, 350, 325, 300), True),
    ("long_words", "100 * word_chars div n_words", (600, 650, 700, 750, 800, 900, 1000, 1200), False),
    ("symbols", "1000 * n_symbols div n_words", (1, 5, 10, 20, 50, 100, 200, 500), False),
    ("repeated_lines", "1000 * n_dup_lines div n_lines", (1, 50, 100, 150, 200, 300, 400, 500), False),
    ("repeated_words", "1000 * n_repeat_words div n_words", (10, 25, 50, 100, 150, 200, 300, 400), False),
    ("few_distinct", "1000 * n_distinct_words div n_words", (600, 500, 450, 400, 350, 300, 250, 200), True),
)
LEVELS = 8


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _doubled(items: Column, key: str) -> Column:
    """Of sorted structs those whose ``key`` occurs more than once."""
    def beside(x: Column, j: Column) -> Column:
        return F.coalesce(x[key] == F.get(items, j - 1)[key], F.lit(False)) | F.coalesce(x[key] == F.get(items, j + 1)[key], F.lit(False))

    return F.filter(items, beside)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Hashes find candidates, the words decide."""
    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def word(i: Column, k: int) -> Column:
        return F.get(words, i + k)

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                         lambda i: F.struct(F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("i")))
    likely = _let(F.sort_array(hashed), lambda s: _doubled(s, "h"))
    spelled = F.transform(likely, lambda x: F.struct(F.concat_ws(" ", word(x["i"], 0), word(x["i"], 1), word(x["i"], 2)).alias("g"), x["i"].alias("i")))
    at = _let(F.sort_array(spelled), lambda s: F.sort_array(F.transform(_doubled(s, "g"), lambda x: x["i"])))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(at, covered))


def measures(text: Column) -> Column:
    """The ``MEASURES`` of a text as a struct of longs."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANK, "") != "")

        def counts(w: Column) -> Column:
            return _let(lines, lambda full: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, BLANK, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
                F.size(full).cast("long").alias("n_lines")))

        return _let(words, counts)

    return _let(text, of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``base_failed``."""
    kept = without(docs, *({*MEASURES, "base_failed"} - {text.lower()}))
    m = free_name(kept, "m")
    measured = kept.withColumn(m, measures(F.col(f"`{text}`")))
    columns = [F.col(f"`{c}`") for c in kept.columns if c.lower() not in MEASURES]
    return measured.select(*columns, f"{m}.*").withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def levels() -> Column:
    """Per rule the number of its cutoffs that a measured row meets; rows that fail the base checks have none."""
    def level(value: str, cutoffs: tuple[int, ...], small: bool) -> Column:
        met = [(F.expr(value) < c if small else F.expr(value) >= c).cast("int") for c in cutoffs]
        return sum(met[1:], met[0])

    return F.when(~F.col("base_failed"), F.array(*[level(v, c, s) for _, v, c, s in RULES]))


def stratum_of(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"`{name}`").cast("string"), F.lit("")), F.lit("und"))


def _at_most(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), all terms added; 1 from the mean on, where it is over the half or near it."""
    def add(acc: Column, i: Column) -> Column:
        term = acc["log"] + F.log((n - i + 1) / i) + F.lit(math.log(p) - math.log1p(-p))
        return F.struct(term.alias("log"), (acc["sum"] + F.exp(term)).alias("sum"))

    none = n * F.lit(math.log1p(-p))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, F.struct(none.alias("log"), F.exp(none).alias("sum")), add, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def ladder(cells: DataFrame) -> DataFrame:
    """``stratum, rule, level, step`` from ``stratum, good, rule, level, n`` of the tuning rows: the rungs in order."""
    tails = cells.select("stratum", "good", "rule", "n", F.explode(F.sequence(F.lit(0), "level")).alias("level"))
    of = tails.groupBy("stratum", "rule", "level").agg(
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("b"))
    every = of.where("level = 0").select("stratum", "rule", F.col("g").alias("all_g"), F.col("b").alias("all_b"))
    useful = of.where("level > 0").join(every, ["stratum", "rule"]).where(F.col("b") * F.col("all_g") > LIFT * F.col("g") * F.col("all_b"))
    order = Window.partitionBy("stratum").orderBy(((F.col("b") + 1.0) / (F.col("g") + 1.0)).desc(), "rule", F.col("level").desc())
    return useful.select("stratum", "rule", "level", F.row_number().over(order).alias("step"))


def _first_step(levels_: Column, steps: Column) -> Column:
    """The lowest rung that rejects; ``steps``: structs of rule, level, step. Null: none."""
    hit = F.filter(steps, lambda s: F.get(levels_, s["rule"]) >= s["level"])
    return F.array_min(F.transform(hit, lambda s: s["step"]))


def fit(measured: DataFrame, labels: DataFrame, *, stratum: str = "lang", doc_id: str = "doc_id", quality: str = "quality",
        limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """``stratum, steps, n_good, last_step, n_rejected``: ladders and the last certified rung (0: none), for strata with a ladder.

    ``measured`` is what ``measure`` gave; ``labels`` has the id and 1 for good, 0 for bad.
    """
    known = labels.where(F.col(f"`{quality}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max(F.col(f"`{quality}`") > 0).alias("good"))
    passed = measured.where("not base_failed").select(F.col(f"`{doc_id}`").alias("id"), stratum_of(stratum).alias("stratum"), levels().alias("levels"))
    evidence = staged(passed.join(known, "id").select("stratum", "good", held_out(F.col("id")).alias("holdout"), "levels")
                      .groupBy("stratum", "good", "holdout", "levels").agg(F.count("*").alias("n")), "quality-evidence")
    cells = evidence.where("not holdout").select("stratum", "good", "n", F.posexplode("levels").alias("rule", "level"))
    cells = cells.groupBy("stratum", "good", "rule", "level").agg(F.sum("n").alias("n"))
    steps = staged(ladder(cells).groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", "rule", "level"))).alias("steps")), "quality-ladder")
    tested = max(1, steps.count())
    held = evidence.where("holdout and good").join(steps, "stratum").select("stratum", "n", _first_step(F.col("levels"), F.col("steps")).alias("step"))
    held = held.groupBy("stratum", "step").agg(F.sum("n").alias("n"))
    totals = held.groupBy("stratum").agg(F.sum("n").alias("n_good"))
    rungs = steps.select("stratum", F.explode("steps.step").alias("step")).join(held, ["stratum", "step"], "left")
    below = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counted = rungs.withColumn("k", F.coalesce(F.sum("n").over(below), F.lit(0))).join(totals, "stratum")
    passes = counted.withColumn("holds", _at_most(F.col("k"), F.col("n_good"), limit) <= risk / tested)
    unbroken = passes.withColumn("holds", F.min("holds").over(below))
    last = unbroken.where("holds").groupBy("stratum", "n_good").agg(F.max(F.struct("step", "k")).alias("last"))
    return staged(steps.join(last, "stratum", "left").select(
        "stratum", "steps", F.col("n_good"), F.coalesce("last.step", F.lit(0)).alias("last_step"), F.col("last.k").alias("n_rejected")), "quality-cutoffs")


def judge(measured: DataFrame, fitted: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``rejected_by`` (the rules that reject the row; null if none) and ``kept``."""
    rows = without(measured, "kept", "rejected_by")
    key, certified = free_name(rows, "stratum"), free_name(rows, "certified")
    # Only certified strata matter, each of which has dozens of labelled documents; few enough are broadcast.
    cut = fitted.where("last_step > 0").select(F.col("stratum").alias(key), F.filter("steps", lambda s: s["step"] <= F.col("last_step")).alias(certified))
    if cut.count() <= MAX_BROADCAST_STRATA:
        cut = F.broadcast(cut)
    joined = rows.withColumn(key, stratum_of(stratum)).join(cut, key, "left")
    names = F.array(*[F.lit(name) for name, *_ in RULES])
    hit = F.filter(F.col(certified), lambda s: F.get(levels(), s["rule"]) >= s["level"])
    rejected = F.array_sort(F.array_distinct(F.transform(hit, lambda s: F.get(names, s["rule"]))))
    judged = joined.withColumn("rejected_by", F.when(F.size(rejected) > 0, rejected))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(key, certified)
