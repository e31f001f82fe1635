"""Quality rules whose cutoffs come from labelled holdouts, with exact binomial bounds on false rejection.

A rule rejects a document when a ratio (symbols to word characters, repeated lines to lines, ...) exceeds a cutoff. For
each stratum (language) and rule, the good labelled documents that each cutoff would reject are counted. A cutoff is
certified when the exact binomial test rejects "it falsely rejects more than ``alpha`` of good documents" at level
``delta`` over the number of (stratum, rule) tests; ``alpha`` is the promised bound over the number of rules, so that all
rules of a stratum together keep the promise. Cutoffs of one rule are tested from loose to strict (a fixed sequence, in
which false rejections only grow), so all certified ones hold at once, and of these the loosest that rejects the most bad
documents is used. A stratum with too few labels certifies nothing and loses nothing.

Everything is DataFrame expressions: one scan of the texts, then counts over small columns.

Defined results: null or empty text has no words and fails the base rule; a null language is a stratum of its own; a
document with several label rows counts as bad if any says so, and so does a text with several ids; label rows with null
id or quality are ignored; repeated rows are judged each, but equal texts are one trial of the holdout; windows of three
words are equal if their 64-bit hashes are; extra columns pass through ``keep_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staging

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# Rule: (numerator, denominator, steps by which a cutoff can move in a ratio of one).
RULES = {
    "symbols": ("n_symbols", "word_chars", 200),
    "dup_lines": ("n_dup_lines", "n_lines", 200),
    "repeats": ("n_repeat_words", "n_words", 200),
    "word_length": ("word_chars", "n_words", 10),
}


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts in ``STATS`` (long) and ``_digest``, a hash of the text. Heavy arrays are dropped in the same stage that makes them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    x = x.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD)))
    x = x.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_lines", F.size("_lines").cast("long"))
    x = x.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    x = x.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    x = x.withColumn("n_symbols", F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long")).withColumn("_digest", F.xxhash64("_text"))
    # Windows of three words are compared by 64-bit hashes; only texts with equal ones are looked at window by window.
    heads = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))
    second, third = (lambda i: F.get("_words", i + 1)), (lambda i: F.get("_words", i + 2))
    x = x.withColumn("_hashes", F.transform(heads, lambda w, i: F.xxhash64(w, second(i), third(i))))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    x = x.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda h, j: F.get("_sorted", j)["h"].eqNullSafe(h)
    twice = F.filter("_sorted", lambda s, j: same(s["h"], j - 1) | same(s["h"], j + 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    x = x.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), 0).otherwise(F.size(covered)).cast("long"))
    return x.drop("_text", "_words", "_lines", "_hashes", "_sorted")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def rule_step(rule: str) -> Column:
    """The smallest cutoff (in steps) that lets a document pass ``rule``: its ratio, rounded up to a step."""
    top, bottom, steps = RULES[rule]
    return F.when(F.col(bottom) > 0, F.ceil(steps * F.col(top) / F.col(bottom))).otherwise(F.lit(0)).cast("long")


def most_rejections(n: Column, alpha: float, level: Column) -> Column:
    """The most rejections among ``n`` at which P(Binomial(n, alpha) <= rejections) is within ``level``; -1 if none is.

    Terms are summed in log space up to n * alpha, beyond which the probability is above any sensible level.
    """
    odds = F.log(F.lit(alpha / (1 - alpha)))
    start = F.struct((n * F.log(F.lit(1 - alpha))).alias("term"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        total = acc["sum"] + F.exp(acc["term"])
        following = acc["term"] + F.log((n - i) / (i + 1.0)) + odds
        return F.struct(following.alias("term"), total.alias("sum"), F.when(total <= level, i).otherwise(acc["k"]).cast("long").alias("k"))

    last = F.greatest(F.floor(n * alpha), F.lit(0)).cast("long")
    return F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, step)["k"]


def fit_cutoffs(stats: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", id_col: str = "doc_id", promise: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, one cutoff in steps for each rule or null): a row for each stratum that has labels.

    Trials of the binomial test must be independent, so equal texts of a stratum are one trial, however many ids and rows they have.
    """
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).filter("_quality IS NOT NULL")
    held = stats.join(marked, F.col(id_col) == F.col("_id")).filter(~base_failed())
    held = held.groupBy(F.col(stratum_col).alias("stratum"), "_digest").agg((F.min("_quality") >= 1).alias("_good"), *[F.max(rule_step(r)).alias(r) for r in RULES])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("_p")
    cells = held.select("stratum", "_good", pairs).groupBy("stratum", "_p.rule", "_p.step")
    cells = cells.agg(F.count_if("_good").alias("_g"), F.count_if(~F.col("_good")).alias("_b"))
    # From here on: strata x rules x steps rows.
    group, stricter = Window.partitionBy("stratum", "rule"), Window.partitionBy("stratum", "rule").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_n", F.sum("_g").over(group))
    cells = cells.withColumn("_false", F.coalesce(F.sum("_g").over(stricter), F.lit(0))).withColumn("_caught", F.coalesce(F.sum("_b").over(stricter), F.lit(0)))
    allowed = cells.select("stratum", "rule", "_n").distinct().withColumn("_tests", F.count("*").over(Window.partitionBy()))
    allowed = allowed.withColumn("_most", most_rejections(F.col("_n"), promise / len(RULES), F.lit(delta) / F.col("_tests")))
    allowed = allowed.select(F.col("stratum").alias("_s"), F.col("rule").alias("_r"), "_most")
    certified = cells.join(allowed, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("rule") == F.col("_r"))).filter("_false <= _most AND _caught > 0")
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("_caught", "step"))["step"].alias("step"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("step"))).alias(f"_cut_{r}") for r in RULES])


def judge(stats: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows that have the counts."""
    joined = stats.join(cutoffs.withColumnRenamed("stratum", "_stratum"), F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    passes = F.lit(True)
    for rule in RULES:
        passes = passes & F.coalesce(rule_step(rule) <= F.col(f"_cut_{rule}"), F.lit(True))
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & passes)
    return out.drop("_stratum", "_digest", *[f"_cut_{r}" for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of ``docs``; the texts are scanned once."""
    staging = Staging(docs.sparkSession, "quality-rules")
    stats = staging.write(with_stats(docs.select("doc_id", "lang", "text")).drop("text"), "stats")
    cutoffs = staging.write(fit_cutoffs(stats, labels, **options), "cutoffs")
    staging.keep(stats, cutoffs)
    return judge(stats, cutoffs)


def keep_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, whole. The counts are staged beside the rows, so the texts are scanned once."""
    staging = Staging(docs.sparkSession, "quality-rules")
    own = ("doc_id", "lang", "text")
    rest = [c for c in docs.columns if c not in own]  # set apart, so that their names can't clash with the counts
    aside = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias("_")).alias("_rest"))
    stats = staging.write(with_stats(aside), "stats")
    cutoffs = staging.write(fit_cutoffs(stats.drop("text", "_rest"), labels, **options), "cutoffs")
    staging.keep(stats, cutoffs)
    kept = judge(stats, cutoffs).filter("kept")
    return kept.select(*[F.col(c) if c in own else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
