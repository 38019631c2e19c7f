"""Quality rules by weak supervision, in DataFrame operations only.

Every rule looks at one signal of a document and votes good, bad, or abstains. Nobody says which rules
are right: expectation-maximisation over the counts of vote patterns estimates how each rule votes on
good and on bad documents (`RuleModel`), and the posterior probability of "good" decides. There are at most
3 ** rules patterns, whatever the corpus size, so an iteration is an aggregate over a few thousand rows
and the driver sees only its sums.

Defined results: null and empty texts have no words, all signals zero, and fail the base test;
repeated rows are judged alike; an empty table gives an empty table; input columns with the name of an
output column are replaced, all others pass through. Windows of eight words are compared by a 64-bit
hash within one document, so n words err with a probability of about n**2 / 2**65.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .text import BLANKS, NOT_BLANK, packed, words

WINDOW = 8
# A character that ends a word and is neither a letter, a digit nor common punctuation.
ODD_END = r"""[^\p{L}\p{M}\p{N}\s.,;:?'"()-](?=\s|$)"""
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SIGNALS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_distinct_words", "n_sentence_ends", "n_odd_ends",
]
# What is believed of a rule before the data speak: how often it votes good on good documents and bad on bad
# ones, and how much that belief weighs, as a share of all documents. A rule looks for one kind of fault, so
# it misses the others, but it seldom accuses a good document.
SPECIFICITY, SPECIFICITY_WEIGHT = 0.99, 0.10
SENSITIVITY, SENSITIVITY_WEIGHT = 0.50, 0.02
ITERATIONS = 20


def _repeated(frame: DataFrame) -> DataFrame:
    """Replace `_words` by n_repeat_words: words inside windows found twice or more, the first included."""
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i + 1, WINDOW)))
    frame = frame.withColumn("_windows", hashed).drop("_words")
    # Most documents repeat no window; only the others pay for a sort.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    frame = frame.withColumn("_sorted", F.when(some, F.sort_array(pairs))).drop("_windows")

    def twin(pair, j, step):
        return F.get(F.col("_sorted"), j + step)["x"] == pair["x"]

    def has_twin(pair, j):
        return F.coalesce(twin(pair, j, -1), F.lit(False)) | F.coalesce(twin(pair, j, 1), F.lit(False))

    found = F.sort_array(F.transform(F.filter("_sorted", has_twin), lambda pair: pair["i"]))
    frame = frame.withColumn("_starts", found).drop("_sorted")

    def fresh(start, j):
        return F.coalesce(F.least(F.get(F.col("_starts"), j + 1) - start, F.lit(WINDOW)), F.lit(WINDOW))

    covered = F.aggregate(F.transform("_starts", fresh), F.lit(0), lambda total, x: total + x)
    # Never anything but zero. A filter on a verdict would otherwise be rewritten in terms of the text, every
    # signal once for each of its many uses; Spark moves no filter below a column that is not deterministic.
    nothing = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return frame.withColumn("n_repeat_words", (F.coalesce(covered, F.lit(0)) + nothing).cast("bigint")).drop("_starts")


def signals(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """The signals of every document beside the columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))
    found = docs.select(*carry, text.alias("_text"), words(text).alias("_words"), lines.alias("_lines"))
    found = found.select(
        *[c for c in found.columns if c not in ("_text", "_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", BLANKS, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct_words"),
        F.length(F.regexp_replace("_text", r"[^.!?…。]+", "")).cast("bigint").alias("n_sentence_ends"),
        (F.length("_text") - F.length(F.regexp_replace("_text", ODD_END, ""))).cast("bigint").alias("n_odd_ends"),
    )
    return _repeated(found)


def base_failed() -> Column:
    """The hard test: fewer than 20 words, or more than 30% of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes good, votes bad); a rule with neither abstains."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    symbols, odd, ends = F.col("n_symbols"), F.col("n_odd_ends"), F.col("n_sentence_ends")
    repeated, upper, distinct = F.col("n_repeat_words"), F.col("n_upper"), F.col("n_distinct_words")
    return {
        "length": (n >= MIN_WORDS, n < MIN_WORDS),
        "symbols_per_word": (50 * symbols <= n, 5 * symbols > n),
        "symbols_per_character": (200 * symbols <= chars, 20 * symbols > chars),
        "odd_endings": (50 * odd <= n, 5 * odd > n),
        "duplicate_lines": ((lines >= 2) & (F.col("n_dup_lines") == 0), 10 * F.col("n_dup_lines") > 3 * lines),
        "repeated_windows": ((n >= 40) & (20 * repeated <= n), 4 * repeated > n),
        "word_length": (chars.between(3 * n, 11 * n) & (n > 0), (chars < 2 * n) | (chars > 16 * n)),
        "capitals": (10 * upper <= chars, 3 * upper > chars),
        "vocabulary": (3 * distinct >= n, (8 * distinct < n) | ((n <= 400) & (3 * distinct < n))),
        "sentences": ((60 * ends >= n) & (2 * ends <= n), ends > n),
    }


def votes(judges: dict[str, tuple[Column, Column]]) -> list[Column]:
    """One column `_vote_<i>` per rule: 0 good, 1 bad, 2 abstain."""
    cases = [F.when(bad, 1).when(good, 0).otherwise(2) for good, bad in judges.values()]
    return [case.alias(f"_vote_{i}") for i, case in enumerate(cases)]


@dataclass(frozen=True)
class RuleModel:
    """`good` is the share of good documents; rates[rule] = (P(good vote | good), P(bad vote | bad)), of its votes."""

    good: float
    rates: list[tuple[float, float]]

    def posterior(self) -> Column:
        """Probability that a document with the vote columns is good; an abstention says nothing."""
        weight = F.lit(math.log(self.good / (1 - self.good)))
        for i, (specific, sensitive) in enumerate(self.rates):
            vote = F.col(f"_vote_{i}")
            for_good, for_bad = math.log(specific / (1 - sensitive)), math.log((1 - specific) / sensitive)
            weight = weight + F.when(vote == 0, for_good).when(vote == 1, for_bad).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-weight))

    def accuracies(self) -> list[float]:
        """Estimated share of right votes of each rule."""
        return [self.good * specific + (1 - self.good) * sensitive for specific, sensitive in self.rates]


def _rate(right: float, all_votes: float, prior: float, weight: float) -> float:
    return (right + prior * weight) / (all_votes + weight)


def fit(found: DataFrame, judges: dict[str, tuple[Column, Column]] | None = None) -> RuleModel | None:
    """Estimate the rules from the signals of all documents; None without documents."""
    judges = judges or rules()
    names = [f"_vote_{i}" for i in range(len(judges))]
    counted = found.select(*votes(judges)).groupBy(*names).agg(F.count("*").alias("_n"))
    # At most 3 ** rules rows.
    counted = cut_lineage(counted.coalesce(1))
    model = RuleModel(0.9, [(SPECIFICITY, SENSITIVITY)] * len(names))
    for _ in range(ITERATIONS):
        belief = model.posterior()
        sums = [F.sum("_n").alias("n"), F.sum(F.col("_n") * belief).alias("good")]
        for c in names:
            for vote in range(2):
                cast = F.col("_n") * (F.col(c) == vote).cast("double")
                sums += [F.sum(cast * belief).alias(f"{c}_{vote}_g"), F.sum(cast).alias(f"{c}_{vote}")]
        row = counted.agg(*sums).first()
        n = row["n"]
        if not n:
            return None
        rates = []
        for c in names:
            good_on_good, bad_on_good = row[f"{c}_0_g"], row[f"{c}_1_g"]
            good_on_bad, bad_on_bad = row[f"{c}_0"] - good_on_good, row[f"{c}_1"] - bad_on_good
            specific = _rate(good_on_good, good_on_good + bad_on_good, SPECIFICITY, SPECIFICITY_WEIGHT * n)
            sensitive = _rate(bad_on_bad, good_on_bad + bad_on_bad, SENSITIVITY, SENSITIVITY_WEIGHT * n)
            rates.append((specific, sensitive))
        model = RuleModel((row["good"] + 1) / (n + 2), rates)
    return model


def judge(found: DataFrame, model: RuleModel | None) -> DataFrame:
    """Add base_failed, quality (posterior, 9 digits) and kept; `found` has the signals."""
    if model is None:
        belief = F.lit(None).cast("double")
    else:
        belief = F.round(model.posterior(), 9)
    names = found.columns
    voted = found.select(*names, *votes(rules())).select(*names, belief.alias("quality"), base_failed().alias("base_failed"))
    return voted.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= 0.5, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """All documents with their signals, posterior quality and verdict.

    The signals are computed twice, once for the patterns and once for the verdicts: texts are read
    again rather than stored.
    """
    produced = [*SIGNALS, "quality", "base_failed", "kept"]
    carried = [packed(docs, produced)]
    model = fit(signals(docs, []))
    return judge(signals(docs, carried), model).select("_row.*", *produced)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = judge(signals(docs, [row]), fit(signals(docs, [])))
    return judged.where("kept").select("_row.*")


def judged_ids(docs: DataFrame) -> DataFrame:
    """Verdicts by document id; without texts to carry, the signals are stored and computed once."""
    found = cut_lineage(signals(docs, [F.col("doc_id")]))
    columns = [*SIGNALS[:5], "base_failed", "kept", "quality"]
    return judge(found, fit(found)).select("doc_id", *columns)
