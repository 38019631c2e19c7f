"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document; expectation-maximisation over the counts of their
vote patterns estimates their accuracies, and the posterior of "good" is the label. A linear scorer over
hashed features (words, word shapes, repeated words) is then trained on these soft labels. It sees the
wording itself, so it also judges documents on which the labellers abstain.

The labellers are counted over all documents. The scorer is fitted on a sample of about `SAMPLE` documents,
drawn by a hash of id and text, and then scores all documents.

Defined results: null and empty texts have no features, so their score is the scorer's intercept; repeated
rows score alike; an empty table gives an empty table; extra columns play no part.
"""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .quality_rules import ODD_END, RuleModel, fit, votes
from .text import BLANKS, words

# About this many documents train the scorer, whatever the size of the corpus.
SAMPLE = 20_000
FEATURES = 1 << 14
STEPS = 40
PENALTY = 1e-6
_MODULUS = 1_000_000


def labeller_signals(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """What the labellers look at, beside the columns to carry."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*carry, text.alias("_text"), words(text).alias("_words"))
    stutter = F.filter("_words", lambda word, i: (i > 0) & (F.get(F.col("_words"), i - 1) == word))
    return found.select(
        *[c for c in found.columns if c not in ("_text", "_words")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", BLANKS, "")).alias("_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>{}~^=_\\]+", "")).alias("_symbols"),
        (F.length("_text") - F.length(F.regexp_replace("_text", ODD_END, ""))).alias("_odd"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).alias("_upper"),
        F.length(F.regexp_replace("_text", r"[^!]+", "")).alias("_shouts"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        F.size(stutter).alias("_stutter"),
    )


def labellers() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes good, votes bad)."""
    n, chars = F.col("n_words"), F.col("_chars")
    symbols, odd, upper, shouts = F.col("_symbols"), F.col("_odd"), F.col("_upper"), F.col("_shouts")
    distinct, stutter = F.col("_distinct"), F.col("_stutter")
    return {
        "enough_words": (n >= 20, n < 8),
        "few_symbols": (50 * symbols <= n, 5 * symbols > n),
        "symbol_share": (200 * symbols <= chars, 20 * symbols > chars),
        "plain_endings": (50 * odd <= n, 5 * odd > n),
        "few_capitals": (10 * upper <= chars, 3 * upper > chars),
        "no_shouting": (shouts == 0, 3 * shouts > n),
        "capitals_or_shouts": (20 * (upper + shouts) <= 3 * chars, 2 * (upper + shouts) > chars),
        "varied_words": (3 * distinct >= n, (n >= 30) & (n <= 400) & (3 * distinct < n) | (8 * distinct < n)),
        "no_stutter": ((n >= 20) & (20 * stutter <= n), 3 * stutter > n),
        "stutter_or_few_words": (2 * distinct >= n, (n >= 20) & (2 * stutter > n)),
        "word_length": (chars.between(3 * n, 9 * n) & (n > 0), (chars > 14 * n) | (2 * chars < 3 * n)),
    }


def features(text: Column) -> Column:
    """Feature words: the lower-case words, the shapes of words, and a mark for each word that repeats the last."""
    text = F.coalesce(text, F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "0")
    shapes = F.transform(words(shape), lambda x: F.concat(F.lit("\x01"), x))
    return F.concat(words(F.lower(text)), shapes)


def _vectors(frame: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=FEATURES, inputCol="_features", outputCol="_counts").transform(frame)
    return Normalizer(inputCol="_counts", outputCol="_vector").transform(hashed).drop("_features", "_counts")


def _with_repeats(frame: DataFrame) -> DataFrame:
    """`_features` from `_text`; a word equal to the one before adds a mark."""
    frame = frame.withColumn("_words", words(F.col("_text"))).withColumn("n_words", F.size("_words").cast("bigint"))
    again = F.filter("_words", lambda word, i: (i > 0) & (F.get(F.col("_words"), i - 1) == word))
    marks = F.transform(again, lambda _: F.lit("\x02"))
    return frame.withColumn("_features", F.concat(features(F.col("_text")), marks)).drop("_words", "_text")


def train(docs: DataFrame, labels: RuleModel, n_docs: int) -> LogisticRegressionModel:
    """The scorer, from the posterior labels of the sample: each document counts as good and as bad by its belief."""
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(_MODULUS))
    sample = docs.select("doc_id", "text").where(drawn * n_docs < F.lit(float(_MODULUS) * SAMPLE))
    found = labeller_signals(sample, [F.coalesce("text", F.lit("")).alias("_keep")])
    judged = found.select("_keep", *votes(labellers())).select(F.col("_keep").alias("_text"), labels.posterior().alias("_good"))
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("_good").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("_good")).alias("weight")),
    )
    # Stored: the optimizer reads it once per step.
    rows = cut_lineage(_with_repeats(judged).select("_features", F.explode(sides).alias("s")).select("_features", "s.*"))
    learner = LogisticRegression(
        featuresCol="_vector", weightCol="weight", maxIter=STEPS, regParam=PENALTY, standardization=False, tol=1e-6
    )
    return learner.fit(_vectors(rows))


def posteriors(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the label model's posterior of "good" for every document."""
    labels = fit(labeller_signals(docs, []), labellers())
    belief = F.lit(None).cast("double") if labels is None else F.round(labels.posterior(), 9)
    voted = labeller_signals(docs, [F.col("doc_id")]).select("doc_id", "n_words", *votes(labellers()))
    return voted.select("doc_id", "n_words", belief.alias("posterior"))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the scorer's probability of "good", and kept (0.5 or more)."""
    columns = ["doc_id", "n_words", "score", "kept"]
    labels = fit(labeller_signals(docs, []), labellers())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    if labels is None:
        counted = rows.withColumn("n_words", F.size(words(F.col("_text"))).cast("bigint"))
        return counted.withColumns({"score": F.lit(None).cast("double"), "kept": F.lit(False)}).select(*columns)
    model = train(docs, labels, docs.select("doc_id").count())
    scored = model.transform(_vectors(_with_repeats(rows)))
    scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.withColumn("kept", F.col("score") >= 0.5).select(*columns)
