"""Quality rules whose cutoffs are certified on labelled holdouts by exact binomial tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import packed, split_by_ids, stored, unpacked

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bangs long, n_upper long"
#: Each rule's badness, from 0 to 1, from the metrics.
RULES = {
    "symbols": lambda m: m("n_symbols") / F.greatest(m("word_chars"), F.lit(1)),
    "bangs": lambda m: m("n_bangs") / F.greatest(m("n_words"), F.lit(1)),
    "dup_lines": lambda m: m("n_dup_lines") / F.greatest(m("n_lines"), F.lit(1)),
    "repeats": lambda m: m("n_repeat_words") / F.greatest(m("n_words"), F.lit(1)),
    "upper": lambda m: m("n_upper") / F.greatest(m("word_chars"), F.lit(1)),
    "long_words": lambda m: m("word_chars") / F.greatest(m("n_words"), F.lit(1)) / 40,
}
BINS = 100


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more. Words are numbers here, so that very long texts take little memory."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 21:  # three numbers would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    found = counts[which] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + len(found)] |= found
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The metrics of one text, in the order of METRICS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # on bytes: ASCII white space only
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = np.frombuffer(raw, dtype=np.uint8)
    upper = int(np.count_nonzero((letters >= 65) & (letters <= 90)))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), text.count("!"), upper)


def metrics(text: str) -> Column:
    """Metrics of whole texts as a struct, in Arrow batches."""

    @F.pandas_udf(METRICS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[c.split()[0] for c in METRICS.split(", ")], dtype="int64")

    return measured(text)


def base_failed(m) -> Column:
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def _bin(badness: Column) -> Column:
    return F.least(F.floor(badness * BINS), F.lit(BINS)).cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n draws with chance p, as a regularised incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, 1.0 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + t * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + t / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return f


def _tables(counts: pd.DataFrame, weight: float) -> tuple[pd.DataFrame, pd.Series]:
    """Of one rule in one stratum: rows at or above each bin, and what the fitting half gains by that cutoff."""
    above = counts.set_index("bin")[["good_test", "good_fit", "bad_fit"]].reindex(range(BINS + 1), fill_value=0)[::-1].cumsum()[::-1]
    return above, (above["bad_fit"] - weight * above["good_fit"])[1:]


def promising(counts: pd.DataFrame, weight: float = 5.0) -> bool:
    """Whether any cutoff of the rule gains on the fitting half, which the certifying half knows nothing of."""
    return bool((_tables(counts, weight)[1] > 0).any())


def certified_cutoff(counts: pd.DataFrame, alpha: float, delta: float, weight: float = 5.0) -> int | None:
    """The cutoff bin of one rule in one stratum, or None.

    counts: bin, good_test, good_fit, bad_fit. Cutoffs are tried from the most lenient on; each is
    certified if the holdout refutes, at level ``delta``, that it rejects ``alpha`` or more of the good
    rows, and the first that is not ends the trial (fixed-sequence testing, so one level serves the
    whole sequence). Of the certified ones, that which gains most on the other half is taken: bad
    rows rejected less ``weight`` times the good ones; none if none gains; the most lenient of equals.
    """
    above, gains = _tables(counts, weight)
    n, best, chosen = int(above["good_test"][0]), 0.0, None
    if not n:
        return None
    for k in range(BINS, 0, -1):
        if binomial_cdf(int(above["good_test"][k]), n, alpha) > delta:
            break
        if gains[k] > best:
            best, chosen = gains[k], k
    return chosen


def learn(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Cutoff bins of every stratum: ``stratum`` and one column a rule, null where nothing could be certified.

    measured: doc_id, the stratum and the metrics; labels: doc_id and quality (1 good, 0 bad).
    With probability 1 - ``delta`` over the labelled rows, no stratum loses more than ``alpha`` of its
    good documents: alpha is shared out over the stratum's rules (union bound) and delta over strata and
    their rules (Bonferroni). Labelled rows are halved by a hash of doc_id; one half certifies, the other
    chooses, and tells which rules have bad rows to catch at all, so that nothing is spent on the others. Only counts by stratum, rule and bin are gathered, at most 101 rows a rule and stratum.
    A doc_id labelled twice counts as bad if any label says so. Rows that fail the base rules do not count.
    """
    truth = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.where(~base_failed(F.col)).join(truth, "doc_id").withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), _bin(f(F.col)).alias("bin")) for name, f in RULES.items()])
    counts = (
        known.select(F.col(stratum).alias("stratum"), "quality", "test", F.inline(rules))
        .groupBy("stratum", "rule", "bin")
        .agg(
            F.count_if(F.col("test") & (F.col("quality") == 1)).alias("good_test"),
            F.count_if(~F.col("test") & (F.col("quality") == 1)).alias("good_fit"),
            F.count_if(~F.col("test") & (F.col("quality") == 0)).alias("bad_fit"),
        )
    )
    counts = stored(counts, "bins")
    strata = max(1, counts.select("stratum").distinct().count())

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rules = {name: own for name, own in rows.groupby("rule") if promising(own)}
        cut = {name: certified_cutoff(own, alpha / len(rules), delta / (strata * len(rules))) for name, own in rules.items()}
        return pd.DataFrame([[rows["stratum"].iloc[0], *(cut.get(name) for name in RULES)]], columns=["stratum", *RULES]).astype({name: "Int32" for name in RULES})

    schema = f"stratum {dict(measured.dtypes)[stratum]}, " + ", ".join(f"{name} int" for name in RULES)
    return stored(counts.groupBy("stratum").applyInPandas(decide, schema), "cutoffs")


def _verdict(df: DataFrame, cutoffs: DataFrame, stratum: str, m) -> DataFrame:
    """Adds base_failed and kept to a frame whose metrics ``m`` names; a stratum without cutoffs rejects nothing more."""
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(name).alias(f"_cut_{name}") for name in RULES])
    over = F.lit(False)
    for name, f in RULES.items():
        over = over | F.coalesce(_bin(f(m)) >= F.col(f"_cut_{name}"), F.lit(False))
    joined = df.join(cuts, df[stratum].eqNullSafe(cuts["_stratum"]), "left")
    failed = base_failed(m)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Metrics and verdict of every document.

    docs: doc_id, text and the stratum column; others are ignored. Returns doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept. Null texts have
    no words and fail; a null stratum is a stratum of its own; repeated rows are judged alike; empty
    tables give empty results, and without labels only the base rules reject.
    """
    names = [c.split()[0] for c in METRICS.split(", ")]
    measured = stored(docs.select("doc_id", stratum, metrics("text").alias("m")).select("doc_id", stratum, *[f"m.{c}" for c in names]), "measured")
    out = _verdict(measured, learn(measured, labels, stratum, alpha, delta), stratum, F.col)
    return out.select("doc_id", *names[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, all columns unchanged.

    Null, empty and blank texts fail the base rules and go; repeated rows stay or go together; rows
    without doc_id are judged but never learned from; a null stratum is one of its own; without labels
    only the base rules reject; an empty table gives an empty result; columns may have any names.
    """
    names = [c.split()[0] for c in METRICS.split(", ")]
    needed = docs.select("doc_id", F.col(stratum).alias(stratum), "text")
    # rows that a map of bits takes for labelled ones fall out when ``learn`` joins its labels, so no text is shuffled
    labelled, _ = split_by_ids(needed, labels.select("doc_id"), "doc_id")
    measured = labelled.select("doc_id", stratum, metrics("text").alias("m")).select("doc_id", stratum, *[f"m.{c}" for c in names])
    cutoffs = learn(stored(measured, "measured"), labels, stratum, alpha, delta)
    rows = packed(docs, stratum, "text").withColumn("_m", metrics("text"))
    return unpacked(_verdict(rows, cutoffs, stratum, lambda c: F.col(f"_m.{c}")).where("kept"), docs)
