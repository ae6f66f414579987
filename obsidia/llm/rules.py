"""Quality rules as weak supervision: each rule votes or abstains, and expectation maximisation weighs the votes.

All of it is DataFrame functions. Each row is read once; only the counts of vote patterns, a number that the rules bound, reach the
driver, where the accuracies are estimated.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.llm import common

#: Prior of a good document, votes' pseudo-counts, rounds of expectation maximisation.
PRIOR, SMOOTH, ROUNDS = 0.9, 0.5, 50


def let(value: Column, body) -> Column:
    """body(x), with x bound to the value: computed once a row and not again for each element of a lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column, width: int) -> Column:
    """The hash of every window of `width` words, in order."""

    def of(hashes: Column) -> Column:
        last = F.size(hashes) - (width - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, width)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _repeated(windows: Column, width: int) -> Column:
    """How many words lie in windows that are found twice or more."""

    def covered(by_hash: Column) -> Column:
        places = F.filter(by_hash, lambda x, i: (F.get(by_hash, i - 1)["h"] == x["h"]) | (F.get(by_hash, i + 1)["h"] == x["h"]))
        at = F.array_sort(F.transform(places, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("end"))
        return F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + (i + width - F.greatest(i, acc["end"]))).cast("long").alias("n"), (i + width).alias("end")), lambda acc: acc["n"])

    def of(w: Column) -> Column:
        by_hash = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(by_hash, covered))

    return let(windows, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, keep: list[str] | None = None) -> DataFrame:
    """doc_id and what the rules look at; the fields in words and lines are structs, so that each text is split once.

    Words are runs of characters other than ASCII white space. A null text has none. n_upper: words of capitals. n_twice: words that
    equal the word before. n_marked: words that hold a symbol or "!". n_distinct: different words. n_lines and n_dup_lines: lines with
    a word, and those that equal an earlier one.
    """
    space = r"[\x20\x09-\x0D]+"
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split("text", space), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\v\f\r", "    ")) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated(_windows(w, width), width).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1))).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).cast("long").alias("n_twice"),
            F.size(F.filter(w, lambda x: F.translate(x, "#*$%&|<>!", "") != x)).cast("long").alias("n_marked"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def without(chars: str) -> Column:
        return (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(keep or [])).select(
        "doc_id",
        *(keep or []),
        let(words, of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        F.length(F.regexp_replace("text", space, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        without("!").alias("n_shouts"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Integer comparisons alone, so any engine votes alike."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "mean_word": vote((chars > 14 * n) | (chars < 2 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "symbols": vote(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "marked": vote(5 * F.col("n_marked") > n, 50 * F.col("n_marked") <= n),
        "lines": vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        "repeats": vote(100 * F.col("n_repeat_words") > 10 * n, 100 * F.col("n_repeat_words") <= 2 * n),
        "shouting": vote((2 * F.col("n_upper") > n) | (2 * F.col("n_shouts") > n), (10 * F.col("n_upper") <= n) & (20 * F.col("n_shouts") <= n)),
        "stutter": vote(5 * F.col("n_twice") > n, 20 * F.col("n_twice") <= n),
        "variety": vote((4 * F.col("n_distinct") < n) & (n <= 1000), 2 * F.col("n_distinct") >= n),
    }


Pattern = tuple[int, ...]


def fit(patterns: list[tuple[Pattern, int]], asked: list[Pattern] | None = None) -> dict[Pattern, float]:
    """The posterior probability of a good document for each pattern of votes, from how often each pattern occurs.

    Each rule has a chance of each vote given a good and given a bad document. Starts from the majority of votes; a rule's chances
    are smoothed by pseudo-counts. A rule is taken to be no worse than chance: a vote for a document never counts against it, nor
    the other way round, and abstaining says nothing. With no pattern the result is empty; a pattern of abstentions alone gets the
    prior's odds. asked: the patterns to judge, if they are others than those that are learned from.
    """
    patterns = sorted(patterns)
    asked = [p for p, _ in patterns] if asked is None else asked
    rules = len((asked or [()])[0])
    good = {p: 0.5 + 0.45 * (sum(p) / max(1, sum(map(abs, p)))) for p, _ in patterns}

    def judged(of: list[Pattern], odds: float, chance: list[dict]) -> dict[Pattern, float]:
        def sign(j: int, v: int) -> float:
            ratio = log(chance[j][True, v] / chance[j][False, v])
            return max(0.0, ratio) if v > 0 else min(0.0, ratio)

        return {p: 1 / (1 + exp(-max(-60.0, min(60.0, odds + sum(sign(j, v) for j, v in enumerate(p) if v))))) for p in of}

    for _ in range(ROUNDS):
        weight = {True: SMOOTH * PRIOR, False: SMOOTH * (1 - PRIOR)}
        seen = [{(c, v): SMOOTH * (2 if v == (1 if c else -1) else 1) for c in (True, False) for v in (-1, 0, 1)} for _ in range(rules)]
        for p, count in patterns:
            for c, w in ((True, good[p] * count), (False, (1 - good[p]) * count)):
                weight[c] += w
                for j, v in enumerate(p):
                    seen[j][c, v] += w
        chance = [{(c, v): s[c, v] / sum(s[c, x] for x in (-1, 0, 1)) for c, v in s} for s in seen]
        odds = log(weight[True] / weight[False])
        good = judged([p for p, _ in patterns], odds, chance)
    return judged(asked, odds, chance) if patterns else {p: PRIOR for p in asked}


def _measured(df: DataFrame) -> DataFrame:
    """df's measures with each rule's vote beside them."""
    table = df.select("*", "words.*", "lines.*").drop("words", "lines")
    return table.withColumn("votes", F.array(*[v.cast("int") for v in votes().values()]))


def _scored(table: DataFrame) -> DataFrame:
    """votes and posterior: a row for each pattern of votes that occurs, at most 3 to the power of the number of rules.

    Learned from rows that pass the base: what it has settled would else be all that the rules agree on.
    """
    found = table.groupBy("votes").agg(F.count(F.when(~_failed(), 1)).alias("n")).collect()
    posterior = fit([(tuple(r["votes"]), r["n"]) for r in found if r["n"]], [tuple(r["votes"]) for r in found])
    return table.sparkSession.createDataFrame([(list(p), v) for p, v in posterior.items()], "votes array<int>, posterior double")


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, the votes, posterior and kept for each row.

    base_failed: fewer than 20 words, or over 30 in 100 words within repeated windows of eight words. kept: not base_failed, and the
    posterior is at least the threshold; the rules are weighed on the rows that pass the base. A null text counts as empty, and
    fails; rows with equal or null ids each give a row; an empty table gives none. Other columns of docs are ignored.
    """
    table = _measured(common.written(measures(docs, id_col, text_col), "rules"))
    out = table.join(F.broadcast(_scored(table)), "votes").withColumn("base_failed", _failed())
    names = [F.get("votes", F.lit(i)).alias(f"vote_{k}") for i, k in enumerate(votes())]
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior", *names)


def filtered(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. The measures are written beside the rows, so nothing is joined back.

    A null text counts as empty, and goes; null, equal and tied ids and repeated rows are judged each by its own text; an empty table
    gives none.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    table = _measured(common.written(measures(row, keep=["row"]), "rules"))
    out = table.join(F.broadcast(_scored(table)), "votes").where(~_failed() & (F.col("posterior") >= threshold))
    return out.select("row.*")
