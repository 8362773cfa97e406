"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1). Expectation-maximisation over the counts of vote patterns (at
most 3 to the number of rules of them, whatever the corpus) estimates each rule's accuracy on good and on bad documents, where it
votes, and the share of good documents; the posterior probability of each document replaces all-must-pass filtering. It starts from the share
of a document's votes that are good. All rules are held alike, by a hundredth of the documents' weight, to one accuracy better than
chance, which tells which of the two classes is the good one. An abstention says nothing, so a corpus without bad
documents is not split by what rules abstain on.

Null, empty and wordless texts have no words, so the base rule fails and the document is not kept. Repeated rows are
judged alike, by their own text; texts of any length are measured whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import let, saved

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Two marks or more in a row, or one that stands alone.
MARK_RUNS = r"[!-/:-@\[-`{-~]{2,}|(?<!\S)[!-/:-@\[-`{-~](?!\S)"
#: The accuracy that every rule is held to, and the weight of that as a share of the documents.
ACCURACY, TRUST = 0.7, 0.01


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more (the first included)."""
    n = F.size(w)
    spots = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def again(s: Column) -> Column:
        return F.transform(F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))), lambda x: x["p"])

    def covered(r: Column) -> Column:
        return F.aggregate(F.transform(r, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(r, i + 1) - p), F.lit(3))), F.lit(0), lambda a, b: a + b)

    return F.when(n >= 3, let(F.sort_array(let(F.sort_array(spots), again)), covered)).otherwise(0)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measurements of each document, one row each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.filter(F.split(text, SPACE), lambda x: x != "").alias("w"))
    dense = F.translate(F.col("t"), " \t\n\x0b\f\r", "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    return split.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(dense).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
        let(F.col("w"), _repeat_words).cast("long").alias("n_repeat_words"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", ".,;:?", ""))).cast("long").alias("n_points"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).cast("long").alias("n_bangs"),
        F.regexp_count("t", F.lit(MARK_RUNS)).cast("long").alias("n_runs"),
        F.size(F.array_distinct("w")).cast("long").alias("n_kinds"),
    )


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, -1 abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    marks = F.col("n_symbols") + F.col("n_points") + F.col("n_bangs")
    return {
        "symbols": vote(F.col("n_symbols") * 20 > n, F.col("n_symbols") * 100 <= n),
        "marks": vote(marks * 8 > chars, marks * 20 <= chars),
        "runs": vote(F.col("n_runs") * 20 > n, F.col("n_runs") * 100 <= n),
        "capitals": vote(F.col("n_upper") * 2 > chars, F.col("n_upper") * 5 <= chars),
        "bangs": vote(F.col("n_bangs") * 10 > n, F.col("n_bangs") * 100 <= n),
        "repeats": vote(F.col("n_repeat_words") * 4 > n, F.col("n_repeat_words") * 10 <= n),
        "variety": vote(F.col("n_kinds") * 3 < n, F.col("n_kinds") * 2 >= n),
        "lines": vote((F.col("n_dup_lines") * 3 > F.col("n_lines")) & (F.col("n_lines") >= 3), F.col("n_dup_lines") == 0),
        "word_length": vote((chars > n * 14) | (chars < n * 2), (chars <= n * 10) & (chars >= n * 3)),
        "length": vote(n < 5, n >= 100),
        "points": vote(F.col("n_points") * 100 < n, F.col("n_points") * 25 >= n),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, trust: float = TRUST) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and, for each rule, its accuracy where it votes: on good and on bad documents; by expectation-maximisation.

    Rules are taken as independent given the class. Without a round every vote counts alike.
    """
    m = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    held = max(1.0, trust * total)
    good = [(sum(v == 1 for v in votes) + 1) / (sum(v >= 0 for v in votes) + 2) for votes, _ in patterns]
    share, table = 0.5, [(ACCURACY, ACCURACY)] * m
    for _ in range(rounds if total else 0):
        right = [[held * ACCURACY, held * ACCURACY] for _ in range(m)]
        cast = [[held, held] for _ in range(m)]
        for (votes, n), p in zip(patterns, good, strict=True):
            for r, v in enumerate(votes):
                if v >= 0:
                    right[r][1 - v] += n * (p if v else 1 - p)
                    cast[r][0] += n * p
                    cast[r][1] += n * (1 - p)
        share = (math.fsum(n * p for (_, n), p in zip(patterns, good, strict=True)) + 1) / (total + 2)
        table = [(right[r][0] / cast[r][0], right[r][1] / cast[r][1]) for r in range(m)]
        good = [posterior(votes, share, table) for votes, _ in patterns]
    return share, table


def _evidence(vote: int, accuracy: tuple[float, float]) -> float:
    """Log of how much likelier a vote is for a good document."""
    on_good, on_bad = accuracy
    return math.log(on_good / (1 - on_bad)) if vote == 1 else math.log((1 - on_good) / on_bad) if vote == 0 else 0.0


def posterior(votes: tuple[int, ...], prior: float, table: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior)) + sum(_evidence(v, table[r]) for r, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the base measurements, base_failed, quality (posterior), kept."""
    votes = rules()
    base = saved(features(docs, id_col, text_col).withColumns({f"v_{k}": c for k, c in votes.items()}))
    names = [f"v_{k}" for k in votes]
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in base.groupBy(*names).count().collect()]
    prior, table = fit(sorted(patterns) or [((-1,) * len(names), 0)])
    logit = F.lit(math.log(prior / (1 - prior)))
    for r, name in enumerate(names):
        logit = logit + F.when(F.col(name) == 1, _evidence(1, table[r])).when(F.col(name) == 0, _evidence(0, table[r])).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    quality = 1 / (1 + F.exp(-logit))
    return base.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality")
    )
