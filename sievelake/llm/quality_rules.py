"""Quality rules that vote or abstain, weighed by expectation-maximisation (weak supervision).

All work on texts is in built-in column functions. The driver sees one row for each combination of votes, at most
3 ** len(RULES) rows whatever the input, and runs EM on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.shared import materialize, words_of

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: name, condition to vote "good", condition to vote "bad"; neither: abstain. The columns are those of with_counts(); all are shares, so that
#: texts of any length are judged alike. n_varied adds up the distinct words of each CHUNK words in a row.
RULES = [
    ("length", "n_words >= 50", "n_words < 15"),
    ("symbols", "n_symbols < 0.005 * word_chars", "n_symbols > 0.06 * word_chars"),
    ("marked_words", "n_marked < 0.01 * n_words", "n_marked > 0.15 * n_words"),
    ("repeats", "n_repeat_words < 0.02 * n_words", "n_repeat_words > 0.1 * n_words"),
    ("lines", "n_lines >= 3 and n_dup_lines = 0", "n_dup_lines > 0.2 * n_lines"),
    ("word_length", "word_chars >= 3.5 * n_words and word_chars <= 8 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("variety", "n_varied >= 0.6 * n_words", "n_varied < 0.4 * n_words"),
    ("exclamations", "n_exclaim < 0.02 * n_words", "n_exclaim > 0.2 * n_words"),
    ("capitals", "n_capitals < 0.1 * word_chars", "n_capitals > 0.4 * word_chars"),
]

CHUNK = 100
#: A document stays if it is good with at least this probability.
KEEP_AT = 0.5
#: EM starts from, and is held by, these beliefs, worth this share of the rows: in good, that a vote on a good text is "good" (sensitivity), and that
#: a vote on a bad one is "bad" (specificity). As most texts pass most rules, the last is the weakest.
PRIOR_GOOD, PRIOR_SENSITIVITY, PRIOR_SPECIFICITY, PRIOR_SHARE = 0.8, 0.98, 0.15, 0.05
STEPS = 80


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more; hashes: one per window start."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # (hash, start), sorted; a start counts if a neighbour has its hash.
    flagged = lambda s: F.filter(
        F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    gaps = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x
    )
    # let-bindings: each array is made once
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return let(pairs, lambda s: let(F.sort_array(flagged(s)), gaps))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as the struct _row, plus the columns COUNTS of its text and _votes, one of + - 0 for each rule.

    A null text counts as empty and has zeros throughout. As docs is wrapped, none of its columns can clash.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    n = F.size("_hashes")
    df = df.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(repeated, _covered(F.col("_windows"))).otherwise(0),
        "n_lines": F.size("_lines"),
        "n_varied": F.aggregate(F.sequence(F.lit(0), n, F.lit(CHUNK)), F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice("_hashes", i + 1, CHUNK)))),
        "n_marked": F.regexp_count("_text", F.lit("[#*$%&|<>][ \\t-\\r]")),
        "n_exclaim": F.regexp_count("_text", F.lit("!")),
        "n_capitals": F.regexp_count("_text", F.lit("\\p{Lu}")),
    }
    # The running number keeps Catalyst from copying the counts into filters that stand above, once for each mention.
    df = df.select("_row", *[c.cast("long").alias(name) for name, c in counts.items()], F.monotonically_increasing_id().alias("_nth"))
    return df.withColumn("_votes", _votes())


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _votes(rules=RULES) -> Column:
    one = [F.when(F.expr(f"n_words > 0 and ({good or 'false'})"), "+").when(F.expr(f"n_words > 0 and ({bad or 'false'})"), "-").otherwise("0") for _, good, bad in rules]
    return F.concat(*one)


def fit(patterns: dict[str, int], steps: int = STEPS) -> tuple[float, list[tuple[float, float]]]:
    """EM over the vote patterns and their counts: the log odds of good before any vote, and for each rule those that its vote good and its vote bad add.

    A rule has two accuracies, on good texts and on bad ones; abstaining says nothing.
    """
    total = sum(patterns.values())
    n_rules = len(next(iter(patterns), ""))
    held = PRIOR_SHARE * total + 2
    good, sens, spec = PRIOR_GOOD, [PRIOR_SENSITIVITY] * n_rules, [PRIOR_SPECIFICITY] * n_rules
    for _ in range(steps):
        model = _weights(good, sens, spec)
        mass = 0.0
        of_good, of_bad, yes, no = ([0.0] * n_rules for _ in range(4))
        for pattern, n in patterns.items():
            g = _p_good(pattern, *model)
            mass += g * n
            for k, x in enumerate(pattern):
                if x != "0":
                    of_good[k] += g * n
                    of_bad[k] += (1 - g) * n
                    yes[k] += g * n if x == "+" else 0
                    no[k] += (1 - g) * n if x == "-" else 0
        good = (mass + held * PRIOR_GOOD) / (total + held)
        sens = [(a + held * PRIOR_SENSITIVITY) / (b + held) for a, b in zip(yes, of_good)]
        spec = [(a + held * PRIOR_SPECIFICITY) / (b + held) for a, b in zip(no, of_bad)]
    return _weights(good, sens, spec)


def _weights(good: float, sens: list[float], spec: list[float]) -> tuple[float, list[tuple[float, float]]]:
    return math.log(good / (1 - good)), [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(sens, spec)]


def _p_good(pattern: str, prior: float, weights: list[tuple[float, float]]) -> float:
    z = prior + sum(w[x == "-"] for x, w in zip(pattern, weights) if x != "0")
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def posterior(model: tuple[float, list[tuple[float, float]]]) -> Column:
    """P(good) from the column _votes, as a sum of one weight per vote."""
    z = F.lit(model[0])
    for k, (yes, no) in enumerate(model[1]):
        at = F.substring("_votes", k + 1, 1)
        z = z + F.when(at == "+", yes).when(at == "-", no).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def learn(counted: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """EM over the votes of all rows of a table with _votes."""
    return fit({r["_votes"]: r["count"] for r in counted.groupBy("_votes").count().orderBy("_votes").collect()})


def rule_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and votes (one of + - 0 for each rule) for every row.

    The counts are written once, so that the texts are read once. Repeated rows are judged each, null ids are like any other; an empty table gives none.
    """
    counted = with_counts(docs.select("doc_id", "text")).select(F.col("_row.doc_id").alias("doc_id"), *BASE, "_votes")
    counted = materialize(counted, "rules")
    failed, p = base_failed(), posterior(learn(counted))
    return counted.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (p >= KEEP_AT)).alias("kept"), F.col("_votes").alias("votes"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, their columns unchanged. Rows are written once with their votes, so that the texts are counted once."""
    counted = materialize(with_counts(docs).select("_row", base_failed().alias("_failed"), "_votes"), "judged")
    kept = ~F.col("_failed") & (posterior(learn(counted.select("_votes"))) >= KEEP_AT)
    return counted.where(kept).select("_row.*")


def _oracle() -> str:
    """rule_report() of documents as SQL for DuckDB, EM included, from the same RULES."""
    n = range(len(RULES))
    blank = "[ \\x09-\\x0D]"
    votes = ", ".join(f"CASE WHEN n_words > 0 AND ({good}) THEN 1 WHEN n_words > 0 AND ({bad}) THEN -1 ELSE 0 END AS v{k}" for k, (_, good, bad) in enumerate(RULES))
    z = "ln(g / (1 - g))" + "".join(f" + CASE v{k} WHEN 1 THEN ln(a{k} / (1 - b{k})) WHEN -1 THEN ln((1 - a{k}) / b{k}) ELSE 0 END" for k in n)
    start = ", ".join(f"CAST({PRIOR_SENSITIVITY} AS DOUBLE) AS a{k}, CAST({PRIOR_SPECIFICITY} AS DOUBLE) AS b{k}" for k in n)
    step = ", ".join(
        f"(sum(CASE WHEN v{k} = 1 THEN p * n ELSE 0 END) + held * {PRIOR_SENSITIVITY}) / (sum(CASE WHEN v{k} <> 0 THEN p * n ELSE 0 END) + held),"
        f"(sum(CASE WHEN v{k} = -1 THEN (1 - p) * n ELSE 0 END) + held * {PRIOR_SPECIFICITY}) / (sum(CASE WHEN v{k} <> 0 THEN (1 - p) * n ELSE 0 END) + held)"
        for k in n
    )
    all_votes = ", ".join(f"v{k}" for k in n)
    shown = " || ".join(f"CASE v{k} WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END" for k in n)
    return f"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i : i + {WINDOW - 1}], ' '))) AS x FROM texts WHERE len(w) >= {WINDOW}
), found AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1
), covered AS (
    SELECT r, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM found) GROUP BY r
), counted AS (
    SELECT texts.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        coalesce(list_sum(list_transform(range(0, len(w), {CHUNK}), lambda i: len(list_distinct(w[i + 1 : i + {CHUNK}])))), 0) AS n_varied,
        len(regexp_extract_all(t, '[#*$%&|<>]{blank}')) AS n_marked, len(regexp_extract_all(t, '!')) AS n_exclaim, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals
    FROM texts LEFT JOIN covered ON texts.r = covered.r
), voted AS (SELECT *, {votes} FROM counted
), patterns AS (SELECT {all_votes}, count(*) AS n FROM voted GROUP BY {all_votes}
), weight AS (SELECT {PRIOR_SHARE} * sum(n) + 2 AS held FROM patterns
), em AS (
    SELECT 0 AS step, CAST({PRIOR_GOOD} AS DOUBLE) AS g, {start}
    UNION ALL
    SELECT step + 1, (sum(p * n) + held * {PRIOR_GOOD}) / (sum(n) + held), {step}
    FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM patterns, em, weight WHERE step < {STEPS}) GROUP BY step, held
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 1 / (1 + exp(-({z}))) >= {KEEP_AT} AS kept, {shown} AS votes
FROM voted, em WHERE step = {STEPS}
"""


ORACLE = _oracle()
