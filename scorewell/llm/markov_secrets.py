"""Secrets: pattern spans, and strings that look random to two character Markov models.

One model is of random strings (hexadecimal and base-64 digests of numbers), one of ordinary identifiers (words of a
bounded sample of the documents). A string's log-likelihood ratio is the sum over its transitions of a
table of 67 x 66 numbers; strings whose ratio outweighs the prior odds against a secret are spans of
kind ``random``, unless a pattern already covers them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.spans import spans_sql

KINDS = ["assign", "access", "hex", "random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Documents and random strings that the models are fitted on, about; the odds against a string being a secret.
SAMPLE_DOCUMENTS, SAMPLE_STRINGS = 2_000, 20_000
PRIOR_ODDS = 1e6
SMOOTHING = 0.5

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
STRING = r"[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"[A-Za-z0-9_-]{4,}"


def transitions(tokens: DataFrame) -> DataFrame:
    """(pair, n) over the columns ``token``: two neighbouring characters; a token's first follows a space."""
    pair = "explode(transform(sequence(1, length(token)), i -> substr(concat(' ', token), i, 2))) AS pair"
    return tokens.where("length(token) > 0").selectExpr(pair).groupBy("pair").agg(F.count("*").alias("n"))


def likelihood_ratios(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary), at ``66 * place(a) + place(b)`` (the space before ``a`` has place 0)."""
    width, counts = len(ALPHABET), []
    for frame in (random, ordinary):
        table = [[SMOOTHING] * width for _ in range(width + 1)]
        for row in frame.collect():  # at most 67 x 66 pairs
            a, b = ALPHABET.find(row["pair"][0]) + 1, ALPHABET.find(row["pair"][1])
            if b >= 0:
                table[a][b] += row["n"]
        counts.append(table)
    sums = [[sum(line) for line in table] for table in counts]
    return [
        math.log(counts[0][a][b] / sums[0][a]) - math.log(counts[1][a][b] / sums[1][a])
        for a in range(width + 1)
        for b in range(width)
    ]


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The table of ratios from labelled samples: generated strings are random, words of the documents are not."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    strings = spark.range(SAMPLE_STRINGS).select(
        F.when(F.col("id") % 2 == 0, F.substring(digest, 1, 40)).otherwise(
            F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 40), "=", "")
        ).alias("token")
    )
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    chosen = docs.where(F.xxhash64(text).cast("double") <= F.lit((2 * share - 1) * 2.0**63))
    plain = F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), f"{HEX}|{ACCESS}", " ")
    tokens = chosen.select(F.explode(F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0))).alias("token"))
    return likelihood_ratios(transitions(strings), transitions(tokens))


def secrets(docs: DataFrame, ratios: list[float], text_col: str = "text", odds: float = PRIOR_ODDS) -> DataFrame:
    """``docs`` with ``secret_base`` (spans of the patterns) and ``secret_spans`` (all spans, sorted).

    A null text is empty. Columns of the input with these names are replaced; all other columns stay as they are.
    """
    own = [F.col(f"`{x}`") for x in docs.columns if x not in ("secret_base", "secret_spans", "__text", "__random")]
    rows = docs.select(*own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    found = [
        spans_sql("__text", "assign", 0, ASSIGN, "__text RLIKE '[:=]'", "length({v}) >= 12", 1),
        spans_sql("__text", "access", 1, ACCESS, "instr(__text, 'AKIA') > 0"),
        spans_sql("__text", "hex", 2, HEX, f"__text RLIKE '{HEX}'"),
    ]
    width = len(ALPHABET)
    place = "instr('" + ALPHABET + "', substr({v}, {i}, 1))"
    before = "if(i = 1, 0, " + place.replace("{i}", "i - 1") + ")"
    table = "array(" + ", ".join(f"{x:.9g}D" for x in ratios) + ")"
    score = (
        f"aggregate(sequence(1, length({{v}})), 0D, (t, i) -> t + element_at({table}, "
        f"{before} * {width} + {place.replace('{i}', 'i')}))"
    )
    looks = spans_sql("__text", "random", 3, STRING, f"__text RLIKE '{STRING}'", f"{score} >= {math.log(odds)}D")
    based = rows.withColumn("secret_base", F.expr(f"array_sort(concat({', '.join(found)}))")).withColumn("__random", F.expr(looks))
    fresh = "filter(__random, r -> NOT exists(secret_base, b -> r.start < b.end AND r.end > b.start))"
    return based.withColumn("secret_spans", F.expr(f"array_sort(concat(secret_base, {fresh}))")).select(
        *own, "secret_base", "secret_spans"
    )
