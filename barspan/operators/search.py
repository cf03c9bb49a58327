"""Fuzzy instrument search as a batch: a table of queries against the whole master.

A token can only match a text that holds one of its pieces unchanged: four pieces survive
three gaps or two edits, the letters of a shorter token one edit. So distinct tokens and
distinct texts meet in a hash join on pieces, and only those pairs are scored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspan.operators.tables import top_rows

# Layer scores, field weights and limits of the matcher.
EXACT, PREFIX, CONTAINS, SUBSEQUENCE, FUZZY_1, FUZZY_2 = 1000, 800, 600, 400, 200, 100
GAP_PENALTY, CONTAINS_CAP, MAX_TOKEN, MAX_FUZZY_TOKEN = 40, 50, 12, 8
WEIGHTS = {"name": 1.0, "code": 1.0, "code_full": 1.0, "code_flat": 1.0, "industry": 0.9, "area": 0.85}


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, lower case: the JVM's functions offer no normal form."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s).lower())


def normalized(col) -> Column:
    """Compatibility normal form, lower case, null as empty."""
    return _nfkc(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


def _gaps(token: Column, text: Column) -> Column:
    """Characters skipped by the leftmost subsequence match, or null."""
    letters = F.filter(F.split(token, ""), lambda x: x != "")
    pattern = F.concat_ws(".*?", F.transform(letters, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))))
    return F.length(F.regexp_substr(text, pattern)) - F.length(token)


def _bit(place) -> Column:
    return F.call_function("shiftleft", F.lit(1), place)


def _distance(token: Column, text: Column) -> Column:
    """Smallest edit distance between ``token`` and any substring of ``text``.

    Bit-parallel: a column of the distance table is two masks of vertical steps, and a letter of the text
    moves them with a few operations whatever the token holds. Tokens have at most 8 letters.
    """
    n = F.length(token)
    full, top = _bit(n) - 1, _bit(n - 1)
    spots = F.sequence(F.lit(1), n)

    def equal(c):
        """Places of the token that hold the letter."""
        return F.aggregate(spots, F.lit(0), lambda acc, i: acc + F.when(F.substr(token, i, F.lit(1)) == c, _bit(i - 1)).otherwise(0))

    def step(acc, c):
        up, down = acc["up"], acc["down"]
        x = acc["eq"].bitwiseOR(down)
        diagonal = ((up + x.bitwiseAND(up)).bitwiseXOR(up)).bitwiseOR(x).bitwiseAND(full)
        left = up.bitwiseAND(diagonal)
        right = down.bitwiseOR(F.bitwise_not(up.bitwiseOR(diagonal)).bitwiseAND(full))
        score = acc["score"] + F.when(right.bitwiseAND(top) != 0, 1).when(left.bitwiseAND(top) != 0, -1).otherwise(0)
        shifted = F.shiftleft(right, 1).bitwiseAND(full)
        return F.struct(
            F.shiftleft(left, 1).bitwiseOR(F.bitwise_not(shifted.bitwiseOR(diagonal))).bitwiseAND(full).alias("up"),
            shifted.bitwiseAND(diagonal).alias("down"),
            score.alias("score"),
            F.least(acc["best"], score).alias("best"),
            F.lit(0).alias("eq"),
        )

    def load(acc, c):
        return F.struct(acc["up"].alias("up"), acc["down"].alias("down"), acc["score"].alias("score"), acc["best"].alias("best"), equal(c).alias("eq"))

    start = F.struct(full.alias("up"), F.lit(0).alias("down"), n.alias("score"), n.alias("best"), F.lit(0).alias("eq"))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, start, lambda acc, c: step(load(acc, c), c), lambda acc: acc["best"])


def _near(token: Column, text: Column, d: int) -> Column:
    """Is some substring of ``text`` within ``d`` edits of ``token``?"""
    return _distance(token, text) <= d


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def layer_score(token: Column, text: Column) -> Column:
    """Score of the best layer on which a token matches a text, before field weights.

    Long tokens match as they stand or not at all; gaps and edits are for short ones.
    """
    at = F.instr(text, token) - 1
    n, gaps = F.length(token), _gaps(token, text)
    fuzzy = (n >= 2) & (n <= MAX_FUZZY_TOKEN)
    return (
        F.when(text == "", 0)
        .when(token == text, EXACT)
        .when(at == 0, PREFIX)
        .when(at > 0, CONTAINS - F.least(at, F.lit(CONTAINS_CAP)))
        .when(n > MAX_TOKEN, 0)
        .when((n >= 2) & (gaps <= F.when(n >= 3, 3).otherwise(2)), SUBSEQUENCE - gaps * GAP_PENALTY)
        .when(fuzzy & _near(token, text, 1), FUZZY_1)
        .when(fuzzy & (n >= 6) & _near(token, text, 2), FUZZY_2)
        .otherwise(0)
    )


def _pieces(token: Column) -> Column:
    """Four nearly equal pieces of a token, the letters of one of up to four; three letters of a long one, which must stand unchanged."""
    n = F.length(token)
    k = F.least(n, F.lit(4))

    def cut(i):
        return F.floor(i * n / k).cast("int")

    short = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substr(token, cut(i) + 1, cut(i + 1) - cut(i)))
    return F.when(n > MAX_TOKEN, F.array(F.substr(token, F.lit(1), F.lit(3)))).otherwise(short)


def _grams(text: Column) -> Column:
    """Distinct substrings of up to three letters, the longest a piece can be."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def of_length(m):
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(m)))

    runs = [of_length(m) for m in (1, 2, 3)]
    return F.array_distinct(F.filter(F.concat(*runs), lambda g: g != ""))


#: Texts of one task that hold the same piece.
TEXTS_PER_TASK = 20_000


def _met(by_piece: DataFrame, by_gram: DataFrame) -> DataFrame:
    """Tokens and texts with a piece in common; a piece that very many texts hold, a single letter say, is spread over tasks."""
    held = by_gram.join(by_piece.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("_texts"))
    spread = by_piece.join(held, "piece").withColumn("_salts", F.ceil(F.col("_texts") / TEXTS_PER_TASK).cast("int"))
    sizes = spread.select("piece", "_salts").distinct().where("_salts > 1")
    spread = spread.select("piece", "token", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    grams = by_gram.join(sizes, "piece", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("body"), F.col("_salts")).cast("int"), F.lit(0)))
    return spread.join(grams.drop("_salts"), ["piece", "_salt"])


def search(master: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """``queries(query_id, text)`` -> best matches per query: all tokens must score, ties by code.

    A query without tokens lists the first codes with score 0.
    """
    split = queries.select("query_id", F.filter(F.split(normalized("text"), r"\s+"), lambda x: x != "").alias("tokens"))
    asked = split.select("query_id", F.size("tokens").alias("needed"), F.posexplode("tokens").alias("pos", "token"))
    code = normalized("ts_code")
    bodies = {
        "name": normalized("name"),
        "code": F.substring_index(code, ".", 1),
        "code_full": code,
        "code_flat": F.replace(code, F.lit("."), F.lit("")),
        "industry": normalized("industry"),
        "area": normalized("region"),
    }
    fields = master.select(
        "ts_code", F.inline(F.array(*[F.struct(bodies[f].alias("body"), F.lit(w).alias("weight")) for f, w in WEIGHTS.items()]))
    ).where("body <> ''")
    tokens = asked.select("token").distinct()
    by_piece = tokens.select("token", F.explode(F.array_distinct(_pieces(F.col("token")))).alias("piece"))
    by_gram = fields.select("body").distinct().select("body", F.explode(_grams(F.col("body"))).alias("piece"))
    pairs = _met(by_piece, by_gram).select("token", "body").distinct()
    scored = pairs.withColumn("layer", layer_score(F.col("token"), F.col("body"))).where("layer > 0")
    hits = asked.join(scored, "token").join(fields, "body")
    best = hits.groupBy("query_id", "needed", "pos", "ts_code").agg(F.max(_half_up(F.col("layer") * F.col("weight"))).alias("score"))
    total = best.where("score > 0").groupBy("query_id", "needed", "ts_code").agg(F.sum("score").cast("long").alias("score"), F.count(F.lit(1)).alias("_hit"))
    full = total.where(F.col("_hit") == F.col("needed")).select("query_id", "ts_code", "score")
    found = top_rows(full, [F.desc("score"), F.asc("ts_code")], limit, ["query_id"])
    first = master.select("ts_code").orderBy("ts_code").limit(limit).agg(F.sort_array(F.collect_list("ts_code")).alias("c")).select("c").scalar()
    blank = split.where(F.size("tokens") == 0).select("query_id", F.posexplode(first).alias("position", "ts_code"))
    listed = blank.select("query_id", "ts_code", F.lit(0).cast("long").alias("score"), (F.col("position") + 1).alias("position"))
    return found.unionByName(listed)
