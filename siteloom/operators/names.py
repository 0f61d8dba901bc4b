"""Joining misspelt names by the ratio of what they share.

The ratio is that of ``difflib``: twice the letters in common, counted by the
longest run first and then on both sides of it, over the letters of both. It
can be met only by names that share a rare pair of letters: of names a and b
with T letters, M in common and so T - 2 M unshared ones, the common runs hold
M - (T - 2 M + 1) pairs at least. So each name emits just its rarest pairs,
as many as may be missing and one more, and names meet on those and on
their length. Names of fewer than two letters meet only as equals.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.operators.ranking import if_small

RATIO = 0.9


@F.pandas_udf(T.DoubleType())
def ratio(names: pd.Series, typed: pd.Series) -> pd.Series:
    """``difflib``'s ratio of a name to what was typed."""
    from difflib import SequenceMatcher

    matcher = SequenceMatcher()
    out = []
    for name, text in zip(names, typed, strict=True):
        matcher.set_seq2(text)
        matcher.set_seq1(name)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


def pairs_needed(n: int, cutoff: float) -> int:
    """The least pairs of letters that a name of ``n`` letters shares with any name it is alike to."""
    share = cutoff / 2
    shortest = n + math.ceil(share * n / (1 - share) - 1e-9)  # letters of both, where the other one is as short as can be
    return min(3 * math.ceil(share * total - 1e-9) - total - 1 for total in range(shortest, shortest + 40))


def _emitted(length: Column, cutoff: float, longest: int = 64) -> Column:
    """How many of its rarest pairs a name emits."""
    out = length  # all of them, where a name is so long or the cutoff so low that no pair is certain
    for n in range(2, longest + 1):
        need = pairs_needed(n, cutoff)
        out = F.when(length == n, max(1, n - 1 - need + 1) if need > 0 else n).otherwise(out)
    return out


def _numbered_pairs(name: str) -> Column:
    """Pairs of letters of a name, each with its number among the same ones before it."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(F.col(name), i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))


def alike(typed: DataFrame, names: DataFrame, cutoff: float = RATIO) -> DataFrame:
    """(typed, name, ratio): for each of ``typed`` its most alike name of at least that ratio, of equal ones the last by letter."""
    if not 0.7 < cutoff <= 1:
        raise ValueError("below 0.7 names need not share a pair of letters")
    left, right = typed.select("typed").distinct(), names.select("name").distinct()
    tokens = lambda d, c: d.where(F.length(c) > 1).select(F.col(c).alias("text"), F.explode(_numbered_pairs(c)).alias("pair"))
    counts = if_small(tokens(left, "typed").unionByName(tokens(right, "name")).groupBy("pair").agg(F.count("*").alias("n")))

    def rare(d: DataFrame, c: str) -> DataFrame:
        ranked = tokens(d, c).join(counts, "pair").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("own"))
        return ranked.select("text", F.length("text").alias("letters"), F.explode(F.slice("own", F.lit(1), _emitted(F.length("text"), cutoff))).alias("o")).select("text", "letters", F.col("o.pair").alias("pair"))

    a, b = rare(left, "typed").withColumnRenamed("text", "typed"), rare(right, "name").select(F.col("text").alias("name"), F.col("letters").alias("others"), "pair")
    share = cutoff / 2
    near = (F.col("others") * (1 - share) >= F.col("letters") * share - 1e-9) & (F.col("letters") * (1 - share) >= F.col("others") * share - 1e-9)
    met = a.join(b, "pair").where(near).select("typed", "name").distinct()
    same = left.join(right, F.col("typed") == F.col("name")).where(F.length("typed") < 2).select("typed", "name")
    scored = met.unionByName(same).withColumn("ratio", ratio("name", "typed")).where(F.col("ratio") >= cutoff)
    best = scored.groupBy("typed").agg(F.max(F.struct("ratio", "name")).alias("best"))
    return best.select("typed", F.col("best.name").alias("name"), F.col("best.ratio").alias("ratio"))


def resolved(rows: DataFrame, names: DataFrame, aliases: dict[str, str], combined: str, cutoff: float = RATIO) -> DataFrame:
    """``rows`` (district and more) with ``name`` and ``how``: exact, alias or fuzzy; or null with combo, empty or unmatched.

    Districts and names are compared by their letters a to z alone. A district
    that the pattern ``combined`` finds to name several is dropped.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    known = names.select("name").distinct()
    spelt = rows.select("district").distinct().withColumn("typed", plain(F.col("district")))
    renamed = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    dropped = F.when(F.coalesce(F.col("district"), F.lit("")).rlike(combined), "combo").when(F.col("typed") == "", "empty")
    spelt = spelt.withColumn("dropped", dropped).withColumn("sought", F.coalesce(F.element_at(renamed, F.col("typed")), F.col("typed")))
    exact = spelt.join(known.withColumn("exact", F.col("name")), F.col("sought") == F.col("name"), "left").drop("name")
    rest = exact.where("exact IS NULL AND dropped IS NULL").select(F.col("sought").alias("typed"))
    fuzzy = alike(rest, known, cutoff).select(F.col("typed").alias("sought"), F.col("name").alias("fuzzy"))
    found = exact.join(fuzzy, "sought", "left")
    name = F.when(F.col("dropped").isNull(), F.coalesce("exact", "fuzzy"))
    how = F.coalesce("dropped", F.when(F.col("exact").isNotNull(), F.when(F.col("sought") != F.col("typed"), "alias").otherwise("exact")).when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("unmatched"))
    each = found.select(F.col("district").alias("spelling"), name.alias("name"), how.alias("how"))
    return rows.join(each, rows["district"].eqNullSafe(each["spelling"])).drop("spelling")
