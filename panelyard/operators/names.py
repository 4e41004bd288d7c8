"""Entity names that no alias equals: candidates from an inverted index of the aliases' words,
decided by the words alone.

Distinct names are counted first, so the match works on names, not on rows. Of two word sets one
can hold the other only if it holds its rarest word: names meet aliases by the rarest word of
either side, and a word that most aliases share brings nobody together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.joins import normal_name
from panelyard.operators.sizing import null_safe_join

STATUS = ("exact", "words", "contained")


def name_words(
    name: Column, patterns: Sequence[tuple[str, str]] = (), words: Mapping[str, str] | None = None, ignore: Sequence[str] = ()
) -> Column:
    """Sorted distinct words of a name: ``patterns`` are replaced in its normal form, then single
    words by ``words``, then the ``ignore`` ones go."""
    text = normal_name(name)
    for pattern, new in patterns:
        text = F.regexp_replace(text, pattern, new)
    parts = F.filter(F.split(text, " +"), lambda w: w != "")
    if words:
        known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
        parts = F.transform(parts, lambda w: F.coalesce(F.try_element_at(known, w), w))
    if ignore:
        parts = F.filter(parts, lambda w: ~w.isin(list(ignore)))
    return F.array_sort(F.array_distinct(parts))


def match_names(
    df: DataFrame, name: str, aliases: DataFrame, alias: str = "alias", code: str = "countrycode",
    patterns: Sequence[tuple[str, str]] = (), words: Mapping[str, str] | None = None, ignore: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct name: ``name``, ``rows``, ``status``, ``code`` and ``candidates``.

    The first rule that finds anything decides: an alias of the same normal form (``exact``), of
    the same words (``words``), or one whose words hold the name's or are held by them
    (``contained``; the least number of words apart). Several codes there make the name
    ``ambiguous``, none ``unknown``; both have a NULL code. Names without words are unknown.
    """
    rules = (patterns, words, ignore)
    counts = df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("rows"))
    names = counts.select("name", "rows", normal_name(F.col("name")).alias("plain"), name_words(F.col("name"), *rules).alias("own"))
    known = aliases.select(
        normal_name(F.col(alias)).alias("plain"), name_words(F.col(alias), *rules).alias("words"), F.col(code).alias("code")
    ).filter("code IS NOT NULL AND plain <> ''").distinct()

    entries = known.select("words", "code").filter(F.size("words") > 0).distinct()
    index = entries.withColumn("word", F.explode("words"))
    often = index.groupBy("word").agg(F.count("*").alias("often"))
    rarest = F.min_by("word", F.struct("often", "word")).alias("word")
    spelt = names.filter(F.size("own") > 0).select("name", "own", F.explode("own").alias("word"))
    # A name with a word that no alias has cannot be held by one.
    rare_of_name = spelt.join(often, "word").groupBy("name", "own").agg(F.count("*").alias("met"), rarest)
    rare_of_name = rare_of_name.filter(F.col("met") == F.size("own")).drop("met")
    rare_of_alias = index.join(often, "word").groupBy("words", "code").agg(rarest)
    pairs = rare_of_name.join(index, "word").select("name", "own", "words", "code").union(
        spelt.join(rare_of_alias, "word").select("name", "own", "words", "code")
    )
    lost, more = F.size(F.array_except("own", "words")), F.size(F.array_except("words", "own"))
    pairs = pairs.filter((lost == 0) | (more == 0)).select("name", F.when(lost + more == 0, 1).otherwise(2).alias("rule"), (lost + more).alias("apart"), "code")
    exact = names.join(known, "plain").select("name", F.lit(0).alias("rule"), F.lit(0).alias("apart"), "code")

    ranked = exact.union(pairs).groupBy("name", "rule", "apart").agg(F.array_sort(F.collect_set("code")).alias("candidates"))
    best = ranked.groupBy("name").agg(F.min_by(F.struct("rule", "candidates"), F.struct("rule", "apart")).alias("best"))
    found = counts.join(best, "name", "left")
    single = F.size("best.candidates") == 1
    status = F.when(F.col("best").isNull(), "unknown").when(~single, "ambiguous").otherwise(
        F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.col("best.rule") + 1)
    )
    return found.select(
        "name", "rows", status.alias("status"), F.when(single, F.element_at("best.candidates", 1)).alias("code"),
        F.col("best.candidates").alias("candidates"),
    )


def resolve_matched(df: DataFrame, name: str, matches: DataFrame, code: str = "countrycode") -> DataFrame:
    """``df`` with the code that ``match_names`` found for its name, NULL where it found none."""
    return null_safe_join(df, matches.select(F.col("name").alias(name), F.col("code").alias(code)), [name])
