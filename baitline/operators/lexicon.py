"""Words and names of a table of any size found in texts and labels.

``with_word_hits`` finds all words of a dictionary in one pass over each text,
by an Aho-Corasick automaton.  ``nearest_names`` finds the closest names within
an edit distance by an index of deletions.  Both meet their table by its size:
the automaton is sent to the tasks in parts of bounded size, the index is an
equi-join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from .suffix import split_host_by

#: Bytes of words that one automaton may hold.
PART_BYTES = 32 << 20


def with_word_hits(df: DataFrame, text: str, words: DataFrame, out: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add ``out``: the distinct words (column ``word`` of ``words``) that occur anywhere in ``text``, in order.

    Case is ignored.  Null and empty words are left out, null texts hold none.
    Words of over ``part_bytes`` bytes are dealt over several automata; a text
    then passes each of them, still within its row.  No row is moved.
    """
    lowered = words.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    size = lowered.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    found = df.withColumn("_hits", F.array().cast("array<string>")).withColumn("_text", F.lower(F.coalesce(F.col(text), F.lit(""))))
    for part in range(parts):
        mine = lowered.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        # about ``part_bytes`` bytes, whatever the dictionary's size
        found = found.mapInArrow(_search([r["word"] for r in mine.collect()]), found.schema)
    return found.select(*df.columns, F.array_sort("_hits").alias(out))


def _search(words: list[str]):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            before = batch.column("_hits").to_pylist()
            hits = [old + list({word for _, word in automaton.iter(t)}) if words and t else old for t, old in zip(texts, before)]
            at = batch.schema.get_field_index("_hits")
            yield batch.set_column(at, "_hits", pa.array(hits, pa.list_(pa.string())))

    return run


def join_keyword_table(urls: DataFrame, words: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per word of the table: rows and distinct URLs that contain it; words without any are not listed.

    Equal URLs are folded first, so a URL that a third of all rows share is searched once.
    """
    distinct = urls.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    hits = with_word_hits(distinct, "url", words, "keyword", part_bytes)
    per_word = hits.select("n", F.explode("keyword").alias("keyword")).groupBy("keyword")
    return per_word.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("urls"))


def deletions(name: Column, within: int) -> Column:
    """The name and all strings that are left when up to ``within`` (1 or 2) characters are taken out."""
    def without_one(text: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda _: F.length(text) > 0)
        return F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))

    once = F.array_distinct(without_one(name))
    every = F.concat(F.array(name), once)
    if within > 1:
        every = F.concat(every, F.flatten(F.transform(once, without_one)))
    return F.array_distinct(every)


def nearest_names(labels: DataFrame, names: DataFrame, max_distance: int = 2) -> DataFrame:
    """Per distinct label that is near a name and not one itself: label, name, distance.

    labels: ``label``; names: ``name`` and ``place``, which breaks ties (then
    the name).  Two strings within edit distance d share a string left when at
    most d characters are taken out of each, so candidates are an equi-join on
    those; the exact distance decides.  Labels too long or short for any name
    are left out before.
    """
    if max_distance not in (1, 2):
        raise ValueError("max_distance must be 1 or 2")
    known = names.filter("name <> ''").groupBy(F.lower("name").alias("name")).agg(F.min("place").alias("place"))
    low, high = known.agg(F.min(F.length("name")), F.max(F.length("name"))).first()
    asked = labels.select(F.lower("label").alias("label")).filter("label <> ''").distinct()
    asked = asked.filter(F.length("label").between((low or 0) - max_distance, (high or 0) + max_distance))
    asked = asked.join(known.select(F.col("name").alias("label")), "label", "left_anti")
    left = asked.select("label", F.explode(deletions(F.col("label"), max_distance)).alias("_left"))
    right = known.select("name", "place", F.explode(deletions(F.col("name"), max_distance)).alias("_left"))
    distance = F.levenshtein("label", "name", max_distance)
    met = left.join(right, "_left").select("label", "name", "place").distinct().withColumn("distance", distance)
    best = F.min(F.struct("distance", "place", "name")).alias("_best")
    return met.filter(F.col("distance") > 0).groupBy("label").agg(best).select("label", "_best.name", "_best.distance")


def join_typosquat_table(
    urls: DataFrame, names: DataFrame, max_distance: int = 2, suffixes: DataFrame | None = None
) -> DataFrame:
    """Nearest name of a table to the domain label of each URL: label, typosquat_target, typosquat_distance (0: none)."""
    hosted = urls.withColumn("_host", U.registry_host(F.col("url")))
    split = split_host_by(hosted, "_host", suffixes, "label", "_suffix", "_n").select(*urls.columns, "label")
    near = nearest_names(split.select("label"), names, max_distance).select(
        F.col("label").alias("_label"), F.col("name").alias("typosquat_target"), F.col("distance").alias("_distance"))
    joined = split.join(near, F.lower("label") == F.col("_label"), "left")
    return joined.select(*urls.columns, "label", "typosquat_target", F.coalesce("_distance", F.lit(0)).alias("typosquat_distance"))
