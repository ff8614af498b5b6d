"""Suppliers as entities in the order in which their names arrive.

A name joins the entity that holds the most similar earlier name, if that similarity is at least `ENTITY`; of equally similar
entities the one opened first; else it opens one. Since an entity's similarity is that of its best member, a name only has to
know its most similar earlier names (`nearest_earlier`), and its entity is the first opened of theirs. So no name waits for
another one to be compared: the links to the nearest earlier names form trees and ties, most of which have one opening name,
which all of the tree belongs to. Only where ties lead to several opening names are entities handed down link by link.

Names of equal words in any order are one name (their similarity is 1). A name without words, as one of legal forms only,
resembles nothing and is an entity of its own; null and empty names are `Unknown`. Ids must be distinct.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deletions import LONGEST, shared
from .entities import ENTITY, candidates, cut, indel_ratio, name_words, sorted_form

#: What an empty name is called; links that entities are handed down between two checkpoints.
UNKNOWN = "Unknown"
STEPS = 4


def word_key(name: Column) -> Column:
    """The words of a name's normal form in order: equal for names of similarity 1."""
    return F.array_join(F.array_sort(name_words(name)), " ")


def nearest_earlier(names: DataFrame, least: float = ENTITY) -> DataFrame:
    """(id, other, score): for each of (id, name) the earlier names (smaller ids) of the highest similarity, `least` or more.

    Names that leave the same text with one, then two characters deleted of either meet by that text's key. That settles a name
    if none that can't leave one would be as similar: the most similar of those has `most` + 1 characters more, and a
    similarity of 2 n / (2 n + `most` + 1). Only the names still open are compared with all, by what they would have to beat.
    """
    names = names.where("name is not null").repartition(names.sparkSession.sparkContext.defaultParallelism, "id")
    known = cut(names.select("id", sorted_form(F.col("name")).alias("form")))
    asking, done = known.withColumn("low", F.lit(least)), []
    for most in (1, 2):
        met = highest(shared(known.join(asking.select("id", "low"), "id", "left"), most, least))
        forms = lambda key, name: known.select(F.col("id").alias(key), F.col("form").alias(name))
        told = cut(met.join(forms("id", "a"), "id").join(forms("other", "b"), "other").select("id", "other", "score", (ratio("a", "b") == F.col("score")).alias("sure")))
        found = told.groupBy("id").agg(F.max("score").alias("score"), F.min("sure").alias("sure"))
        n = F.length("form")
        beyond = 2 * n / (2 * n + most + 1)
        beaten = F.when(F.col("sure"), F.col("score") > beyond).otherwise(F.lit(False)) | (F.col("sure").isNull() & (beyond < F.col("low")))
        seen = cut(asking.join(found, "id", "left").withColumn("settled", (n <= LONGEST - most) & beaten))
        done.append(told.join(seen.where("settled").select("id"), "id", "left_semi").select("id", "other", "score"))
        asking = seen.where("not settled").select("id", "form", F.when(F.col("sure"), F.col("score")).otherwise(F.col("low")).alias("low"))
    every = known.select(F.col("id").alias("vendor_id"), F.col("form").alias("vendor"))
    rest = candidates(asking.select("id", F.col("form").alias("name"), "low"), every, least, best=True, earlier=True)
    return cut(reduce(DataFrame.union, done, highest(rest.withColumnRenamed("vendor_id", "other"))))


def highest(pairs: DataFrame) -> DataFrame:
    """The pairs (id, other, score) of the highest score of their id, each once."""
    pairs = cut(pairs)
    return pairs.join(pairs.groupBy("id").agg(F.max("score").alias("score")), ["id", "score"]).select("id", "other", "score").distinct()


def ratio(a: str, b: str) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series(map(indel_ratio, x, y), dtype=float), "double")(a, b)


def first_opened(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, entity) of all `ids`: the smallest id without links of its own that the links (id, other) lead to.

    Names of one link are led to the first name that has none or several, in steps that double; between those few, the smallest
    id is handed down link by link. Links must lead to smaller ids, so there is no circle.
    """
    of = links.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("other"))
    at = cut(ids.join(of, "id", "left").select("id", F.when(F.col("n") == 1, F.col("other")).otherwise(F.col("id")).alias("at"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("long").alias("was")))
    while not at.where("not at <=> was").isEmpty():
        after = at.select("id", "at", "n", F.col("at").alias("was"))
        for _ in range(2):
            after = after.join(after.select(F.col("id").alias("at"), F.col("at").alias("far")), "at").select("id", F.col("far").alias("at"), "n", "was")
        at = cut(after)
    edges = cut(links.join(at.where("n > 1").select("id"), "id").join(at.select(F.col("id").alias("other"), "at"), "other").select("id", F.col("at").alias("other")).distinct())
    now = cut(at.where("n <> 1").select("id", F.when(F.col("n") == 0, F.col("id")).alias("entity"), F.lit(None).cast("long").alias("was")))
    while not now.where("not entity <=> was").isEmpty():
        after = now.select("id", "entity", F.col("entity").alias("was"))
        for _ in range(STEPS):
            told = edges.join(after.select(F.col("id").alias("other"), "entity"), "other").groupBy("id").agg(F.min("entity").alias("told"))
            after = after.join(told, "id", "left").select("id", F.least("entity", "told").alias("entity"), "was")
        now = cut(after)
    return at.select("id", "at").join(now.select(F.col("id").alias("at"), "entity"), "at").select("id", "entity")


def linked_suppliers(names: DataFrame, least: float = ENTITY) -> DataFrame:
    """id, entity (the id that opened it) for each of (id, name), in the order of the ids."""
    said = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", UNKNOWN).otherwise(F.col("name"))
    keyed = cut(names.select("id", word_key(said).alias("key")))
    one = cut(keyed.groupBy("key").agg(F.min("id").alias("id")))
    links = nearest_earlier(one.where("key <> ''").select("id", F.col("key").alias("name")), least)
    entity = first_opened(one.select("id"), links)
    return keyed.join(one.withColumnRenamed("id", "first"), "key").join(entity.withColumnRenamed("id", "first"), "first").select("id", "entity")


def entity_list(names: DataFrame, linked: DataFrame) -> DataFrame:
    """entity, canonical (its first name), variations (the first name of each normal form, by arrival), invoices."""
    said = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", UNKNOWN).otherwise(F.col("name"))
    met = names.select("id", said.alias("name"), word_key(said).alias("key")).join(linked, "id")
    forms = met.groupBy("entity", "key").agg(F.min(F.struct("id", "name")).alias("first"), F.count(F.lit(1)).alias("n"))
    of = forms.groupBy("entity").agg(F.array_sort(F.collect_list("first"))["name"].alias("variations"), F.sum("n").alias("invoices"))
    return of.select("entity", F.get("variations", F.lit(0)).alias("canonical"), "variations", "invoices")
