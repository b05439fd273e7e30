"""Corpus profile, near variants, candidate patterns with support, replay percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngram_profile(corpus: DataFrame, top: int, n: tuple[int, ...] = (1,)) -> DataFrame:
    """Ranked word n-grams: key, occurrences, atoms, documents, rank.

    corpus: text (normalized), identity, document_set. An atom is a distinct (identity, document set). Order: atoms,
    occurrences, key. Counts are exact.
    """
    words = F.filter(F.split("text", " +"), lambda w: w != "")
    gram = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    every = F.concat(*(F.when(F.size("w") >= k, gram(k)).otherwise(F.array().cast("array<string>")) for k in n))
    rows = corpus.withColumn("w", words).select("identity", "document_set", F.explode(every).alias("key"))
    per_atom = rows.groupBy("key", "identity", "document_set").agg(F.count("*").alias("n"))
    out = per_atom.groupBy("key").agg(F.sum("n").alias("occurrences"), F.count("*").alias("atoms"), F.count_distinct("document_set").alias("documents"))
    order = [F.desc("atoms"), F.desc("occurrences"), F.asc("key")]
    return out.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def edit_one(a: Column, b: Column) -> Column:
    """Words of at least 8 characters within one edit."""
    return (F.least(F.length(a), F.length(b)) >= 8) & (F.levenshtein(a, b, 1) >= 0)


def near_variants(texts: DataFrame) -> DataFrame:
    """(left, right): distinct texts that are equal but for punctuation, or differ in one word by little.

    Blocking loses nothing. Equal texts without punctuation share that text. Texts of as many words that differ in one
    share the text with that word blanked out; words within one edit share a form with one letter less or none, so they
    also meet by that form; and a word of one letter, of which a block has as many as there are letters, meets all.
    """
    rows = texts.select("text").filter("text is not null").distinct()
    bare = rows.select("text", F.regexp_replace("text", r"(?U)[^\w]", "").alias("block"))
    same = bare.alias("a").join(bare.alias("b"), "block").filter("a.text < b.text").select(F.col("a.text").alias("left"), F.col("b.text").alias("right"))
    words = rows.withColumn("w", F.filter(F.split("text", " +"), lambda x: x != ""))
    holes = words.select("text", F.posexplode("w").alias("at", "word"), "w")
    blank = holes.select("text", F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("at")), F.array(F.lit("\u0000")), F.slice("w", F.col("at") + 2, F.size("w")))).alias("block"), "at", "word")
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    forms = blank.filter(F.length("word") >= 8).select("text", "block", "at", "word", F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("form"))
    edited = forms.alias("a").join(forms.alias("b"), ["block", "at", "form"]).filter("a.text < b.text").filter(edit_one(F.col("a.word"), F.col("b.word")))
    letters = blank.filter(F.length("word") == 1).alias("a").join(blank.alias("b"), ["block", "at"]).filter("a.text <> b.text")
    each = lambda pairs: pairs.select(F.least("a.text", "b.text").alias("left"), F.greatest("a.text", "b.text").alias("right"))
    return same.unionByName(each(edited)).unionByName(each(letters)).distinct()


def candidates(corpus: DataFrame, scope: list[str], least: int = 3) -> DataFrame:
    """Patterns (scope, skeleton) with support: atoms, documents and one outcome.

    corpus: the scope columns, skeleton, identity, document_set, outcome, resolution. Only confirmed atoms with a single
    outcome support a pattern; patterns with fewer atoms than `least`, or several outcomes, go.
    """
    confirmed = corpus.filter("resolution = 'confirmed' and outcome is not null")
    atom = confirmed.groupBy(*scope, "skeleton", "identity", "document_set").agg(F.count_distinct("outcome").alias("n"), F.min("outcome").alias("outcome")).filter("n = 1")
    out = atom.groupBy(*scope, "skeleton").agg(F.count("*").alias("support_atoms"), F.count_distinct("document_set").alias("documents"), F.count_distinct("outcome").alias("outcomes"), F.min("outcome").alias("outcome"))
    return out.filter((F.col("support_atoms") >= least) & (F.col("outcomes") == 1)).drop("outcomes")


def evaluate_candidates(corpus: DataFrame, found: DataFrame, scope: list[str]) -> DataFrame:
    """Per pattern: matched, supporting and contradicting atoms, and the agreement as numerator and denominator."""
    facts = corpus.groupBy(*scope, "skeleton", "identity", "document_set").agg(F.min("outcome").alias("actual"), F.bool_or(F.col("resolution") == "confirmed").alias("confirmed"))
    keys = [*scope, "skeleton"]
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    rows = found.alias("c").join(facts.alias("f"), same)
    yes, no = F.col("f.confirmed") & (F.col("f.actual") == F.col("c.outcome")), F.col("f.confirmed") & (F.col("f.actual") != F.col("c.outcome"))
    out = rows.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).agg(F.count("*").alias("matched"), F.count_if(yes).alias("support"), F.count_if(no).alias("contradictions"))
    return out.withColumn("agreement_numerator", F.col("support")).withColumn("agreement_denominator", F.col("support") + F.col("contradictions"))


def nearest_rank(samples: DataFrame, column: str, percentiles: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """The ceil(p n / 100)-th smallest sample for each percentile, per group."""
    exprs = [F.expr(f"percentile_disc({p / 100}) within group (order by {column})").alias(f"p{p}") for p in percentiles]
    return samples.filter(F.col(column).isNotNull()).groupBy(*(by or [])).agg(*exprs)


def contradictions(edges: DataFrame) -> DataFrame:
    """Unordered pairs with a must_link and a cannot_link or hard_negative (edges: left, right, relation)."""
    pair = edges.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "relation")
    out = pair.groupBy("left", "right").agg(F.bool_or(F.col("relation") == "must_link").alias("must"), F.bool_or(F.col("relation").isin("cannot_link", "hard_negative")).alias("cannot"))
    return out.filter("must and cannot").select("left", "right")


def queue_order(items: DataFrame, descending: list[str], key: str) -> DataFrame:
    """Items with their place in a total order: descending scores, then the key.

    Sorted by range; a partition's places follow those of the partitions before it, of which only the sizes meet.
    """
    order = [*(F.desc(c) for c in descending), F.asc(key)]
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = items.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return placed.join(before, "_part").withColumn("place", F.col("place") + F.col("_before")).drop("_part", "_before")
