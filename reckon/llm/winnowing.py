"""Operator 5, line dedup: winnowing over line hashes. DataFrame functions only.

The lines with a word of a text form a sequence of hashes with word counts. A run is lines that follow each other
and hold `words` words or more. A window is the shortest run from a line on, or up to a line; every line of a run lies
in a window that lies in the run. A window's fingerprint is its smallest line hash, with its place; neighbouring windows
share theirs, so a text has few. Equal windows have equal fingerprints, so only windows whose fingerprint stands at two
places or more can be copies, and only these are joined, by the hash of their whole content: a fingerprint may occur in
texts that go on differently, and each content is joined with the first place of its own (texts by id, then by line).
Windows that follow each other extend a copy both ways, line by line. A line lies in a copy of an earlier run if
and only if one of its windows has the content of an earlier one; lines in later windows are deleted. Since a deleted
run equals an earlier one, the first of all copies stays, and a group of copies costs its size, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckon.llm.common import cut, parquet

#: Words that a repeated run must hold.
WORDS = 50


def line_words(line: Column) -> Column:
    """Words (separated by ASCII white space) of a line."""
    return F.size(F.filter(F.split(line, "[ \\t\\x0B\\f\\r]+"), lambda w: w != ""))


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside another function's lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marks(sorted_numbers: Column) -> Column:
    """An array of characters, 'F' at each of the ascending distinct numbers, '.' before and between."""
    gap = lambda x, k: F.concat(F.repeat(F.lit("."), (x - F.coalesce(F.get(sorted_numbers, k - 1), F.lit(-1)) - 1).cast("int")), F.lit("F"))
    return F.split(F.array_join(F.transform(sorted_numbers, gap), ""), "")


def line_sequences(docs: DataFrame, words: int) -> DataFrame:
    """place, hashes, counts, nos: the lines with a word of each distinct (id, text), if they hold `words` words.

    counts are cut at `words`, which is as many as a window can ask for; nos are the lines' numbers in the text.
    """
    each = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.xxhash64(x).alias("hash"), line_words(x).alias("words")))
    seq = docs.select("place", F.filter(each, lambda x: x["words"] > 0).alias("seq"))
    seq = seq.filter(F.aggregate("seq", F.lit(0), lambda a, x: a + x["words"]) >= words)
    return seq.select(
        "place",
        F.transform("seq", lambda x: x["hash"]).alias("hashes"),
        F.transform("seq", lambda x: F.least(x["words"], F.lit(words))).alias("counts"),
        F.transform("seq", lambda x: x["no"]).alias("nos"),
    ).groupBy("place").agg(F.min("hashes").alias("hashes"), F.min("counts").alias("counts"), F.min("nos").alias("nos"))


def windows(sequences: DataFrame, words: int) -> DataFrame:
    """place, low, high, mark, at, content: the lines (by number in the sequence), the smallest line hash with its line, and
    the hash of all lines, of the shortest window of `words` words from each line on, and of the shortest one up to each line
    where that is none of the former."""
    flat = sequences.select("place", F.posexplode(F.arrays_zip("hashes", "counts")).alias("no", "x")).select("place", "no", F.col("x.hashes").alias("hash"), F.col("x.counts").alias("words"))
    text = Window.partitionBy("place")
    flat = flat.withColumn("end", F.sum("words").over(text.orderBy("no"))).withColumn("start", F.col("end") - F.col("words")).withColumn("total", F.sum("words").over(text))
    on, upto = text.orderBy("start").rangeBetween(0, words - 1), text.orderBy("end").rangeBetween(1 - words, 0)
    least = lambda lines: F.min(F.struct("hash", "no")).over(lines)
    window = lambda low, high, lines: F.struct(low.alias("low"), high.alias("high"), least(lines)["hash"].alias("mark"), least(lines)["no"].alias("at"), F.xxhash64(F.collect_list("hash").over(lines)).alias("content"))
    first = F.when(F.col("start") + words <= F.col("total"), window(F.col("no"), F.max("no").over(on), on))
    last = F.when(F.col("start") - F.min("start").over(upto) >= words, window(F.min("no").over(upto), F.col("no"), upto))
    return flat.select("place", first.alias("first"), last.alias("last")).select("place", F.explode(F.array("first", "last")).alias("w")).filter("w is not null").select("place", "w.*")


def repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """place, gone: the ascending numbers of the lines that lie in a later copy of a run; texts without are left out."""
    sequences = cut(line_sequences(docs, words))
    found = cut(windows(sequences, words))
    stands = F.struct("place", "at")
    marks = found.groupBy("mark").agg(F.min(stands).alias("first"), F.max(stands).alias("last")).filter("first < last").select("mark")
    near = found.join(marks, "mark", "left_semi")
    first = near.groupBy("content").agg(F.min(F.struct("place", "low")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("content", "first")
    later = near.join(first, "content").filter(F.struct("place", "low") > F.col("first"))
    lines = later.groupBy("place").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("low", "high")))).alias("lines"))
    return lines.join(sequences.select("place", "nos"), "place").select("place", F.array_sort(F.transform("lines", lambda i: F.get("nos", i))).alias("gone"))


def drop_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text's later repeated runs deleted, and long columns n_lines and n_removed.

    Texts are ordered by id (null first), then digest; rows that repeat id and text are one text and change alike. The
    first copy of a run stays, in an earlier text or earlier in the same one. Lines are equal if their 64-bit hashes
    are; lines without a word neither count nor break a run, and stay. Null text stays null (0 lines); an empty
    table gives no rows. Columns of docs named n_lines or n_removed are replaced.
    """
    place = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"))
    gone = repeated_lines(docs.filter(F.col(text_col).isNotNull()).select(place.alias("place"), F.col(text_col).cast("string").alias("text")), words)
    lines = F.split(text_col, "\n")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(*names, place.alias("_place")).alias("own")
    joined = own.join(gone.alias("gone"), F.col("own._place") == F.col("gone.place"), "left")
    left = _bind(_marks(F.col("gone.gone")), lambda marks: F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get(marks, i) != "F", F.lit(True))), "\n"))
    text = F.when(F.col("gone.gone").isNull(), F.col(f"own.{text_col}")).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"own.{c}") for c in names], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone.gone"), F.lit(0)).cast("long").alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(parquet(spark, sf_dir, "documents").select("doc_id", "text"))
