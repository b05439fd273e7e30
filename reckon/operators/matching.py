"""Source to target matching: strategies as equi-joins, status by the best strategy, never by confidence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from reckon.operators.bounded import MOST_ROWS, sent, tidy

#: Strategies from best to worst, with their confidence.
STRATEGIES = {
    "exact_business_key": "1.000000",
    "index_position": "0.980000",
    "object_subobject_position": "0.960000",
    "normalized_name_unit": "0.920000",
    "normalized_name_context": "0.880000",
    "configuration_rule": "0.750000",
    "fuzzy_review": "0.750000",
}
ORDINAL = {name: i for i, name in enumerate(STRATEGIES)}
RULE_CONFIDENCE = {"exact": "0.850000", "prefix": "0.800000", "contains": "0.750000"}
#: Columns that join a pair, by strategy; equality is on non-null values.
KEYS = {
    "exact_business_key": ("object_code", "subobject_code", "position_code", "work_name", "unit"),
    "index_position": ("document_index", "position_code"),
    "object_subobject_position": ("object_code", "subobject_code", "position_code"),
    "normalized_name_unit": ("work_name", "unit"),
}
CONFIDENCE = "decimal(8,6)"
#: Names of a block.
NAME_BLOCK = 2048


def equi_pairs(sources: DataFrame, targets: DataFrame, strategy: str) -> DataFrame:
    """(source_row_id, target_row_id) whose key columns for the strategy are equal; nulls and '' never match."""
    keys = KEYS[strategy]
    filled = " and ".join(f"{k} <> ''" for k in keys)
    return sources.filter(filled).select("source_row_id", *keys).join(targets.filter(filled).select("target_row_id", *keys), list(keys)).select("source_row_id", "target_row_id")


def name_context_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Equal names, and equal objects or equal subobjects: two equi-joins that share no pair."""
    cols = ("work_name", "object_code", "subobject_code")
    s, t = sources.filter("work_name is not null").select("source_row_id", *cols), targets.filter("work_name is not null").select("target_row_id", *cols)
    by_object = s.drop("subobject_code").join(t.drop("subobject_code"), ["work_name", "object_code"])
    rest = s.alias("s").join(t.alias("t"), ["work_name", "subobject_code"]).filter("not coalesce(s.object_code = t.object_code, false)")
    return by_object.select("source_row_id", "target_row_id").unionByName(rest.select("source_row_id", "target_row_id"))


def _counted(rows: DataFrame, keys: Sequence[str], given: str) -> DataFrame:
    """(keys, n): rows by key columns, of those that meet a condition."""
    return rows.filter(given).groupBy(*keys).agg(F.count("*").alias("n"))


def _totals(parts: list[DataFrame]) -> DataFrame:
    """(target_row_id, n): sums over (target_row_id, n) parts, of targets with any."""
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("target_row_id").agg(F.sum("n").alias("n")).filter("n <> 0")


def equi_counts(sources: DataFrame, targets: DataFrame, strategy: str) -> DataFrame:
    """(target_row_id, n): how many pairs equi_pairs gives a target, without making them: sources are counted by key first."""
    keys = KEYS[strategy]
    filled = " and ".join(f"{k} <> ''" for k in keys)
    met = targets.filter(filled).select("target_row_id", *keys).join(_counted(sources, keys, filled), list(keys))
    return _totals([met.select("target_row_id", "n")])


def name_context_counts(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_row_id, n): how many pairs name_context_pairs gives a target, without making them.

    Sources are counted by name and object, and by name and subobject; those that agree in both are in both counts, so they
    are counted by all three and taken off once.
    """
    parts = []
    for keys, sign in ((["object_code"], 1), (["subobject_code"], 1), (["object_code", "subobject_code"], -1)):
        keys = ["work_name", *keys]
        met = targets.select("target_row_id", *keys).join(_counted(sources, keys, " and ".join(f"{k} is not null" for k in keys)), keys)
        parts.append(met.select("target_row_id", (F.col("n") * sign).alias("n")))
    return _totals(parts)


def _unit_ok(clause: str, unit: Column) -> Column:
    allowed, excluded = F.col(f"{clause}.source_units"), F.col(f"{clause}.excluded_units")
    return ((F.size(allowed) == 0) | F.coalesce(F.array_contains(allowed, unit), F.lit(False))) & ~F.coalesce(F.array_contains(excluded, unit), F.lit(False))


def clause_matches(clause: str, name: Column, unit: Column) -> Column:
    """Whether a rule clause (struct or alias) holds for a normalized name and unit."""
    literal, kind = F.col(f"{clause}.literal"), F.col(f"{clause}.match_kind")
    hit = F.when(kind == "exact", name == literal).when(kind == "prefix", name.startswith(literal)).otherwise(name.contains(literal))
    required = F.forall(f"{clause}.required_substrings", lambda x: name.contains(x))
    forbidden = F.exists(f"{clause}.forbidden_substrings", lambda x: name.contains(x))
    return F.coalesce(hit, F.lit(False)) & _unit_ok(clause, unit) & required & ~forbidden


def _listed(rule: str, allowed: str, value: Column) -> Column:
    return (F.size(F.col(f"{rule}.{allowed}")) == 0) | F.coalesce(F.array_contains(F.col(f"{rule}.{allowed}"), value), F.lit(False))


def target_scope(rule: str, object_code: Column, stage: Column, process: Column) -> Column:
    """An empty list allows any value; otherwise the target's value must be present and listed."""
    return _listed(rule, "object_scopes", object_code) & _listed(rule, "stages", stage) & _listed(rule, "target_processes", process)


def scope_matches(rule: str, object_code: Column, stage: Column, process: Column, unit: Column) -> Column:
    """A rule's whole scope: the target's part, and the source unit."""
    return target_scope(rule, object_code, stage, process) & _listed(rule, "scope_units", unit)


def rule_pairs(sources: DataFrame, targets: DataFrame, clauses: DataFrame) -> DataFrame:
    """Pairs that an approved rule's clause joins, with rule_ids, blockers, manual and confidence.

    clauses: the rule table, one row a clause; it is configuration (files up to 1 MiB) whose size is checked before it is sent to
    all executors. Sources meet clauses by name and unit, targets meet them by scope, and the two meet by clause: an
    equi-join that makes the wanted pairs and no others. A clause with very many sources is a skewed key that adaptive
    execution splits.
    """
    live = clauses.filter("owner_approved and status = 'approved'").withColumn("clause", F.xxhash64(F.to_json(F.struct(*clauses.columns))))
    live = sent(live, "rule clauses").alias("c")
    hit = sources.alias("s").join(live, clause_matches("c", F.col("s.work_name"), F.col("s.unit")) & _listed("c", "scope_units", F.col("s.unit"))).select("s.source_row_id", "c.clause", "c.rule_id", "c.action", "c.match_kind")
    meant = targets.alias("t").join(live, target_scope("c", F.col("t.object_code"), F.col("t.stage"), F.col("t.work_name"))).select("t.target_row_id", "c.clause")
    pairs = hit.join(meant, "clause")
    sure = F.lit("0").cast(CONFIDENCE)
    for kind, value in RULE_CONFIDENCE.items():
        sure = F.when(F.col("match_kind") == kind, F.lit(value).cast(CONFIDENCE)).otherwise(sure)
    return pairs.groupBy("source_row_id", "target_row_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set(F.when(F.col("action") == "exclude", F.concat(F.lit("EXCLUDE:"), "rule_id")))).alias("blockers"),
        F.bool_or(F.col("action") == "needs_review").alias("manual"),
        F.max(sure).alias("rule_confidence"),
    )


#: Clauses that one word of a clause set holds.
WORD = 63


def numbered(clauses: DataFrame) -> tuple[DataFrame, int]:
    """The approved clauses (configuration, behind a check of their size), each with a bit (word, flag), and the number of words."""
    live = clauses.filter("owner_approved and status = 'approved'")
    sent(live, "rule clauses")
    rows = live.collect()
    schema = StructType([*live.schema.fields, StructField("at", LongType()), StructField("word", IntegerType()), StructField("flag", LongType())])
    table = clauses.sparkSession.createDataFrame([(*r, i, i // WORD, 1 << i % WORD) for i, r in enumerate(rows)], schema)
    return F.broadcast(table), max(1, -(-len(rows) // WORD))


def _words(side: str, n: int) -> list[str]:
    return [f"{side}{k}" for k in range(n)]


def _clause_set(side: str, n: int) -> list[Column]:
    """Aggregates: the set of a group's clauses, in n words."""
    return [F.bit_or(F.when(F.col("word") == k, F.col("flag")).otherwise(0)).alias(w) for k, w in enumerate(_words(side, n))]


def rule_profiles(sources: DataFrame, targets: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rule_pairs says of a target, without making the pairs.

    Sources are counted by the set of clauses that they meet, targets have the set of clauses that mean them, and sets meet
    sets by clause. First table: target_row_id and its set (words). Second, by set: n_sources, rule_ids, rule_confidence,
    blocked, manual (over all pairs of a target); n_blocked pairs, n_free pairs that may be chosen, and first_free, the
    least source of these.
    """
    live, n = numbered(clauses)
    live = live.alias("c")
    s, t = _words("_s", n), _words("_t", n)
    meets = clause_matches("c", F.col("s.work_name"), F.col("s.unit")) & _listed("c", "scope_units", F.col("s.unit"))
    found = sources.select("source_row_id", "work_name", "unit").alias("s").join(live, meets).groupBy("source_row_id").agg(*_clause_set("_s", n))
    found = found.groupBy(*s).agg(F.count("*").alias("n"), F.min("source_row_id").alias("first"))
    meant = targets.alias("t").join(live, target_scope("c", F.col("t.object_code"), F.col("t.stage"), F.col("t.work_name"))).groupBy("target_row_id").agg(*_clause_set("_t", n))
    holds = lambda words: F.get(F.array(*words), F.col("c.word")).bitwiseAND(F.col("c.flag")) != 0
    sure = F.lit("0").cast(CONFIDENCE)
    for kind, value in RULE_CONFIDENCE.items():
        sure = F.when(F.col("match_kind") == kind, F.lit(value).cast(CONFIDENCE)).otherwise(sure)
    left = meant.select(*t).distinct().join(live, holds(t)).select(*t, "at", "rule_id", "action", sure.alias("sure"))
    pairs = left.join(found.join(live, holds(s)).select(*s, "n", "first", "at"), "at").groupBy(*t, *s).agg(
        F.max("n").alias("n"), F.max("first").alias("first"), F.collect_set("rule_id").alias("rule_ids"), F.max("sure").alias("sure"),
        F.bool_or(F.col("action") == "exclude").alias("blocked"), F.bool_or(F.col("action") == "needs_review").alias("manual"),
    )
    free = ~F.col("blocked") & ~F.col("manual")
    totals = pairs.groupBy(*t).agg(
        F.sum("n").alias("n_sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids")))).alias("rule_ids"), F.max("sure").alias("rule_confidence"), F.bool_or("blocked").alias("blocked"), F.bool_or("manual").alias("manual"),
        F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("n_blocked"), F.sum(F.when(free, F.col("n")).otherwise(0)).alias("n_free"), F.min(F.when(free, F.col("first"))).alias("first_free"),
    )
    return meant, totals


def rule_totals(sources: DataFrame, targets: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row per target that a rule joins to a source: n_sources, rule_ids, rule_confidence, blocked, manual."""
    meant, totals = rule_profiles(sources, targets, clauses)
    words = [w for w in meant.columns if w != "target_row_id"]
    return meant.join(totals, words).select("target_row_id", "n_sources", "rule_ids", "rule_confidence", "blocked", "manual")


def sequence_ratio(a: str, b: str) -> Decimal:
    """Twice the characters in matching blocks over all characters (longest block first, both sides recursively)."""
    same = sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return (Decimal(2 * same) / Decimal(len(a) + len(b))).quantize(Decimal("0.000001"))


def letter_counts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the counts of characters (dealt to 64 columns by code), and the lengths."""
    out = np.zeros((len(names), 64), dtype=np.uint16)
    for i, name in enumerate(names):
        np.add.at(out[i], np.fromiter(map(ord, name), dtype=np.int64, count=len(name)) % 64, 1)
    return out, np.array([len(x) for x in names])


def fuzzy_names(names_a: DataFrame, names_b: DataFrame, threshold: str = "0.750000") -> DataFrame:
    """(source_name, target_name, score) of distinct, different names with a score of threshold or more.

    Two names of lengths a and b cannot score above 2 min/(a+b), and share at least as many characters (as a
    multiset) as match; both tests come before the score and lose nothing. Lengths are dealt into bands so wide that
    names that can match lie in one band or in neighbours; the names of a band are dealt into blocks of bounded
    size, and blocks meet blocks in tasks of their own. Each distinct pair is scored once.
    """
    least = float(threshold) - 5e-7
    wide = math.log((2 - least) / least)
    names = lambda df, name: df.select(F.col("work_name").alias(name)).filter(F.col(name) != "").distinct().withColumn("band", F.floor(F.log(F.length(name).cast("double")) / wide + 1e-9).cast("int"))
    a, b = names(names_a, "source_name"), names(names_b, "target_name")
    # Blocks of each side by band; there are as many rows as bands.
    blocks = lambda df, out: df.groupBy("band").agg(F.ceil(F.count("*") / NAME_BLOCK).cast("int").alias(out))
    near = F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("other")
    sizes_a, sizes_b = blocks(a, "n_a"), blocks(b, "n_b")
    met = sizes_a.select("band", "n_a", near).join(sizes_b.select(F.col("band").alias("other"), "n_b"), "other")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(met, "band").select("source_name", "band", "other", F.pmod(F.xxhash64("source_name"), F.col("n_a")).cast("int").alias("i"), upto("n_b").alias("j"))
    right = b.join(met.select(F.col("band").alias("own"), F.col("other").alias("band"), "n_a", "n_b"), "band").select("target_name", F.col("own").alias("band"), F.col("band").alias("other"), upto("n_a").alias("i"), F.pmod(F.xxhash64("target_name"), F.col("n_b")).cast("int").alias("j"))

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            sources, targets = x["source_name"].tolist(), y["target_name"].tolist()
            (letters_a, n), (letters_b, m) = letter_counts(sources), letter_counts(targets)
            for name, own, size in zip(sources, letters_a, n):
                shared = np.minimum(own, letters_b).sum(axis=1, dtype=np.int64)
                for j in np.flatnonzero(2 * np.minimum(shared, np.minimum(size, m)) >= least * (size + m)).tolist():
                    if name != targets[j] and (ratio := sequence_ratio(name, targets[j])) >= Decimal(threshold):
                        out.append((name, targets[j], ratio))
        return pd.DataFrame(out, columns=["source_name", "target_name", "score"], dtype=object)

    keys = ["band", "other", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "source_name string, target_name string, score decimal(8,6)")


def fuzzy_pairs(sources: DataFrame, targets: DataFrame, threshold: str = "0.750000") -> DataFrame:
    names = fuzzy_names(sources, targets, threshold)
    hit = sources.select("source_row_id", F.col("work_name").alias("source_name")).join(names, "source_name")
    return hit.join(targets.select("target_row_id", F.col("work_name").alias("target_name")), "target_name").select("source_row_id", "target_row_id", "score")


def candidates(sources: DataFrame, targets: DataFrame, clauses: DataFrame | None = None, fuzzy: str | None = None) -> DataFrame:
    """One row per pair that any strategy joins.

    Columns: source_row_id, target_row_id, strategies (best first), ordinal, confidence, rule_ids, blockers,
    auto_selectable. A pair is not selectable if a rule excludes it or asks for review, or only names alike join it.
    """
    none = F.array().cast("array<string>")

    def shape(df: DataFrame, strategy: str, rule_ids=none, blockers=none, manual=F.lit(False), sure=None) -> DataFrame:
        return df.select("source_row_id", "target_row_id", F.lit(ORDINAL[strategy]).alias("ordinal"), rule_ids.alias("rule_ids"), blockers.alias("blockers"), manual.alias("manual"), (F.lit(STRATEGIES[strategy]).cast(CONFIDENCE) if sure is None else sure).alias("sure"))

    found = [shape(equi_pairs(sources, targets, s), s) for s in KEYS]
    found.append(shape(name_context_pairs(sources, targets), "normalized_name_context"))
    if clauses is not None:
        found.append(shape(rule_pairs(sources, targets, clauses), "configuration_rule", F.col("rule_ids"), F.col("blockers"), F.col("manual"), F.col("rule_confidence")))
    if fuzzy:
        found.append(shape(fuzzy_pairs(sources, targets, fuzzy), "fuzzy_review", sure=F.col("score")))
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    names = F.array(*map(F.lit, STRATEGIES))
    out = rows.groupBy("source_row_id", "target_row_id").agg(
        F.array_sort(F.collect_set("ordinal")).alias("ordinals"), F.min_by("sure", "ordinal").alias("confidence"),
        F.flatten(F.collect_list("rule_ids")).alias("rule_ids"), F.flatten(F.collect_list("blockers")).alias("blockers"), F.bool_or("manual").alias("manual"),
    )
    only_alike = F.col("ordinals") == F.array(F.lit(ORDINAL["fuzzy_review"]))
    return out.select(
        "source_row_id", "target_row_id", F.transform("ordinals", lambda i: F.get(names, i)).alias("strategies"), F.get("ordinals", F.lit(0)).alias("ordinal"),
        "confidence", "rule_ids", "blockers", ((F.size("blockers") == 0) & ~F.col("manual") & ~only_alike).alias("auto_selectable"),
    )


def select_best(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per target: status, source_row_id (of a match), ordinal, warning, n_candidates.

    The lowest ordinal among selectable candidates decides: one candidate there is a match, several are ambiguous.
    Without selectable candidates a target is ambiguous if any candidate is unblocked, else unmatched.
    """
    best = pairs.groupBy("target_row_id").agg(
        F.count("*").alias("n_candidates"),
        F.min(F.when(F.col("auto_selectable"), F.struct("ordinal"))).alias("top"),
        F.bool_or(F.size("blockers") == 0).alias("open"),
    )
    ranked = pairs.filter("auto_selectable").groupBy("target_row_id", "ordinal").agg(F.count("*").alias("n"), F.min("source_row_id").alias("source_row_id"))
    ranked = ranked.groupBy("target_row_id").agg(F.min(F.struct("ordinal", "n", "source_row_id")).alias("b"))
    return targets.select("target_row_id").join(best, "target_row_id", "left").join(ranked, "target_row_id", "left").select("target_row_id", *_status(F.col("b.n"), F.col("b.ordinal"), F.col("b.source_row_id"), F.col("n_candidates"), F.col("open")))


def small(table: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has no more than `most` rows; else itself, and joins shuffle."""
    with tidy(table.sparkSession):
        rows = table.limit(most + 1).collect()
    return table if len(rows) > most else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def repeated_ids(rows: DataFrame, ident: str, looks: Sequence[str]) -> tuple[bool, bool]:
    """Whether ids repeat, and whether rows of one id differ in `looks`. Ids are compared by hash, so a yes may be wrong, a no never."""
    own = F.xxhash64(*(F.coalesce(F.col(x).cast("string"), F.lit("\u0000")) for x in looks))
    by_id = rows.select(F.xxhash64(ident).alias("id"), own.alias("own")).groupBy("id").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
    with tidy(rows.sparkSession):
        found = by_id.filter("n > 1").agg(F.count("*").alias("n"), F.bool_or(F.col("low") != F.col("high")).alias("differ")).first()
    return found.n > 0, bool(found.differ)


LOOKS = ("object_code", "subobject_code", "position_code", "work_name", "unit", "document_index")


def select_by_counts(sources: DataFrame, targets: DataFrame, clauses: DataFrame) -> DataFrame:
    """select_best(targets, candidates(sources, targets, clauses)), without making the pairs.

    Sources are counted by keys, unit and set of clauses: by position, by index, by name and object, by name and subobject,
    by name and unit. A target meets one row of each, a list of counts. Its candidates are those of the rules and, of the
    key strategies, those that no rule joins, each taken from the first list that holds it. Selectable ones are counted by
    strategy; the lowest with any decides, and there no other count can hold a better one. Ids that stand for different
    rows are compared pair by pair.
    """
    again, differ = repeated_ids(sources, "source_row_id", LOOKS)
    if differ or repeated_ids(targets, "target_row_id", LOOKS)[0]:
        return select_best(targets, candidates(sources, targets, clauses))
    if again:
        sources = sources.dropDuplicates(["source_row_id"])
    live, n_words = numbered(clauses)
    live, words, meant = live.alias("c"), _words("_s", n_words), _words("_t", n_words)

    def with_set(rows: DataFrame, keys: list[str], meets: Column, side: str) -> DataFrame:
        """rows with the set of clauses that they meet, told from the keys alone."""
        sets = small(rows.select(*keys).distinct().alias("x").join(live, meets).groupBy(*keys).agg(*_clause_set(side, n_words)))
        sets = sets.select(*(F.col(k).alias(f"_{k}") for k in keys), *_words(side, n_words))
        out = rows.join(sets, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        return out.select(*rows.columns, *(F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in _words(side, n_words)))

    s = with_set(sources.select("source_row_id", *LOOKS), ["work_name", "unit"], clause_matches("c", F.col("x.work_name"), F.col("x.unit")) & _listed("c", "scope_units", F.col("x.unit")), "_s")
    t = with_set(targets.select("target_row_id", "stage", *LOOKS), ["object_code", "stage", "work_name"], target_scope("c", F.col("x.object_code"), F.col("x.stage"), F.col("x.work_name")), "_t")

    filled = lambda keys: " and ".join(f"{k} <> ''" for k in keys)
    present = lambda keys: " and ".join(f"{k} is not null" for k in keys)

    def with_counts(t: DataFrame, rows: DataFrame, keys: list[str], given: str, rest: list[str], few: bool, **found: Column) -> DataFrame:
        """t with what it finds in the list of its keys: counts of sources by the rest of the looks and the set of clauses, with
        the least id. Lists of few kinds are made of partial counts; others of sources dealt by key, which move once."""
        rows = rows.filter(given)
        counts = (rows if few else rows.repartition(*keys)).groupBy(*keys, *rest, *words).agg(F.count("*").alias("n"), F.min("source_row_id").alias("first"))
        lists = counts.groupBy(*keys).agg(F.collect_list(F.struct(*rest, *words, "n", "first")).alias("list"))
        return t.join(small(lists) if few else lists, keys, "left").select(*t.columns, *(x.alias(name) for name, x in found.items()))

    exclude = [0] * n_words
    review = [0] * n_words
    for r in live.filter("action in ('exclude', 'needs_review')").select("action", "word", "flag").collect():
        (exclude if r.action == "exclude" else review)[r.word] |= r.flag
    both = lambda x, k: x[words[k]].bitwiseAND(F.col(meant[k]))
    every = lambda test: [test(k) for k in range(n_words)]

    def all_of(tests: list[Column]) -> Column:
        out = tests[0]
        for other in tests[1:]:
            out = out & other
        return out

    unruled = lambda x: all_of(every(lambda k: both(x, k) == 0))
    free = lambda x: all_of(every(lambda k: both(x, k).bitwiseAND(F.lit(exclude[k] | review[k]).cast("long")) == 0))
    same = lambda x, key: F.coalesce(x[key] == F.col(key), F.lit(False))
    full = lambda *keys: F.coalesce(F.expr(filled(keys)), F.lit(False))
    # Whether a list's source is joined by name and unit; the target's own name and unit are filled if they equal the source's.
    in_unit = lambda x: same(x, "unit") & full("work_name", "unit")
    in_name = lambda x: same(x, "work_name") & (in_unit(x) | same(x, "object_code") | same(x, "subobject_code"))
    in_position = lambda x: same(x, "object_code") & same(x, "subobject_code") & full("object_code", "subobject_code")
    held = lambda test: F.filter(F.coalesce("list", F.array()), test)

    def plain(test) -> Column:
        """Candidates that no rule joins and no list before holds."""
        return F.aggregate(held(lambda x: unruled(x) & test(x)), F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def chosen(strategy: str, test) -> Column:
        """Selectable ones of a strategy, and the least of them."""
        rows = held(lambda x: free(x) & test(x))
        return F.struct(F.lit(ORDINAL[strategy]).alias("ordinal"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.array_min(F.transform(rows, lambda x: x["first"])).alias("source_row_id"))

    any_ = lambda x: F.lit(True)
    position, index, name_unit = (list(KEYS[k]) for k in ("object_subobject_position", "index_position", "normalized_name_unit"))
    name_object, name_subobject = ["work_name", "object_code"], ["work_name", "subobject_code"]
    context, other = "normalized_name_context", lambda x: ~same(x, "subobject_code")
    # Only sources whose subobject some target has can share a position with one.
    subobjects = small(targets.select("subobject_code").distinct())
    t = with_counts(t, s, name_object, present(name_object), ["subobject_code", "unit"], False, p0=plain(lambda x: ~in_unit(x) & other(x)), c5=chosen(context, other))
    t = with_counts(
        t, s.join(subobjects, "subobject_code", "left_semi"), position, filled(position), ["work_name", "unit"], False,
        p1=plain(lambda x: ~same(x, "work_name")), c0=chosen("exact_business_key", lambda x: same(x, "work_name") & in_unit(x)), c2=chosen("object_subobject_position", any_),
    )
    t = with_counts(t, s, index, filled(index), ["object_code", "subobject_code", "work_name", "unit"], False, p2=plain(lambda x: ~in_position(x) & ~in_name(x)), c1=chosen("index_position", any_))
    t = with_counts(t, s, name_subobject, present(name_subobject), ["unit"], True, p3=plain(lambda x: ~in_unit(x)), c4=chosen(context, any_))
    t = with_counts(t, s, name_unit, filled(name_unit), [], True, p4=plain(any_), c3=chosen("normalized_name_unit", any_))
    by_context = F.struct(F.col("c4.ordinal"), (F.col("c4.n") + F.col("c5.n")).alias("n"), F.least("c4.source_row_id", "c5.source_row_id").alias("source_row_id"))
    ranked = F.array("c0", "c1", "c2", "c3", by_context)
    out = t.select("target_row_id", *meant, sum((F.col(f"p{i}") for i in range(1, 5)), F.col("p0")).alias("plain"), F.get(F.filter(ranked, lambda x: x["n"] > 0), F.lit(0)).alias("b"))
    ruled = small(rule_profiles(sources, targets, clauses)[1].select(*meant, "n_sources", "n_blocked", "n_free", "first_free"))
    out = out.join(ruled, meant, "left").na.fill(0, ["n_sources", "n_blocked", "n_free"])
    by_rule = F.when(F.col("n_free") > 0, F.struct(F.lit(ORDINAL["configuration_rule"]).alias("ordinal"), F.col("n_free").alias("n"), F.col("first_free").alias("source_row_id")))
    b, n = F.coalesce("b", by_rule), F.col("plain") + F.col("n_sources")
    return out.select("target_row_id", *_status(b["n"], b["ordinal"], b["source_row_id"], n, n > F.col("n_blocked")))


def _status(n: Column, ordinal: Column, source: Column, total: Column, unblocked: Column) -> list[Column]:
    matched = n == 1
    status = F.when(matched, "matched").when((n > 1) | (n.isNull() & F.coalesce(unblocked, F.lit(False))), "ambiguous").otherwise("unmatched")
    warning = (
        F.when(matched, F.lit(None)).when(n > 1, "MULTIPLE_BEST_CANDIDATES").when(total.isNull() | (total == 0), "NO_CANDIDATES")
        .when(unblocked, "MANUAL_REVIEW_REQUIRED").otherwise("NO_ELIGIBLE_CANDIDATE")
    )
    return [status.alias("status"), F.when(matched, source).alias("source_row_id"), F.when(matched, ordinal).alias("ordinal"), warning.alias("warning"), F.coalesce(total, F.lit(0)).cast("long").alias("n_candidates")]


def match_by_keys(sources: DataFrame, targets: DataFrame, strategies: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """select_best(targets, candidates(...)) for key strategies alone, without making the pairs.

    Sources are counted by key first, so a key with very many sources costs one row a target and no fan-out. The
    lowest strategy with any source decides; n_candidates counts its sources only.
    """
    out = targets.select("target_row_id", *sorted({k for s in strategies for k in KEYS[s]}))
    tops = []
    for s in strategies:
        keys = KEYS[s]
        filled = " and ".join(f"{k} <> ''" for k in keys)
        grouped = sources.filter(filled).groupBy(*keys).agg(F.count("*").alias("n"), F.min("source_row_id").alias("source_row_id"))
        out = out.join(grouped.select(*keys, F.struct(F.lit(ORDINAL[s]).alias("ordinal"), "n", "source_row_id").alias(f"_{s}")), list(keys), "left")
        tops.append(F.col(f"_{s}"))
    top = F.coalesce(*tops)
    return out.select("target_row_id", *_status(top["n"], top["ordinal"], top["source_row_id"], top["n"], top["n"].isNotNull()))
