"""Drawing cards: decisions per row, aggregates per (object, drawing, category), complete cards, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.functions.numeric import MONEY
from reckon.operators.dedup import latest

#: Performed cost may exceed the contract's by this; rows excluded as hierarchy may be this share.
CONTRACT_TOLERANCE = 1000
EXCLUSION_SHARE = 0.50
DISPOSITIONS = ("HIERARCHY_AGGREGATE_EXCLUDED", "HIERARCHY_RESOURCE_DETAIL_EXCLUDED", "MANUAL_REVIEW", "MATCHED", "UNCLASSIFIED")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)[0-9a-zа-я]+|м/к"), F.lit(0))


def contains_mask(text: Column, mask: str) -> Column:
    """Whether a normalized text holds the mask: its words in order as a prefix phrase, or one word within one edit.

    The tolerance is for masks of one word of at least 6 characters, against words of at least 6.
    """
    import re

    words = re.findall("[0-9a-zа-я]+|м/к", mask.lower())
    if not words:
        return F.lit(False)
    phrase = text.rlike("(?iu)(?<![0-9a-zа-я])" + "[^0-9a-zа-я]+".join(re.escape(w) for w in words))
    if len(words) > 1 or len(words[0]) < 6:
        return phrase
    near = lambda t: (F.length(t) >= 6) & (F.levenshtein(t, F.lit(words[0]), 1) >= 0)
    return phrase | F.exists(tokens(text), near)


def any_mask(text: Column, masks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in masks:
        out = out | contains_mask(text, m)
    return out


def rule_matches(text: Column, include_any: tuple = (), include_all: tuple = (), exclude_any: tuple = ()) -> Column:
    """No excluded mask, and one full group of include_all or any mask of include_any."""
    groups = F.lit(False)
    for group in include_all:
        every = F.lit(True)
        for m in group:
            every = every & contains_mask(text, m)
        groups = groups | every
    return ~any_mask(text, exclude_any) & (groups | any_mask(text, include_any))


def classify(rows: DataFrame, rules: dict[str, dict], negative: tuple[str, ...] = ()) -> DataFrame:
    """rows (row_id, text, unit, quantity, cost) with category, strategy, quantity_decision, cost_decision, requires_review.

    Nothing to count or no text: excluded; a confirmed negative: excluded; one category with a fitting unit: decided by
    its rule; several: review; one with another unit: review; none: excluded as irrelevant.
    """
    text = F.col("text")
    fits = lambda r: F.col("unit").isNull() | (F.lit(True) if not r.get("units") else F.col("unit").isin(*r["units"]))
    hits = {k: rule_matches(text, r.get("any", ()), r.get("all", ()), r.get("not", ())) for k, r in rules.items()}
    rows = rows.withColumn("_hit", F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in hits.items()))))
    rows = rows.withColumn("_fit", F.array_compact(F.array(*(F.when(F.array_contains("_hit", k) & fits(r), F.lit(k)) for k, r in rules.items()))))
    idle = (text == "") | (F.coalesce(F.col("quantity") == 0, F.lit(True)) & F.coalesce(F.col("cost") == 0, F.lit(True)))
    one = F.size("_fit") == 1
    strategy = (
        F.when(idle, "deterministic_no_impact").when(any_mask(text, negative), "deterministic_negative").when(one, "deterministic_rules")
        .when((F.size("_fit") > 1) | (F.size("_hit") == 1), "review").when(F.size("_hit") > 1, "review").otherwise("deterministic_irrelevant")
    )
    rows = rows.withColumn("strategy", strategy)
    ruled, review = F.col("strategy") == "deterministic_rules", F.col("strategy") == "review"
    category = F.when(ruled, F.get("_fit", F.lit(0))).when(review & (F.size("_hit") == 1), F.get("_hit", F.lit(0)))
    filled = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    decide = lambda c: F.when(review, "review").when(ruled & filled(c), "include").otherwise("exclude")
    return rows.select(*[c for c in rows.columns if not c.startswith("_") and c != "strategy"], category.alias("category"), "strategy", decide("quantity").alias("quantity_decision"), decide("cost").alias("cost_decision"), review.alias("requires_review"))


def aggregate(rows: DataFrame) -> DataFrame:
    """Totals per (object_index, drawing_key, category).

    rows: seq, object_index, drawing_key, category, unit, quantity, cost, quantity_decision, cost_decision, rule_id,
    strategy, confidence. Quantity is null on several units, 0 if only costs are there. First and ordered values go by seq.
    """
    q = (F.col("quantity_decision") == "include") & F.col("quantity").isNotNull()
    c = (F.col("cost_decision") == "include") & F.col("cost").isNotNull()
    unit = F.when(q, F.nullif("unit", F.lit("")))
    # Rows without a category go by an aggregate: a filter on the key itself moves below and computes the rules again.
    kept = rows.filter("object_index <> '' and drawing_key <> ''")
    key = ["object_index", "drawing_key", "category"]
    # By strategy first: the ordered strategies are then gathered from a few rows a group, not from all of its rows.
    part = kept.groupBy(*key, "strategy").agg(
        F.max("category").alias("there"),
        F.min(unit).alias("u"), F.max(unit).alias("v"), F.sum(F.when(q, F.col("quantity").cast(MONEY))).alias("q"), F.sum(F.when(c, F.col("cost").cast(MONEY))).alias("c"),
        F.count_if(q).alias("nq"), F.count_if(c).alias("nc"), F.min(F.when(q & F.col("rule_id").isNotNull(), F.struct("seq", "rule_id"))).alias("rule"), F.min(F.when(q, F.col("confidence"))).alias("sure"),
        F.min(F.when(q, F.col("seq"))).alias("first"), F.bool_or((F.col("quantity_decision") == "review") | (F.col("cost_decision") == "review")).alias("r"),
    )
    strategies = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull() & F.col("strategy").isNotNull(), F.struct("first", "strategy"))))
    out = part.filter("there is not null").groupBy(*key).agg(
        F.max("there").alias("there"), F.min("u").alias("u"), F.max("v").alias("v"), F.sum("q").alias("q"), F.sum("c").alias("c"), F.sum("nq").alias("n_quantity_rows"), F.sum("nc").alias("n_cost_rows"), F.min("rule").alias("rule"),
        F.min("sure").alias("quantity_confidence"), F.transform(strategies, lambda x: x["strategy"]).alias("quantity_strategies"), F.bool_or("r").alias("reviewed"),
    ).withColumn("quantity_rule_id", F.col("rule.rule_id"))
    mixed = F.coalesce(F.col("u") != F.col("v"), F.lit(False))
    quantity = F.when(mixed, F.lit(None)).otherwise(F.coalesce("q", F.when(F.col("c").isNotNull(), F.lit(0))))
    return out.select(
        "object_index", "drawing_key", F.col("there").alias("category"), F.when(~mixed, F.col("u")).alias("unit"), quantity.cast(MONEY).alias("quantity"), F.col("c").cast(MONEY).alias("total_cost"),
        "n_quantity_rows", "n_cost_rows", "quantity_rule_id", "quantity_confidence", "quantity_strategies",
        (mixed | F.col("reviewed")).alias("requires_review"), F.when(mixed, "UNIT_MISMATCH").when(F.col("reviewed"), "WARNING").otherwise("OK").alias("status"),
    )


def complete(rows: DataFrame, totals: DataFrame, categories: tuple[str, ...], unit_hints: dict[str, str] | None = None) -> DataFrame:
    """Every (object_index, drawing_key) with every category; categories without totals have a status and a unit hint."""
    drawings = rows.filter("object_index <> '' and drawing_key <> ''").select("object_index", "drawing_key").distinct()
    every = drawings.select("*", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    hint = F.lit(None).cast("string")
    for name, unit in (unit_hints or {}).items():
        hint = F.when(F.col("category") == name, F.lit(unit)).otherwise(hint)
    out = every.join(totals.withColumn("_there", F.lit(True)), ["object_index", "drawing_key", "category"], "left")
    gap = F.when(hint.isNotNull(), "UNIT_FROM_TEMPLATE").otherwise("VALUE_NOT_FOUND")
    return out.select("object_index", "drawing_key", "category", F.coalesce("unit", hint).alias("unit"), "quantity", "total_cost", F.when(F.col("_there"), F.col("status")).otherwise(gap).alias("status"), F.coalesce("requires_review", F.lit(False)).alias("requires_review"))


def merge_update(new: DataFrame, existing: DataFrame, keys: list[str], values: list[str], policy: str) -> DataFrame:
    """Full outer update of cards: keep_existing, fill_empty_only, overwrite or conflicts_to_review.

    Rows only in `existing` are preserved and marked; with conflicts_to_review, conflicts lists the values that differ.
    """
    n = new.select(*keys, F.struct(*values).alias("n"))
    o = existing.select(*keys, F.struct(*values).alias("o"))
    both = n.join(o, keys, "full_outer")
    order = ("n", "o") if policy == "overwrite" else ("o", "n")
    differs = lambda v: F.when(F.col(f"n.{v}") != F.col(f"o.{v}"), F.lit(v))
    conflicts = F.array_compact(F.array(*map(differs, values))) if policy == "conflicts_to_review" else F.array().cast("array<string>")
    return both.select(*keys, *(F.coalesce(f"{order[0]}.{v}", f"{order[1]}.{v}").alias(v) for v in values), (F.col("n").isNull()).alias("preserved"), conflicts.alias("conflicts"))


def contract_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Contract quantity without cost, or performed cost over the contract's by more than CONTRACT_TOLERANCE."""
    bare = (F.col("contract_quantity") != 0) & (F.col("contract_cost") == 0)
    over = F.col("performed_cost") - F.col("contract_cost")
    code = F.when(bare, "contract_quantity_without_cost").when(over > CONTRACT_TOLERANCE, "performed_cost_exceeds_contract")
    return rows.select(*keys, code.alias("issue_code"), F.when(~bare, over).alias("difference")).filter("issue_code is not null")


def last_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows joined with their last decision (by seq); rows without a category go."""
    return rows.join(latest(decisions, ["row_id"], [F.col("seq")]).drop("seq"), "row_id").filter("category is not null")


def disposition(requires_review: Column, category: Column) -> Column:
    """Review wins over a nominal category."""
    return F.when(requires_review, "MANUAL_REVIEW").when(category.isNotNull(), "MATCHED").otherwise("UNCLASSIFIED")


def funnel(rows: DataFrame, extracted: int | None = None) -> DataFrame:
    """(disposition, n) with every disposition present, the excluded share and whether it is anomalous."""
    counts = rows.groupBy("disposition").agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(d,) for d in DISPOSITIONS], "disposition string")
    out = names.join(counts, "disposition", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("disposition").startswith("HIERARCHY_"), F.col("n")).otherwise(0)).alias("excluded"))
    share = F.coalesce(F.try_divide(F.col("excluded").cast("double"), F.lit(extracted) if extracted else F.col("total")), F.lit(0.0))
    return out.crossJoin(totals).select("disposition", "n", F.round(share, 6).alias("exclusion_share"), (share > EXCLUSION_SHARE).alias("anomalous"))


def summary(rows: DataFrame, cost_scale: int = 1) -> DataFrame:
    """Per (object_index, category): summed quantity and cost, the unit only if all rows agree on it."""
    out = rows.groupBy("object_index", "category").agg(F.sum("quantity").alias("quantity"), F.sum("total_cost").alias("c"), F.count_distinct("unit").alias("n"), F.count_if(F.col("unit").isNull()).alias("gone"), F.min("unit").alias("u"))
    return out.select("object_index", "category", F.when((F.col("n") == 1) & (F.col("gone") == 0), F.col("u")).alias("unit"), F.col("quantity").cast("decimal(38,6)").alias("quantity"), (F.col("c") / cost_scale).cast("decimal(38,6)").alias("total_cost"))


def cascade(rows: DataFrame, rules: dict[str, dict], negative: tuple[str, ...] = (), cost_only: str | None = None, cost_only_category: str | None = None) -> DataFrame:
    """The whole decision of a row, from evidence that joins have put beside it.

    rows: row_id, text, unit, quantity, cost and evidence: approved_category, approved_action (null without an approval),
    example_id, example_category, example_unit, example_conflict, formula_unresolved, consensus, consensus_review. In
    order: an approval; a conflict of examples (review); an exact example, whose quantity needs a fitting unit; an
    unresolved formula (review); nothing to count; a confirmed negative; a leading cost-only phrase; a stale or conflicting
    consensus (review); the consensus; the rules. Adds category, strategy, quantity_decision, cost_decision,
    requires_review.
    """
    base = classify(rows, rules, negative)
    c = F.col
    unit_fits = F.lit(True)
    for name, r in rules.items():
        if r.get("units"):
            unit_fits = F.when(c("example_category") == name, c("unit").isNull() | c("unit").isin(*r["units"])).otherwise(unit_fits)
    approved, rejected = c("approved_action").isNotNull(), c("approved_action").isin("reject", "skip")
    exact = c("example_id").isNotNull()
    same_unit = c("example_unit").isNull() | c("example_unit").eqNullSafe(c("unit")) | c("example_category").isNull()
    idle, minus = c("strategy") == "deterministic_no_impact", c("strategy") == "deterministic_negative"
    coupling = c("text").rlike(cost_only) if cost_only else F.lit(False)
    priced = F.coalesce(c("cost") > 0, F.lit(False))
    ladder = [
        (approved, "manual_review"), (F.coalesce("example_conflict", F.lit(False)), "review"), (exact & ~unit_fits, "review_unit"), (exact & same_unit, "confirmed_dictionary"), (exact, "review"),
        (F.coalesce("formula_unresolved", F.lit(False)), "review"), (idle, "deterministic_no_impact"), (minus, "deterministic_negative"), (coupling & priced, "deterministic_cost_only"), (coupling, "review"),
        (F.coalesce("consensus_review", F.lit(False)), "review"), (c("consensus").isNotNull(), "machine_consensus_exact"),
    ]
    step = F.lit(None).cast("string")
    for when, name in reversed(ladder):
        step = F.when(when, F.lit(name)).otherwise(step)
    out = base.withColumn("_s", step)
    s = c("_s")
    filled = lambda x: F.coalesce(c(x) != 0, F.lit(False))
    category = (
        F.when(s == "manual_review", F.when(~rejected, c("approved_category"))).when(s.isin("confirmed_dictionary", "review_unit"), c("example_category")).when(s == "deterministic_cost_only", F.lit(cost_only_category))
        .when(s == "machine_consensus_exact", c("consensus")).when(s.isNull(), c("category"))
    )
    given = lambda x, only: F.when(rejected, "exclude").when(c("approved_action").isin("approve", "change_category", only), "include").otherwise("exclude")
    known = lambda x: F.when(category.isNull(), "exclude").when(filled(x), "include").otherwise("exclude")
    pick = lambda x, only: (
        F.when(s == "manual_review", given(x, only)).when(s == "review", "review").when(s == "review_unit", "review" if x == "quantity" else known(x)).when(s.isin("confirmed_dictionary", "machine_consensus_exact"), known(x))
        .when(s == "deterministic_cost_only", "exclude" if x == "quantity" else "include").when(s.isNotNull(), "exclude").otherwise(c(f"{x}_decision"))
    )
    q, v = pick("quantity", "quantity_only"), pick("cost", "cost_only")
    keep = [x for x in rows.columns]
    return out.select(*keep, category.alias("category"), F.when(s == "review_unit", "review").otherwise(F.coalesce(s, c("strategy"))).alias("strategy"), q.alias("quantity_decision"), v.alias("cost_decision"), ((q == "review") | (v == "review")).alias("requires_review"))


def validate_cards(rows: DataFrame, published: DataFrame) -> DataFrame:
    """(object_index, category, error) where a published summary differs from its rows or one side is missing."""
    own = summary(rows).select("object_index", "category", F.struct("unit", "quantity", "total_cost").alias("a"))
    out = own.join(published.select("object_index", "category", F.struct("unit", "quantity", "total_cost").alias("b")), ["object_index", "category"], "full_outer")
    error = F.when(F.col("b").isNull(), "SUMMARY_MISSING").when(F.col("a").isNull(), "SUMMARY_WITHOUT_ROWS").when(~F.col("a").eqNullSafe(F.col("b")), "SUMMARY_DIFFERS")
    return out.select("object_index", "category", error.alias("error")).filter("error is not null")


def layout_issues(layouts: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(object_index, error) where a published card's layout, counts or cells contradict its plan.

    layouts: object_index, start_row, end_row, drawing_code (a block each). cells: object_index, row, kind, value. rows: object_index,
    drawing_code. Blocks of one object must not overlap nor lie outside its cells; objects and drawings must be those of the
    rows; a cell with an error value, or a number with a binary tail, fails.
    """
    w = Window.partitionBy("object_index").orderBy("start_row", "end_row")
    overlap = layouts.withColumn("_before", F.max("end_row").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("start_row") <= F.col("_before")).select("object_index", F.concat(F.lit("BLOCKS_OVERLAP:"), "drawing_code").alias("error"))
    turned = layouts.filter("end_row < start_row").select("object_index", F.concat(F.lit("BLOCK_TURNED:"), "drawing_code").alias("error"))
    planned = layouts.groupBy("object_index").agg(F.count_distinct("drawing_code").alias("a"))
    there = rows.groupBy("object_index").agg(F.count_distinct("drawing_code").alias("b"))
    both = planned.join(there, "object_index", "full_outer")
    counts = both.filter(~F.coalesce("a", F.lit(0)).eqNullSafe(F.coalesce("b", F.lit(0)))).select("object_index", F.concat(F.lit("DRAWING_COUNT:"), F.coalesce("b", F.lit(0)), F.lit("!="), F.coalesce("a", F.lit(0))).alias("error"))
    broken = cells.filter("kind = 'error'").select("object_index", F.concat(F.lit("FORMULA_ERROR:"), "row", F.lit(":"), "value").alias("error"))
    tail = cells.filter((F.col("kind") == "number") & F.col("value").rlike(r"\.[0-9]*(?:0{6,}[1-9][0-9]?|9{6,}[0-9]{1,2})$")).select("object_index", F.concat(F.lit("BINARY_FLOAT_SERIALIZATION:"), "row", F.lit(":"), "value").alias("error"))
    out = overlap
    for other in (turned, counts, broken, tail):
        out = out.unionByName(other)
    return out
