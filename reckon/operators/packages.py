"""Document packages: inherited codes, evidence scoring, atoms, exact package partition."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no meaning in work names; signal weights; bounds of a package; search budget; units.
STOP = ("работ", "работы", "устройство", "выполнены", "следующие", "скрытых")
CODE_WEIGHT, NAME_WEIGHT = 2, 1
MOST_ATOMS, MOST_FAMILIES, MOST_PAIRS, MOST_STATES = 128, 64, 8192, 100_000
UNITS = {"м": "m", "мп": "m", "км": "km", "м2": "m2", "м²": "m2", "м3": "m3", "шт": "pcs", "т": "t", "кг": "kg"}


def inherited_codes(rows: DataFrame) -> DataFrame:
    """rows (sheet, row_number, work_code, drawing_code) with code: the own drawing code, else the longest dotted
    ancestor's, nearest before the row in its sheet.

    A code of n dots gives n ancestors, so this is one equi-join on (sheet, ancestor); rows with an own code stay out.
    """
    own = F.coalesce(F.col("drawing_code") != "", F.lit(False))
    need = rows.filter(~own & F.coalesce(F.col("work_code") != "", F.lit(False)))
    parts = F.split("work_code", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    asked = need.filter(F.size(parts) > 1).select("sheet", "row_number", F.explode(above).alias("ancestor"))
    have = rows.filter(own & (F.col("work_code") != "")).select("sheet", F.col("row_number").alias("at"), F.col("work_code").alias("ancestor"), F.col("drawing_code").alias("code"))
    best = asked.join(have, ["sheet", "ancestor"]).filter("at < row_number").groupBy("sheet", "row_number").agg(F.max_by("code", F.struct(F.length("ancestor"), "at")).alias("_code"))
    return rows.join(best, ["sheet", "row_number"], "left").withColumn("code", F.when(own, F.col("drawing_code")).otherwise(F.col("_code"))).drop("_code")


def project_components(value: Column) -> Column:
    """Component arrays of the project codes in a text: three or more parts, 8 characters, letters and digits."""
    codes = F.regexp_extract_all(F.coalesce(F.lower(value), F.lit("")), F.lit(r"(?U)(?<!\w)([a-zа-яё0-9]{1,24}(?:[./\-][a-zа-яё0-9]{1,24}){2,})(?!\w)"), F.lit(1))
    parts = F.transform(codes, lambda c: F.split(c, r"[./\-]"))
    whole = lambda p: F.array_join(p, "")
    return F.array_distinct(F.filter(parts, lambda p: (F.length(whole(p)) >= 8) & whole(p).rlike("[0-9]") & whole(p).rlike("[a-zа-яё]")))


def project_signal(left: Column, right: Column) -> Column:
    """Whether any component array of one text is a prefix of (or equal to) one of the other."""
    same = lambda a, b: F.when(F.size(a) <= F.size(b), F.slice(b, F.lit(1), F.size(a)) == a).otherwise(F.slice(a, F.lit(1), F.size(b)) == b)
    return F.exists(project_components(left), lambda a: F.exists(project_components(right), lambda b: same(a, b)))


def name_tokens(value: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.lower(value), F.lit("")), F.lit("[a-zа-яё0-9]{3,}"), F.lit(0)))
    return F.filter(found, lambda t: ~t.isin(*STOP))


def similar_names(left: Column, right: Column) -> Column:
    """Shared words are at least six tenths of the shorter name's."""
    a, b = name_tokens(left), name_tokens(right)
    shared = F.size(F.array_intersect(a, b))
    return (shared > 0) & (shared * 10 >= F.least(F.size(a), F.size(b)) * 6)


def unit_kind(unit: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(unit), r"\s+", ""), r"\.+$", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), clean)


def compare_quantity(q1: Column, u1: Column, q2: Column, u2: Column) -> Column:
    """MATCH, MISMATCH or NOT_COMPARABLE; metres and kilometres convert, nothing else does."""
    a, b = unit_kind(u1), unit_kind(u2)
    metres = lambda q, u: F.when(u == "km", q * 1000).otherwise(q)
    lengths = a.isin("m", "km") & b.isin("m", "km")
    equal = F.when(lengths, metres(q1, a) == metres(q2, b)).when(a == b, q1 == q2)
    return F.coalesce(F.when(equal, "MATCH").when(~equal, "MISMATCH"), F.lit("NOT_COMPARABLE"))


def reconcile(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per workbook row (row_id, work_code, code, name, quantity, unit): status, pdf_id, comparison.

    evidence: pdf_id, work_code, project_codes, description, quantity, unit, document_type, readable. Candidates share
    the work code; a project code weighs 2, a like description 1; no signal is review, two equal best are ambiguous.
    """
    e = evidence.select("work_code", F.struct("pdf_id", "project_codes", "description", "quantity", "unit", "document_type", "readable").alias("e"))
    pair = rows.filter("work_code <> ''").join(e, "work_code", "left")
    usable = F.coalesce(F.col("e.document_type") == "aosr", F.lit(False))
    weight = F.when(project_signal(F.col("code"), F.col("e.project_codes")), CODE_WEIGHT).otherwise(0) + F.when(similar_names(F.col("name"), F.col("e.description")), NAME_WEIGHT).otherwise(0)
    scored = pair.select("row_id", "quantity", "unit", "e", usable.alias("usable"), F.when(usable, weight).otherwise(0).alias("w"))
    best = scored.withColumn("m", F.max("w").over(Window.partitionBy("row_id")))
    out = best.groupBy("row_id").agg(
        F.count("e").alias("n"), F.count_if("usable").alias("n_usable"), F.max("m").alias("m"), F.count_if((F.col("w") == F.col("m")) & F.col("usable")).alias("n_top"),
        F.max(F.when((F.col("w") == F.col("m")) & F.col("usable"), F.struct("e.pdf_id", "e.quantity", "e.unit", "e.readable"))).alias("b"), F.first("quantity").alias("quantity"), F.first("unit").alias("unit"),
    )
    compared = compare_quantity(F.col("quantity"), F.col("unit"), F.col("b.quantity"), F.col("b.unit"))
    status = (
        F.when(F.col("n").isNull(), "NEEDS_REVIEW").when(F.col("n") == 0, "NO_EVIDENCE").when(F.col("n_usable") == 0, F.when(F.col("n") == 1, "NEEDS_REVIEW").otherwise("AMBIGUOUS"))
        .when(F.col("m") == 0, "NEEDS_REVIEW").when(F.col("n_top") > 1, "AMBIGUOUS").when(~F.col("b.readable"), "NEEDS_REVIEW").when(compared == "MISMATCH", "MISMATCH").otherwise("MATCH")
    )
    full = rows.select("row_id").join(out, "row_id", "left").select("row_id", status.alias("status"), "b", compared.alias("c"))
    sure = F.col("status").isin("MATCH", "MISMATCH")
    return full.select("row_id", "status", F.when(sure, F.col("b.pdf_id")).alias("pdf_id"), F.when(sure, F.col("c")).otherwise("NOT_COMPARABLE").alias("quantity_comparison"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def atom_clusters(atoms: DataFrame) -> DataFrame:
    """Hard partition of atoms by boundary, critical and typed signature: n_atoms, sorted atom ids and route.

    A single atom is an outlier; a cluster with a blocked atom goes to manual review.
    """
    out = atoms.groupBy("boundary", "critical_signature", "typed_signature").agg(F.array_sort(F.collect_list("atom_id")).alias("atoms"), F.bool_or("blocked").alias("blocked"))
    return out.select("boundary", "critical_signature", "typed_signature", F.size("atoms").cast("long").alias("n_atoms"), "atoms", F.when(F.col("blocked"), "manual").when(F.size("atoms") == 1, "outlier").otherwise("candidate").alias("route"))


def partition(sizes: list[int], compatible: set[tuple[int, int]], most_families: int = MOST_FAMILIES, most_atoms: int = MOST_ATOMS) -> list[tuple[int, ...]]:
    """The fewest groups of pairwise compatible families within the bounds; of those, the first in family order.

    Exact, by dynamic programming over sets of families left; fails beyond MOST_STATES steps instead of guessing.
    """
    steps = 0
    known: dict[int, tuple[int, tuple]] = {0: (0, ())}

    def fits(group: tuple[int, ...]) -> bool:
        atoms = sum(sizes[i] for i in group)
        return len(group) <= most_families and atoms <= most_atoms and atoms * (atoms - 1) // 2 <= MOST_PAIRS

    def spend() -> None:
        nonlocal steps
        if (steps := steps + 1) > MOST_STATES:
            raise RuntimeError("exact partition exceeds its search budget")

    def groups(first: int, rest: list[int]):
        found = [(first,)]
        for i in rest:
            for g in found[:]:
                spend()
                if all((j, i) in compatible for j in g) and fits((*g, i)):
                    found.append((*g, i))
        return found

    def solve(left: int) -> tuple[int, tuple]:
        if left in known:
            return known[left]
        first = (left & -left).bit_length() - 1
        rest = [i for i in range(first + 1, len(sizes)) if left >> i & 1 and (first, i) in compatible]
        best = None
        for g in groups(first, rest):
            spend()
            n, tail = solve(left & ~sum(1 << i for i in g))
            if best is None or (n + 1, (g, *tail)) < best:
                best = (n + 1, (g, *tail))
        known[left] = best
        return best

    return list(solve((1 << len(sizes)) - 1)[1])


def optimal_packages(families: DataFrame, compatible: DataFrame) -> DataFrame:
    """(boundary, family_id, package) by the fewest safe packages per boundary.

    families: boundary, family_id, n_atoms; compatible: boundary, left_id, right_id. A boundary is bounded by the
    contract (MOST_FAMILIES families a package, MOST_STATES steps), so one group is one bounded Python call.
    """

    def solve(key, f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("family_id").reset_index(drop=True)
        at = {v: i for i, v in enumerate(f["family_id"])}
        pairs = {tuple(sorted((at[a], at[b]))) for a, b in zip(c["left_id"], c["right_id"]) if a in at and b in at}
        rows = [(key[0], f["family_id"][i], n) for n, g in enumerate(partition(f["n_atoms"].tolist(), pairs)) for i in g] if len(f) else []
        return pd.DataFrame(rows, columns=["boundary", "family_id", "package"])

    kind = dict(families.dtypes)
    families, compatible = families.alias("f").toDF(*families.columns), compatible.alias("c").toDF(*compatible.columns)
    return families.groupBy("boundary").cogroup(compatible.groupBy("boundary")).applyInPandas(solve, f"boundary {kind['boundary']}, family_id {kind['family_id']}, package int")


def complete_pairs(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(package_id, n_atoms, n_pairs, safe): a package is safe if all its pairs are there, compatible, and within bounds."""
    a = atoms.groupBy("package_id").agg(F.count_distinct("atom_id").alias("n_atoms"))
    p = pairs.groupBy("package_id").agg(F.count_distinct(F.struct(F.least("left_id", "right_id"), F.greatest("left_id", "right_id"))).alias("n_pairs"), F.bool_and("compatible").alias("ok"))
    out = a.join(p, "package_id", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    full = F.col("n_pairs") == F.col("n_atoms") * (F.col("n_atoms") - 1) / 2
    return out.select("package_id", "n_atoms", "n_pairs", (full & F.coalesce("ok", F.col("n_atoms") == 1) & (F.col("n_atoms") <= MOST_ATOMS) & (F.col("n_pairs") <= MOST_PAIRS)).alias("safe"))


def brute_partition_size(n: int, compatible: set[tuple[int, int]]) -> int:
    """Fewest cliques that cover n families, by trying all partitions (tests only: tiny n)."""
    def parts(items):
        if not items:
            yield []
            return
        head, rest = items[0], items[1:]
        for k in range(len(rest) + 1):
            for g in combinations(rest, k):
                group = (head, *g)
                if all(p in compatible for p in combinations(group, 2)):
                    for tail in parts([i for i in rest if i not in g]):
                        yield [group, *tail]
    return min(len(p) for p in parts(list(range(n))))


def discover(files: DataFrame, workbooks: tuple[str, ...] = (".xlsx", ".xlsm", ".ods"), evidence: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """Package roots (first folder below the source) with their workbooks and evidence files, and what is missing.

    files: relative_path, extension.
    """
    root = F.when(F.col("relative_path").contains("/"), F.substring_index("relative_path", "/", 1)).otherwise(".")
    of = lambda kinds: F.array_sort(F.collect_list(F.when(F.col("extension").isin(*kinds), F.col("relative_path"))))
    out = files.groupBy(root.alias("package")).agg(of(workbooks).alias("workbooks"), of(evidence).alias("documents"))
    issue = F.when(F.size("workbooks") == 0, "WORKBOOK_MISSING").when(F.size("documents") == 0, "EVIDENCE_MISSING")
    return out.withColumn("issue", issue)
