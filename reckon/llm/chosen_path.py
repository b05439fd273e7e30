"""Operator 9, n-gram Jaccard join: chosen-path join over sets of word shingles.

Texts with the same set form one class from the start; its set stands for all. Every set is embedded as min-hash
tokens. A run lets each set follow those of its tokens whose run-specific hash is under 1/(threshold * tokens),
so sets that share tokens follow the same ones. A node with more than a few sets is split again by other sampled
tokens; nodes that stay are leaves, and every two sets of a leaf are compared: a leaf too large for one task (by sets or
by bytes) is dealt into blocks, and every block meets every other. Of the leaves that two sets share the smallest alone counts the pair,
so each pair counts once; it is compared by min-hash tokens first, then exactly, on the sets themselves. There are
as many runs as a pair at the threshold needs to stay together through all levels with probability recall. Linked
classes are then joined by connected components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.common import ascii_words, cut, parquet, texts
from reckon.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
TOKENS = 32
#: Sets of a node that is not split, and levels of splitting.
BUCKET = 48
LEVELS = 3
#: Sets and shingles (8 bytes each) of a block of a larger leaf: two blocks are what a task holds at a time.
BLOCK = 1024
BLOCK_ITEMS = 1_000_000
#: Values that one matrix product covers, and rows whose tokens are compared at once.
SLICE, TILE = 2048, 64
_WORDS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """Words to 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: dict, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of k consecutive words, ascending; a text with 1 to k-1 words has one, of all of them."""
    found = ascii_words(text)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    if not len(h):
        return h
    out = np.zeros(max(1, len(h) - k + 1), dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = mix(out * _ODD + h[j : j + len(out)] + np.uint64(1))
    return np.unique(out)


def signature(sets: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """Min-hash values; each is a permutation's smallest, by position."""
    seeds = mix(np.arange(1, tokens + 1, dtype=np.uint64) * _ODD)
    out = np.full(tokens, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096]
        out = np.minimum(out, ((part[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint64(1))).min(axis=1))
    return mix(out + seeds)


def first_nodes(sig: np.ndarray, runs: int, threshold: float) -> list[int]:
    """The children of the roots 0 to runs - 1, at once."""
    roots = np.arange(runs, dtype=np.uint64)[:, None]
    h = mix(sig[None, :] ^ mix(roots + _ODD))
    run, at = np.nonzero(h < np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(sig))))))
    return mix(h[run, at] + roots[run, 0]).view(np.int64).tolist()


def children(sig: np.ndarray, node: int, threshold: float) -> list[int]:
    """The nodes that a set goes on to from a node: one for each of its tokens sampled there."""
    h = mix(sig ^ mix(np.array([node & (2**64 - 1)], dtype=np.uint64) + _ODD))
    picked = h[h < np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(sig)))))]
    return mix(picked + np.uint64(node & (2**64 - 1))).view(np.int64).tolist()


def shared_odds(threshold: float, tokens: int) -> list[float]:
    """Probability that a pair at the threshold shares 0, 1, ... tokens."""
    return [math.comb(tokens, x) * threshold**x * (1 - threshold) ** (tokens - x) for x in range(tokens + 1)]


def runs_for(threshold: float, recall: float, levels: int = LEVELS, tokens: int = TOKENS) -> int:
    """Runs after which a pair at the threshold has met in a leaf of the last level with probability recall.

    A pair that shares x tokens loses each other at a node unless one of the x is sampled and its child does not lose
    them; all runs see the same x.
    """
    lost = np.zeros(tokens + 1)
    for _ in range(levels):
        lost = (1 - (1 - lost) / (threshold * tokens)) ** np.arange(tokens + 1)
    odds, runs = np.array(shared_odds(threshold, tokens)), 1
    while (odds * lost**runs).sum() > (1 - recall) * 0.99:  # the rest is for least_agreeing
        runs += 1
    return runs


def least_agreeing(threshold: float, recall: float, tokens: int = TOKENS) -> int:
    """Shared tokens under which a pair at the threshold lies with less than a hundredth of 1 - recall."""
    return int((np.cumsum(shared_odds(threshold, tokens)) < (1 - recall) / 100).sum())


def shared(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix: number of values that a list of the left and one of the right have in common (right None: the left again).

    Every list holds a value once. Dense products over slices of the values, without those that only one list holds.
    """
    lists = left if right is None else [*left, *right]
    values, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[n[at] > 1]
    _, at = np.unique(at[n[at] > 1], return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(left), len(left if right is None else right)), dtype=np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, SLICE):
        a, b = np.searchsorted(at, [low, low + SLICE])
        grid = np.zeros((len(lists), min(SLICE, int(at[-1]) + 1 - low)), dtype=np.float32)
        grid[owner[a:b], at[a:b] - low] = 1
        out += grid[: len(left)] @ grid[0 if right is None else len(left) :].T
    return out


def sides(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Places of the sets of a gid's two blocks (halves 1 and 2); a block against itself (halves 0) is the left one alone."""
    return (np.flatnonzero(halves != 2), np.flatnonzero(halves == 2)) if halves.any() else (np.arange(len(halves)), None)


def to_compare(nodes: list[np.ndarray], node: int, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Matrix: whether a pair counts here, since it shares no smaller node; of a block against itself each pair once."""
    smaller = [x[x < node] for x in nodes]
    here = shared([smaller[i] for i in left], None if right is None else [smaller[j] for j in right]) == 0
    return np.triu(here, 1) if right is None else here


def agreeing(marks: np.ndarray, left: np.ndarray, right: np.ndarray | None, wanted: np.ndarray, least: int) -> np.ndarray:
    """The wanted pairs (a matrix) whose marks agree in `least` places."""
    other = marks[left if right is None else right]
    for low in range(0, len(left), TILE):
        if wanted[low : low + TILE].any():
            wanted[low : low + TILE] &= (marks[left[low : low + TILE], None] == other[None]).sum(axis=2) >= least
    return wanted


def similarities(members: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """Matrix of exact Jaccard similarities of the sets at the places left with those at the places right."""
    left = np.arange(len(members)) if left is None else left
    sizes = np.array([len(m) for m in members], dtype=np.float64)
    common = shared([members[i] for i in left], None if right is None else [members[j] for j in right]).astype(np.float64)
    return common / np.maximum(1, sizes[left][:, None] + sizes[left if right is None else right][None] - common)


def similar(members: list[np.ndarray], threshold: float) -> list[tuple[int, int, float]]:
    """Pairs i < j of sets with Jaccard similarity >= threshold, exactly."""
    jaccard = similarities(members)
    i, j = np.nonzero(np.triu(jaccard >= threshold, 1))
    return list(zip(i.tolist(), j.tolist(), jaccard[i, j].tolist()))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect what the pairs (i, j), sorted by i, connect among 0 to n - 1."""
    label, out = np.arange(n), []
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])).tolist() if len(i) else []
    for low, high in zip(starts, [*starts[1:], len(i)]):
        tops = np.unique(np.append(label[j[low:high]], label[i[low]]))
        if len(tops) > 1:
            out += [(int(tops[0]), t) for t in tops[1:].tolist()]
            label[np.isin(label, tops[1:])] = tops[0]
    return out


def embedded(rows: DataFrame, k: int, threshold: float, runs: int) -> DataFrame:
    """doc_id, key (of the set; null without words), size, sig, marks (a byte of each token), nodes of the first level."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHash()
        for batch in batches:
            for b in (batch.iloc[i : i + 2000] for i in range(0, len(batch), 2000)):
                keys, sizes, sigs, marks, nodes = [], [], [], [], []
                for text in b["text"]:
                    s = shingles(text, words, k)
                    sig = signature(s) if len(s) else s
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sizes.append(len(s))
                    sigs.append(sig.tobytes() if len(s) else None)
                    marks.append(sig.astype(np.uint8).tobytes() if len(s) else None)
                    nodes.append(first_nodes(sig, runs, threshold) if len(s) else [])
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": keys, "size": sizes, "sig": sigs, "marks": marks, "nodes": nodes})

    return rows.mapInPandas(embed, "doc_id long, key binary, size long, sig binary, marks binary, nodes array<long>")


def leaves(sets: DataFrame, threshold: float, bucket: int, levels: int) -> DataFrame:
    """(node, blocks, key): the sets of the nodes that are not split any more, each node with two sets or more, and the
    number of blocks that a node is dealt into."""
    found = []
    frontier = sets.select("key", "size", F.explode("nodes").alias("node")).distinct()
    for level in range(1, levels + 1):
        sizes = frontier.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("items")).filter("n > 1")
        active = cut(frontier.join(sizes, "node").select("node", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("long").alias("blocks"), "key"))
        found.append(active.filter((F.col("n") <= bucket) | F.lit(level == levels)).select("node", "blocks", "key"))
        large = active.filter(F.col("n") > bucket)
        if level == levels or large.isEmpty():
            break

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                kids = [children(np.frombuffer(s, dtype=np.uint64), n, threshold) for s, n in zip(b["sig"], b["node"])]
                yield pd.DataFrame({"key": b["key"], "size": b["size"], "nodes": kids})

        frontier = large.join(sets.select("key", "size", "sig"), "key").select("key", "size", "node", "sig").mapInPandas(split, "key binary, size long, nodes array<long>").select("key", "size", F.explode("nodes").alias("node")).distinct()
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return rows


def in_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of the gids of rows that are sorted by gid."""
    held = []
    for b in batches:
        starts = np.flatnonzero(np.append(True, b["gid"].to_numpy()[1:] != b["gid"].to_numpy()[:-1])).tolist() if len(b) else []
        for low, high in zip(starts, [*starts[1:], len(b)]):
            part = b.iloc[low:high]
            if held and held[0]["gid"].iloc[0] != part["gid"].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def candidates(sets: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(gid, node, half, key, nodes): the sets to be compared, by gid; those without a pair that counts there and agrees
    in `least` tokens are left out. A leaf is one gid; a larger one has a gid for every two of its blocks."""
    each = rows.groupBy("key").agg(F.collect_set(F.struct("node", "blocks")).alias("at")).join(sets.select("key", "marks"), "key")
    each = each.select("key", "marks", F.col("at.node").alias("nodes"), F.explode("at").alias("x")).select("key", "marks", "nodes", "x.node", "x.blocks")
    each = each.withColumn("own", F.pmod(F.xxhash64("key", "node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    gid = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for g in in_groups(batches):
            if len(g) > 1:
                left, right = sides(g["half"].to_numpy())
                wanted = to_compare(g["nodes"].tolist(), g["node"].iloc[0], left, right)
                if wanted.any():
                    wanted = agreeing(np.stack([np.frombuffer(x, dtype=np.uint8) for x in g["marks"]]), left, right, wanted, least)
                    keep = np.zeros(len(g), dtype=bool)
                    keep[left] |= wanted.any(axis=1)
                    keep[left if right is None else right] |= wanted.any(axis=0)
                    if keep.any():
                        out.append(g.drop(columns="marks")[keep])
                        n += len(out[-1])
            if n >= 5000:
                yield pd.concat(out)
                out, n = [], 0
        if out:
            yield pd.concat(out)

    dealt = each.select(gid.alias("gid"), "node", half.cast("int").alias("half"), "key", "nodes", "marks").repartition("gid").sortWithinPartitions("gid")
    return dealt.mapInPandas(choose, "gid long, node long, half int, key binary, nodes array<long>")


def links(rows: DataFrame, base: DataFrame, asked: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, n): with b, links that connect all that is linked; without, n links of the set a, to be summed."""
    asked = cut(asked)
    wanted = asked.select("key").distinct()
    stand = base.join(wanted, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHash()
        for b in batches:
            found = [shingles(t, words, k) for t in b["text"]]
            yield pd.DataFrame({"key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], "set": [s.tobytes() for s in found]})

    # An id may stand on several texts; the key tells which of their sets is meant.
    bodies = rows.join(stand.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text").mapInPandas(sets, "key binary, set binary").join(wanted, "key").groupBy("key").agg(F.min("set").alias("set"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in in_groups(batches):
            left, right = sides(g["half"].to_numpy())
            members, keys = [np.frombuffer(x, dtype=np.uint64) for x in g["set"]], g["key"].tolist()
            i, j = np.nonzero((similarities(members, left, right) >= threshold) & to_compare(g["nodes"].tolist(), g["node"].iloc[0], left, right))
            i, j = left[i], (left if right is None else right)[j]
            out += [(keys[a], keys[b], None) for a, b in forest(i, j, len(g))]
            degrees = np.bincount(np.append(i, j), minlength=len(g))
            out += [(keys[a], None, int(degrees[a])) for a in np.flatnonzero(degrees).tolist()]
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["a", "b", "n"]).astype({"n": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "n"]).astype({"n": "Int64"})

    grouped = asked.join(bodies, "key").repartition("gid").sortWithinPartitions("gid")
    return grouped.select("gid", "node", "half", "key", "nodes", "set").mapInPandas(verify, "a binary, b binary, n long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, recall: float = RECALL, bucket: int = BUCKET, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies.

    class_id: the smallest doc_id of the texts connected by links (similarity >= threshold). n_links: verified
    links of the row's set to other sets, all of them in groups of any size. n_copies: rows with the same set. Words are runs of characters other than
    ASCII white space. A text without words (null, empty, blank) is a class of its own with no links. Null ids are
    kept; a class of null ids only has a null class_id. Rows that repeat id and text stay. Pairs under the threshold are
    never linked; a pair at it is found with probability `recall` or more.
    """
    rows = texts(docs, id_col, text_col)
    base = cut(embedded(rows, k, threshold, runs_for(threshold, recall, levels)))
    sets = base.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min("size").alias("size"), F.min("sig").alias("sig"), F.min("marks").alias("marks"), F.min("nodes").alias("nodes"))
    sets = cut(sets)
    asked = candidates(sets, leaves(sets, threshold, bucket, levels), least_agreeing(threshold, recall))
    found = cut(links(rows, base.filter("key is not null").select("doc_id", "key"), asked, k, threshold))
    degree = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    labels = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    known = sets.select("key", "rep", "n_copies").join(labels, "key", "left").join(degree, "key", "left").withColumn("label", F.coalesce("label", "key"))
    lead = known.groupBy("label").agg(F.min("rep").alias("class_id"))
    info = known.join(lead, "label").select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return base.select("doc_id", "key").join(info, "key", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(parquet(spark, sf_dir, "documents"))
