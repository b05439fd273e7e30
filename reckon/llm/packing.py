"""Operator 6, packing: best-fit decreasing with a segment tree indexed by remaining capacity."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import bpe
from reckon.llm.common import cut, parquet, texts

PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that one best-fit-decreasing run takes, about.
RUN_PIECES = 100_000
#: Entries of a worker's chunk cache; beyond it the cache starts anew.
CACHE_ENTRIES = 500_000
#: Texts that are encoded together.
TEXTS = 500


class CapacityTree:
    """Open windows by remaining capacity 0..size; each leaf holds a stack of windows, inner nodes their number."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.count = [0] * (2 * self.n)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = self.n + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest open window with capacity >= need."""
        i = self.n + need
        while not self.count[i]:
            while i & 1:  # climb to the next subtree on the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.n:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.n
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece (1 <= length <= size), and the number of windows. Ties keep input order."""
    tree, window, offset, made = CapacityTree(size), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (got := tree.take(lengths[i])) is None:
            got, made = (size, made), made + 1
        capacity, window[i] = got
        offset[i] = size - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], window[i])
    return window, offset, made


class Encoder:
    """Token ids of texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    The vocabulary's words do not influence each other, so ids are kept by white-space-separated chunk. New chunks
    that are letters with punctuation after them are cut there; their letters go to the library many at a time, and the
    ids that end a word tell where each word's ids end. Texts that a chunk cannot stand for go to the library whole.
    """

    #: Punctuation that forms one word of the pattern after letters.
    after = ".,!?;:*$&%#\"()"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str], at_once: int = 200) -> None:
        """Ids of words of letters alone."""
        parts = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            body = ids.tobytes()
            if len(cuts) == len(part) + 1:
                self.ids.update((w, body[i:j]) for w, i, j in zip(part, cuts, cuts[1:]))
            else:
                self.ids.update(zip(part, self.library(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; some hundred texts at a time, so that what is held besides the cache stays small."""
        if len(self.ids) >= CACHE_ENTRIES:
            self.ids.clear()
        chunks = [None if "<|" in t or bpe.WordBpe.plain.search(t) else t.lower().split() for t in texts]
        new = set().union(*filter(None, chunks)).difference(self.ids)
        cut = [(c, w, c[len(w) :]) for c in new if (w := c.rstrip(self.after)).isalpha()]
        plain = {c for c, _, _ in cut}
        other = list((new - plain) | {t for _, _, t in cut if t and t not in self.ids})
        self.ids.update(zip(other, self.library(other)))
        self.letters([w for w in {w for _, w, _ in cut} if w not in self.ids])
        ids = self.ids
        ids.update((c, ids[w] + ids[t]) for c, w, t in cut if t)
        return [self.library([t])[0] if c is None else b"".join(map(ids.__getitem__, c)) for t, c in zip(texts, chunks)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, size: int, end_id: int, path: str | None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents as ids and end_id, cut into windows of `size` and a rest."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path or bpe.default_path())
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            ids_of = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            for at in range(0, len(batch), TEXTS):
                out = []
                for doc_id, ids in zip(ids_of[at : at + TEXTS], enc.encode(batch["text"].iloc[at : at + TEXTS].tolist())):
                    ids += end
                    for low in range(0, len(ids), 4 * size):
                        piece = ids[low : low + 4 * size]
                        out.append((doc_id, low // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                yield pd.DataFrame(out, columns=list(PIECE)).astype({"doc_id": "Int64"})

    return docs.mapInPandas(cut_up, ", ".join(f"{c} long" for c in PIECE))


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id; null text counts as empty, so its document is end_id alone. A document
    of size ids or more is first cut into full windows; all pieces are packed by best-fit decreasing. Pieces, not texts,
    are dealt by their content into runs of about RUN_PIECES, so a run's last windows are the only ones partly filled
    for want of pieces, and memory is bounded. Equal pieces are counted before they are dealt and dealt one by
    one, so very many of them spread over all runs. The result depends on the rows alone, not on their order or
    partitions: sequence_id is the run's number times 2^40 plus the window's in it. Null ids and repeated rows are
    documents like any others; an empty table gives no rows.
    """
    counted = cut(pieces(texts(docs, id_col, text_col), size, end_id, path).groupBy(*PIECE).agg(F.count("*").alias("n")))
    runs = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // RUN_PIECES))
    each = counted.select(*PIECE, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    dealt = each.withColumn("run", F.pmod(F.xxhash64(*PIECE, "copy"), F.lit(runs)))

    def packed(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, [(c, "ascending") for c in (*PIECE, "copy")], null_placement="at_start"))
        window, offset, _ = best_fit_decreasing(found["length"].to_pylist(), size)
        ids = (found["run"][0].as_py() << 40) + np.array(window, dtype=np.int64)
        return found.select(list(PIECE)).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("run").applyInArrow(packed, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(parquet(spark, sf_dir, "documents"))
