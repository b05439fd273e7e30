"""Operator 7, language-model scoring: a log-bilinear model trained with noise-contrastive estimation, in numpy.

The model predicts symbols: the words that the training texts hold often enough (the vocabulary follows the corpus, up to
a bound that keeps the model small enough to send), and classes of all other words by their last two bytes. Symbols lie in
groups of like endings, and a symbol's probability is that of its group times that of the symbol in the group; both
are normalised, so the probabilities of all texts sum to one. The vector of a context is linear in the vectors of the words
before: the last, the last but one, and the mean of sixteen more, each weighted by place. A score is that vector's product
with the group's or the symbol's own, plus a bias. A class shares its probability among its words by their counts in the
corpus, with a place for unknown words.

Every position of every training document is trained on once, in batches. Tasks train on their own documents from the same
start; what they send back are the vectors they touched, weighted by use, and a table merges them. The documents are dealt
into rounds, and a round starts from what the ones before have learnt.

Word counts are a table. Of it the most frequent words are sent to the tasks, a bounded number; the other words of a
document are joined with their counts, and the sums come back to it. Texts are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.common import cut, parquet, remainder, texts

#: Most words with a vector of their own (bounds what is sent: 256 bytes a word), and how often they must occur.
VOCABULARY, LEAST_COUNT = 16_384, 5
#: Most words whose counts are sent to the tasks, some 40 bytes each; the others meet theirs in a join.
COUNTED = 262_144
#: Classes of the words without a vector.
CLASSES = 1024
#: Vector width; noise samples of groups and of symbols in a group; places of a batch; places of a run of one group.
WIDTH, GROUP_NOISE, NOISE, BATCH, RUN = 31, 32, 12, 4096, 32
#: Words of the mean, how far a context reaches back, and rounds of training.
MEAN, REACH, ROUNDS = 16, 18, 2
RATE = 0.05
#: Places that are scored at a time, and of them those whose contexts and groups are (they stay in a core's cache).
AT_ONCE, BLOCK = 32_768, 2048
#: Bytes of texts that are split into words at a time, in counting and in training or scoring.
COUNTED_BYTES, READ_BYTES = 32_000_000, 8_000_000
#: Vectors of a merging group, and parts that one merging step takes together.
MERGED_ROWS, FAN = 512, 256
END = b" "  # no word holds white space


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


#: class_of by a word's last two bytes (times 256, plus the last), and by the byte of a word that has one.
BY_TWO = np.array([zlib.crc32(bytes((i // 256, i % 256))) % CLASSES for i in range(65536)])
BY_ONE = np.array([zlib.crc32(bytes((i,))) % CLASSES for i in range(256)])


def portions(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, number) of texts that hold `most` bytes together, or one."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield at, max(1, stop - at)
        at += max(1, stop - at)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words in lower case (A-Z only) as UTF-8, end to end, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, starts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text gives empty ones
    n = np.add.reduceat(filled.astype(np.int64), np.cumsum(starts) - starts) if len(starts) else starts
    return (flat if filled.all() else flat.filter(pa.array(filled))).cast(pa.binary()), n


class Numbers:
    """The number of a word: its place among the counted words (END is one), or their number plus the word's class."""

    def __init__(self, words: list[bytes]):
        self.words, self.n_words = pa.array(words, pa.binary()), len(words)
        self.end = words.index(END)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of the texts' tokens end to end, END after each text's words; tokens by text; the words that are not
        counted, end to end; and their number by text."""
        words, n = split_words(texts)
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = found < 0
        other = words.filter(pa.array(unknown))
        at = np.frombuffer(other.buffers()[1], dtype=np.int32)[other.offset : other.offset + len(other) + 1] if len(other) else np.zeros(1, dtype=np.int32)
        if len(other):
            data = np.frombuffer(other.buffers()[2], dtype=np.uint8)
            last, before = data[at[1:] - 1], data[np.maximum(at[1:] - 2, 0)].astype(np.int64)
            found[unknown] = self.n_words + np.where(np.diff(at) > 1, BY_TWO[before * 256 + last], BY_ONE[last])
        out = np.empty(len(found) + len(n), dtype=np.int64)
        ends = np.cumsum(n + 1) - 1
        is_word = np.ones(len(out), dtype=bool)
        is_word[ends] = False
        out[ends], out[is_word] = self.end, found
        owner = np.repeat(np.arange(len(n)), n)
        return out, n + 1, other, np.bincount(owner[unknown], minlength=len(n))


@dataclass
class Model:
    """words: the vocabulary, by reversed spelling; begin: where each group's symbols begin, and their number;
    share: the symbols' shares of the training tokens; vectors: rows for contexts (the last: before a text),
    symbols, groups and the three places. The last column is the bias of symbols and groups, and 0 elsewhere."""

    words: list[bytes]
    begin: np.ndarray
    share: np.ndarray
    vectors: np.ndarray

    @property
    def size(self) -> int:
        return int(self.begin[-1])

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views: contexts, symbols, groups, places."""
        s, g = self.size, len(self.begin) - 1
        return self.vectors[: s + 1], self.vectors[s + 1 : 2 * s + 1], self.vectors[2 * s + 1 : 2 * s + 1 + g], self.vectors[2 * s + 1 + g :]

    @property
    def group_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


def first_model(counts: dict[bytes, int], class_counts: np.ndarray, seed: int = 7) -> Model:
    """The common start: small random vectors, and log shares as biases. counts: of the vocabulary."""
    words = sorted(counts, key=lambda w: w[::-1])
    n = len(words) + CLASSES
    size = max(1, round(n**0.5))
    begin = np.unique(np.concatenate([np.arange(0, len(words), size), len(words) + np.arange(0, CLASSES, size), [n]]))
    share = np.concatenate([[counts[w] for w in words], class_counts]) + 0.5
    share = share / share.sum()
    rng = np.random.default_rng(seed)
    model = Model(words, begin, share, np.zeros((2 * n + len(begin) + 3, WIDTH + 1), dtype=np.float32))
    context, symbol, group, place = model.parts
    for part in (context, symbol, group):
        part[:, :WIDTH] = rng.normal(0, 0.1, (len(part), WIDTH))
    of_group = np.add.reduceat(share, begin[:-1])
    symbol[:, WIDTH] = np.log(share / of_group[model.group_of])
    group[:, WIDTH] = np.log(of_group)
    place[:, :WIDTH] = np.array([1, 1, 4])[:, None]
    return model


def pieces(ids: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """A text's symbols in parts of `most` at most, each with as many symbols before it as a context reaches, and their number."""
    for at in range(0, len(ids), most):
        lead = min(at, REACH)
        yield ids[at - lead : at + most], lead


class Places:
    """Symbols of pieces laid end to end, with REACH places before each piece and at the end that no context looks beyond."""

    def __init__(self, found: list[tuple[np.ndarray, int]], before: int):
        """before: the symbol that stands before a text."""
        at = REACH
        self.ids = np.full(sum(len(ids) + REACH for ids, _ in found) + REACH, before, dtype=np.int64)
        self.text, self.real = np.zeros(len(self.ids), dtype=bool), np.zeros(len(self.ids), dtype=bool)
        for ids, lead in found:
            self.ids[at : at + len(ids)] = ids
            self.text[at : at + len(ids)] = True
            self.real[at + lead : at + len(ids)] = True
            at += len(ids) + REACH

    def contexts(self, context: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """For each place from low to high, the vectors of the last word, of the last but one, and the mean of those before (the
        first axis). The first REACH places lack what lies before low."""
        each = context.take(self.ids[low:high], axis=0)
        out = np.empty((3, *each.shape), dtype=np.float32)
        out[0, :1], out[1, :2], out[2, :REACH] = 0, 0, 0
        out[0, 1:], out[1, 2:] = each[:-1], each[:-2]
        each[~self.text[low:high]] = 0
        for width in (1, 2, 4, 8):  # sums of 2, 4, 8 and MEAN places, of as many as there are
            each = each[width:] + each[:-width]
        np.multiply(each[:-3], np.float32(1 / MEAN), out=out[2, REACH:])
        return out

    def back(self, grad: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the context vectors of all places, and of the vector before a text."""
        out = np.empty_like(grad)
        np.multiply(grad[1:], place[0], out=out[:-1])
        out[-1] = 0
        out[:-2] += grad[2:] * place[1]
        first = out[~self.text].sum(axis=0)
        sums = grad
        for width in (1, 2, 4, 8):
            sums = sums[:-width] + sums[width:]
        sums = sums[3:]
        sums *= place[2] / MEAN
        out[:-REACH] += sums  # the last places are no text's
        return out, first


def shortfall(x: np.ndarray) -> np.ndarray:
    """1 less the logistic function, in place; exp overflows to the right limit."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def firsts(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, sorted_numbers[1:] != sorted_numbers[:-1]))


def run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at `first`. numpy adds column by column, and two columns as one complex number."""
    return np.add.reduceat(np.ascontiguousarray(rows).view(np.complex64), first, axis=0).view(np.float32)


def states(seen: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Contexts' vectors; the last column, which meets the biases, is 1."""
    h = seen[0] * place[0]
    h += seen[1] * place[1]
    h += seen[2] * place[2]
    h[:, WIDTH] = 1
    return h


@np.errstate(over="ignore")
def train(model: Model, batches: Iterator[list[tuple[np.ndarray, int]]], seed: int, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Vectors after Adagrad on noise-contrastive estimates, and how often each was used.

    For its group, a place competes with GROUP_NOISE groups drawn by share for the whole batch; for its symbol, with NOISE
    symbols drawn by share in its group. The places of a batch are sorted by symbol and so by group, and those of one
    group are taken in runs, so sums are over neighbours and products are dense. The vectors of noise are negated and lack
    the noise's logarithm in their bias, so that what each vector adds to a gradient is the shortfall of its product.
    """
    m = Model(model.words, model.begin, model.share, model.vectors.copy())
    context, symbol, group, place = m.parts
    at_symbol, at_group, at_place = len(context), len(context) + len(symbol), len(context) + len(symbol) + len(group)
    squares, used = np.ones_like(m.vectors), np.zeros(len(m.vectors))
    rng = np.random.default_rng([11, seed])
    group_of, n_groups = m.group_of, len(m.begin) - 1
    of_group = np.add.reduceat(m.share, m.begin[:-1])
    of_group = of_group / of_group.sum()
    log_group = np.log(GROUP_NOISE * of_group).astype(np.float32)
    log_symbol = np.log(NOISE * m.share / np.add.reduceat(m.share, m.begin[:-1])[group_of]).astype(np.float32)
    upto = np.concatenate([[0], np.cumsum(m.share)])
    low, high = upto[m.begin[:-1]], upto[m.begin[1:]]
    small = np.uint16 if len(m.vectors) < 65536 else np.int64  # sorts faster

    def move(rows: np.ndarray, total: np.ndarray, weight: np.ndarray) -> None:
        used[rows] += weight
        step = squares.take(rows, axis=0)
        step += total * total
        squares[rows] = step
        np.sqrt(step, out=step)
        np.divide(total, step, out=step)
        step *= np.float32(rate)
        step += m.vectors.take(rows, axis=0)
        m.vectors[rows] = step

    def move_sorted(at: np.ndarray, grad: np.ndarray) -> None:
        first = firsts(at)
        move(at[first], run_sums(grad, first), np.diff(np.append(first, len(at))))

    def move_any(at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at.astype(small), kind="stable")
        move_sorted(at[order], grad.take(order, axis=0))

    for batch in batches:
        p = Places(batch, m.size)
        real = np.flatnonzero(p.real)
        real = real[np.argsort(p.ids[real].astype(small), kind="stable")]
        seen, target = p.contexts(context), p.ids[real]
        own, n_real = group_of[target], len(real)
        h = np.zeros((n_real + 1, WIDTH + 1), dtype=np.float32)  # the last row fills up runs
        h[:-1] = states(seen, place).take(real, axis=0)
        padded, h = h, h[:-1]
        # The group's noise.
        noise = rng.choice(n_groups, GROUP_NOISE, p=of_group)
        vn = -group[noise]
        vn[:, WIDTH] += log_group[noise]
        dn = shortfall(h @ vn.T)
        grad = dn @ vn
        by_noise = -(dn.T @ h)
        # The group, and the symbols drawn in it: runs of places of one group, all with the group's noise.
        n_own = np.bincount(own, minlength=n_groups)
        n_runs = -(-n_own // RUN)
        of_run = np.repeat(np.arange(n_groups), n_runs)
        nth = np.arange(len(of_run)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        rows = (np.cumsum(n_own) - n_own)[of_run][:, None] + (nth * RUN)[:, None] + np.arange(RUN)
        held = rows < np.cumsum(n_own)[of_run][:, None]
        rows[~held] = n_real
        drawn = np.searchsorted(upto, low[:, None] + rng.random((n_groups, NOISE)) * (high - low)[:, None], side="right") - 1
        drawn = np.clip(drawn, m.begin[:-1, None], m.begin[1:, None] - 1)
        each = np.empty((n_groups, NOISE + 1, WIDTH + 1), dtype=np.float32)
        np.negative(symbol[drawn], out=each[:, :NOISE])
        each[:, :NOISE, WIDTH] += log_symbol[drawn]
        each[:, NOISE] = group
        each[:, NOISE, WIDTH] -= log_group
        hs, vs = padded.take(rows, axis=0), each.take(of_run, axis=0)
        ds = shortfall(hs @ vs.transpose(0, 2, 1))
        grad += (ds @ vs).reshape(-1, WIDTH + 1).take(np.flatnonzero(held), axis=0)  # runs hold the places in order
        by_run = ds.transpose(0, 2, 1) @ hs
        by_each = by_run[nth == 0]
        place_of = np.cumsum(n_own > 0) - 1
        for k in range(1, int(nth.max()) + 1):
            by_each[place_of[of_run[nth == k]]] += by_run[nth == k]
        # The symbol.
        vt = symbol.take(target, axis=0)
        dt = shortfall(np.einsum("ij,ij->i", h, vt) - log_symbol[target])
        vt *= dt[:, None]
        grad += vt
        h *= dt[:, None]
        move_sorted(target + at_symbol, h)
        move_any(drawn[n_own > 0].ravel() + at_symbol, -by_each[:, :NOISE].reshape(-1, WIDTH + 1))
        move(np.flatnonzero(n_own) + at_group, by_each[:, NOISE], n_own[n_own > 0])
        move_any(noise + at_group, by_noise)
        # The context.
        grad[:, WIDTH] = 0
        whole = np.zeros((len(p.ids), WIDTH + 1), dtype=np.float32)
        whole[real] = grad
        of_place = np.einsum("kij,ij->kj", seen, whole)
        by_place, first = p.back(whole, place)
        move(np.array([m.size]), first[None], np.array([1.0]))
        move_sorted(target, by_place.take(real, axis=0))
        if len(leads := np.flatnonzero(p.text & ~p.real)):
            move_any(p.ids[leads], by_place[leads])
        move(at_place + np.arange(3), of_place / np.float32(len(real) ** 0.5), np.full(3, len(real)))
    return m.vectors, used


def batched(columns: Iterator[pa.Array], numbers: Numbers, symbol_of: np.ndarray) -> Iterator[list[tuple[np.ndarray, int]]]:
    """All positions of columns of texts, in batches of some BATCH places."""
    held, n = [], 0
    for column in columns:
        for low, count in portions(column, READ_BYTES):
            found, lengths, _, _ = numbers.of(column.slice(low, count))
            symbols, ends = symbol_of[found], np.cumsum(lengths)
            for start, end in zip((ends - lengths).tolist(), ends.tolist()):
                for piece in pieces(symbols[start:end], BATCH):
                    held.append(piece)
                    n += len(piece[0])
                    if n >= BATCH:
                        yield held
                        held, n = [], 0
    if held:
        yield held


def longest(vectors: np.ndarray) -> float:
    return float(np.einsum("ij,ij->i", vectors, vectors).max()) ** 0.5


def log_normalised(h: np.ndarray, vectors: np.ndarray, at: np.ndarray, most: float) -> np.ndarray:
    """Logarithms of the shares of the vectors `at` in the softmax of h's products with all the vectors. No product exceeds
    `most`, in either direction."""
    scores = h @ vectors.T
    picked = scores[np.arange(len(at)), at].astype(np.float64)
    if most < 60 or (scores.max() < 60 and picked.min() > -60):  # neither overflow nor an empty sum
        return picked - np.log(np.exp(scores, out=scores) @ np.ones(len(vectors), dtype=np.float32))
    top = scores.max(axis=1, keepdims=True)
    scores -= top
    return picked - top[:, 0] - np.log(np.exp(scores, out=scores).sum(axis=1))


def log_probabilities(model: Model, found: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Natural log-probabilities of the pieces' symbols, in order, without those that lead."""
    context, symbol, group, place = model.parts
    p = Places(found, model.size)
    target = p.ids[p.real]
    own = model.group_of[target]
    h, out, n = np.empty((len(target), WIDTH + 1), dtype=np.float32), np.empty(len(target)), 0
    of_group = longest(group)
    for low in range(0, len(p.ids), BLOCK):
        lead = min(low, REACH)
        real = np.flatnonzero(p.real[low : low + BLOCK])
        if len(real):
            some = slice(n, n + len(real))
            h[some] = states(p.contexts(context, low - lead, low + BLOCK), place)[lead + real]
            out[some] = log_normalised(h[some], group, own[some], longest(h[some]) * of_group)
            n += len(real)
    order = np.argsort(own.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(model.begin)))
    most = longest(h) * longest(symbol) if len(h) else 0.0
    for g in np.flatnonzero(np.diff(cuts)):
        rows, low = order[cuts[g] : cuts[g + 1]], model.begin[g]
        out[rows] += log_normalised(h[rows], symbol[low : model.begin[g + 1]], target[rows] - low, most)
    return out


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary), n: counts of all tokens of the training texts, END included; summed over many texts in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, n in portions(b.column(0), COUNTED_BYTES):
                found = pc.value_counts(split_words(b.column(0).slice(low, n))[0])
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([n], pa.int64())], ["word", "n"])

    return training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def merged(parts: DataFrame) -> DataFrame:
    """(at, weight, v): the weighted mean of each vector over all parts. Steps of FAN parts, so no group grows with them."""

    def mean(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at", kind="stable")
        at, w = b["at"].to_numpy(), b["weight"].to_numpy()
        v = np.frombuffer(b"".join(b["v"]), dtype=np.float32).reshape(len(b), -1) * w[:, None]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        weight = np.add.reduceat(w, first)
        v = (np.add.reduceat(v, first, axis=0) / weight[:, None]).astype(np.float32)
        return pd.DataFrame({"at": at[first], "part": b["part"].iloc[0] // FAN, "weight": weight, "v": [x.tobytes() for x in v]})

    for _ in range(3):
        parts = parts.groupBy((F.col("at") / MERGED_ROWS).cast("int"), (F.col("part") / FAN).cast("int")).applyInPandas(mean, "at int, part int, weight double, v binary")
    return parts.select("at", "v")


@dataclass
class Counts:
    """What of the corpus' counts is sent: total and distinct tokens; the counted words, most frequent first, END among them,
    and their counts; tokens and distinct words by class, of all words without a vector (n_vectors of the counted ones have one)."""

    total: int
    distinct: int
    words: list[bytes]
    n: np.ndarray
    n_vectors: int
    class_n: np.ndarray
    class_v: np.ndarray

    def symbol_of(self, model: Model) -> np.ndarray:
        """The symbol of every number that Numbers(words) gives."""
        own = {w: i for i, w in enumerate(model.words)}
        other = len(model.words)
        return np.array([*(own[w] for w in self.words[: self.n_vectors]), *(other + class_of(w) for w in self.words[self.n_vectors :]), *range(other, other + CLASSES)])


def counted(counts: DataFrame, vocabulary: int) -> Counts:
    in_class = (F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int")
    # Words by sixteenths of powers of two of their counts: a few hundred rows tell from which count on they are sent, so that
    # tasks return no more of them than that.
    scale = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.b, r.n) for r in counts.filter("n > 1").groupBy(scale.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, sent = 10**6, 0
    for b, k in sizes:
        if sent + k > max(COUNTED, vocabulary):
            break
        least, sent = b, sent + k
    top = counts.filter("n > 1").filter(scale >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, n = [bytes(w) for w in top["word"]], top["n"].to_numpy(dtype=np.int64)
    if END not in words:  # it is counted always, since it stands in every text
        own = counts.filter(F.col("word") == F.lit(END)).first()
        words, n = [*words, END], np.append(n, own.n if own else 0)
    n_vectors = min(vocabulary, int((n >= LEAST_COUNT).sum()))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(in_class.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r.k], class_v[r.k] = r.n, r.v
    total, distinct = int(class_n.sum()), int(class_v.sum())
    for word, k in zip(words[:n_vectors], n):
        class_n[class_of(word)] -= k
        class_v[class_of(word)] -= 1
    return Counts(total, distinct, words, n, n_vectors, class_n, class_v)


def fitted(training: DataFrame, start: Model, known: Counts, rounds: int = ROUNDS) -> Model:
    """The model after all rounds; only the merged vectors of each come to the driver."""
    vectors, symbol_of = start.vectors, known.symbol_of(start)
    for turn in range(rounds):
        now = Model(start.words, start.begin, start.share, vectors.copy())

        def learn(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            found, used = train(now, batched((b.column(0) for b in batches), Numbers(known.words), symbol_of), part)
            rows = np.flatnonzero(used)
            if len(rows):
                v = pa.array([x.tobytes() for x in found[rows]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(used[rows]), v], ["at", "part", "weight", "v"])

        own = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).select("text")
        vectors = vectors.copy()
        for at, v in merged(own.mapInArrow(learn, "at int, part int, weight double, v binary")).toPandas().itertuples(index=False):
            vectors[at] = np.frombuffer(v, dtype=np.float32)
    return Model(start.words, start.begin, start.share, vectors)


def score_texts(docs: DataFrame, held_out_remainder: int = 1, modulus: int = 5, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(doc_id as text) mod `modulus` differs from the remainder. base_score:
    smoothed unigram log10 probability; score: the model's. Null text counts as empty and so has one token, the end;
    a null id hashes as ''. Without training documents both scores still come from normalised (flat) shares.
    Repeated rows are documents each. An empty table gives no rows. Other columns, whatever their names, are dropped.
    """
    rows = texts(docs)
    training = rows.filter(remainder("doc_id", modulus) != held_out_remainder)
    counts = cut(word_counts(training))
    known = counted(counts, vocabulary)
    model = fitted(training, first_model(dict(zip(known.words[: known.n_vectors], known.n.tolist())), known.class_n), known)
    out = score_with(rows, model, known, counts)
    return out.select("doc_id", (remainder("doc_id", modulus) == held_out_remainder).alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_with(rows: DataFrame, model: Model, known: Counts, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of rows (doc_id, text); counts: (word, n) of all training words.

    A row is told from others by its partition and its place there, so rows must come in the same partitions if they are
    read again, as files do.
    """
    log_base = float(np.log10(known.total + 0.5 * (known.distinct + 1)))
    log_class = np.log10(known.class_n + 0.5 * (known.class_v + 1))
    logs = np.log10(known.n + 0.5)
    symbol_of = known.symbol_of(model)
    # What a token adds to each score besides the model's logarithm for its symbol; a word that is not counted lacks the
    # logarithm of its count, which the join brings.
    own = np.append(logs, np.zeros(CLASSES))
    add_base = own - log_base
    add_score = np.where(symbol_of < len(model.words), 0, own - log_class[np.maximum(symbol_of - len(model.words), 0)])
    is_known = np.append(known.n > 0, np.zeros(CLASSES, dtype=bool)).astype(np.int64)
    information = "struct<doc_id: bigint, n_tokens: bigint, n_known: bigint, base: double, score: double>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(known.words)
        next_row = TaskContext.get().partitionId() << 40
        for b in batches:
            for low, count in portions(b.column(1), READ_BYTES):
                found, lengths, other, n_other = numbers.of(b.column(1).slice(low, count))
                symbols, ends = symbol_of[found], np.cumsum(lengths)
                # Long texts are scored in parts; short ones together.
                each, group, n = [], [], 0
                for piece in (p for start, end in zip((ends - lengths).tolist(), ends.tolist()) for p in pieces(symbols[start:end], AT_ONCE)):
                    if group and n + len(piece[0]) > AT_ONCE:
                        each.append(log_probabilities(model, group))
                        group, n = [], 0
                    group.append(piece)
                    n += len(piece[0])
                each.append(log_probabilities(model, group))
                sums = lambda x: pa.array(np.add.reduceat(x, ends - lengths))  # noqa: E731,B023
                info = {"doc_id": b.column(0).slice(low, count), "n_tokens": pa.array(lengths), "n_known": sums(is_known[found]), "base": sums(add_base[found]), "score": sums(np.concatenate(each) / np.log(10) + add_score[found])}
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_other)]).astype(np.int32)), other)
                row = pa.array(np.arange(next_row, next_row + count))
                next_row += count
                yield pa.RecordBatch.from_arrays([row, pa.StructArray.from_arrays(list(info.values()), list(info)), words], ["row", "info", "words"])

    each = rows.select("doc_id", "text").mapInArrow(scored, f"row bigint, info {information}, words array<binary>")
    # One row for the document itself, whose word is none, and one for each of its words that are not counted.
    itself = F.array(F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary").alias("word"), F.col("info")))
    others = F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(None).cast(information).alias("info")))
    flat = each.select("row", F.explode(F.concat(itself, others)).alias("x")).select("row", "x.*")
    met = flat.join(counts, "word", "left")
    added = F.when(F.col("info").isNull(), F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).otherwise(0.0)
    out = met.groupBy("row").agg(F.max("info").alias("info"), F.sum(added).alias("logs"), F.count("n").alias("known"))
    return out.select("info.doc_id", "info.n_tokens", (F.col("info.n_known") + F.col("known")).alias("n_known"), (F.col("info.base") + F.col("logs")).alias("base_score"), (F.col("info.score") + F.col("logs")).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(parquet(spark, sf_dir, "documents"))
