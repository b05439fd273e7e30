import numpy as np
import pytest

from reckon.llm import quality, statistics, trees


def loops(text):
    """The base counts by plain loops."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@pytest.mark.parametrize("text", ["", " \n ", "a", "a b c", "a b c a b c", "x x x x", "a b c d a b c\na b c d\n\na b c d", "é#ß $$ <|x|>\n\t\x0b q", "a\x85b\xa0c d\x1ce f", "w " * 3000])
def test_base_counts(text):
    assert statistics.base_counts(text) == loops(text)


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, ((x[:, 0] - 2 * (x[:, 1] > 0.5) + rng.normal(0, 0.3, n)) > 0).astype(float)


def test_flat_arrays_score_like_a_walk():
    x, y = data()
    f = trees.fit(x, y, trees=12, depth=3)

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert np.allclose(f.raw(x), [walk(r) for r in x])
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_constraints_hold():
    x, y = data()
    f = trees.fit(x, y, trees=30, depth=4, monotone={0: -1, 1: 1})
    for feature, sign in ((0, -1), (1, 1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, feature] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(f.raw(grid).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-9).all()


def test_degenerate_fits():
    assert trees.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert (trees.fit(np.ones((20, 2)), np.ones(20)).score(np.zeros((1, 2))) > 0.9).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    rules = quality.quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rules]) >= 0.95


def test_edge_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (3, "w " * 20000, 0.5), (3, "w " * 20000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (9, 0)], "doc_id long, quality int")
    for out in (quality.classify(docs, labels), quality.quality_rules(docs, labels), quality.classify(docs, labels.limit(0))):
        assert out.count() == 5
        assert all(0 <= r.score <= 1 for r in out.collect())
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.n_words: r.base_failed for r in quality.quality_rules(docs, labels).collect()} == {0: True, 2: True, 20000: True}
