import random

import pytest

from reckon.llm import winnowing


def all_earlier(texts, words):
    """The definition by plain loops over all earlier places: id -> numbers of the lines that go."""
    seqs = {i: [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in texts.items()}
    gone, runs = {}, {}
    for i in sorted(seqs):
        seq = seqs[i]
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(x[2] for x in seq[a:b]) >= words:
                    run = tuple(x[1] for x in seq[a:b])
                    if runs.setdefault(run, (i, a)) < (i, a):
                        gone.setdefault(i, set()).update(x[0] for x in seq[a:b])
    return gone


@pytest.mark.parametrize("words", [20, 40])
def test_against_loops(spark, words):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 5, 9, 30]))) for _ in range(25)] + ["", "  "]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 8, 20, 60]))) for i in range(80)}
    for i in range(60, 75):
        texts[i] = texts[i - 40] + "\n" + texts[i - 20]
    want = all_earlier(texts, words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in winnowing.drop_repeats(docs, words=words).collect()}
    assert want
    for i, t in texts.items():
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())), i
        assert got[i].n_removed == len(want.get(i, ()))


def test_long_line_and_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"own a\n{long}\nown b", "x"), (2, f"other\n{long}", "x"), (2, f"other\n{long}", "x"), (None, long, "x"), (3, None, "x"), (4, "", "x"), (5, "short\nshort", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in winnowing.drop_repeats(docs).collect()), key=str)
    assert got == sorted([(1, "own a\nown b", 1), (2, "other", 1), (2, "other", 1), (0, long, 0), (3, None, 0), (4, "", 0), (5, "short\nshort", 0)], key=str)
    assert winnowing.drop_repeats(docs.limit(0)).count() == 0


def test_all_earlier_places_count(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    g, h, z = line("g", 30), line("h", 30), line("z", 30)
    texts = {1: f"{g}\n{z}", 2: f"{g}\n{h}", 3: f"{g}\n\n{h}", 4: f"short line\n{g}\n{h}"}
    # The tail of a run whose last full window occurs first before another line.
    texts |= {10: "\n".join([line("p", 45), line("q", 10), "other"]), 11: "\n".join([line("p", 45), line("q", 10), "tail end"]), 12: "\n".join([line("p", 45), line("q", 10), "tail end"])}
    rng = random.Random(9)
    pool = [line(f"l{k}_", rng.choice([1, 3, 8, 26, 30])) for k in range(12)] + [""]
    texts |= {i: "\n".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 12]))) for i in range(20, 80)}
    want = all_earlier(texts, 50)
    assert want[3] == {0, 2} and want[4] == {1, 2} and want[12] == {0, 1, 2}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in winnowing.drop_repeats(docs).collect()}
    for i, t in texts.items():
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())), i
        assert got[i].n_removed == len(want.get(i, ()))
