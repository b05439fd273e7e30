import random

import pytest

from reckon.llm import chosen_path as cp


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, threshold=0.8):
    s = {i: sets(t) for i, t in texts.items()}
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if s[i] and s[j] and jaccard(s[i], s[j]) >= threshold:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def make(rng):
    words = [f"w{i}" for i in range(4000)]
    texts, i = {}, 0
    for _ in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(body)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[i] = " ".join(copy)
            i += 1
    body = [rng.choice(words) for _ in range(150)]
    for _ in range(130):  # a group far above a bucket
        copy = list(body)
        for _ in range(rng.choice([0, 1, 2])):
            copy[rng.randrange(150)] = rng.choice(words)
        texts[i] = " ".join(copy)
        i += 1
    return texts


def test_classes_against_all_pairs(spark):
    texts = make(random.Random(5))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in cp.jaccard_classes(docs).collect()}
    want = brute(texts)
    wrong = [i for i in texts if got[i].class_id != want[i]]
    assert len(wrong) <= 0.01 * len(texts), [(i, got[i].class_id, want[i]) for i in wrong]
    ids = sorted(texts)[:100]
    s = {i: sets(t) for i, t in texts.items()}
    for i in ids:  # small groups: every link to another set is there
        near = {frozenset(s[j]) for j in texts if s[i] and s[j] and s[i] != s[j] and jaccard(s[i], s[j]) >= 0.8}
        assert got[i].n_links == len(near)


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "one two", 1), (5, "one two", 1), (5, "one two", 1), (None, "one two", 1), (6, "one two three", 1), (7, "x " * 9000, 1), (7, "another text on the same id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id or 0, r.class_id, r.n_links, r.n_copies) for r in cp.jaccard_classes(docs).collect()))
    assert got == sorted([(1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 0, 1), (4, 4, 0, 4), (5, 4, 0, 4), (5, 4, 0, 4), (0, 4, 0, 4), (6, 6, 0, 1), (7, 7, 0, 1), (7, 7, 0, 1)])
    assert cp.jaccard_classes(docs.limit(0)).count() == 0


def test_similarity_is_exact():
    rng = random.Random(2)
    words = cp._WordHash()
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    got = {(i, j): s for i, j, s in cp.similar([cp.shingles(t, words) for t in texts], 0.01)}
    for i in range(30):
        for j in range(i + 1, 30):
            assert abs(got.get((i, j), 0) - (x if (x := jaccard(sets(texts[i]), sets(texts[j]))) >= 0.01 else 0)) < 1e-9


def edited(body, n, rng, word):
    copy = list(body)
    for at in rng.sample(range(len(body)), n):
        copy[at] = word()
    return copy


@pytest.mark.parametrize("block", [cp.BLOCK, 128])
def test_large_groups_have_all_their_links(spark, monkeypatch, block):
    """A star (copies like the original, hardly like each other) and a shared template, both far above a bucket."""
    monkeypatch.setattr(cp, "BLOCK", block)
    rng, new = random.Random(8), iter(range(10**9))
    word = lambda: f"n{next(new)}"
    star = [word() for _ in range(300)]
    texts = {0: " ".join(star)} | {i: " ".join(edited(star, 5, rng, word)) for i in range(1, 601)}
    template = [word() for _ in range(300)]
    for i in range(2000, 2500, 2):
        body = edited(template, 7, rng, word)
        texts[i], texts[i + 1] = " ".join(body), " ".join(edited(body, 3, rng, word))
    s = {i: sets(t) for i, t in texts.items()}
    want = {i: 0 for i in texts}
    for group in (range(601), range(2000, 2500)):
        for i in group:
            for j in range(group[0], i):
                if jaccard(s[i], s[j]) >= 0.8:
                    want[i] += 1
                    want[j] += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in cp.jaccard_classes(docs).collect()}
    assert all(got[i].n_links <= want[i] for i in texts)
    assert sum(r.n_links for r in got.values()) >= 0.995 * sum(want.values())
    assert sum(got[i].class_id != 0 for i in range(601)) <= 3 and want[0] >= 595
    classes = brute({i: t for i, t in texts.items() if i >= 2000})
    assert sum(got[i].class_id != classes[i] for i in classes) <= 3


def test_runs_count_every_level():
    miss = 0.0
    for _ in range(cp.LEVELS):
        miss = (1 - (1 - miss) / cp.TOKENS) ** cp.TOKENS
    assert miss ** cp.runs_for(cp.THRESHOLD, cp.RECALL) <= 1 - cp.RECALL
