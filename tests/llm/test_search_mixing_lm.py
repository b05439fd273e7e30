import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reckon.llm import bilinear, maxscore, mixing


def test_top_k_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)])) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0, 2.0]), (305, []), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    asked = [0, 50, 100, 200, 304]
    want = set()
    for q in asked:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    for shard, block in ((16384, 2048), (16, 2)):
        got = maxscore.top_k(df, df.filter(df.vec_id.isin(asked)), shard_rows=shard, query_block=block).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert maxscore.top_k(df.limit(0), df.limit(0)).count() == 0


def test_raking_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.choice([3, 90, 300])), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), "t1" if i % 3 else "t2") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    want = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 2.0)], "value string, weight double")
    cells = docs.selectExpr("coalesce(source, '') source", "lang", "topic", "size(split(text, ' ')) n").groupBy("source", "lang", "topic").sum("n").withColumnRenamed("sum(n)", "tokens")
    out = mixing.raked(cells, mixing.POWERS, 40, {"source": want}).collect()
    share = {s: sum(r.share for r in out if r.source == s) for s in ("a", "b", "")}
    assert share[""] == pytest.approx(0.5, abs=1e-6) and share["a"] == pytest.approx(0.25, abs=1e-6)
    assert max(r.probability for r in out) == 1
    kept = mixing.mix(docs, targets={"source": want}, topic="topic")
    assert kept.count() == 400 and kept.columns[-3:] == ["n_words", "probability", "sampled"]


def test_mixing_edge_rows(spark):
    rows = [(1, None, None, None), (None, "", "s", "en"), (2, "a b", "s", "en"), (2, "a b", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'clash' as sampled")
    got = mixing.mix(docs).collect()
    assert len(got) == 4 and all(0 <= r.probability <= 1 for r in got) and sorted(r.n_words for r in got) == [0, 0, 2, 2]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_raking_goes_on_until_the_marginals_are_met(spark):
    """Cells so lopsided that few sweeps are not enough; what is impossible ends too."""
    rows = [(s, l, t, (900 if (s, l) in (("a", "x"), ("b", "y")) else 150) + (300 if t == "t" else 0) + 70 * (s == "a")) for s in "ab" for l in "xy" for t in "tu"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    once = mixing.residuals(mixing.swept(mixing.wanted(cells, mixing.POWERS), 1)).agg({"residual": "max"}).first()[0]
    out = mixing.raked(cells, mixing.POWERS, 1)
    assert mixing.residuals(out).agg({"residual": "max"}).first()[0] <= mixing.TOLERANCE < once
    impossible = spark.createDataFrame([("a", 1.0)], "value string, weight double")
    assert mixing.raked(cells, mixing.POWERS, 1, {"source": impossible}).count() == 8


def test_tables_of_any_size_give_equal_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = sorted(mixing.mix(docs, kept=0.5).select("doc_id", "n_words", "probability", "sampled").collect())
    monkeypatch.setattr(mixing, "SENT_CELLS", 0)
    assert sorted(mixing.mix(docs.repartition(5), kept=0.5).select("doc_id", "n_words", "probability", "sampled").collect()) == sent
    long = spark.createDataFrame([(1, "word " * 200_000, "s", "en"), (2, "a|b " * 9, "s", "en"), (3, "12 34", "s", "en"), (4, "what? yes!", "s", "en")], "doc_id long, text string, source string, lang string")
    assert [r.t for r in long.select(mixing.text_topic(long.text).alias("t")).collect()] == ["prose", "markup", "numbers", "talk"]
    assert {r.doc_id: r.n_words for r in mixing.mix(long).collect()} == {1: 200_000, 2: 9, 3: 2, 4: 2}


def test_a_rare_cell_does_not_shrink_the_sample(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, "word " * 40, "en", "new source", 200), (-2, None, None, None, 0)], docs.schema)
    cells = mixing.mix(docs.unionByName(odd), kept=0.5)
    sums = cells.selectExpr("sum(greatest(n_words, 1) * probability) k", "sum(greatest(n_words, 1)) t").first()
    assert sums.k / sums.t == pytest.approx(0.5, abs=1e-6)
    assert {r.probability for r in cells.filter("doc_id < 0").collect()} == {1.0}
    words = lambda df: df.selectExpr("sum(size(filter(split(text, '[ \\\\t\\\\n]+'), w -> w != '')))").first()[0]
    assert words(corpus_pipeline.mix_sources(spark, docs.unionByName(odd), "")) > 0.35 * words(docs)
    for kept in (0.0, 1.0):
        assert {r.probability for r in mixing.mix(docs, kept=kept).select("probability").distinct().collect()} == {kept}


def small_model(n=30, scale=1.0):
    """A vocabulary of n words and random vectors."""
    rng = np.random.default_rng(0)
    counts = {f"w{i}".encode(): int(k) for i, k in enumerate(rng.integers(5, 900, n))}
    model = bilinear.first_model(counts, rng.integers(0, 50, bilinear.CLASSES).astype(float))
    for part in model.parts[:3]:
        part[:, : bilinear.WIDTH] = rng.normal(0, scale, (len(part), bilinear.WIDTH))
    return model


def each(model, texts, most=bilinear.AT_ONCE):
    return bilinear.log_probabilities(model, [p for t in texts for p in bilinear.pieces(np.array(t), most)])


@pytest.mark.parametrize("scale", [0.3, 3.0])
def test_symbols_sum_to_one(scale):
    model = small_model(scale=scale)
    found = each(model, [[3, 5, 9, k] for k in range(model.size)]).reshape(model.size, 4)
    assert np.exp(found[:, 3]).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(found[:, :3], found[0, :3], atol=1e-4)
    # Texts do not see each other, and a long text may be scored in parts.
    assert np.allclose(each(model, [[7, 8, 9]]), each(model, [[1], [7, 8, 9], [4, 4]])[1:4], atol=1e-4)
    long = np.random.default_rng(1).integers(0, model.size, 700)
    assert np.allclose(each(model, [long]), each(model, [long], most=64), atol=1e-4)


def loops(model, ids):
    """Log-probabilities of a text's symbols, one by one."""
    context, symbol, group, place = (x.astype(float) for x in model.parts)
    out = []
    for t, s in enumerate(ids):
        before = lambda k: context[ids[t - k]] if t >= k else context[model.size]  # noqa: E731,B023
        far = sum((context[ids[t - k]] for k in range(3, 19) if t >= k), np.zeros(bilinear.WIDTH + 1)) / 16
        h = before(1) * place[0] + before(2) * place[1] + far * place[2]
        h[bilinear.WIDTH] = 1
        g = int(model.group_of[s])
        members = range(model.begin[g], model.begin[g + 1])
        share = lambda rows, at: math.log(math.exp(rows[at] @ h) / sum(math.exp(r @ h) for r in rows))  # noqa: E731,B023
        out.append(share(group, g) + share(symbol[members.start : members.stop], s - members.start))
    return out


def test_probabilities_against_loops():
    model = small_model(scale=0.4)
    text = np.random.default_rng(2).integers(0, model.size, 60).tolist()
    assert np.allclose(each(model, [text]), loops(model, text), atol=1e-4)


def test_blocks_of_places_do_not_show(monkeypatch):
    model, rng = small_model(), np.random.default_rng(5)
    texts = [rng.integers(0, model.size, n).tolist() for n in (1, 17, 18, 19, 63, 200, 2, 64)]
    whole = each(model, texts)
    for block in (1, 7, 64):
        monkeypatch.setattr(bilinear, "BLOCK", block)
        assert np.allclose(each(model, texts), whole, atol=1e-4)


def test_gradients_go_back_to_the_words_of_the_context():
    rng = np.random.default_rng(3)
    found = [p for n in (1, 5, 40) for p in bilinear.pieces(rng.integers(0, 6, n), 1000)]
    p = bilinear.Places(found, 6)
    place, table = rng.normal(size=(3, bilinear.WIDTH + 1)).astype(np.float32), rng.normal(size=(7, bilinear.WIDTH + 1)).astype(np.float32)
    grad = rng.normal(size=(len(p.ids), bilinear.WIDTH + 1)).astype(np.float32) * p.text[:, None]
    ahead = (np.einsum("kij,kj->ij", p.contexts(table), place) * grad).sum()
    by_place, first = p.back(grad, place)
    back = (table[p.ids[p.text]] * by_place[p.text]).sum() + (table[6] * first).sum()
    assert ahead == pytest.approx(back, rel=1e-3)


def test_training_learns_what_follows():
    rng = np.random.default_rng(1)
    counts = {f"w{i}".encode(): 100 for i in range(20)}
    start = bilinear.first_model(counts, np.zeros(bilinear.CLASSES))
    texts = []
    for _ in range(400):
        x = [int(rng.integers(0, 20))]
        for _ in range(99):
            x.append((x[-1] * 7 + 3) % 20 if rng.random() < 0.9 else int(rng.integers(0, 20)))
        texts.append(np.array(x))
    batches = iter([[p for t in texts[i : i + 10] for p in bilinear.pieces(t, 1000)] for i in range(0, 400, 10)])
    vectors, used = bilinear.train(start, batches, 3, rate=0.15)
    model = bilinear.Model(start.words, start.begin, start.share, vectors)
    found = each(model, [[5, k, (k * 7 + 3) % 20] for k in range(20)]).reshape(20, 3)
    assert found[:, 2].mean() > np.log(1 / 20) + 1
    assert used[model.size] > 0 and used[-1] == 40000  # the vector before a text; every position


def stepped(model, batch, seed):
    """The vectors after one batch of training, place by place."""
    width, old = bilinear.WIDTH, model.vectors.astype(float)
    s, n_groups, group_of = model.size, len(model.begin) - 1, model.group_of
    of_group = np.add.reduceat(model.share, model.begin[:-1])
    rng, upto = np.random.default_rng([11, seed]), np.concatenate([[0], np.cumsum(model.share)])
    noise = rng.choice(n_groups, bilinear.GROUP_NOISE, p=of_group)
    low, high = upto[model.begin[:-1], None], upto[model.begin[1:], None]
    drawn = np.searchsorted(upto, low + rng.random((n_groups, bilinear.NOISE)) * (high - low), side="right") - 1
    grads, places = {k: np.zeros_like(old) for k in ("own", "drawn", "group", "noise", "before", "real", "lead", "place")}, old[-3:]
    n = 0
    for ids, lead in batch:
        for t in range(lead, len(ids)):
            at = {k: (ids[t - k], "lead" if t - k < lead else "real") if t >= k else (s, "before") for k in range(1, bilinear.REACH + 1)}
            used = [(*at[k], k - 1, 1) for k in (1, 2)] + [(*at[k], 2, 1 / bilinear.MEAN) for k in range(3, bilinear.REACH + 1) if t >= k]
            h, gh, g = sum(old[row] * places[k] * w for row, _, k, w in used), np.zeros(width + 1), group_of[ids[t]]
            h[width] = 1
            ratio = lambda i: bilinear.NOISE * model.share[i] / of_group[group_of[i]]
            met = [("own", s + 1 + ids[t], ratio(ids[t])), ("group", 2 * s + 1 + g, bilinear.GROUP_NOISE * of_group[g])]
            met += [("drawn", s + 1 + i, ratio(i)) for i in drawn[g]] + [("noise", 2 * s + 1 + i, bilinear.GROUP_NOISE * of_group[i]) for i in noise]
            for name, row, q in met:
                d = (name in ("own", "group")) - 1 / (1 + math.exp(math.log(q) - h @ old[row]))
                grads[name][row] += d * h
                gh += d * old[row]
            gh[width] = 0
            for row, name, k, w in used:
                grads[name][row] += gh * places[k] * w
                grads["place"][k - 3] += gh * old[row] * w
            n += 1
    grads["place"] /= n**0.5
    squares, new = np.ones_like(old), old.copy()
    for grad in grads.values():
        squares += grad**2
        new += bilinear.RATE * grad / np.sqrt(squares)
    return new


def test_training_step_against_loops():
    """Groups with several runs of places, with a run that is not full, and with none; texts that are cut."""
    model, rng = small_model(scale=0.4), np.random.default_rng(8)
    few = np.append(np.arange(8), model.size - 1)
    batch = [p for n in (1, 2, 30, 210) for p in bilinear.pieces(rng.choice(few, n), 90)]
    found, used = bilinear.train(model, iter([batch]), 5)
    want = stepped(model, batch, 5)
    assert np.abs(want - model.vectors).max() > 0.03 and np.allclose(found, want, atol=1e-5)
    assert used[-1] == 243 and (used[model.vectors.shape[0] - 3 :] == 243).all()


def test_sums_of_runs():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(600, bilinear.WIDTH + 1)).astype(np.float32)
    for first in (np.array([0]), np.arange(600), np.array([0, 1, 2, 9, 400, 599])):
        want = [rows[low:high].astype(float).sum(axis=0) for low, high in zip(first, [*first[1:], 600])]
        assert np.allclose(bilinear.run_sums(rows, first), want, atol=1e-4)
        assert np.allclose(bilinear.run_sums(rows[:, ::-1], first), np.array(want)[:, ::-1], atol=1e-4)  # rows that do not lie end to end


def tokens(text):
    return [*text.encode().lower().split(), bilinear.END]


def test_numbers_of_words():
    texts = ["", "  ", "W0 w1\tW0", " É\x0bodd\x0cx ÉÀ\x1cy a\n", "w1"]
    known = [b"w0", bilinear.END, b"w1"]
    numbers = bilinear.Numbers(known)
    found, lengths, other, n_other = numbers.of(pa.array(texts))
    words = [w for t in texts for w in tokens(t)]
    assert found.tolist() == [known.index(w) if w in known else 3 + bilinear.class_of(w) for w in words]
    assert lengths.tolist() == [len(tokens(t)) for t in texts]
    assert other.to_pylist() == [w for w in words if w not in known]
    assert n_other.tolist() == [0, 0, 0, 5, 0]
    assert list(bilinear.portions(pa.array(texts), 9)) == [(0, 2), (2, 1), (3, 1), (4, 1)]


def test_every_position_is_trained_on(monkeypatch):
    monkeypatch.setattr(bilinear, "BATCH", 700)
    monkeypatch.setattr(bilinear, "READ_BYTES", 300)
    texts = [" ".join(f"w{i % 9}" for i in range(n)) for n in (0, 1, 50, 2000)]
    numbers = bilinear.Numbers([b"w0", b"w1", bilinear.END])
    symbol_of = np.arange(3 + bilinear.CLASSES)
    batches = list(bilinear.batched(iter([pa.array(texts[:2]), pa.array(texts[2:])]), numbers, symbol_of))
    got = [int(i) for b in batches for ids, lead in b for i in ids[lead:]]
    assert got == numbers.of(pa.array(texts))[0].tolist() and len(got) == sum(n + 1 for n in (0, 1, 50, 2000))
    assert all(len(ids) <= 700 + bilinear.REACH for b in batches for ids, _ in b)


def test_parts_merge_by_use(spark):
    v = lambda *x: np.array(x, dtype=np.float32).tobytes()
    rows = [(0, 0, 1.0, v(1, 2)), (0, 700, 3.0, v(5, 2)), (9, 5, 2.0, v(7, 7))]
    got = {r["at"]: np.frombuffer(r.v, dtype=np.float32).tolist() for r in bilinear.merged(spark.createDataFrame(rows, "at int, part int, weight double, v binary")).collect()}
    assert got == {0: [4.0, 2.0], 9: [7.0, 7.0]}


def test_scores_against_loops(spark):
    """The whole score: the model's symbols, the counts of the words in a class, and words that are not counted."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["w1", "w2", "W3", "rare1", "rare2", "odd", "new"]) for _ in range(n)) for n in (0, 1, 7, 60)]
    model = small_model()
    train = {b"rare1": 4, b"rare2": 3, b"odd": 1} | {w: 50 for w in model.words}
    top = sorted(model.words) + [b"rare1", b"rare2", bilinear.END]  # odd is left to the join, and the end was never seen
    k = len(model.words)
    class_n, class_v = np.zeros(bilinear.CLASSES), np.zeros(bilinear.CLASSES)
    for w in (b"rare1", b"rare2", b"odd"):
        class_n[bilinear.class_of(w)] += train[w]
        class_v[bilinear.class_of(w)] += 1
    total, distinct = sum(train.values()), len(train)
    known = bilinear.Counts(total, distinct, top, np.array([train.get(w, 0) for w in top]), k, class_n, class_v)
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in train.items()], "word binary, n long")
    want = []
    for t in texts:
        words = tokens(t)
        ids = [model.words.index(w) if w in model.words else k + bilinear.class_of(w) for w in words]
        score = sum(loops(model, ids)) / math.log(10)
        score += sum(math.log10((train.get(w, 0) + 0.5) / (class_n[i - k] + 0.5 * (class_v[i - k] + 1))) for w, i in zip(words, ids) if i >= k)
        base = sum(math.log10((train.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        want.append((len(words), sum(w in train for w in words), base, score))
    got = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in bilinear.score_with(docs, model, known, counts).collect())
    assert np.allclose(got, sorted(want), atol=1e-3)


def test_lm_scores_and_base(spark):
    rows = [(i, "The cat Sat on the mat. " * (i % 5) + "É x" * (i % 2)) for i in range(40)] + [(None, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bilinear.score_texts(docs).collect()
    assert len(got) == 43
    train, texts = {}, []
    import zlib

    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    for i, t in rows:
        words = [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
        held = zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
        texts.append((i, held, words))
        if not held:
            for w in words:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    want = sorted((i or -1, held, len(w), sum(x in train for x in w), n, round(sum(math.log10((train.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, held, w in texts)
    assert sorted((r.doc_id or -1 if r.doc_id is None else r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    assert bilinear.score_texts(docs.limit(0)).count() == 0
    # A very long text, and columns whose names clash.
    odd = spark.createDataFrame([(1, "word " * 100_000, 1.0, "x"), (2, "word other", 2.0, "y")], "doc_id long, text string, score double, word string")
    assert {r.doc_id: r.n_tokens for r in bilinear.score_texts(odd).collect()} == {1: 100_001, 2: 3}


def test_lm_beats_unigrams_on_held_out(spark):
    got = bilinear.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    gain = (sum(r.score for r in got) - sum(r.base_score for r in got)) / sum(r.n_tokens for r in got)
    assert gain > 0.2
