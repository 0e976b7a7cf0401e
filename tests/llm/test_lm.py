"""Pseudo-likelihood: sums against naive terms, gradients against differences, spelling, held-out text, file splits, odd cases."""

import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm, queries

SMALL = lm.Shape(classes=4, per_class=8, hidden=4, buckets=8)


def naive_score(text, words, net, spelling, counts):
    """The sum of one text's conditional log-probabilities, token by token."""
    shape, place = net.shape, {w: i for i, w in enumerate(words)}

    def code(w):
        return w[-2] * 256 + w[-1] if len(w) > 1 else 65536 + w[-1]

    def bucket(w):
        return (code(w) * 0x9E3779B97F4A7C15 % 2**64 >> 33) % shape.buckets

    tokens = text.split()
    ids = [place.get(w, shape.first_bucket + bucket(w)) for w in tokens]
    padded = [shape.tokens] * 2 + ids + [shape.tokens] * 2
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    total = 0.0
    for i, w in enumerate(tokens):
        h = net.bias.astype(float).copy()
        for k, o in enumerate(lm.OFFSETS):
            h += net.embed[k * (shape.tokens + 1) + padded[i + 2 + o]]
        h = np.tanh(h)
        g, p = divmod(ids[i], shape.per_class)
        total += math.log(softmax(h @ net.to_class + net.class_bias)[g]) + math.log(softmax(h @ net.to_token[g] + net.token_bias[g])[p])
        if w not in place:
            spell, b = spelling.ends[code(w)], bucket(w)
            for j in range(len(w) - 2, -1, -1):  # backwards: the byte before j, given bytes j and j + 1
                context = (w[j] * 256 + w[j + 1]) * 40503 % 65521 % lm.CONTEXTS
                spell += spelling.steps[context * lm.SYMBOLS + (w[j - 1] if j else 256)]
            own = [v for v in counts if v not in place and bucket(v) == b]
            total += math.log((counts[w] + len(own) * math.exp(spell)) / (sum(counts[v] for v in own) + len(own)))
    return total


def test_scores_are_the_sums_of_naive_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.fit(docs, SMALL, shard_tokens=20_000)
    vocabulary, net = model.vocabulary, model.network
    got = {r.doc_id: r for r in lm.score(docs, model, model.words).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    counts = Counter(w for t in texts.values() for w in t.split())
    assert set(got) == set(texts)
    short = [i for i, t in texts.items() if len(t) < 700][:12]
    assert len(short) > 5
    for i in short:
        assert got[i].pll == pytest.approx(naive_score(texts[i], vocabulary.words, net, vocabulary.spelling, counts), rel=1e-4, abs=1e-3)
    for i, t in texts.items():
        assert got[i].n_tokens == len(t.split()) and (got[i].pll_mean is None) == (not t.split())


def test_vocabulary_and_tables_count_every_word(spark, make_docs):
    texts = ["aa bb cc dd"] * 3 + ["bb zz zzz q é"] * 2 + ["aa", None, ""]
    counts = Counter(w for t in texts if t for w in t.encode().split())
    shape = lm.Shape(classes=2, per_class=2, hidden=2, buckets=2)
    vocabulary = lm.fit(make_docs(texts), shape).vocabulary
    assert vocabulary.words == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:2]
    ends, steps, kinds = lm.spelling_counts(lm.count_words(make_docs(texts)), vocabulary)
    rare = {w: n for w, n in counts.items() if w not in vocabulary.words}
    assert ends.sum() == sum(rare.values()) and steps.sum() == sum(n * (len(w) - 1) for w, n in rare.items())
    assert kinds.sum() == len(rare) and ends[ord("z") * 257] == 4 and ends[65536 + ord("q")] == 2


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(0)
    spelling = lm.Spelling.of(rng.integers(0, 5, lm.ENDS).astype(float), rng.integers(0, 3, lm.CONTEXTS * lm.SYMBOLS).astype(float), np.ones(lm.ENDS), 16)
    bucket = lm.end_bucket(np.arange(lm.ENDS), 16)
    assert np.bincount(bucket, np.exp(spelling.ends), 16) == pytest.approx(np.ones(16), rel=1e-3)
    assert np.exp(spelling.steps).reshape(lm.CONTEXTS, lm.SYMBOLS).sum(1) == pytest.approx(np.ones(lm.CONTEXTS), rel=1e-3)
    known, unknown = spelling.log_probabilities([b"abc", b"xyz"])
    assert known < 0 and unknown < 0


def test_gradients_are_those_of_the_mean_loss():
    rng = np.random.default_rng(1)
    net = lm.Network.start(SMALL, rng.integers(1, 50, SMALL.tokens).astype(float))
    flat, sizes = np.concatenate([[32] * 2, rng.integers(0, 32, 60), [32] * 2]), np.array([60])
    at = lm.positions_of(sizes)
    for k in lm.Network.NAMES:  # doubles, so that differences tell
        setattr(net, k, getattr(net, k).astype(float))
    found = {}

    def keep(name, gradient, rate, where=Ellipsis):
        out = found.setdefault(name, np.zeros_like(getattr(net, name)))
        out[where] += gradient

    net._step = keep
    net.train(flat, at)
    loss = lambda: -net.log_probabilities(flat, at).mean()
    for name in lm.Network.NAMES:
        value = getattr(net, name)
        for place in zip(*(rng.integers(0, n, 6) for n in value.shape), strict=True):
            was = value[place]
            value[place] = was + 1e-2
            up = loss()
            value[place] = was - 1e-2
            down = loss()
            value[place] = was
            assert found[name][place] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_held_out_text_is_likelier_than_by_frequency(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs.where("doc_id % 2 = 0"), shard_tokens=50_000)
    vocabulary, net = model.vocabulary, model.network
    counts = Counter(w for r in docs.where("doc_id % 2 = 0").collect() for w in (r.text or "").encode().split())
    known = np.array([counts[w] for w in vocabulary.words] + [0] * (net.shape.first_bucket - len(vocabulary.words)), float)
    texts = [(r.text or "").encode() for r in docs.where("doc_id % 2 = 1").collect()]
    numbers, sizes = lm.tokens_of(texts, vocabulary, net.shape.tokens)
    flat, _ = vocabulary.settled(numbers)
    at = lm.positions_of(sizes)
    shares = np.concatenate([known, vocabulary.spelling.total]) + 1
    by_frequency = np.log(shares / shares.sum())[flat[at]].mean()
    assert net.log_probabilities(flat, at).mean() > by_frequency + 0.1


def test_sets_are_averaged_by_levels(spark):
    rng = np.random.default_rng(2)
    sets = [(i, int(n), rng.normal(size=5).astype(np.float32)) for i, n in enumerate(rng.integers(1, 100, 11))]
    df = spark.createDataFrame([(i, n, bytearray(x.tobytes())) for i, n, x in sets], "part long, n long, mean binary").repartition(3)
    (row,) = lm.averaged(df, 11, 2).collect()
    assert row.n == sum(n for _, n, _ in sets)
    assert np.frombuffer(row["mean"], np.float32) == pytest.approx(sum(n * x for _, n, x in sets) / row.n, rel=1e-5, abs=1e-6)


def test_scores_do_not_depend_on_the_file_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fits = [lm.fit(docs.repartition(n), SMALL, shard_tokens=5_000) for n in (1, 7)]
    assert fits[0].vocabulary.words == fits[1].vocabulary.words and fits[0].shards > 5
    for k in lm.Network.NAMES:
        assert getattr(fits[0].network, k) == pytest.approx(getattr(fits[1].network, k), rel=1e-4, abs=1e-5)
    one, two, other = ({r.doc_id: r.pll for r in lm.score(docs, m, words).collect()} for m, words in ((fits[0], fits[0].words), (fits[1], fits[1].words), (fits[0], None)))
    assert one == pytest.approx(two, rel=1e-4) and one == pytest.approx(other, rel=1e-6)


def test_rare_words_are_known_by_their_counts(make_docs):
    common = ["c%d c%d c%d" % (i % 12, i % 11, i % 7) for i in range(400)]
    docs = make_docs(common + ["c1 c2 qaaing c3 c4"] * 9 + ["c1 c2 qbbing c3 c4"])
    model = lm.fit(docs, lm.Shape(classes=4, per_class=4, hidden=4, buckets=4))
    got = {r.doc_id: r.pll for r in lm.score(docs, model, model.words).collect()}
    assert got[400] > got[409] + 1
    unseen = make_docs(["c1 c2 qbbing c3 c4", "c1 c2 qzzing c3 c4"])
    known, new = (r.pll for r in sorted(lm.score(unseen, model).collect()))
    assert known == pytest.approx(got[409], rel=1e-6) and math.isfinite(new) and new < known


def test_pseudo_likelihood_odd_cases(make_docs, odd_texts):
    got = {r.doc_id: r for r in lm.pseudo_likelihood(make_docs(odd_texts), SMALL).collect()}
    for i, t in enumerate(odd_texts):
        n = len((t or "").encode().split())
        assert got[i].n_tokens == n and (got[i].pll < 0 if n else got[i].pll == 0 and got[i].pll_mean is None)
        assert not n or math.isfinite(got[i].pll)
    assert got[4].pll == pytest.approx(got[9].pll)  # equal texts
    assert lm.pseudo_likelihood(make_docs()).count() == 0
    nulls = make_docs(rows=[(None, "a b", None, None, None, None, None, None)] * 3 + [(None,) * 8])
    assert sorted(r.n_tokens for r in lm.pseudo_likelihood(nulls, SMALL).collect()) == [0, 2, 2, 2]


def test_query_scores_every_row(spark, sf_dir):
    rows = queries.op1_pseudo_likelihood(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r.pll <= 0 for r in rows)


def test_words_are_looked_up_at_the_cost_of_counting_them():
    text = " ".join(f"w{i}" for i in range(200_000)).encode()
    vocabulary = lm.Vocabulary([b"w1", b"w2"], SMALL)
    rare = [w for w in text.split() if w not in vocabulary.words]

    def least(run, first=lambda: None):
        took = []
        for _ in range(3):
            vocabulary.forget()
            first()
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    counting = least(lambda: Counter(text.split()))
    assert least(lambda: vocabulary.tokens(lm.words_of([text])[0].dictionary)) < 4 * counting  # in training
    assert least(lambda: lm.tokens_of([text], vocabulary, SMALL.tokens), lambda: vocabulary.learn(rare, [1] * len(rare))) < 4 * counting  # in scoring


def test_tokens_in_batch_are_those_word_by_word():
    words = [b"aa", b"q", "é漢".encode(), b"zz", b"x" * 3000, b"bq", b"b"]
    vocabulary = lm.Vocabulary([b"zz", b"aa"], SMALL)
    numbers, _ = lm.tokens_of([b" ".join(words)], vocabulary, SMALL.tokens)
    flat, _ = vocabulary.settled(numbers)
    for part in (slice(0, 7), slice(2, 6), slice(3, 4), slice(0, 0)):
        tokens, rare = vocabulary.tokens(pa.array(words, pa.large_binary())[part])
        assert tokens.tolist() == flat[lm.PAD : -lm.PAD][part].tolist()
        assert lm.bytes_of(rare) == [w for w in words[part] if w not in vocabulary.words]
    assert lm.Vocabulary([], SMALL).tokens(pa.array(words[:1], pa.large_binary()))[0][0] >= SMALL.first_bucket


def test_shards_tell_each_of_their_words_once(spark, sf_dir, monkeypatch):
    for name, least in (("ROOM", 3000), ("WAIT", 50), ("SPELL", 70)):  # so that all three run out many times
        monkeypatch.setattr(lm, name, least)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.fit(docs, SMALL, shard_tokens=20_000)
    rows = docs.select(lm.dealt(docs, model.shards, "doc_id", "text")[0].alias("shard"), "text").collect()
    want = {(r.shard, w) for r in rows for w in (r.text or "").encode().split()} - {(k, w) for k in range(model.shards) for w in model.vocabulary.words}
    assert model.shards > 1 and Counter((r.shard, bytes(r.word)) for r in model.words.collect()) == dict.fromkeys(want, 1)
    told, untold = ({r.doc_id: r.pll for r in lm.score(docs, model, words).collect()} for words in (model.words, None))
    assert told == pytest.approx(untold, rel=1e-6)
