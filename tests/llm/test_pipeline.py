"""Fuzzy line dedup against brute force, and the pipeline's stages on a whole small table."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import lines, mixing, neardup


def near(a, b, size=8, threshold=0.8):
    x, y = ({t[i : i + size] for i in range(len(t) - size + 1)} for t in (a, b))
    return a == b or (len(a) >= size and len(b) >= size and len(x & y) >= threshold * len(x | y))


def kept_truth(texts):
    """Kept (document, line) positions: the first of each component of near lines with a word."""
    at = [(d, n, x) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    parent = list(range(len(at)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(at)):
        for j in range(i):
            if near(at[i][2], at[j][2]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {at[i][:2] for i in range(len(at)) if root(i) == i}, at


@pytest.mark.parametrize("search", [{}, {"dense": 0, "block": 8}, {"bands": 16, "rows": 1, "dense": 0}])
def test_lines_match_brute_force(make_docs, search):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [" ".join(word() for _ in range(12)) for _ in range(12)]
    texts = []
    for _ in range(40):
        picked = []
        for line in rng.choices(base, k=4):
            at = rng.randrange(len(line))
            picked.append(line if rng.random() < 0.4 else line[:at] + "Z" + line[at + 1 :])
        texts.append("\n".join([*picked, "", word()]))
    texts += [None, "", "\n\n", "short", "short"]
    keep, at = kept_truth(texts)
    for r in lines.dedup_lines(make_docs(texts), **search).collect():
        mine = [(n, x) for d, n, x in at if d == r.doc_id]
        assert r.lines_before == len(mine)
        assert [x for x in (r.text or "").split("\n") if x.strip()] == [x for n, x in mine if (r.doc_id, n) in keep]
        assert r.lines_cut == sum((r.doc_id, n) not in keep for n, _ in mine)
        assert (r.text is None) == (texts[r.doc_id] is None)


def test_sketch_bound_never_rules_out_near_pairs():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 62, 120).astype(np.uint64) for _ in range(3)]
    sets += [np.concatenate([s[: 120 - k], rng.integers(0, 1 << 62, k).astype(np.uint64)]) for s in sets for k in range(1, 30)]
    bits = np.zeros((len(sets), 512), bool)
    for row, s in zip(bits, sets, strict=True):
        row[(s & np.uint64(511)).astype(int)] = True
    side = (np.array([len(set(s.tolist())) for s in sets]), np.arange(len(sets)), np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    a, b, bound = lines.possible(side, side, 0.8)
    passed = dict(zip(zip(a.tolist(), b.tolist(), strict=True), bound.tolist(), strict=True))
    for i, x in enumerate(map(set, (s.tolist() for s in sets))):
        for j, y in enumerate(map(set, (s.tolist() for s in sets))):
            true = len(x & y) / len(x | y)
            assert i == j or true < 0.8 or passed[i, j] >= true - 1e-9
    assert len(passed) < len(sets) ** 2 / 2


def test_lines_odd_cases(make_docs, odd_texts):
    assert lines.dedup_lines(make_docs(odd_texts)).count() == len(odd_texts)
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_partitions_of_short_lines(make_docs):
    texts = ["short", "a\nbc\nshort", "tiny", "short"]
    got = lines.dedup_lines(make_docs(texts).coalesce(1)).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3]
    assert {r.doc_id: r.text for r in got} == {r.doc_id: r.text for r in lines.dedup_lines(make_docs(texts + ["one line that is long enough for shingles"])).collect() if r.doc_id < 4}


def kept_documents(texts, size=5, threshold=0.8):
    low = [("".join(c.lower() if c.isascii() else c for c in t or "").split(), i) for i, t in enumerate(texts)]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for w, _ in low]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_documents_match_brute_force(make_docs, odd_texts):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice((40, 200, 400)))] for _ in range(8)]
    texts = [*odd_texts, *odd_texts]
    for _ in range(60):
        words = list(rng.choice(base))
        for k in rng.sample(range(len(words)), rng.choice((0, 1, 3, 8))):
            words[k] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words).title())
    got = neardup.keep_one(make_docs(texts))
    assert got.columns == make_docs(()).columns
    assert {r.doc_id for r in got.collect()} == kept_documents(texts)
    assert neardup.keep_one(make_docs(())).count() == 0


def test_mixed_texts_hold_the_taken_words(make_docs, odd_texts):
    docs = make_docs([*odd_texts, "a b c d e f"] * 2)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert len(mixing._WORDS.findall(r.text)) > 0 and r.n_chars == len(r.text) and taken[r.doc_id] > 0
    assert mixing.taken_text("a  b c", [{"start": 0, "end": 2, "times": 2}, {"start": 2, "end": 3, "times": 1}]) == "a  b c\n\na  b"


def test_stages_hand_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, sf_dir), name)
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n <= before and docs.select("doc_id").distinct().count() == n
        before = n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
