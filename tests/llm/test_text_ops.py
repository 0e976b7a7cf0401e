"""Secret spans against brute force, and language identification on its held-out fold."""

import hashlib
import re
import zlib

from pyspark.sql import functions as F

from tessera.llm import language, queries, secrets

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base_truth(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == n for _, n, _ in spans) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


def test_secret_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_linked_secrets(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.n_hex for r in rows)
    for r in rows:
        counts, digest, joined = base_truth(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == digest
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_weak_parts_need_complements(make_docs, odd_texts):
    weak = "user: jsmith and https://db.example.com/x then"
    texts = [*odd_texts, weak, f"{weak} password=abcdefghijkl1", f"{weak} {'word ' * 100} password=abcdefghijkl1"]
    got = {r.doc_id: r for r in secrets.secret_spans(make_docs(texts)).collect()}
    assert len(got) == len(texts)
    assert [got[len(odd_texts) + k].n_linked for k in range(3)] == [0, 2, 0]
    assert secrets.secret_spans(make_docs()).count() == 0


def test_languages_of_the_held_out_fold(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_language(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
        if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und":
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(right) > 30 and sum(right) >= 0.9 * len(right), (sum(right), len(right))


def test_language_odd_cases(make_docs, odd_texts):
    assert language.identify(make_docs(odd_texts)).count() == len(odd_texts)
    assert language.identify(make_docs()).count() == 0


def test_planted_secrets_match_brute_force(make_docs):
    texts = ["é AKIA" + "Q1" * 8 + " x AKIAQ1", "My Token: 'abcdefghijkl' API_KEY=short apikey=AbC/+=.-_1234 passwd = 0123456789abcdef01", "deadbeef" * 2 + "G" + "ab" * 7]
    found = secrets.secret_spans(make_docs(texts)).withColumn("s", secrets.span_text(F.col("base_spans")))
    for r in found.collect():
        counts, _, joined = base_truth(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and sum(counts) > 0 and r.s == joined
