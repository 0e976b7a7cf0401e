"""Packing, quality rules, SimHash, mixing and media columns against brute force on whole small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import media, mixing, packing, quality, queries, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- media columns


def media_truth(text):
    data = (text or "").encode()
    padded = data + b" " * (-len(data) % 192 if data else 192)
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])


def test_media_query_matches_brute_force(spark, sf_dir):
    docs = texts_of(spark, sf_dir)
    got = queries.op10_media_columns(spark, sf_dir).collect()
    assert len(got) == len(docs)
    same = defaultdict(set)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == media_truth(docs[r.doc_id].text)
        same[docs[r.doc_id].text].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_media_odd_cases(make_docs, odd_texts):
    got = {r.doc_id: r for r in media.media_columns(make_docs(odd_texts)).collect()}
    for i, t in enumerate(odd_texts):
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == media_truth(t)
        assert hashlib.sha256(got[i].media).hexdigest() == got[i].media_sha256 and len(got[i].media) == got[i].media_bytes
        assert media.png_decode(bytes(got[i].media)).tobytes()[: got[i].n_bytes] == (t or "").encode()
    assert media.media_columns(make_docs()).count() == 0


@pytest.mark.parametrize("channels", [1, 3])
def test_png_undoes_every_filter(channels):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (10, 12 * channels)).astype(np.uint8)
    lines = np.zeros((10, 12 * channels + 1), np.uint8)
    zero = [0] * (12 * channels)
    for y in range(10):
        kind = y % 5
        up, mine = (rows[y - 1].tolist() if y else zero), rows[y].tolist()
        for x, v in enumerate(mine):
            a, b, c = (mine[x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (v - [0, a, b, (a + b) // 2, paeth][kind]) % 256
        lines[y, 0] = kind
    assert (media.unfilter(lines, channels) == rows).all()


def test_png_refuses_damage():
    good = media.png_encode(b"a" * 192 * 3)
    for at in (0, 20, 50, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.png_decode(bytes(bad))
    with pytest.raises(ValueError):
        media.png_decode(good[:-4])
    assert struct.unpack(">II", good[16:24]) == (192, 3)


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(0)
    image = np.add.outer(np.arange(64), np.arange(192)).astype(np.uint8)
    near = image.copy()
    near[5, 5] ^= 3
    bits = lambda x: int(media.cosine_hash(x), 16)
    assert (bits(image) ^ bits(near)).bit_count() <= 4
    assert (bits(image) ^ bits(rng.integers(0, 256, (64, 192)).astype(np.uint8))).bit_count() > 12


def hash_truth(samples):
    """The hash in plain Python integers and fractions."""
    from fractions import Fraction
    from math import cos, floor, pi

    height, width = len(samples), len(samples[0])

    def cell(i, j):
        total = Fraction(0)
        for y in range(height):
            over_y = min(Fraction((i + 1) * height, 32), y + 1) - max(Fraction(i * height, 32), y)
            for x in range(width) if over_y > 0 else ():
                over_x = min(Fraction((j + 1) * width, 32), x + 1) - max(Fraction(j * width, 32), x)
                total += max(over_x, 0) * over_y * samples[y][x]
        return floor(64 * total * 1024 / (height * width))

    cells = [[cell(i, j) for j in range(32)] for i in range(32)]
    wave = [[round(cos(pi * (2 * x + 1) * k / 64) * 16384) for x in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * cells[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sum(sorted(low)[31:33])
    return f"{int(''.join('1' if 2 * f > middle + 4 * 64 * 16384 * 16384 else '0' for f in low), 2):016x}"


@pytest.mark.parametrize("size", [(1, 192), (3, 192), (37, 40), (32, 32)])
def test_hash_matches_brute_force(size):
    image = np.random.default_rng(size[0]).integers(0, 256, size).astype(np.uint8)
    assert media.cosine_hash(image) == hash_truth(image.tolist())


def test_hash_of_flat_images_and_ramps_is_fixed():
    for value in (0, 32, 255):  # a flat image has its average and nothing else
        for size in ((1, 192), (7, 192), (200, 192), (5, 50)):
            assert media.cosine_hash(np.full(size, value, np.uint8)) == ("8000000000000000" if value else "0" * 16)
    ramp = np.add.outer(np.arange(64), np.arange(192)).astype(np.uint8)
    # only the first row and column of frequencies are not 0, and of these the odd ones, which fall with the ramp
    assert media.cosine_hash(ramp) == "8000000000000000"
    assert media.cosine_hash(255 - ramp) == "d580008000800080"
    assert media.media_row(b"")[6] == "8000000000000000"


# --- mixing


def brute_lague(shares, seats):
    out = [0] * len(shares)
    for _ in range(seats):
        i = max(range(len(shares)), key=lambda k: (shares[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(5)
    for _ in range(40):
        shares = [float(x) for x in rng.integers(1, 1000, rng.integers(1, 12))]
        seats = int(rng.integers(0, 300))
        assert mixing.sainte_lague(shares, seats) == brute_lague(shares, seats)


def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def check_mix(docs, rows, tolerance):
    size = Counter()
    for r in docs:
        size[r.source] += len(WORDS.findall(r.text or ""))
    targets, taken, by_id = brute_targets(size), Counter(), {r.doc_id: r for r in docs}
    for r in rows:
        d = by_id[r.doc_id]
        assert r.size == len(WORDS.findall(d.text or "")) and r.source_size == size[d.source]
        assert r.target == pytest.approx(targets[d.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(tolerance * t, 2)


def test_mix_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.op9_mix_sources(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check_mix(docs, rows, 0.01)
    again = queries.op9_mix_sources(spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)


def test_mix_caps_small_sources_and_shards(make_docs, odd_texts):
    rows = [(i, "a b c d e f g h i j" * (1 + i % 3), "en", ["big", "tiny", None][0 if i > 9 else 1 if i > 4 else 2], 1, "", 0.0, "") for i in range(400)]
    rows += [(1000 + i, t, "en", "odd", 1, "", 0.0, "") for i, t in enumerate(odd_texts)]
    docs = make_docs(rows=rows)
    got = mixing.mix_sources(docs, per_shard=50, block=7)
    check_mix(docs.collect(), got.collect(), 0.05)
    for r in got.collect():
        assert sum((p.end - p.start) * p.times for p in r.parts) == r.taken and all(0 <= p.start < p.end <= r.size for p in r.parts)
    assert mixing.mix_sources(make_docs()).count() == 0
    empty = mixing.mix_sources(make_docs([None, "", " "])).collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 3


# --- packing


def truth_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_paths()[0])
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def check_packed(docs, pieces, window=1024):
    ids_of = truth_ids()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == {d.doc_id for d in docs}
    for d in docs:
        ids, at = ids_of(d.text), 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    used = []
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        used.append(at)
    return used


def test_pack_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    used = check_packed(docs, queries.op3_pack_mixture(spark, sf_dir).collect())
    assert sum(u < 1024 for u in used) <= 1


def test_pack_odd_cases_and_carried_deficits(make_docs, odd_texts):
    rows = [(i, "the of and tion " * (5 + i % 40), "en", ["a", "b", None][min(2, i % 5)], 1, "", 0.0, "") for i in range(300)]
    rows += [(1000 + i, t, "en", "odd", 1, "", 0.0, "") for i, t in enumerate(odd_texts)]
    docs = make_docs(rows=rows)
    pieces = packing.pack(docs, shard_tokens=10_000, lane=2, keep_ids=True).collect()
    used = check_packed(docs.collect(), pieces)
    assert sum(u < 1024 for u in used) <= 12
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
    assert packing.pack(make_docs()).count() == 0


def test_windows_keep_to_target_proportions():
    rng = np.random.default_rng(2)
    shares = [0.5, 0.3, 0.2]
    queues = [[(s * 10_000 + i, int(n)) for i, n in enumerate(rng.integers(20, 900, k))] for s, k in enumerate((500, 300, 200))]
    pieces = packing.fill_windows(queues, shares, [0.0] * 3)
    by_window = defaultdict(Counter)
    for d, _, n, w, _ in pieces:
        by_window[w][d // 10_000] += n
    steady = min(max(w for w in by_window if by_window[w][s]) for s in range(3))
    run = Counter()
    for w in range(steady):
        assert sum(by_window[w].values()) == 1024
        run.update(by_window[w])
        for s in range(3):  # carried deficits hold the running total near the target, always
            assert abs(run[s] - shares[s] * 1024 * (w + 1)) <= 3 * 128 + 1


def test_fast_tokenizer_equals_the_other(spark):
    tok = packing.ByteBpe(*packing.default_paths())
    rng = np.random.default_rng(7)
    alphabet = [chr(c) for c in range(256)] + list("    \n\n'stvre0123") + ["don't", "  ", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert tok.ids(text).tolist() == tok.slow.encode(text, add_special_tokens=False).ids
    for text in ("漢字かな", " x y", "<|endoftext|>a", "\U0001f600 ok", "Ελληνικά ١٢٣"):
        assert tok.ids(text).tolist() == tok.slow.encode(text, add_special_tokens=False).ids


# --- quality


def count_truth(text):
    words = WORDS.findall(text or "")
    windows = list(zip(*(words[k:] for k in range(5)), strict=False))
    found, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, rep, n < 10 or 100 * rep > 20 * n


def test_quality_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = texts_of(spark, sf_dir)
    got = queries.op4_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == count_truth(docs[r.doc_id].text)
        assert not (r.base_failed and r.kept)


def test_quality_odd_cases(make_docs, odd_texts, spark):
    texts = [*odd_texts, "a b c d e f a b c d e\na b\na b\n \n \n", "x y z x y z x y z x y z"]
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(make_docs(texts), labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == count_truth(t)
        assert r.kept == (not r.base_failed)  # too few labels for any cutoff to hold
    assert quality.quality_rules(make_docs(), labels.limit(0)).count() == 0


def test_binomial_bound_is_exact():
    from math import comb

    for k, n, p in ((0, 20, 0.1), (3, 50, 0.05), (7, 9, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    bound = quality.upper_bound(2, 100, 0.05)
    assert quality.binomial_tail(2, 100, bound) == pytest.approx(0.05)


def test_cutoffs_limit_false_rejection(make_docs, spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 4 == 0
        words = [("w%d" % x) + ("#" if bad and rng.random() < 0.6 else "") for x in rng.integers(0, 500, 40)]
        rows.append((i, " ".join(words), ["en", None][i % 3 == 0], "s", 1, "", 0.0, ""))
        labels.append((i, int(not bad), 0))
    docs, marks = make_docs(rows=rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    half = marks.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.quality_rules(docs, half).collect()}
    for lang in ("en", None):
        unseen = [i for i in range(6000) if i % 2 and rows[i][2] == lang]
        good, bad = [i for i in unseen if i % 4], [i for i in unseen if i % 4 == 0]
        assert sum(not got[i].kept for i in good) <= 0.02 * len(good)
        assert not bad or sum(not got[i].kept for i in bad) >= 0.9 * len(bad)
    assert quality.keep_good(docs, half).columns == docs.columns


def test_small_strata_get_cutoffs(make_docs, spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for lang in "abcd":
        for i in range(340):
            bad, words = i % 17 == 0, ["w%d" % x for x in rng.integers(0, 500, 40)]
            if lang != "d":  # capitals tell nothing there, symbols do
                words = [w.upper() if rng.random() < 0.9 else w for w in words]
            words = [w + ("#" if bad and k % 2 else "") for k, w in enumerate(words)]
            labels.append((len(rows), int(not bad), 0))
            rows.append((len(rows), " ".join(words), lang, "s", 1, "", 0.0, ""))
    got = {r.doc_id: r for r in quality.quality_rules(make_docs(rows=rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i, good, _ in labels:
        assert got[i].kept == bool(good)


def test_joint_rejection_is_tested_against_alpha():
    n = 400
    levels = np.zeros((n + 40, 4), np.int64)
    good = np.arange(n + 40) < n
    levels[:6, 0], levels[6:12, 1] = 15, 15  # 6 of 400 pass, 12 do not
    levels[n : n + 30, 0], levels[n + 30 :, 1] = 15, 15
    cuts = quality.choose_set(levels, np.ones(n + 40, np.int64), good, 0.04, 0.05)
    assert cuts[0] is not None and cuts[1] is None
    lost = int((good & (levels[:, 0] > 0)).sum())
    assert quality.binomial_tail(lost, n, 0.04) <= 0.05 < quality.binomial_tail(2 * lost, n, 0.04)


# --- SimHash


def print_truth(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def group_truth(prints):
    """doc_id -> smallest reachable, by all pairs."""
    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4), strict=True):
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_simhash_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = texts_of(spark, sf_dir)
    prints = {i: print_truth(d.text) for i, d in docs.items()}
    groups = group_truth(prints)
    got = queries.op7_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", groups[i]) for i in docs} and len(got) == len(docs)


def test_simhash_components_of_a_larger_table(spark):
    """Links here differ in every segment, the first one included."""
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op7_simhash(spark, sf_dir).collect()}
    ids = sorted(got)
    fp = np.array([int(got[i].fingerprint, 16) for i in ids], np.uint64)
    root, segments = list(range(len(ids))), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at in range(0, len(ids), 500):
        apart = np.bitwise_count(fp[at : at + 500, None] ^ fp[None, :])
        for i, j in zip(*np.nonzero(apart <= 4), strict=True):
            segments |= {k for k, (low, width) in enumerate(simhash.segments(4)) if int(fp[at + i] ^ fp[j]) >> low & ((1 << width) - 1)}
            a, b = find(int(i) + at), find(int(j))
            root[max(a, b)] = min(a, b)
    assert segments == {0, 1, 2, 3, 4}
    assert {i: got[i].component_id for i in ids} == {ids[k]: ids[find(k)] for k in range(len(ids))}


@pytest.mark.parametrize("prefix", [1, 2])
def test_pairs_that_differ_in_any_segments_are_linked(spark, prefix):
    from itertools import combinations

    rng = np.random.default_rng(11)
    cut, pairs = simhash.segments(4), set()
    for n in (1, 2, 3, 4):
        for chosen in combinations(range(5), n):
            x = int(rng.integers(0, 2**63))
            y = x
            for s in chosen:
                y ^= 1 << (cut[s][0] + int(rng.integers(cut[s][1])))
            pairs.add(tuple(sorted(v - (v >> 63 << 64) for v in (x, y))))
    df = spark.createDataFrame([(v,) for p in pairs for v in p], "fp long")
    assert {tuple(r) for r in simhash.links(df, prefix=prefix).collect()} == pairs


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"prefix": 2}, {"prefix": 2, "block": 3}])
def test_simhash_links_are_whole(spark, how):
    rng = np.random.default_rng(4)
    fps = set(rng.integers(-(2**63), 2**63, 300).tolist())
    for base in rng.integers(-(2**63), 2**63, 12).tolist():
        now = base & (2**64 - 1)
        for _ in range(15):  # chains that drift, and dense groups
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            for k in flips:
                now ^= 1 << int(k)
            fps.add(now - (now >> 63 << 64))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    prints = {x: x & (2**64 - 1) for x in fps}
    from tessera.llm.common import components

    edges = simhash.links(df, **how)
    assert edges.count() < 40 * len(fps)
    got = {r.node: r.root for r in components(edges).collect()}
    assert {x: got.get(x, x) for x in fps} == group_truth(prints)


def test_simhash_odd_cases(make_docs, odd_texts):
    docs = make_docs([*odd_texts, "ONE", "one two three four five six seven"])
    groups = group_truth({i: print_truth(t) for i, t in enumerate([*odd_texts, "ONE", "one two three four five six seven"])})
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == groups
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(groups.values())
    assert simhash.near_duplicates(make_docs()).count() == 0


def test_components_on_paths_stars_and_loops(spark):
    from tessera.llm.common import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
