"""Quality rules with risk-controlled thresholds.

Counts per document give four scores where higher is worse (symbols, capitals, repeated lines, repeated word windows). For
every stratum (language), labelled documents of good quality are the holdout: a set of cutoffs may be used only if the exact
binomial (Clopper-Pearson) upper bound of the share of good documents that any of its rules rejects is at most alpha. Sets are
tested in sequences, one per rule: it goes from the laxest to stricter cutoffs of that rule until all bad documents that the rule
can catch are caught, adds the other rules likewise for the bad ones that are left, and stops at the first set that fails. The
bad labels alone say what is tested next (fixed sequence, so its length needs no correction); across sequences and strata the
error delta is split evenly (Bonferroni).
So with probability 1 - delta no stratum loses more than alpha of its good documents to the rules. Among the sets that hold, the
one with the best balance of bad over good rejections is taken, the first tested on ties; a stratum without enough labels
(286 at 4 strata, none of them rejected) rejects nothing by the rules.

Defined results: null text has no words (and so fails the base rule); null language is a stratum of its own; documents whose
label is null, absent or contradictory (both qualities) are only judged; repeated rows are judged each; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, text_bytes

SPACES = b" \t\n\v\f\r"
FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not start a code point
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
RULES = ("symbols", "capitals", "dup_lines", "repeats")
#: Cutoffs tried, laxest first; each score is a share in 0..1 (symbols: per word, over 1 counts as 1).
GRID = tuple(round(0.95 - 0.05 * i, 2) for i in range(19))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside a window of so many words that occurs twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint64, len(words))
    mixed = ids[:n].copy()
    for k in range(1, size):
        mixed *= _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        mixed += ids[k : k + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # different mixes are different windows
    flat = ids.tolist()
    windows = list(zip(*(flat[k : k + n] for k in range(size)), strict=True))
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero([found[w] > 1 for w in windows])
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = len(text.translate(None, SPACES + FOLLOWING))
    capitals, letters = (len(text) - len(text.translate(None, c)) for c in (CAPITALS, LETTERS))
    return len(words), bare, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines), capitals, letters


def count_texts(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """ids, stratum and COUNTS per row, in one narrow pass."""
    picked = docs.select(*ids, docs[stratum_col].cast("string").alias("stratum"), docs[text_col].alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + "".join(f", {c} long" for c in COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_counts(t) for t in text_bytes(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in found.T)], names=[*batch.schema.names[:-1], *COUNTS])

    return picked.mapInArrow(run, schema)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds the RULES' scores and base_failed to COUNTS."""
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(0.0)
    return counts.withColumns({
        "symbols": share("n_symbols", "n_words"), "capitals": share("n_capitals", "n_letters"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    x = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in x]) + x * math.log(p) + (n - x) * math.log1p(-p)
    top = log.max()
    return float(math.exp(top) * np.exp(log - top).sum())


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n still have probability delta."""
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def sequences(bad: np.ndarray, n_bad: np.ndarray) -> list[list[tuple[int, ...]]]:
    """The sets of cutoffs to test, in order: per rule how many cutoffs of GRID are in reach (0: the rule is off). See the head.

    bad: rows of levels per rule, the number of GRID's cutoffs that a document's score is over; n_bad: documents of each row.
    """
    order = sorted(range(len(RULES)), key=lambda r: (-int((bad[:, r] * n_bad).sum()), r))
    out = []
    for first in order:
        now, steps, caught = [0] * len(RULES), [], np.zeros(len(bad), bool)
        for r in (first, *(o for o in order if o != first)):
            left = ~caught & (bad[:, r] > 0)
            for i in np.unique(len(GRID) + 1 - bad[left, r]).tolist():
                now[r] = i
                steps.append(tuple(now))
            caught |= left
        out.append(steps)
    return out


def choose_set(levels: np.ndarray, n: np.ndarray, good: np.ndarray, alpha: float, delta: float) -> tuple[float | None, ...]:
    """A cutoff per rule (None: the rule is off) of one stratum. Rows: levels per rule as in sequences(), documents n, whether they are good."""
    best, value, n_good = (0,) * len(RULES), 0, int(n[good].sum())
    for steps in sequences(levels[~good], n[~good]) if n_good else ():
        for reach in steps:
            over = np.zeros(len(n), bool)
            for r, i in enumerate(reach):
                over |= (levels[:, r] >= len(GRID) - i + 1) & (i > 0)
            lost, caught = int(n[over & good].sum()), int(n[over & ~good].sum())
            if binomial_tail(lost, n_good, alpha) > delta:
                break
            if caught - lost > value:
                best, value = reach, caught - lost
    return tuple(GRID[i - 1] if i else None for i in best)


def choose_cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum: stratum and cut_<rule> (null: the rule rejects nothing there). labels: doc_id, quality 0 or 1.

    Documents that fail the base rule are gone before the rules and don't count. What meets per stratum is a row per different
    levels of the four scores, 20 ** 4 at most.
    """
    clear = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    holdout = scored.where(~F.col("base_failed")).join(clear, F.col("doc_id") == F.col("labelled_id"))
    level = lambda r: sum(((F.col(r) > cut).cast("int") for cut in GRID), F.lit(0))
    profiles = holdout.select("stratum", "quality", *(level(r).alias(r) for r in RULES)).groupBy("stratum", "quality", *RULES).agg(F.count("*").alias("n"))
    strata = max(1, scored.select("stratum").distinct().count())
    share = delta / (len(RULES) * strata)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        cuts = choose_set(f[list(RULES)].to_numpy(np.int64), f["n"].to_numpy(np.int64), f["quality"].to_numpy() == 1, alpha, share)
        return pd.DataFrame({"stratum": f["stratum"].iloc[:1]} | {f"cut_{r}": pd.array([c], "Float64") for r, c in zip(RULES, cuts, strict=True)})

    return profiles.groupBy("stratum").applyInPandas(run, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row of docs: ids, COUNTS, base_failed, kept and failed_rules (comma-joined names). labels are matched by doc_id."""
    counts = stage(count_texts(docs, ids, text_col, stratum_col), "counts")
    scored = with_scores(counts)
    cuts = stage(choose_cutoffs(scored, labels, alpha, delta), "cutoffs")
    cuts = cuts.withColumnRenamed("stratum", "cut_stratum")
    if cuts.count() <= 100_000:  # a row is 40 bytes and a name
        cuts = F.broadcast(cuts)
    judged = scored.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    failed = F.concat_ws(",", *(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES))
    return judged.select(*ids, *COUNTS, "base_failed", (~F.col("base_failed") & (failed == "")).alias("kept"), failed.alias("failed_rules"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    kept = quality_rules(marked, labels, ids=("doc_id", "__mark"), **how).where("kept").select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__text")).distinct()
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__text")), "left_semi").drop("__mark")
