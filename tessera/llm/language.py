"""Language identification, words first with backoff to character n-grams.

Learning counts, per language, lower-cased letter runs (words) and the character n-grams of those words. It is fitted on at
most about `per_lang` labelled documents of each language, picked by a hash of their id; the tables keep the `words` and, per
order, `grams` most frequent entries of a language, so the model's size is bounded by languages * (words + 5 * grams) entries.

Prediction reads every word of a text: a known word gives its log frequency in each language; an unseen word falls back to
5-character n-grams, and if none is known to 4, 3, 2 and 1, giving their mean log frequency. The sums decide; the score is the
winner's share of the evidence, tempered by the square root of the number of words.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing could be learned;
letters of which nothing is known give the most frequent learned language and an even score; ties go to the first language by
code point; rows without a language are only predicted; a null doc_id is not held out; repeated rows repeat their prediction;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)


def fold(doc_id: Column, n: int = 3) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def words_of(text: str) -> list[str]:
    return RUN.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """Character n-grams of the word between blanks; single characters without the blanks."""
    padded = word if order == 1 else f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Model:
    """Log frequencies by language of words and n-grams. counts: (language, order, entry, n), order 0 for words."""

    def __init__(self, langs: list[str], totals: dict[tuple[str, int], int], counts: Iterable[tuple[str, int, str, int]], first: int = 0):
        self.langs, self.first = langs, first
        at = {l: i for i, l in enumerate(langs)}
        total = {o: np.array([totals.get((l, o), 0) for l in langs], np.float64) for o in (0, *ORDERS)}
        rows: dict[int, dict[str, np.ndarray]] = {o: {} for o in (0, *ORDERS)}
        for lang, order, entry, n in counts:
            rows[order].setdefault(entry, np.zeros(len(langs)))[at[lang]] += n
        self.tables = {}
        for o, table in rows.items():
            seen = np.array(list(table.values()), np.float64).reshape(len(table), len(langs))
            logs = np.log((seen + 0.5) / (total[o] + 0.5 * (len(table) + 1)))
            self.tables[o] = (dict(zip(table, range(len(table)), strict=True)), (logs - logs.mean(1, keepdims=True) if len(table) else logs).astype(np.float32))

    def evidence(self, word: str) -> np.ndarray:
        """Log frequencies by language, less their mean."""
        index, logs = self.tables[0]
        if (row := index.get(word)) is not None:
            return logs[row]
        for order in ORDERS:
            index, logs = self.tables[order]
            known = [r for g in grams_of(word, order) if (r := index.get(g)) is not None]
            if known:
                return logs[known].mean(0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Predicts texts; remembers the evidence of up to `most` words and then starts anew."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.model.langs)), np.float32)

    def _row(self, word: str) -> int:
        i = len(self.index)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[i] = self.model.evidence(word)
        self.index[word] = i
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        if not text or not langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        total, n = np.zeros(len(langs)), 0
        words = words_of(text)
        for at in range(0, len(words), 50_000):
            if len(self.index) > self.most:
                self._clear()
            part = words[at : at + 50_000]
            get, new = self.index.get, self._row
            rows = [r if (r := get(w)) is not None else new(w) for w in part]
            total += self.rows[rows].sum(0, dtype=np.float64)
            n += len(part)
        best = int(total.argmax()) if total.any() else self.model.first
        share = np.exp((total - total.max()) / max(1.0, n**0.5))
        return langs[best], float(share[best] / share.sum())


def learn(train: DataFrame, per_lang: int = 4096, words: int = 30_000, grams: int = 10_000) -> Model:
    """train: doc_id, text, lang (non-null). One row per language and the bounded tables reach the driver."""
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, [])
    part = F.create_map(*(x for l in langs for x in (F.lit(l), F.lit(min(1.0, per_lang / sizes[l])))))
    picked = train.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text or ""))
            rows = [(l, w, n) for l, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for order in ORDERS:
                    for g in grams_of(word, order):
                        seen[lang, order, g] += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((l, o, g, n) for (l, o, g), n in seen.items()), strict=True) if seen else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "order", "entry", "n"])

    by_word = picked.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_gram = by_word.mapInArrow(count_grams, "lang string, order int, entry string, n long").groupBy("lang", "order", "entry").agg(F.sum("n").alias("n"))
    every = by_word.where("n > 1").select("lang", F.lit(0).alias("order"), F.col("word").alias("entry"), "n").union(by_gram)
    rank = F.row_number().over(W.partitionBy("lang", "order").orderBy(F.desc("n"), "entry"))
    ranked = every.withColumn("rank", rank).withColumn("total", F.sum("n").over(W.partitionBy("lang", "order")))
    rows = ranked.where(F.col("rank") <= F.when(F.col("order") == 0, words).otherwise(grams)).select("lang", "order", "entry", "n", "total").toArrow().to_pydict()
    totals = dict(zip(zip(rows["lang"], rows["order"], strict=True), rows["total"], strict=True))
    return Model(langs, totals, zip(rows["lang"], rows["order"], rows["entry"], rows["n"], strict=True), first=langs.index(max(langs, key=lambda l: (sizes[l], l))))


def predict(docs: DataFrame, model: Model, text_col: str = "text", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, lang_pred and score per row, in one narrow pass. The model is broadcast: its size is bounded by learn()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*ids, docs[text_col].alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return picked.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows with a language outside the held fold, predicted for all."""
    train = docs.where((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return predict(docs, learn(train, **how)).withColumn("held_out", fold(F.col("doc_id"), folds) == held).select("doc_id", "held_out", "lang_pred", "score")
