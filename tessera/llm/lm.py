"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from the tokens on both sides.

Tokens are words. The vocabulary comes from counts over all documents: the `classes * per_class - buckets` most frequent
words have a token each and every other word one of `buckets` tokens by its last two bytes. The network adds a vector per
neighbour and position (2 on each side), takes tanh, and predicts the token's frequency class and then the token in the class
(two softmaxes). A word that shares a bucket has the bucket's probability times its own in the bucket, (n + d s) / (N + d): n is how
often it occurs in the corpus, N the bucket's words, d the bucket's different words, and s the probability of its spelling, read from
its end: the last two bytes given the bucket, each byte before given the two after it, then the start. So every word of the
corpus is known by its count, and no word at all has a probability of 0.

Training is one pass over all tokens of all documents. A hash of (doc_id, text) deals them to shards of some `shard_tokens`
tokens, in a fixed order; every shard trains on its own from the same start (the biases hold the corpus frequencies), and the
shards' parameters are averaged, weighted by tokens, at most FAN sets at a time, level by level. So results depend on the rows
and not on how files or partitions split them. What training gathers is one row per distinct word of a partition, the texts
once and one set of parameters per shard, so it grows with the corpus; the driver gets the vocabulary, the spelling's tables and the
average, whose sizes are fixed by the parameters. For scoring a shard's different words in buckets bring their counts by a join
and meet the shard's texts, so a task holds the words of one shard and never a table of all.

Defined results: null text is empty; no words give n_tokens 0, score 0 and a null mean; repeated rows are trained on and
scored each; an empty corpus gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, text_bytes

OFFSETS = (-2, -1, 1, 2)
PAD = max(OFFSETS)
#: Tokens of one training step, at every size.
STEP = 8192
#: Tokens scored at once.
CHUNK = 8192
#: Bytes of texts whose tokens are shuffled together.
ROOM = 1_000_000
#: The largest exponent of a softmax.
TOP = np.float32(60)
#: Sets of parameters that one task adds up.
FAN = 32
#: Words whose spelling is read at once.
SPELL = 65536
#: Words in buckets, besides those a shard is known to have, that wait to be told apart.
WAIT = 200_000


@dataclass(frozen=True)
class Shape:
    classes: int = 64
    per_class: int = 64
    hidden: int = 16
    buckets: int = 256

    @property
    def tokens(self) -> int:
        return self.classes * self.per_class

    @property
    def first_bucket(self) -> int:
        return self.tokens - self.buckets


#: Places of the spelling's tables: hashed pairs of bytes before which a byte may stand, and what may stand there (256: the start).
CONTEXTS, SYMBOLS = 2048, 257
#: Codes of a word's end: two bytes, or 65536 and more for a word of one.
ENDS = 65536 + 256


def end_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def end_codes(flat: np.ndarray, n: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Codes of the ends of words of n bytes (one or more) that end at stop in the bytes."""
    last = flat[stop - 1].astype(np.int64)
    return np.where(n > 1, flat[np.maximum(stop - 2, 0)].astype(np.int64) * 256 + last, 65536 + last)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of a byte or more: all bytes, each word's length and where it ends, and the code of its end."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    stop = np.cumsum(n)
    return flat, n, stop, end_codes(flat, n, stop)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The column's values; to_pylist() makes a scalar of each first, which takes some fifteen times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the words' ends, and for each byte that is read after an end and each start the place in the table (context *
    SYMBOLS + symbol) and whose word it is."""
    flat, n, stop, codes = letters(words)
    steps = np.maximum(n - 1, 0)  # the bytes before the last two, and the start; a word of one byte has nothing to add
    word = np.repeat(np.arange(len(words)), steps)
    at = (stop - n)[word] + np.arange(len(word)) - np.repeat(np.cumsum(steps) - steps, steps)  # the first of the two that are known
    symbol = np.where(at > (stop - n)[word], flat[np.maximum(at - 1, 0)], 256)
    context = (flat[at] * 256 + flat[np.minimum(at + 1, len(flat) - 1)]) * 40503 % 65521 % CONTEXTS
    return codes, context * SYMBOLS + symbol, word


@dataclass
class Spelling:
    """P(word | bucket) of words without a token of their own, by spelling and count."""

    ends: np.ndarray
    steps: np.ndarray
    total: np.ndarray  # words of each bucket
    different: np.ndarray

    @staticmethod
    def of(ends: np.ndarray, steps: np.ndarray, kinds: np.ndarray, buckets: int) -> Spelling:
        """From counts of end codes (of words and of different words) and of (context, symbol); what was never seen keeps a small share."""
        bucket = end_bucket(np.arange(ENDS), buckets)
        more = ends + 0.01
        by_symbol = (steps.reshape(CONTEXTS, SYMBOLS).sum(0) + 1.0) / (steps.sum() + SYMBOLS)
        table = steps.reshape(CONTEXTS, SYMBOLS) + 4.0 * by_symbol
        return Spelling(
            np.log(more / np.bincount(bucket, more, buckets)[bucket]).astype(np.float32), np.log(table / table.sum(1, keepdims=True)).astype(np.float32).ravel(),
            np.bincount(bucket, ends, buckets), np.maximum(1, np.bincount(bucket, kinds, buckets)),
        )

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        codes, places, word = spelled(words)
        return self.ends[codes] + np.bincount(word, self.steps[places], len(words))

    def shares(self, words: list[bytes], bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(word | its bucket) of words that occur n times in the corpus."""
        return np.log(n + self.different[bucket] * np.exp(self.log_probabilities(words))) - np.log(self.total + self.different)[bucket]


class Vocabulary(dict):
    """Word -> token. A word that isn't known gets a number over the pad's, remembered for a while: settled() tells its bucket, inside()
    the logarithm of its share of it, by its spelling and the count that learn() was told."""

    def __init__(self, words: list[bytes], shape: Shape, spelling: Spelling | None = None):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.words, self.shape, self.spelling = words, shape, spelling
        self.base, self.known = shape.tokens + 1, pa.array(words, pa.large_binary())
        self.new: list[bytes] = []
        self.n: list[int] = []
        self.buckets, self.shares = np.empty(0, np.int64), np.empty(0)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.base + len(self.new)
        self.new.append(word)
        self.n.append(0)
        return number

    def learn(self, words: list[bytes], n: list[int]) -> None:
        """Gives words in buckets their numbers; n: how often each occurs in the corpus."""
        at = self.base + len(self.new)
        self.update(zip(words, range(at, at + len(words))))
        self.new += words
        self.n += n

    def forget(self) -> None:
        """Between shards: starts anew."""
        self.clear()
        self.update(zip(self.words, range(len(self.words)), strict=True))
        self.new, self.n, self.buckets, self.shares = [], [], np.empty(0, np.int64), np.empty(0)

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Tokens of different words (large binary), and those among them that are in buckets; nothing is remembered."""
        tokens = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(tokens < 0)
        new = words.take(pa.array(rare))
        if len(rare):
            _, edges, flat = new.buffers()
            edges = np.frombuffer(edges, np.int64)[new.offset : new.offset + len(new) + 1]
            codes = end_codes(np.frombuffer(flat, np.uint8), np.diff(edges), edges[1:])
            tokens[rare] = self.shape.first_bucket + end_bucket(codes, self.shape.buckets)
        return tokens, new

    def settled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the numbers, and the positions of those over the pad's."""
        if len(self.new) > len(self.buckets):
            bucket = end_bucket(letters(self.new[len(self.buckets) :])[-1], self.shape.buckets)
            self.buckets = np.concatenate([self.buckets, self.shape.first_bucket + bucket])
        rare = np.flatnonzero(numbers > self.shape.tokens)
        tokens = numbers.copy()
        tokens[rare] = self.buckets[numbers[rare] - self.shape.tokens - 1]
        return tokens, rare

    def inside(self, numbers: np.ndarray) -> np.ndarray:
        """Of numbers that settled() has seen."""
        shares = [self.shares]
        for a in range(len(self.shares), len(self.new), SPELL):
            some = slice(a, a + SPELL)
            shares.append(self.spelling.shares(self.new[some], self.buckets[some] - self.shape.first_bucket, np.array(self.n[some], np.float64)))
        self.shares = np.concatenate(shares)
        return self.shares[numbers - self.shape.tokens - 1]

    def __reduce__(self):
        return Vocabulary, (self.words, self.shape, self.spelling)


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' words, one after the other, as an index into the different ones, and how many each text has."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.large_string()))
    words, edges = lists.flatten(), lists.offsets.to_numpy()
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # what leading and trailing separators leave
        edges = np.concatenate(([0], np.cumsum(~empty)))[edges]
        words = words.filter(pa.array(~empty))
    return words.cast(pa.large_binary()).dictionary_encode(), np.diff(edges).astype(np.int64)


def tokens_of(texts: list[bytes], vocabulary: Vocabulary, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' numbers with PAD pads around each, and the texts' lengths."""
    words, sizes = words_of(texts)
    different = bytes_of(words.dictionary)
    numbers = np.fromiter(map(vocabulary.__getitem__, different), np.int64, len(different))
    return padded(numbers[words.indices.to_numpy()], sizes, pad), sizes


def padded(numbers: np.ndarray, sizes: np.ndarray, pad: int) -> np.ndarray:
    """Numbers of all texts' words with PAD pads around each text."""
    flat = np.full(len(numbers) + PAD * (len(sizes) + 1), pad, np.int64)
    flat[positions_of(sizes)] = numbers
    return flat


def positions_of(sizes: np.ndarray) -> np.ndarray:
    """Where tokens_of() put the tokens, pads left out."""
    start = PAD + np.concatenate(([0], np.cumsum(sizes + PAD)[:-1]))
    return np.repeat(start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


@dataclass
class Network:
    shape: Shape
    embed: np.ndarray  # (positions * (tokens + 1), hidden); the last token of each position is the pad
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_token: np.ndarray  # (classes, hidden, per_class)
    token_bias: np.ndarray
    seen: dict = field(default_factory=dict)  # Adagrad's sums of squares

    NAMES = ("embed", "bias", "to_class", "class_bias", "to_token", "token_bias")

    def copy(self, packed: bytes | None = None) -> Network:
        """A network with parameters of its own, those of packed() if given, that has not been trained."""
        sizes = np.cumsum([0, *(getattr(self, k).size for k in self.NAMES)])
        flat = np.frombuffer(packed if packed is not None else self.packed(), np.float32)
        return Network(self.shape, *(flat[a:b].reshape(getattr(self, k).shape).copy() for k, a, b in zip(self.NAMES, sizes, sizes[1:])))

    def packed(self) -> bytes:
        return b"".join(getattr(self, k).tobytes() for k in self.NAMES)

    @staticmethod
    def start(shape: Shape, counts: np.ndarray, seed: int = 1) -> Network:
        """Small random weights; the biases give the tokens' corpus frequencies."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        by_class = (counts + 1.0).reshape(shape.classes, shape.per_class)
        return Network(
            shape, draw(len(OFFSETS) * (shape.tokens + 1), shape.hidden), np.zeros(shape.hidden, np.float32), draw(shape.hidden, shape.classes), np.log(by_class.sum(1) / by_class.sum()).astype(np.float32),
            draw(shape.classes, shape.hidden, shape.per_class), np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        )

    def _near(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.stack([flat[at + o] + i * (self.shape.tokens + 1) for i, o in enumerate(OFFSETS)], 1)

    def _forward(self, flat: np.ndarray, at: np.ndarray):
        near, target = self._near(flat, at), flat[at]
        total, one = np.tile(self.bias, (len(at), 1)), np.empty((len(at), self.shape.hidden), self.embed.dtype)
        for k in range(len(OFFSETS)):
            total += np.take(self.embed, near[:, k], axis=0, out=one, mode="clip")
        hidden = np.ones((len(at), self.shape.hidden + 1), self.embed.dtype)  # the last unit is always on: biases are its weights
        np.tanh(total, out=hidden[:, :-1])
        group, place = np.divmod(target, self.shape.per_class)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.shape.classes + 1))
        return near, hidden, group, place, order, edges

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Of classes and of tokens in their classes, with the biases as the last unit's."""
        return np.vstack([self.to_class, self.class_bias]), np.concatenate([self.to_token, self.token_bias[:, None]], 1)

    def _token_scores(self, hidden: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Of the tokens of each one's class; hidden in the order of classes, whose rows begin at edges."""
        scores = np.empty((len(hidden), self.shape.per_class), self.embed.dtype)
        for g in np.flatnonzero(np.diff(edges)).tolist():
            np.matmul(hidden[edges[g] : edges[g + 1]], weights[g], out=scores[edges[g] : edges[g + 1]])
        return scores

    @staticmethod
    def _exponentials(x: np.ndarray) -> np.ndarray:
        """exp(x) in place. tanh bounds what the weights add to the biases, which are logarithms of shares; over TOP counts as TOP."""
        return np.exp(np.minimum(x, TOP, out=x), out=x)

    def _log_softmax_at(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The logarithm of the softmax at one place of each row; x is overwritten."""
        own = np.minimum(x[np.arange(len(x)), at], TOP)
        return own - np.log(self._exponentials(x) @ np.ones(x.shape[1], x.dtype))

    def _softmax_error(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The gradient of the mean negative logarithm of the softmax at one place of each row; x is overwritten."""
        self._exponentials(x)
        x *= (1 / (len(x) * (x @ np.ones(x.shape[1], x.dtype))))[:, None]
        x[np.arange(len(x)), at] -= x.dtype.type(1 / len(x))
        return x

    def log_probabilities(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each token at the given positions, from its neighbours."""
        _, hidden, group, place, order, edges = self._forward(flat, at)
        classes, tokens = self._weights()
        out = self._log_softmax_at(hidden @ classes, group)
        out[order] += self._log_softmax_at(self._token_scores(hidden[order], tokens, edges), place[order])
        return out

    def _step(self, name: str, gradient: np.ndarray, rate: float, where=Ellipsis) -> None:
        value = getattr(self, name)
        if name not in self.seen:
            self.seen[name] = np.full_like(value, 1e-6)
        seen = self.seen[name]
        now = seen[where] + gradient * gradient
        seen[where] = now
        value[where] -= rate * gradient / np.sqrt(now)

    def train(self, flat: np.ndarray, at: np.ndarray, rate: float = 0.1) -> None:
        """One Adagrad step on the tokens at the given positions."""
        near, hidden, group, place, order, edges = self._forward(flat, at)
        classes, tokens = self._weights()
        error = self._softmax_error(hidden @ classes, group)
        back = error @ self.to_class.T
        own = hidden[order]
        inner = self._softmax_error(self._token_scores(own, tokens, edges), place[order])
        gradient, inner_back = np.zeros_like(tokens), np.empty_like(back)
        for g in np.flatnonzero(np.diff(edges)).tolist():
            mine = slice(edges[g], edges[g + 1])
            np.matmul(own[mine].T, inner[mine], out=gradient[g])
            np.matmul(inner[mine], self.to_token[g].T, out=inner_back[mine])
        by_class = hidden.T @ error
        self._step("to_class", by_class[:-1], rate)
        self._step("class_bias", by_class[-1], rate)
        self._step("to_token", gradient[:, :-1], rate)
        self._step("token_bias", gradient[:, -1], rate)
        back[order] += inner_back
        on = hidden[:, :-1]
        back *= 1 - on * on
        self._step("bias", back.sum(0), rate)
        wide, size = np.ascontiguousarray(back.T, np.float64), self.shape.tokens + 1
        for k in range(len(OFFSETS)):  # the sum of the gradients of each token at each position
            ids = near[:, k] - k * size
            sums = np.stack([np.bincount(ids, column, size) for column in wide], 1).astype(self.embed.dtype)
            self._step("embed", sums, rate, slice(k * size, (k + 1) * size))


def batches_of(texts: list[bytes], most: int = ROOM) -> Iterator[list[bytes]]:
    """Texts by so many bytes together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary), n over all documents. Partitions send a row per distinct word, about."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in text_bytes(batch):
                seen.update(text.split())
                if len(seen) > 200_000:
                    yield pack()
                    seen.clear()
        yield pack()

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_counts(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all counted words without a token of their own: how often each end code and each place of the tables occurs, and how many
    different words have each end code."""
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(vocabulary.words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value, np.zeros(2 * ENDS + CONTEXTS * SYMBOLS)
        for batch in batches:
            rare = [(w, n) for w, n in zip(bytes_of(batch.column(0)), batch.column(1).to_numpy().tolist(), strict=True) if w not in known]
            if not rare:
                continue
            codes, places, word = spelled([w for w, _ in rare])
            n = np.array([n for _, n in rare], np.float64)
            sums += np.concatenate([np.bincount(codes, n, ENDS), np.bincount(places, n[word], CONTEXTS * SYMBOLS), np.bincount(codes, minlength=ENDS)])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at].astype(np.int64))], names=["place", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row per place of the tables at most
    out = np.zeros(2 * ENDS + CONTEXTS * SYMBOLS)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out[:ENDS], out[ENDS:-ENDS], out[-ENDS:]


def averaged(sets: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """part, n and mean (float32) of sets of parameters (part 0..shards - 1): their average weighted by n, at most fan sets in a task."""

    def add(rows: pa.Table) -> pa.Table:
        rows, total, n = rows.sort_by("part"), 0.0, sum(rows["n"].to_pylist())
        for k, x in zip(rows["n"].to_pylist(), rows["mean"], strict=True):
            total = total + np.frombuffer(x.as_py(), np.float32).astype(np.float64) * (k / n)
        return pa.table({"part": pa.array([rows["part"][0].as_py() // fan], pa.int64()), "n": pa.array([n], pa.int64()), "mean": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        sets = sets.groupBy(F.expr(f"part div {fan}")).applyInArrow(add, "part long, n long, mean binary")
        shards = -(-shards // fan)
        if shards <= 1:
            return sets


@dataclass
class Model:
    """What fit() made of a corpus. words: shard and word, the different words in buckets of each of its shards."""

    vocabulary: Vocabulary
    network: Network
    counts: DataFrame
    shards: int
    words: DataFrame


def dealt(docs: DataFrame, shards: int, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The shard of a row, and its hash."""
    mark = F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))
    return F.pmod(mark, F.lit(shards).cast("long")), mark


def fit(docs: DataFrame, shape: Shape = Shape(), text_col: str = "text", id_col: str = "doc_id", seed: int = 1, shard_tokens: int = 4_000_000) -> Model:
    """The model of all documents."""
    spark = docs.sparkSession
    counts = stage(count_words(docs, text_col), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(shape.first_bucket).collect()
    vocabulary = Vocabulary([bytes(r["word"]) for r in top], shape)
    ends, steps, kinds = spelling_counts(counts, vocabulary)
    vocabulary.spelling = Spelling.of(ends, steps, kinds, shape.buckets)
    known = np.zeros(shape.tokens)
    known[: len(top)] = [r["n"] for r in top]
    known[shape.first_bucket :] = vocabulary.spelling.total
    first = Network.start(shape, known, seed)
    shared = spark.sparkContext.broadcast((vocabulary, first))  # of fixed size
    shards = max(1, total // shard_tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = shared.value
        shard, net, n, texts, room = None, None, 0, [], 0
        rare, fresh, most = pa.array([], pa.large_binary()), [], 0  # different words in buckets, and those of texts since

        def distinct() -> None:
            nonlocal rare, fresh, most
            rare = pc.unique(pa.chunked_array([rare, *fresh]))
            fresh, most = [], 2 * len(rare) + WAIT

        def learn() -> None:
            nonlocal n, texts, room
            found, sizes = words_of(texts)
            tokens, new = words.tokens(found.dictionary)
            flat = padded(tokens[found.indices.to_numpy()], sizes, shape.tokens)
            at = positions_of(sizes)
            np.random.default_rng((seed, n)).shuffle(at)
            for a in range(0, len(at), STEP):
                net.train(flat, at[a : a + STEP])
            n, texts, room = n + len(at), [], 0
            fresh.append(new)
            if len(rare) + sum(map(len, fresh)) > most:
                distinct()

        def done() -> Iterator[pa.RecordBatch]:
            if texts:
                learn()
            if n:
                distinct()
                columns = [pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([net.packed()], pa.binary()), pa.ListArray.from_arrays([0, len(rare)], rare.cast(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "mean", "words"])

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                if key != shard:
                    yield from done()
                    shard, net, n, texts, room = key, start.copy(), 0, [], 0
                    rare, fresh, most = rare[:0], [], 0
                texts.append(t)
                room += len(t)
                if room >= ROOM:
                    learn()
        yield from done()

    shard, mark = dealt(docs, shards, id_col, text_col)
    placed = docs.select(shard.alias("shard"), mark.alias("mark"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    placed = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "mark", "id", "text").select("shard", "text")
    trained = stage(placed.mapInArrow(run, "part long, n long, mean binary, words array<binary>"), "trained")
    rows = averaged(trained.drop("words"), shards).collect()
    return Model(vocabulary, first.copy(rows[0]["mean"]) if rows else first, counts, shards, trained.select(F.col("part").alias("shard"), F.explode("words").alias("word")))


def rare_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, word: the different words in buckets of other documents than the model's, some twice."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(model.vocabulary.words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list({(k, w) for k, t in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True) for w in t.split() if w not in known.value})
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["shard", "word"])

    return docs.select(dealt(docs, model.shards, id_col, text_col)[0].alias("shard"), docs[text_col].alias("text")).mapInArrow(run, "shard long, word binary").distinct()


def score(docs: DataFrame, model: Model, words: DataFrame | None = None, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """ids, n_tokens, pll (summed log-probability) and pll_mean per row; the first of ids deals the rows. words: the model's own if docs are its corpus."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.network))  # of fixed size
    words = rare_words(docs, model, ids[0], text_col) if words is None else words
    shard, _ = dealt(docs, model.shards, ids[0], text_col)
    rows = docs.select(shard.alias("__shard"), F.lit(True).alias("__is_doc"), F.lit(None).cast("binary").alias("__word"), F.lit(None).cast("long").alias("__n"), *ids, docs[text_col].alias("__text"))
    counted = words.join(model.counts.withColumnRenamed("n", "__n"), "word").select(F.col("shard").alias("__shard"), F.lit(False).alias("__is_doc"), F.col("word").alias("__word"), "__n")
    both = rows.unionByName(counted, allowMissingColumns=True)
    both = both.repartitionById(model.shards, F.col("__shard").cast("int")).sortWithinPartitions("__shard", "__is_doc")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids) + ", n_tokens long, pll double, pll_mean double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, net), now = shared.value, None
        for batch in batches:
            of, is_doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (is_doc[1:] != is_doc[:-1])))).tolist() if len(of) else []
            for a, b in zip(starts, [*starts[1:], len(of)]):
                if of[a] != now:
                    now = of[a]
                    words.forget()
                part = batch.slice(a, b - a)
                if not is_doc[a]:
                    words.learn(bytes_of(part.column(2)), part.column(3).to_numpy().tolist())
                    continue
                n, pll = scored(text_bytes(part, "__text"), words, net)
                mean = pa.array(pll / np.maximum(n, 1), pa.float64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*part.columns[4:-1], pa.array(n), pa.array(pll), mean], names=[*ids, "n_tokens", "pll", "pll_mean"])

    return both.mapInArrow(run, schema)


def scored(texts: list[bytes], words: Vocabulary, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log-probability of each text; words in buckets that words.learn() wasn't told count as not in the corpus."""
    sizes, sums = [np.empty(0, np.int64)], [np.empty(0)]
    for part in batches_of(texts):
        numbers, n = tokens_of(part, words, net.shape.tokens)
        flat, rare = words.settled(numbers)
        at = positions_of(n)
        logs = np.zeros(len(flat))
        for a in range(0, len(at), CHUNK):
            logs[at[a : a + CHUNK]] = net.log_probabilities(flat, at[a : a + CHUNK])
        logs[rare] += words.inside(numbers[rare])
        sums.append(np.bincount(np.repeat(np.arange(len(n)), n), logs[at], len(n)))
        sizes.append(n)
    return np.concatenate(sizes), np.concatenate(sums)


def pseudo_likelihood(docs: DataFrame, shape: Shape = Shape(), text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, pll, pll_mean of every row, by a network of all rows."""
    model = fit(docs, shape, text_col)
    return score(docs, model, model.words, text_col=text_col)
