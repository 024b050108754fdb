"""LM scoring by masked pseudo-likelihood.

Tokens are lower-case words. The softmax is factored by class: each of the ``WORDS`` most frequent words of the
whole corpus is a class of its own, all others share ``CLASSES`` classes by their last letters. A small network
sees the classes of ``SIDE`` tokens on either side of a hidden one (embeddings, one tanh layer) and predicts its
class by two softmaxes of ``BRANCHES``: the branch, then the class within the branch. The word in its class has its share of the class's tokens. Each word seen ``LEAST`` times
or more is listed with its own share, so the list grows with the corpus; rarer words divide the rest of their
class evenly. A document's score is the sum over all its tokens of the log-probability given both sides.

At most ``SHARED_WORDS`` listed words, the most frequent ones by powers of two of the count, are broadcast as 64-bit hashes, 13 bytes each.
The shares of the others are joined on Spark to the documents' counts of such words. Two words of one
hash would share a share; among ten million words that is expected less than once in 100,000 corpora.

Word counts cover all texts. Training is data-parallel: in each round every scan task starts from the
same network, hides every ``rounds``-th token of each document, from the round's number on, and takes Adagrad
steps in numpy; the networks are averaged by tokens seen, in two levels, so that neither a task nor the driver
holds more than one network of each of ``GROUPS`` groups. Over the rounds every token is predicted exactly once.

Defined results: null and blank texts have no tokens, score 0 and no mean. Repeated rows have equal scores.
Sides beyond a text's ends are a token of their own, so documents never see each other. An empty table
gives an empty table. Other columns are ignored. Rows without an id keep their null id; very long texts are read whole.
Ties among the most frequent words go by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema, stage

WORDS, CLASSES, SIDE, WIDTH, HIDDEN = 192, 64, 2, 16, 24
TOKENS = WORDS + CLASSES
EDGE = TOKENS  # beyond a text's end
ROUNDS, GROUPS = 2, 64
BATCH, LARGE_BATCH, FIRST_STEPS = 512, 2048, 64  # a task's first steps are small, so that little text is enough
LEAST = 5  # a word seen so often is listed
BATCH_BYTES = 1 << 22
SCORE_TOKENS = 1 << 13
COUNTED_WORDS = 300_000
BRANCHES = 16
SHARED_WORDS = 1 << 20
_MARKS = ".,;:!?\"'()[]{}<>|*#%$&"
_LEAVES = TOKENS // BRANCHES
_SHAPES = [(TOKENS + 1, WIDTH), (2 * SIDE, WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, BRANCHES), (BRANCHES,), (BRANCHES, HIDDEN, _LEAVES), (BRANCHES, _LEAVES)]
_SIZES = [int(np.prod(s)) for s in _SHAPES]
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(_MARKS) for x in (text or "").lower().split()) if w]


def ending(word: str) -> int:
    """The class of a word outside the most frequent ones."""
    number = 7
    for c in word[-3:]:
        number = (number * 31 + ord(c)) & 0xFFFFFFFF
    return WORDS + (number * 2654435761 >> 16 & 0xFFFF) % CLASSES


def _chunks(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The chunks between blanks of each text (null: none or empty ones), and all of them in a row, dictionary-encoded.

    Arrow splits at the same characters as ``str.split``, but gives empty chunks at blank ends."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    return split, split.flatten().dictionary_encode()


def _words(chunks: pa.Array) -> pa.Array:
    """Chunks in lower case, without the marks around them, as ``words_of`` has them."""
    other = pc.invert(pc.string_is_ascii(chunks))
    low = pc.replace_with_mask(pc.ascii_lower(chunks), other, pa.array([c.lower() for c in chunks.filter(other).to_pylist()], pa.string()))
    return pc.utf8_trim(low, characters=_MARKS)


def _classes(words: pa.Array) -> np.ndarray:
    """``ending`` of each word."""
    ends = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    return np.array([ending(e) for e in ends.dictionary.to_pylist()], np.int32)[ends.indices.to_numpy()]


class Vocabulary:
    """Chunk between blanks -> token: a frequent word, a listed one (behind ``EDGE``, in the order of ``keys``), else the
    class of its ending; -1 if only marks are left."""

    def __init__(self, words: list[str], keys: np.ndarray | None = None) -> None:
        self.words = pa.array(words, pa.string())
        self.keys = np.zeros(0, np.int64) if keys is None else keys

    def learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk the token and the word's hash."""
        words = _words(chunks)
        key = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in words.to_pylist()], np.uint64).view(np.int64)  # as Spark's xxhash64
        at = np.searchsorted(self.keys, key)
        listed = np.searchsorted(self.keys, key, "right") > at
        frequent = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()
        token = np.where(frequent >= 0, frequent, np.where(listed, EDGE + 1 + at, _classes(words)))
        return np.where(pc.binary_length(words).to_numpy() > 0, token, -1).astype(np.int32), key

    def __getitem__(self, chunk: str) -> int:
        return int(self.learn(pa.array([chunk], pa.string()))[0][0])

    def read(self, texts: pa.Array, *, rare: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's tokens, and with ``rare`` the hashes of its words that are neither frequent nor listed.

        A chunk is looked up once for all texts, not once for each of its places."""
        split, coded = _chunks(texts)
        found, key = self.learn(coded.dictionary)
        unlisted = (found >= WORDS) & (found < EDGE) & rare
        places = coded.indices.to_numpy()
        ids = found[places]
        out, start = [], 0
        for end in np.cumsum(pc.list_value_length(split)).tolist():
            own, place = ids[start:end], places[start:end]
            out.append((own[own >= 0], key[place[unlisted[place]]] if rare else key[:0]))
            start = end
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.read(pa.array([text], pa.string()), rare=False)[0][0]


@dataclass(frozen=True)
class Lexicon:
    """The most frequent words, the sorted hashes of the shared listed ones, and by token its class and log-share of it.

    ``least`` is the count from which on listed words are shared."""

    words: list[str]
    keys: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    least: int = LEAST


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, class, n) over all texts."""
    def summed(tables: list[pa.Table], key: str) -> pa.Table:
        return pa.concat_tables(tables).group_by(key, use_threads=False).aggregate([("n", "sum")]).rename_columns([key, "n"]).combine_chunks()

    def counted(chunks: pa.Table) -> pa.RecordBatch:
        """Case and marks are taken off each distinct chunk, not off each word."""
        words = pa.table({"word": pa.concat_arrays([_words(c) for c in chunks.column("chunk").chunks]), "n": chunks.column("n")})
        words = summed([words.filter(pc.not_equal(words.column("word"), ""))], "word")
        word = pa.concat_arrays([pa.array([], pa.string()), *words.column("word").chunks])
        return pa.RecordBatch.from_pydict({"word": word, "class": _classes(word), "n": pa.concat_arrays([pa.array([], pa.int64()), *words.column("n").chunks])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        for block in blocks(batches, text_col, BATCH_BYTES):
            coded = _chunks(block.column(0))[1]
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            tables.append(pa.table({"chunk": coded.dictionary, "n": n}))
            if sum(map(len, tables)) > COUNTED_WORDS:
                tables = [summed(tables, "chunk")]
                if len(tables[0]) > COUNTED_WORDS // 2:
                    yield counted(tables[0])
                    tables.clear()
        if tables:
            yield counted(summed(tables, "chunk"))

    found = docs.select(text_col).mapInArrow(run, "word string, class int, n long")
    return found.groupBy("word", "class").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame) -> list[str]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]


def vocabulary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts; ties in alphabetical order."""
    return _most_frequent(word_counts(docs, text_col))


def _shared_from(listed: DataFrame, most: int) -> int:
    """The least power of two, ``LEAST`` at least, such that at most ``most`` words have this count or a higher one."""
    bits = {r.k: r.words for r in listed.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("words")).collect()}  # 64 rows at most
    total = 0
    for k in sorted(bits, reverse=True):
        total += bits[k]
        if total > most:
            return max(LEAST, 1 << (k + 1))
    return LEAST


def lexicon(docs: DataFrame, text_col: str = "text", *, shared_words: int = SHARED_WORDS) -> tuple[Lexicon, DataFrame | None]:
    """The lexicon, and (key, gain) of the listed words it does not hold (None if it holds all).

    ``gain`` is what such a word's log-share has over that of an unlisted word of its class."""
    counts = stage(word_counts(docs, text_col), "lm-words")
    words = _most_frequent(counts)
    others = counts.where(~F.col("word").isin(words)) if words else counts
    by_class = others.groupBy("class").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).alias("rest"), F.count(F.when(F.col("n") < LEAST, 1)).alias("types"))
    total, rest, types = np.ones(TOKENS), np.zeros(TOKENS), np.ones(TOKENS)
    for r in by_class.collect():  # one row a class
        total[r["class"]], rest[r["class"]], types[r["class"]] = r.total, r.rest, max(r.types, 1)
    # A class without rare words leaves half a token to them; no word of the corpus reads it.
    unlisted = np.log(np.maximum(rest, 0.5) / types / total)
    listed = others.where(F.col("n") >= LEAST).select(F.xxhash64("word").alias("key"), "class", "n")
    least = _shared_from(listed, shared_words)
    held = listed.where(F.col("n") >= least).toArrow()  # `shared_words` rows at most
    key, kind, n = (held.column(c).to_numpy() for c in ("key", "class", "n"))
    order = np.argsort(key, kind="stable")
    key, kind, n = key[order], kind[order], n[order]
    shares = np.concatenate([unlisted, [0.0], np.log(n / total[kind])])
    shares[:WORDS] = 0.0
    known = Lexicon(words, key, np.concatenate([np.arange(EDGE + 1), kind]).astype(np.int16), shares.astype(np.float32), least)
    if least == LEAST:
        return known, None
    base = F.array(*[F.lit(float(np.log(t) + u)) for t, u in zip(total[WORDS:], unlisted[WORDS:], strict=True)])
    # Two words of one hash, if ever, count as their mean.
    gains = listed.where(F.col("n") < least).select("key", (F.log("n") - F.element_at(base, F.col("class") - WORDS + 1)).alias("gain"))
    return known, gains.groupBy("key").agg(F.avg("gain").alias("gain"))


def _across(fold: np.ufunc, rows: np.ndarray) -> np.ndarray:
    """``fold`` over each row, for short rows several times as quick as a reduction: halves down to eight numbers, then neighbours.

    numpy's own sum of 16 numbers goes in this order, so the last bits are the same."""
    while rows.shape[1] > 1 and rows.shape[1] % 2 == 0:
        half = rows.shape[1] // 2
        rows = fold(rows[:, :half], rows[:, half:]) if half >= 8 else fold(rows[:, ::2], rows[:, 1::2])
    return fold.reduce(rows, axis=1, keepdims=True) if rows.shape[1] > 1 else rows


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Rows of probabilities, in place."""
    logits -= _across(np.maximum, logits)
    np.exp(logits, out=logits)
    logits /= _across(np.add, logits)
    return logits


@dataclass
class Network:
    """Embeddings, one layer per place beside the hidden token, biases; the branches' layer and biases, those of each branch's classes."""

    embed: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    leaf: np.ndarray
    leaf_bias: np.ndarray

    @classmethod
    def start(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        return cls(*[np.zeros(s, np.float32) if k in (2, 4, 6) else rng.normal(0, 0.1, s).astype(np.float32) for k, s in enumerate(_SHAPES)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        return cls(*[x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, np.cumsum(_SIZES)[:-1]), _SHAPES, strict=True)])

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.layer, self.bias, self.top, self.top_bias, self.leaf, self.leaf_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def _levels(self, active: np.ndarray, branch: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Probabilities of the branches, and of the classes in each row's own branch; rows are in the order of ``branch``."""
        first = _softmax(active @ self.top + self.top_bias)
        edges = np.searchsorted(branch, np.arange(BRANCHES + 1)).tolist()
        runs = [(j, a, z) for j, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
        second = np.empty((len(active), _LEAVES), np.float32)
        for j, a, z in runs:
            np.matmul(active[a:z], self.leaf[j], out=second[a:z])
        second += self.leaf_bias.take(branch, axis=0)
        return first, _softmax(second), runs

    def log_probs(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the token at each place, given both sides."""
        tables = [self.embed @ w for w in self.layer]
        out = np.empty(len(at))
        for k in range(0, len(at), SCORE_TOKENS):
            branch = padded[at[k:k + SCORE_TOKENS]] // _LEAVES
            order = np.argsort(branch.astype(np.int16), kind="stable")
            place, branch = at[k:k + SCORE_TOKENS][order], branch[order]
            active = np.tanh(self.bias + sum(t.take(padded.take(place + o), axis=0) for t, o in zip(tables, OFFSETS, strict=True)))
            first, second, _ = self._levels(active, branch)
            row = np.arange(len(place))
            own = first[row, branch].astype(np.float64) * second[row, padded[place] % _LEAVES]
            out[k + order] = np.log(np.maximum(own, 1e-300))
        return out

    def learn(self, padded: np.ndarray, at: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        """One Adagrad step on the tokens at ``at``."""
        branch = padded[at] // _LEAVES
        order = np.argsort(branch.astype(np.int16), kind="stable")  # two bytes are sorted by their digits
        at, branch = at[order], branch[order]
        sides = np.stack([padded.take(at + o) for o in OFFSETS])
        hidden = self.bias + sum((self.embed @ w).take(s, axis=0) for s, w in zip(sides, self.layer, strict=True))
        active = np.tanh(hidden)
        first, second, runs = self._levels(active, branch)
        row, share = np.arange(len(at)), np.float32(1 / len(at))
        for p, target in ((first, branch), (second, padded[at] % _LEAVES)):
            p[row, target] -= 1
            p *= share
        back = first @ self.top.T
        leaf, leaf_bias = np.zeros_like(self.leaf), np.zeros_like(self.leaf_bias)
        for j, a, z in runs:
            back[a:z] += second[a:z] @ self.leaf[j].T
            leaf[j] = active[a:z].T @ second[a:z]
            leaf_bias[j] = second[a:z].sum(axis=0)
        back *= 1 - active * active
        moved = np.concatenate([back @ w.T for w in self.layer])
        seen_by = sides.ravel().astype(np.int16)
        order = np.argsort(seen_by, kind="stable")
        seen_by = seen_by[order]
        opens = np.flatnonzero(np.diff(seen_by, prepend=-1))
        embed = np.zeros_like(self.embed)
        embed[seen_by[opens]] = np.add.reduceat(moved.take(order, axis=0), opens, axis=0)
        layer = np.stack([self.embed.take(s, axis=0).T @ back for s in sides])
        grads = [embed, layer, back.sum(axis=0), active.T @ first, first.sum(axis=0), leaf, leaf_bias]
        for value, seen, g in zip(self.parts, memory, grads, strict=True):
            seen += g * g
            value -= rate * g / np.sqrt(seen)


def padded_tokens(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in a row with edges between, the places of their tokens, and each place's document."""
    edge = np.full(SIDE, EDGE, np.int64)
    padded = np.concatenate([edge, *(x for d in docs for x in (d.astype(np.int64), edge))])
    at = np.flatnonzero(padded != EDGE)
    return padded, at, np.repeat(np.arange(len(docs)), [len(d) for d in docs])


def hidden(owner: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Which tokens a round hides: every ``rounds``-th of each document, counted from the document's first."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner)))
    return place % rounds == turn


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in batch.column("__ids").to_pylist()]


def tokens(docs: DataFrame, known: Broadcast[Lexicon], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __row, __ids, __rare): a number for each row, the tokens of each text, four bytes each, and the hashes of words
    that the lexicon does not hold; these only if listed words are among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row = Vocabulary(known.value.words, known.value.keys), TaskContext.get().partitionId() << 40
        for block in blocks(batches, "__text", BATCH_BYTES):
            read = vocabulary.read(block.column("__text"), rare=known.value.least > LEAST)
            rows = pa.array(np.arange(row, row + len(read)))
            row += len(read)
            yield pa.RecordBatch.from_arrays([block.column(0), rows, pa.array([i.tobytes() for i, _ in read], pa.binary()), pa.array([r for _, r in read], pa.list_(pa.int64()))], names=[id_col, "__row", "__ids", "__rare"])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, first_schema(docs, id_col) + ", __row long, __ids binary, __rare array<long>")


def train(rows: DataFrame, known: Broadcast[Lexicon], *, rounds: int = ROUNDS, rate: float = 0.1) -> Network:
    """``rounds`` of local steps over all of ``rows`` (id, __ids) and averaging."""
    spark = rows.sparkSession
    network = Network.start()
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(network)  # about 16,000 numbers

        def local(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            own = Network.of(start.value.flat())
            memory = [np.full_like(p, 1e-4) for p in own.parts]
            rng, seen, steps = np.random.default_rng(TaskContext.get().partitionId()), 0, 0
            for block in blocks(batches, "__ids", 1 << 20):
                padded, at, owner = padded_tokens([known.value.classes[i] for i in _ids(block)])
                chosen = rng.permutation(at[hidden(owner, turn, rounds)])
                k = 0
                while k < len(chosen):
                    size = BATCH if steps < FIRST_STEPS else LARGE_BATCH
                    own.learn(padded, chosen[k:k + size], memory, rate)
                    k, steps = k + size, steps + 1
                seen += len(chosen)
            if seen:
                group = TaskContext.get().partitionId() % GROUPS
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([float(seen)]), pa.array([own.flat().astype("<f8").tobytes()])], names=["group", "n", "net"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(sum(_SIZES)), 0.0
            for batch in batches:
                for weight, net in zip(batch.column("n").to_pylist(), batch.column("net").to_pylist(), strict=True):
                    total += weight * np.frombuffer(net, "<f8")
                    n += weight
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "net"])

        parts = rows.select("__ids").mapInArrow(local, "group long, n double, net binary")
        sums = parts.repartition(GROUPS, "group").mapInArrow(summed, "n double, net binary").collect()  # at most GROUPS networks
        if not sums:
            break
        network = Network.of(sum(np.frombuffer(r.net, "<f8") for r in sums) / sum(r.n for r in sums))
    return network


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, shared_words: int = SHARED_WORDS) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``log_prob`` (sum), ``mean_log_prob`` (null without tokens)."""
    context = docs.sparkSession.sparkContext
    held, gains = lexicon(docs, text_col, shared_words=shared_words)
    known = context.broadcast(held)
    rows = stage(tokens(docs, known, id_col=id_col, text_col=text_col), "lm-tokens")
    shared = context.broadcast(train(rows, known, rounds=rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__ids", 1 << 20):
            ids = _ids(block)
            padded, at, owner = padded_tokens([known.value.classes[i] for i in ids])
            in_class = known.value.shares[np.concatenate(ids)]
            total = np.bincount(owner, weights=shared.value.log_probs(padded, at) + in_class, minlength=len(ids)).astype(float)  # whole numbers if there are no tokens
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array(total)], names=[id_col, "__row", "n_tokens", "log_prob"])

    scored = rows.select(id_col, "__row", "__ids").mapInArrow(run, first_schema(rows, id_col) + ", __row long, n_tokens long, log_prob double")
    if gains is not None:
        rare = rows.select("__row", F.explode("__rare").alias("key")).groupBy("__row", "key").agg(F.count("*").alias("k"))
        gained = rare.join(gains, "key").groupBy("__row").agg(F.sum(F.col("k") * F.col("gain")).alias("gained"))
        scored = scored.join(gained, "__row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("gained", F.lit(0.0)))
    scored = scored.select(id_col, "n_tokens", "log_prob")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
