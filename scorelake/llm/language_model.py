"""Scoring texts by a log-bilinear language model, beside an additive unigram base.

Tokens are a text's words (A-Z lower-cased) and one end. All tokens of the training texts are
counted. For the neural model, tokens belong to classes: the end and the most frequent words are
classes of their own, other words share a class by their last three bytes. The model gives
P(token) = P(class | the three tokens before) * P(token | class). The first factor is log-bilinear:
the context's class vectors, weighted by position, are summed and multiplied with a vector per
class, and normalised over all classes. The second is additive in the class, with one unseen token
more, so the probabilities of all tokens add up to 1.

Class vectors are trained with noise-contrastive estimation in numpy: in each round a task trains on
every position of its texts, starting from the last round's parameters; the results are averaged
by tokens. Texts are written once as a byte per token, its class, and the rounds read those. Counts cover all training texts, and what is trained on grows with them.

The HEAVY most frequent tokens at most (a whole range of counts is taken or not) are sent to the
tasks. Rarer tokens, each at most 1/HEAVY of all, meet their counts in a join.

Defined cases: a NULL text is empty and has the end only; repeated rows are scored alike; without
training texts every token has base probability 1. Equally frequent words are ordered by their bytes.
A very long text is a row like any other: its words are in its task's memory at once, with some 40
bytes each. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import summed
from scorelake.sources.workspace import new_folder

SMOOTHING = 0.1
HEAVY = 1 << 17
CLASSES, TAIL_CLASSES = 128, 32
CONTEXT, WIDTH = 3, 24
ROUNDS, NOISE, BATCH, RATE = 2, 25, 1024, 0.15
#: Bytes of texts whose tokens are counted, or looked up, at a time.
COUNTED, LOOKED_UP = 1 << 25, 1 << 21
#: The end's token, which no word equals, and its class, which also stands before the first word.
END, END_CLASS = b"", 0


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text; the end is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return CLASSES - TAIL_CLASSES + zlib.crc32(word[-3:]) % TAIL_CLASSES


def _blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Where runs of texts begin and how many they are: of about size bytes, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(sizes):
        taken, held = 0, 0
        while at + taken < len(sizes) and held < size:
            held += sizes[at + taken]
            taken += 1
        yield at, taken
        at += taken


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary) one after another, and where each text's words begin and the last ones end."""
    # Copied first: pyarrow 23 lower-cases a slice of texts that begins inside its array wrongly.
    texts = pc.fill_null(texts.take(pa.array(range(len(texts)), pa.int64())).cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    starts, words = parts.offsets.to_numpy(), parts.values.cast(pa.large_binary())
    # Space at an end of a text gives an empty word there.
    real = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return words.filter(pa.array(real)), before[starts]


def tail_classes(words: pa.Array) -> np.ndarray:
    """tail_class() of each word: one call per different end of three bytes."""
    ends = pc.dictionary_encode(pc.binary_slice(words, -3))
    classes = np.fromiter((tail_class(e) for e in ends.dictionary.to_pylist()), np.int16, len(ends.dictionary))
    return classes[ends.indices.to_numpy()] if len(words) else np.zeros(0, np.int16)


def _tail_class(token: Column) -> Column:
    last = F.substring(token, F.greatest(F.octet_length(token) - 2, F.lit(1)), F.lit(3))
    return (F.lit(CLASSES - TAIL_CLASSES) + F.crc32(last) % TAIL_CLASSES).cast("int")


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """token (binary) and c: occurrences over all rows of docs, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, taken in _blocks(batch.column(0), COUNTED):
                counts = split(batch.column(0).slice(at, taken))[0].value_counts()
                tokens = pa.concat_arrays([counts.field(0).cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([tokens, pa.concat_arrays([counts.field(1), pa.array([taken])])], names=["token", "c"])

    return docs.select(text).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Heavy:
    """The tokens every task knows: places in descending order of count."""

    tokens: list[bytes]
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.classes = np.fromiter(map(tail_class, self.tokens), np.int16, len(self.tokens))
        own = [i for i, t in enumerate(self.tokens) if t != END][: CLASSES - TAIL_CLASSES - 1]
        self.classes[own] = np.arange(1, len(own) + 1)
        self.own = {self.tokens[i] for i in own}
        self.known: pa.Array | None = None

    def class_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place (-1 if rare) and class of each word."""
        if self.known is None:
            self.known = pa.array(self.tokens, pa.large_binary())
        found = pc.index_in(words, self.known)
        places = pc.fill_null(found, -1).to_numpy()
        classes = self.classes[places] if len(self.tokens) else np.zeros(len(words), np.int16)
        rare = np.flatnonzero(places < 0)
        if len(rare):
            classes[rare] = tail_classes(words.take(pa.array(rare)))
        return places, classes


@dataclass
class Parameters:
    """Vectors of context classes, weights of positions, vectors and biases of predicted classes."""

    context: np.ndarray
    position: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.position, self.output, self.bias)])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        shapes = ((CLASSES, WIDTH), (CONTEXT, WIDTH), (CLASSES, WIDTH), (CLASSES,))
        parts, at = [], 0
        for shape in shapes:
            size = math.prod(shape)
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return Parameters(*parts)

    @staticmethod
    def first(shares: np.ndarray) -> Parameters:
        rng = np.random.default_rng(11)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Parameters(small(CLASSES, WIDTH), np.full((CONTEXT, WIDTH), 0.5, np.float32), small(CLASSES, WIDTH), np.log(shares).astype(np.float32))

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The weighted sum of the vectors before each target; contexts has a column per position."""
        placed = self.context[None] * self.position[:, None]
        total = placed[0].take(contexts[:, 0], axis=0)
        for j in range(1, CONTEXT):
            total += placed[j].take(contexts[:, j], axis=0)
        return total

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms, normalised over all classes; contexts has a column per position.

        known keeps each context's normaliser (see unknown()) for as long as the parameters stay the same.
        """
        known = unknown() if known is None else known
        tables = [(self.context * self.position[j]) @ self.output.T for j in range(CONTEXT)]
        steps = CLASSES ** np.arange(CONTEXT, dtype=np.int32)
        codes = contexts.astype(np.int32) @ steps
        fresh = np.unique(codes[np.isnan(known[codes])])
        for at in range(0, len(fresh), 1024):
            some = fresh[at : at + 1024]
            scores = sum((tables[j][some // steps[j] % CLASSES] for j in range(CONTEXT)), self.bias)
            most = scores.max(axis=1)
            known[some] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
        return sum((tables[j][contexts[:, j], targets] for j in range(CONTEXT)), self.bias[targets]) - known[codes]


def unknown() -> np.ndarray:
    """A place per context for the logarithm of its normaliser, none known yet."""
    return np.full(CLASSES**CONTEXT, np.nan, np.float32)


def _by_class(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sums of rows by class for each column of classes: a table with a row per class for each."""
    n, kinds = classes.shape
    codes = (classes.T + (np.arange(kinds, dtype=np.int16) * CLASSES)[:, None]).ravel()
    order = np.argsort(codes, kind="stable")
    placed = codes[order]
    starts = np.flatnonzero(placed[1:] != placed[:-1]) + 1
    starts = np.concatenate([[0], starts])
    sums = np.zeros((kinds * CLASSES, rows.shape[1]), np.float32)
    sums[placed[starts]] = np.add.reduceat(rows.take(order % n, axis=0), starts, axis=0)
    return sums.reshape(kinds, CLASSES, -1)


def train(start: Parameters, contexts: np.ndarray, targets: np.ndarray, shares: np.ndarray, state: list | None = None) -> list:
    """One step of noise-contrastive estimation; state holds the sums of squared gradients and the generator."""
    p = start
    if state is None:
        state = [[np.full_like(x, 1e-3) for x in (p.context, p.position, p.output, p.bias)], np.random.default_rng(5)]
    sums, rng = state
    noise = rng.choice(CLASSES, NOISE, p=shares)
    log_noise = np.log(NOISE * shares).astype(np.float32)
    predicted = p.predicted(contexts)
    target_vectors = p.output.take(targets, axis=0)
    of_target = np.einsum("ij,ij->i", predicted, target_vectors) + (p.bias - log_noise)[targets]
    of_noise = predicted @ p.output[noise].T + (p.bias - log_noise)[noise]
    scale = np.float32(1 / len(targets))
    with np.errstate(over="ignore"):
        at_target = (1 / (1 + np.exp(-of_target)) - 1) * scale
        np.negative(of_noise, out=of_noise)
        at_noise = scale / (1 + np.exp(of_noise, out=of_noise))
    back = at_noise @ p.output[noise] + at_target[:, None] * target_vectors
    by_place = _by_class(back, contexts)
    d_output = _by_class(at_target[:, None] * predicted, targets[:, None])[0]
    np.add.at(d_output, noise, at_noise.T @ predicted)
    d_bias = np.bincount(targets, at_target, CLASSES).astype(np.float32)
    np.add.at(d_bias, noise, at_noise.sum(axis=0))
    d_context = (by_place * p.position[:, None]).sum(axis=0)
    d_position = (by_place * p.context).sum(axis=1)
    gradients = (d_context, d_position, d_output, d_bias)
    for x, total, gradient in zip((p.context, p.position, p.output, p.bias), sums, gradients, strict=True):
        total += gradient * gradient
        x -= RATE * gradient / np.sqrt(total)
    return state


def _sequence(classes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(CONTEXT, END_CLASS), classes, [END_CLASS]]).astype(np.int16)


def _windows(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (nearest first) and targets of every position after the first CONTEXT."""
    n = len(sequence) - CONTEXT
    return np.stack([sequence[CONTEXT - 1 - j : CONTEXT - 1 - j + n] for j in range(CONTEXT)], axis=1), sequence[CONTEXT:]


def _encoded(docs: DataFrame, text: str, heavy) -> DataFrame:
    """classes: a byte per word of each text, its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, taken in _blocks(batch.column(0), LOOKED_UP):
                words, starts = split(batch.column(0).slice(at, taken))
                classes = heavy.value.class_ids(words)[1].astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([classes[i:j].tobytes() for i, j in pairwise(starts.tolist())], pa.binary())], names=["classes"])

    return docs.select(text).mapInArrow(run, "classes binary")


def _trained(encoded: DataFrame, start: Parameters, shares: np.ndarray) -> Parameters:
    """A round: parameters trained in each task from start, averaged by positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, state = Parameters.of(start.flat()), None
        contexts, targets, held, seen = [], [], 0, 0

        def step() -> None:
            nonlocal state, seen
            c, t = np.concatenate(contexts), np.concatenate(targets)
            for at in range(0, len(t), BATCH):
                state = train(p, c[at : at + BATCH], t[at : at + BATCH], shares, state)
            seen += len(t)

        for batch in batches:
            for value in batch.column(0):
                c, t = _windows(_sequence(np.frombuffer(value.as_buffer(), np.uint8)))
                contexts.append(c)
                targets.append(t)
                held += len(t)
                if held >= 16 * BATCH:
                    step()
                    contexts, targets, held = [], [], 0
        if held:
            step()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(["p"]), pa.array([(p.flat().astype(np.float64) * seen).tobytes()], pa.binary()), pa.array([float(seen)])],
                names=["key", "vec", "weight"],
            )

    totals, weights = summed(encoded.mapInArrow(run, "key string, vec binary, weight double"), "float64")
    return Parameters.of(totals["p"] / weights["p"]) if totals else start


@dataclass
class Model:
    """counts is the folder of all training counts; classes' totals are by class."""

    counts: str
    tokens: int
    distinct: int
    heavy: Heavy
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    parameters: Parameters


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Counts all rows of docs and trains on them."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-counts")
    count_tokens(docs, text).write.parquet(folder)
    counts = spark.read.parquet(folder)
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(step.alias("step"), (F.col("token") == F.lit(END)).alias("is_end"))
    held = sorted(bins.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect(), key=lambda r: -r.step)
    tokens, distinct = sum(r.c for r in held), sum(r.n for r in held)
    least, room = None, HEAVY
    for row in held:
        room -= row.n
        if room < 0 and (least is None or row.step != least):
            break
        least = row.step
    known = counts.where(step >= least).collect() if least is not None else []
    known.sort(key=lambda r: (-r.c, bytes(r.token)))
    heavy = Heavy([bytes(r.token) for r in known], np.array([r.c for r in known], np.int64))
    own = spark.createDataFrame([(bytearray(t),) for t in sorted(heavy.own | {END})], "token binary")
    tail = counts.join(F.broadcast(own), "token", "left_anti").groupBy(_tail_class(F.col("token")).alias("k"))
    class_tokens, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in tail.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_tokens[row.k], class_distinct[row.k] = row.c, row.n
    for token, c, k in zip(heavy.tokens, heavy.counts, heavy.classes, strict=True):
        if token in heavy.own:
            class_tokens[k], class_distinct[k] = c, 1
    class_tokens[END_CLASS] = sum(r.c for r in held if r.is_end)
    shares = (class_tokens + 1.0) / (class_tokens + 1.0).sum()
    sent = spark.sparkContext.broadcast(heavy)
    parameters = Parameters.first(shares)
    if tokens and rounds:
        sequences = new_folder(spark, "class-sequences")
        _encoded(docs, text, sent).write.parquet(sequences)
        for _ in range(rounds):
            parameters = _trained(spark.read.parquet(sequences), parameters, shares)
    return Model(folder, tokens, distinct, heavy, class_tokens, class_distinct, parameters)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, mark, text) to a row per row with everything but the counts of its rare tokens, which it lists."""
    sent = docs.sparkSession.sparkContext.broadcast(model.heavy)
    parameters, mass, kinds = model.parameters, model.class_tokens, model.class_distinct
    # A shared class divides its probability among its tokens; the end and own words have theirs alone.
    shared = np.zeros(CLASSES)
    shared[CLASSES - TAIL_CLASSES :] = 1
    inside = np.log10(mass + SMOOTHING * (kinds + 1))
    # Without its ends an end could not be told from a word of no training texts.
    n_ends = int(mass[END_CLASS])
    kind = "key long, doc_id {}, mark boolean, n_tokens long, known long, parts double, classes double, rare array<struct<token:binary,n:int>>"
    kind = kind.format(docs.schema["doc_id"].dataType.simpleString())

    def block(texts: pa.Array, normalisers: np.ndarray) -> tuple[list[tuple], pa.ListArray]:
        heavy = sent.value
        log_counts = np.log10(heavy.counts + SMOOTHING)
        every, starts = split(texts)
        all_places, all_classes = heavy.class_ids(every)
        # Different rare words of each text, with their counts.
        at = np.flatnonzero(all_places < 0)
        coded = pc.dictionary_encode(every.take(pa.array(at)).cast(pa.binary()))
        kinds = max(len(coded.dictionary), 1)
        texts_of = np.searchsorted(starts, at, "right") - 1
        pairs, times = np.unique(texts_of * kinds + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        listed = pa.StructArray.from_arrays(
            [coded.dictionary.take(pa.array(pairs % kinds)), pa.array(times.astype(np.int32))], names=["token", "n"]
        )
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // kinds, np.arange(len(texts) + 1)), pa.int32()), listed)
        sequences, rows = [], []
        for i, j in pairwise(starts.tolist()):
            places, classes = all_places[i:j], all_classes[i:j]
            sequences.append(_sequence(classes))
            hit = places >= 0
            parts = float(log_counts[places[hit]].sum()) if hit.any() else 0.0
            # Within shared classes the numerators are those of the base; own words take theirs back.
            alone = hit & (shared[classes] == 0)
            back = float(log_counts[places[alone]].sum()) if alone.any() else 0.0
            divided = float((inside * shared)[classes].sum())
            rows.append((j - i + 1, int(hit.sum()) + (n_ends > 0), parts + math.log10(n_ends + SMOOTHING), -back - math.log10(n_ends + SMOOTHING) - divided))
        whole = np.concatenate(sequences)
        logs = parameters.log_probabilities(*_windows(whole), normalisers).astype(np.float64) / math.log(10)
        ends = np.cumsum([len(s) for s in sequences])
        out, start = [], 0
        for end, (n, known, parts, rest) in zip(ends, rows, strict=True):
            out.append((n, known, parts, rest + float(logs[start : end - CONTEXT].sum())))
            start = end
        return out, rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, normalisers = TaskContext.get().partitionId() << 40, unknown()
        for batch in batches:
            for at, taken in _blocks(batch.column(2), LOOKED_UP):
                part = batch.slice(at, taken)
                some, rare = block(part.column(2), normalisers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(key, key + len(some)), pa.int64()), part.column(0), part.column(1),
                     *(pa.array([r[i] for r in some], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))),
                     rare],
                    names=["key", "doc_id", "mark", "n_tokens", "known", "parts", "classes", "rare"],
                )
                key += len(some)

    return docs.mapInArrow(run, kind)


def score(docs: DataFrame, model: Model, mark: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, mark, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    mark is any boolean that is carried along.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(False) if mark is None else mark).alias("mark"), F.col(text).alias("text"))
    folder = new_folder(spark, "scored-parts")
    _scored(rows, model).write.parquet(folder)
    parts = spark.read.parquet(folder)
    rare = parts.select("key", F.explode("rare").alias("r")).select("key", "r.token", "r.n")
    found = rare.join(spark.read.parquet(model.counts), "token", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = found.groupBy("key").agg(
        F.sum(F.col("n") * F.log10(c + F.lit(SMOOTHING))).alias("rare_parts"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    total = math.log10(model.tokens + SMOOTHING * (model.distinct + 1))
    both = parts.drop("rare").join(sums, "key", "left").withColumn("numerators", F.col("parts") + F.coalesce("rare_parts", F.lit(0.0)))
    return both.select(
        "doc_id", "mark", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("numerators") - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("numerators") + F.col("classes")).alias("score"),
    )
