"""Language-model scores of whole documents by a gated recurrent network.

Tokens are the words of the lower-cased (A-Z) text and one end. The output is factored: a
softmax over classes, then one over the words of the class. The ``CLASSES * PER_CLASS`` most
frequent tokens have classes of their own by rank. All other words, seen or not, fall into ``TAILS``
classes by their last two bytes: the network reads and predicts these classes like any others,
and inside one a word's probability is its smoothed share of the class's training tokens, known from
the whole table of counts. So every token is predicted from its context at least as far as its class,
every text has a probability, and those of all next tokens add up to one.

Counts are taken over all training documents, by Spark. The most frequent words, fewer than
``HEAD`` and all or none of those with the same count, go to every task as a table; its
size is bounded by that parameter, whatever the corpus. All other words of a document are
joined with the whole table of counts.

Texts are taken apart twice: for the counts, and once more when they are written as arrays of token
numbers, which learning and scoring read.

Learning. The network is trained in numpy by truncated back-propagation through windows of
``WINDOW`` tokens, states running on from window to window and starting anew at each document.
Every training document is used once: in rounds of growing shares, each a partition of the table of
numbers, every task trains a copy of the network on its documents, and the copies are averaged by
their tokens between rounds. Their sums are taken as a tree: ``FAN_IN`` copies at a time, until no more
than that are left for the driver, however many tasks there were.

Scoring. The documents of a batch run side by side, longest first, window after window with
their states carried on, so the likelihood is that of the complete text.

Nulls: a null text is the end alone. A null id belongs to training. Without training tokens
every token has probability one in the base and in the untrained model an even share of its
classes. Repeated rows score alike, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forkline.llm.common import keep_table
from forkline.session import scratch_root

HEAD = 100_000
CLASSES, PER_CLASS, TAILS = 32, 32, 32
HIDDEN = 16
WINDOW = 16
LANES = 512
RATE = 6e-3
#: Sixteenths of the training documents in each round.
SHARES = (1, 3, 12)
SCORE_WINDOW = 32
PART = 8192
END = ""
FLUSH = 300_000
REST = CLASSES * PER_CLASS
#: What the network reads and predicts: words of their own class, and classes of other words.
SYMBOLS = REST + TAILS
#: Copies of the weights that one group sums.
FAN_IN = 16
#: The round of documents that are not learnt from.
APART = -1


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ---------------------------------------------------------------- network


def shapes() -> dict[str, tuple[int, ...]]:
    h = HIDDEN
    return {
        "inputs": (SYMBOLS, 3 * h),  # what a token adds to the gates
        "state": (h, 3 * h),
        "state_bias": (h,),
        "classes": (h, CLASSES + TAILS),
        "class_bias": (CLASSES + TAILS,),
        "words": (CLASSES, h, PER_CLASS),
        "word_bias": (CLASSES, PER_CLASS),
    }


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(counts: np.ndarray, tails: np.ndarray, seed: int = 0) -> np.ndarray:
    """Small random weights; biases such that the untrained network knows the frequencies.

    ``counts``: of the words with a class of their own; ``tails``: of the other classes.
    """
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes().values()), np.float32)
    p = unpack(flat)
    for name in ("inputs", "state", "classes", "words"):
        p[name][...] = rng.normal(0, 0.1, p[name].shape)
    padded = np.zeros(REST)
    padded[: len(counts)] = counts
    table = padded.reshape(CLASSES, PER_CLASS) + 1e-3
    p["word_bias"][...] = np.log(table / table.sum(1, keepdims=True))
    every = np.append(table.sum(1), np.asarray(tails, float) + 1e-3)
    p["class_bias"][...] = np.log(every / every.sum())
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(p: dict[str, np.ndarray], given: np.ndarray, h: np.ndarray, after: np.ndarray, reset: np.ndarray, keep: np.ndarray, inner: np.ndarray, new: np.ndarray) -> None:
    """The next states of some lanes, and what the way back needs; all results go to the last five arrays.

    ``given``: what the tokens read add to the gates.
    """
    n = HIDDEN
    own = h @ p["state"]
    np.add(own[:, 2 * n :], p["state_bias"], out=inner)
    own += given
    _sigmoid(own[:, : 2 * n])
    reset[...] = own[:, :n]
    keep[...] = own[:, n : 2 * n]
    np.multiply(reset, inner, out=new)
    new += given[:, 2 * n :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=after)
    after *= keep
    after += new


def _ceilings(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """For each matrix of weights a number that no output of states within -1 and 1 exceeds.

    Outputs less this number have an exponential without looking for each row's greatest. Where
    all of a row could vanish below it, there is none (nan).
    """
    span = np.abs(weights).sum(-2)
    top = (bias + span).max(-1)
    return np.where(top - (bias - span).max(-1) < 60, top, np.nan).astype(weights.dtype)


def _lower(z: np.ndarray, ceiling: np.ndarray) -> None:
    z -= z.max(1, keepdims=True) if np.isnan(ceiling) else ceiling


def _log_softmax_at(z: np.ndarray, at: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """Logarithms of one probability of each row; the matrix is overwritten."""
    _lower(z, ceiling)
    picked = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], z.dtype))


def _gradient_at(z: np.ndarray, at: np.ndarray, n: int, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`_log_softmax_at`, with the gradient of the sum divided by ``n``."""
    rows = np.arange(len(z))
    _lower(z, ceiling)
    logs = z[rows, at]
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    logs -= np.log(sums)
    z *= (-1 / (n * sums))[:, None]
    z[rows, at] += 1 / n
    return logs, z


def outputs(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of targets, in their class for words of their own class.

    With ``grad`` also the gradient of their mean by the states, and ``grad`` is filled.
    """
    n = len(target)
    # Rows are put in the order of their classes once; narrow numbers sort in linear time.
    kind = np.where(target < REST, target // PER_CLASS, target - (REST - CLASSES)).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    kind, mine, wanted = kind[order], h.take(order, axis=0), target[order]
    share = mine @ p["classes"]
    share += p["class_bias"]
    ceiling = _ceilings(p["classes"], p["class_bias"])
    back = None
    if grad is None:
        logs = _log_softmax_at(share, kind, ceiling)
    else:
        logs, off = _gradient_at(share, kind, n, ceiling)
        grad["classes"] += mine.T @ off
        grad["class_bias"] += off.sum(0)
        back = off @ p["classes"].T
    bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
    ceilings = _ceilings(p["words"], p["word_bias"])
    for k in range(CLASSES):
        at = slice(bounds[k], bounds[k + 1])
        if at.start == at.stop:
            continue
        share = mine[at] @ p["words"][k]
        share += p["word_bias"][k]
        word = wanted[at] - k * PER_CLASS
        if grad is None:
            logs[at] += _log_softmax_at(share, word, ceilings[k])
        else:
            more, off = _gradient_at(share, word, n, ceilings[k])
            logs[at] += more
            grad["words"][k] += mine[at].T @ off
            grad["word_bias"][k] += off.sum(0)
            back[at] += off @ p["words"][k].T
    placed = np.empty_like(logs)
    placed[order] = logs
    if back is not None:
        ahead = np.empty_like(back)
        ahead[order] = back
        back = ahead
    return placed, back


def window_gradient(flat: np.ndarray, h: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the mean log-probability over a window (steps x lanes), the last states, and the mean.

    A state starts anew where the token before is an end.
    """
    p = unpack(flat)
    made = np.zeros_like(flat)
    grad = unpack(made)
    steps, lanes = before.shape
    n = HIDDEN
    given = p["inputs"].take(before, axis=0)
    fresh = (before != 0)[:, :, None]
    starts, states, reset, keep, inner, new = (np.empty((steps, lanes, n), flat.dtype) for _ in range(6))
    for t in range(steps):
        np.multiply(h, fresh[t], out=starts[t])
        h = states[t]
        _step(p, given[t], starts[t], h, reset[t], keep[t], inner[t], new[t])
    logs, back = outputs(p, states.reshape(-1, n), target.ravel(), grad)
    back = back.reshape(steps, lanes, n)
    # What does not depend on the way back is computed for all steps at once.
    of_new = (1 - keep) * (1 - new * new)
    of_keep = (starts - new) * keep * (1 - keep)
    of_reset = inner * reset * (1 - reset)
    gates = np.empty((steps, lanes, 3 * n), flat.dtype)
    outer = np.empty((steps, lanes, n), flat.dtype)
    carried = np.zeros((lanes, n), flat.dtype)
    across = np.ascontiguousarray(p["state"].T)
    for t in range(steps - 1, -1, -1):
        d = back[t] + carried
        d_new = np.multiply(d, of_new[t], out=outer[t])
        np.multiply(d_new, of_reset[t], out=gates[t, :, :n])
        np.multiply(d, of_keep[t], out=gates[t, :, n : 2 * n])
        np.multiply(d_new, reset[t], out=gates[t, :, 2 * n :])
        carried = gates[t] @ across
        d *= keep[t]
        carried += d
        carried *= fresh[t]
    grad["state"] += starts.reshape(-1, n).T @ gates.reshape(-1, 3 * n)
    grad["state_bias"] += gates[:, :, 2 * n :].sum((0, 1))
    gates[:, :, 2 * n :] = outer
    ids = before.ravel().astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    grad["inputs"][ids[order][first]] += np.add.reduceat(gates.reshape(-1, 3 * n).take(order, axis=0), first, axis=0)
    return made, h, float(logs.mean())


def train(flat: np.ndarray, stream: np.ndarray, adam: list[np.ndarray] | None = None, lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> np.ndarray:
    """Weights after one pass over a stream of token numbers in which ends are 0.

    The stream is cut into lanes that run side by side. ``adam``: moments and the number of
    steps, kept between calls.
    """
    lanes = max(1, min(lanes, len(stream) // window))
    length = -(-len(stream) // lanes)
    filled = np.zeros(lanes * length, np.int64)
    filled[: len(stream)] = stream
    grid = filled.reshape(lanes, length).T
    before = np.vstack([np.zeros((1, lanes), np.int64), grid[:-1]])
    if adam is None:
        adam = [np.zeros_like(flat), np.zeros_like(flat), np.zeros(1)]
    m, v, count = adam
    flat = flat.copy()
    h = np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, length, window):
        grad, h, _ = window_gradient(flat, h, before[at : at + window], grid[at : at + window])
        count += 1
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        flat += np.float32(rate / (1 - 0.9 ** count[0])) * m / (np.sqrt(v / np.float32(1 - 0.99 ** count[0])) + np.float32(1e-6))
    return flat


def log_likelihoods(flat: np.ndarray, docs: list[np.ndarray], window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log-probability of each sequence of symbols; of other words only their classes."""
    p = unpack(flat)
    sizes = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    every = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    total = np.zeros(len(docs))
    h = np.zeros((len(docs), HIDDEN), np.float32)
    before = np.zeros(len(docs), np.int64)
    room = [np.empty((len(docs), HIDDEN), np.float32) for _ in range(4)]
    for at in range(0, longest, window):
        states, targets, owners = [], [], []
        for t in range(at, min(at + window, longest)):
            k = int(active[t])
            after = np.empty((k, HIDDEN), np.float32)
            _step(p, p["inputs"].take(before[:k], axis=0), h[:k], after, *[r[:k] for r in room])
            h = after
            before = every[starts[:k] + t]
            states.append(h)
            targets.append(before)
            owners.append(np.arange(k))
        whole, wanted = np.concatenate(states), np.concatenate(targets)
        # As many rows at a time as stay near the processor.
        logs = [outputs(p, whole[a : a + PART], wanted[a : a + PART])[0] for a in range(0, len(wanted), PART)]
        total += np.bincount(np.concatenate(owners), np.concatenate(logs), len(docs))
    out = np.zeros(len(docs))
    out[order] = total
    return out


# ---------------------------------------------------------------- corpus


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in counts], "n": list(counts.values())})

    for batch in batches:
        for text in batch["text"]:
            counts.update(tokens_of(text))
            counts[b""] += 1
            if len(counts) > FLUSH:
                yield frame()
                counts.clear()
    if counts:
        yield frame()


def tail_class(word: bytes) -> int:
    """The class of a word without one of its own."""
    return (31 * word[-1] + (word[-2] if len(word) > 1 else 0)) % TAILS if word else 0


def _tail_class(word: Column) -> Column:
    """:func:`tail_class` as an expression."""
    code = lambda at: F.coalesce(F.conv(F.hex(F.substring(word.cast("binary"), at, 1)), 16, 10).cast("int"), F.lit(0))
    before = F.when(F.octet_length(word) > 1, code(-2)).otherwise(F.lit(0))
    return ((code(-1) * 31 + before) % TAILS).cast("int")


@dataclass
class Corpus:
    """Counts of the training tokens: the whole table, its head, and sums.

    ``tails``: training tokens and kinds of each class of words without a class of their own.
    """

    counts: DataFrame
    words: list[bytes]
    numbers: np.ndarray
    total: int
    kinds: int
    tails: np.ndarray

    @property
    def symbols(self) -> np.ndarray:
        """The symbol of each word of the head, and of the classes of all words past it."""
        outer = [REST + tail_class(w) for w in self.words[REST:]]
        return np.concatenate([np.arange(min(REST, len(self.words))), np.array(outer, np.int64), REST + np.arange(TAILS)]).astype(np.int64)


def count_tokens(training: DataFrame, text: str = "text", head: int = HEAD) -> Corpus:
    """``training``: the documents to learn from."""
    spark = training.sparkSession
    partial = training.select(F.col(text).alias("text")).mapInPandas(_counted, "word string, n bigint")
    counts = keep_table(spark, partial.groupBy("word").agg(F.sum("n").alias("n")), "token-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kinds"), F.max(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
    # The least count of the head follows from how many words have each count, so that no
    # more than the head itself reaches the driver. One row per distinct count is ordered.
    words_of = counts.filter(F.col("word") != END)
    falling = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    upto = words_of.groupBy("n").agg(F.count("*").alias("kinds")).withColumn("upto", F.sum("kinds").over(falling))
    least = upto.filter(F.col("upto") < head).agg(F.min("n").alias("n")).first()["n"]
    top = words_of.filter(F.col("n") >= (least if least is not None else sums["n"] + 1)).toPandas()
    order = np.lexsort((top["word"], -top["n"].to_numpy(np.int64)))
    words = [b"", *(w.encode("utf-8", "surrogatepass") for w in top["word"].iloc[order])]
    numbers = np.concatenate([[sums["ends"] or 0], top["n"].to_numpy(np.int64)[order]]).astype(np.int64)
    tails = np.zeros((TAILS, 2), np.int64)
    by_class = counts.filter(F.col("word") != END).groupBy(_tail_class(F.col("word")).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    for r in by_class.collect():  # at most ``TAILS`` rows
        tails[r["k"]] = r["n"], r["kinds"]
    for word, n in zip(words[1:REST], numbers[1:REST].tolist()):
        tails[tail_class(word)] -= n, 1
    return Corpus(counts, words, numbers, sums["n"], sums["kinds"], tails)


_NUMBERS: dict[str, dict[bytes, int]] = {}


def _numbers(head: tuple[str, Broadcast]) -> dict[bytes, int]:
    """The head's words by rank, made once per worker; ``head``: a name of its own, and the words."""
    name, words = head
    if name not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[name] = {w: k for k, w in enumerate(words.value)}
    return _NUMBERS[name]


def _share(spark: SparkSession, corpus: Corpus) -> tuple[str, Broadcast]:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(corpus.words)


def _encoded(head: tuple[str, Broadcast], past: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _numbers(head)
        for batch in batches:
            ids, tails, times = [], [], []
            for text in batch["text"]:
                words = tokens_of(text)
                own = np.fromiter(chain(map(numbers.get, words, repeat(past)), (0,)), np.int32, len(words) + 1)
                outside = np.flatnonzero(own == past)
                beyond = [words[i] for i in outside.tolist()]
                # tail_class, spelled out
                own[outside] += np.fromiter([(31 * w[-1] + (w[-2] if len(w) > 1 else 0)) % TAILS for w in beyond], np.int32, len(beyond))
                ids.append(own.astype("<i4").tobytes())
                distinct = Counter(beyond)
                tails.append(b" ".join(distinct).decode("utf-8", "surrogatepass"))
                times.append(np.fromiter(distinct.values(), np.int64, len(distinct)))
            yield pd.DataFrame({"key": batch["key"].to_numpy(), "turn": batch["turn"].to_numpy(), "ids": ids, "tail": tails, "times": times})

    return rows


def encode(docs: DataFrame, corpus: Corpus, learns: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """number, key, turn, ids, tail and times of every document, in a table of its own, partitioned by round.

    ``learns``: which documents are learnt from; hashes of whole texts deal them to rounds. ``ids`` are
    numbers of the head's words, or past it the classes of words; ``tail`` holds those words, joined by
    blanks, and ``times`` how often each occurs.
    """
    spark = docs.sparkSession
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(sum(SHARES)))
    turn, upto = F.lit(len(SHARES) - 1), sum(SHARES)
    for k in range(len(SHARES) - 1, 0, -1):
        upto -= SHARES[k]
        turn = F.when(draw < upto, F.lit(k - 1)).otherwise(turn)
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.when(learns, turn).otherwise(F.lit(APART)).alias("turn"), F.col(text).alias("text"))
    made = rows.mapInPandas(_encoded(_share(spark, corpus), len(corpus.words)), "key string, turn int, ids binary, tail string, times array<bigint>")
    path = f"{scratch_root(spark).rstrip('/')}/forkline-encoded-{uuid.uuid4().hex}"
    numbered = made.select(F.monotonically_increasing_id().alias("number"), "key", "ids", "tail", "times", "turn")
    numbered.write.partitionBy("turn").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def _trained(flat: np.ndarray, symbols: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, seen, adam = flat, 0, [np.zeros_like(flat), np.zeros_like(flat), np.zeros(1)]
        for batch in batches:
            parts, size = [], 0
            for ids in batch["ids"]:
                parts.append(symbols[np.frombuffer(ids, "<i4")])
                size += len(parts[-1])
                if size > 1 << 22:
                    weights, seen, parts, size = train(weights, np.concatenate(parts), adam), seen + size, [], 0
            if parts:
                weights, seen = train(weights, np.concatenate(parts), adam), seen + size
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "tokens": [seen], "weights": [(weights.astype("<f8") * seen).tobytes()]})

    return rows


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    total = sum(np.frombuffer(w, "<f8") for w in group["weights"])
    return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "tokens": [int(group["tokens"].sum())], "weights": [total.tobytes()]})


def fit(encoded: DataFrame, corpus: Corpus) -> np.ndarray:
    """The weights after all rounds over a table of :func:`encode`."""
    spark = encoded.sparkSession
    flat = initial(corpus.numbers[:REST], corpus.tails[:, 0])
    schema = "part int, tokens bigint, weights binary"
    for turn in range(len(SHARES)):
        copies = encoded.filter(F.col("turn") == turn).select("ids").mapInPandas(_trained(flat, corpus.symbols), schema)
        copies = keep_table(spark, copies, "copies")
        while copies.count() > FAN_IN:
            sums = copies.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_summed, schema)
            copies = keep_table(spark, sums, "copies")
        sums = copies.orderBy("part").collect()
        tokens = sum(r["tokens"] for r in sums)
        if tokens:
            flat = (sum(np.frombuffer(r["weights"], "<f8") for r in sums) / tokens).astype(np.float32)
    return flat


def _scored(flat: np.ndarray, counts: np.ndarray, symbols: np.ndarray, tails: np.ndarray):
    beyond = np.zeros(TAILS)  # past the head: nothing yet
    logs = np.log10(np.append(counts, beyond) + 1.0)
    seen = np.append(counts > 0, beyond > 0)
    spread = np.log10(tails.sum(axis=1) + 1.0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = size = 0
            every = batch["ids"].tolist()
            for stop in range(1, len(every) + 1):  # groups of some 8 million tokens
                size += len(every[stop - 1])
                if size > 1 << 25 or stop == len(every):
                    yield frame(batch.iloc[start:stop], [np.frombuffer(e, "<i4") for e in every[start:stop]])
                    start, size = stop, 0

    def frame(batch: pd.DataFrame, every: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(e) for e in every])
        flat_ids = np.concatenate(every)
        first = np.cumsum(sizes) - sizes
        symbol = symbols[flat_ids]
        each = logs[flat_ids]
        inner = np.where(symbol >= REST, each - spread[np.maximum(symbol - REST, 0)], 0.0)
        total = lambda x: np.add.reduceat(x, first)  # noqa: E731  every document has its end
        lm = log_likelihoods(flat, np.split(symbol, first[1:])) / np.log(10) + total(inner)
        return pd.DataFrame({"number": batch["number"].to_numpy(), "key": batch["key"].to_numpy(), "n_tokens": sizes, "known": total(seen[flat_ids].astype(np.int64)), "head_sum": total(each), "lm": lm})

    return rows


def score_documents(encoded: DataFrame, corpus: Corpus, flat: np.ndarray, kind: str = "bigint") -> DataFrame:
    """doc_id (as ``kind``), turn, n_tokens, n_known, train_tokens, base_score and score of every document of the table."""
    schema = "number bigint, key string, n_tokens bigint, known bigint, head_sum double, lm double"
    run = encoded.select("number", "key", "ids").mapInPandas(_scored(flat, corpus.numbers, corpus.symbols, corpus.tails), schema)
    beyond = encoded.filter(F.size("times") > 0).select("number", "times", F.posexplode(F.split("tail", " ")).alias("at", "word"))
    tails = beyond.select("number", "word", F.get("times", "at").alias("n"))
    found = tails.join(corpus.counts.select(F.col("word").alias("of"), F.col("n").alias("c")), F.col("word") == F.col("of"), "left")
    sums = found.groupBy("number").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("tail_known"))
    joined = run.join(sums.withColumnRenamed("number", "of_number"), F.col("number") == F.col("of_number"), "left")
    more: Column = F.coalesce("tail_sum", F.lit(0.0))
    even = float(np.log10(corpus.total + corpus.kinds + 1.0))
    return joined.select(
        F.col("key").cast(kind).alias("doc_id"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.total).cast("bigint").alias("train_tokens"),
        (F.col("head_sum") + more - F.col("n_tokens") * F.lit(even)).alias("base_score"),
        (F.col("lm") + more).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    training = docs.filter(~held_out(F.col("doc_id")))
    corpus = count_tokens(training)
    encoded = encode(docs, corpus, ~held_out(F.col("doc_id")))
    scored = score_documents(encoded, corpus, fit(encoded, corpus))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
