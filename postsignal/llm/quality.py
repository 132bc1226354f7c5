"""Quality classifier over supervised subword embeddings.

A document is the average of learned vectors: one for each word, each character n-gram of a word
(with marks for its begin and end) and each pair of neighbouring words, all hashed to ``buckets``. Pairs
of one word twice share a bucket (``share_repeats``), so that what repetition says is learned from all words. A softmax over the two classes reads the average. Vectors and softmax are trained
together by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled
documents (``sample``, chosen by a hash of the id); whole texts are used.

A score needs one number per bucket: the average commutes with the softmax's linear part, so each
vector is reduced to its share of the difference between the classes. This array (4 bytes per bucket)
is all that is broadcast. Workers remember the summed shares of a bounded number of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import stored, text_bytes, text_slices, worker_state

#: Bytes of text worked on together, words whose shares a worker keeps, words whose features are made at once.
BATCH_BYTES, KEPT, SLICE = 1 << 20, 200_000, 1 << 14


@dataclass(frozen=True)
class Training:
    """Size of the model and of its training; ``sample`` bounds the labelled rows it sees.

    ``balance`` weighs the classes as if they were equally frequent to that power (0: as they are).
    """

    sample: int = 4000
    buckets: int = 1 << 17
    dims: int = 8
    shortest: int = 2
    longest: int = 4
    epochs: int = 4
    rate: float = 0.5
    balance: float = 0.0
    share_repeats: bool = True
    seed: int = 7


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def word_features(words: list[bytes], model: Training):
    """Buckets of the features of each word: flat array and offsets, and a hash of each word.

    N-grams are of UTF-8 bytes; the word with its marks is a feature of its own.
    """
    import numpy as np

    raw = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    stop = ends[owner]
    at = np.arange(len(raw))
    prime = np.uint64(0x100000001B3)
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(raw), np.uint64)
        for n in range(1, model.longest + 1):
            live = np.flatnonzero(at + n <= stop)
            rolled[live] = rolled[live] * prime + raw[live + n - 1] + np.uint64(1)
            if n >= model.shortest:
                # the whole word comes below, under its own mark
                part = live[(lengths[owner[live]] != n)]
                owners.append(owner[part])
                hashes.append(_mixed(rolled[part] + np.uint64(n << 56)))
        powers = np.cumprod(np.full(int(lengths.max(initial=1)), prime, np.uint64))
        whole = np.add.reduceat((raw + np.uint64(1)) * powers[at - (stop - lengths[owner])], ends - lengths) if len(words) else raw
        owners.append(np.arange(len(words)))
        hashes.append(_mixed(whole + np.uint64(255 << 56)))
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    flat = (hashes[order] % np.uint64(model.buckets)).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))]), whole


def pair_features(hashes, model: Training):
    """Buckets of the pairs of neighbouring words, from the hashes of the words in their order; repeats are bucket 0."""
    import numpy as np

    with np.errstate(over="ignore"):
        found = (_mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) % np.uint64(model.buckets)).astype(np.int64)
    if model.share_repeats:
        found[hashes[:-1] == hashes[1:]] = 0
    return found


def bag(text: bytes, model: Training):
    """(buckets, counts) of a document."""
    import numpy as np

    words = text.split()
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rows = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    flat, offsets, hashes = word_features(list(index), model)
    counts = np.bincount(rows, minlength=len(index))
    sums = np.bincount(flat, weights=np.repeat(counts, np.diff(offsets)), minlength=model.buckets)
    if len(rows) > 1:
        sums += np.bincount(pair_features(hashes[rows], model), minlength=model.buckets)
    keys = np.flatnonzero(sums)
    return keys, sums[keys]


def train(texts: list[bytes], labels: list[int], model: Training):
    """Shares of the log odds of label 1: one per bucket, and the bias at the end."""
    import numpy as np

    shares = np.zeros(model.buckets + 1, np.float64)
    if not texts:
        return shares
    rng = np.random.default_rng(model.seed)
    vectors = rng.uniform(-1, 1, (model.buckets, model.dims)) / model.dims
    output, bias = np.zeros((model.dims, 2)), np.zeros(2)
    bags = []
    for text in texts:
        keys, counts = bag(text, model)
        bags.append((keys.astype(np.int32), (counts / max(1.0, counts.sum())).astype(np.float32)))
    labels = np.asarray(labels)
    share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-9, 1)
    weight = (0.5 / share) ** model.balance
    steps, done = model.epochs * len(bags), 0
    for _ in range(model.epochs):
        for i in rng.permutation(len(bags)).tolist():
            rate = model.rate * (1 - done / steps)
            done += 1
            keys, part = bags[i]
            hidden = part @ vectors[keys]
            odds = hidden @ output + bias
            odds = np.exp(odds - odds.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            error *= weight[labels[i]] * rate
            back = output @ error
            output -= np.outer(hidden, error)
            bias -= error
            if len(keys):
                # gradient of the average, scaled so that the average itself moves by the step
                vectors[keys] -= np.outer(part / (part @ part), back)
    shares[:-1] = vectors @ (output[:, 1] - output[:, 0])
    shares[-1] = bias[1] - bias[0]
    return shares


class Scorer:
    """Scores texts with a trained array of shares."""

    def __init__(self, shares, model: Training):
        import numpy as np

        self.np, self.shares, self.model = np, shares, model
        self.forget()

    def forget(self):
        self.index, self.sums, self.sizes, self.hashes = {}, self.np.zeros(0), self.np.zeros(0), self.np.zeros(0, self.np.uint64)

    def scores(self, texts: list[bytes]):
        np = self.np
        parts = [x.split() for x in texts]
        if len(self.index) > KEPT:
            self.forget()
        new = list(set().union(*parts).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            sums, sizes, hashes = [self.sums], [self.sizes], [self.hashes]
            for a in range(0, len(new), SLICE):
                flat, offsets, own = word_features(new[a : a + SLICE], self.model)
                sums.append(np.add.reduceat(self.shares[flat], offsets[:-1]))
                sizes.append(np.diff(offsets))
                hashes.append(own)
            self.sums, self.sizes, self.hashes = np.concatenate(sums), np.concatenate(sizes), np.concatenate(hashes)
        out = np.zeros(len(texts))
        for i, words in enumerate(parts):
            rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            total, size = self.sums[rows].sum(), self.sizes[rows].sum()
            if len(rows) > 1:
                total += self.shares[pair_features(self.hashes[rows], self.model)].sum()
                size += len(rows) - 1
            out[i] = total / max(1.0, size) + self.shares[-1]
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, model: Training = Training(), label: str = "quality"):
    """Trained shares, from at most ``model.sample`` labelled documents that are not held out.

    Labels other than 0 and 1, null ids and null labels are left out. Null texts count as empty.
    """
    import numpy as np

    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    # sample rows at most, whatever the size of the tables
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(model.sample)
    chosen = stored(chosen, "training-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = stored(rows, "training-texts").coalesce(1).sortWithinPartitions("doc_id", "label", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa

        texts, known = [], []
        for batch in batches:
            texts += text_bytes(batch.column(1))
            known += batch.column(2).to_pylist()
        shares = train(texts, known, model)
        yield pa.RecordBatch.from_arrays([pa.array([shares.tobytes()], pa.binary())], names=["shares"])

    return np.frombuffer(rows.mapInArrow(run, "shares binary").first()["shares"], np.float64)


def score(
    docs: DataFrame,
    shares,
    model: Training = Training(),
    threshold: float = 0.7,
    text: str = "text",
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """``docs`` (all columns) with ``score`` and ``predicted`` (1 if score >= threshold).

    Only the text is read for the score. Null texts count as empty; an empty text has the score of
    the bias alone. Columns of ``docs`` that already have one of the two names give way.
    """
    keep = [c for c in docs.columns if c not in names]
    given = docs.sparkSession.sparkContext.broadcast(shares)  # (buckets + 1) * 8 bytes
    digest = hash(shares.tobytes())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = worker_state(("quality", digest), lambda: Scorer(given.value, model))
        for batch in batches:
            found = np.concatenate([np.zeros(0), *(scorer.scores(texts) for _, _, texts in text_slices(batch.column(len(keep)), BATCH_BYTES))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], names=[*keep, names[0]])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    scored = rows.mapInArrow(run, docs.select(*keep).schema.add(names[0], "double"))
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
