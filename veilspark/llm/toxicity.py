"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

The net is small and written in numpy. A word's embedding is the sum of the embeddings of the word and of
its beginnings, each found by hash, so that inflected and compound forms share what is known of their stem.
Filters of several widths run over all words of a text, and the greatest response of each is kept. Training
takes all labelled rows: they are dealt into shards by hash, in each round every shard trains a copy of the net where it
lies, and Spark adds up what the copies learned. Scoring is one pass of Arrow batches without a shuffle.

Thresholds are calibrated by language on all labelled rows that were not trained on. A row's language column is not
looked at when it is scored: a table of hashed words guesses the language from the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.storage import written
from veilspark.llm.words import Words, filled, mix, pieces, words_of

#: Labelled rows and bytes of text that train one copy of the net.
SHARD_ROWS, SHARD_BYTES = 4_000, 16 << 20
#: Labelled ids that are broadcast, at most; more are joined.
BROADCAST_ROWS = 2_000_000
#: Steps of a logit that thresholds are told apart by.
LOGIT_STEPS = 1_000
#: Every so many-th learned row calibrates instead; a language needs so many calibrating rows of its own.
CALIBRATE, LEAST_ROWS = 4, 60

CELLS = 1 << 15
DIM, FILTERS, WIDTHS = 16, 24, (1, 2, 3)
#: Beginnings of so many bytes are hashed besides the whole word.
BEGINNINGS = (3, 4, 5, 6, 8)
EPOCHS, BATCH, RATE = 4, 64, 0.02
#: Words that pass through the net at once.
RUN = 100_000
#: A clean text taken for toxic costs as much as so many toxic ones taken for clean, each as a part of its kind.
COST = 2.0

_MARK = np.ones(256, bool)
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_PLANES = len(BEGINNINGS) + 1


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each word (one row per word: the word, then its beginnings; 0 where it is too short) and
    the first word of each text. Words are runs of letters and digits; case is the caller's to fold."""
    words = words_of(texts)
    n = len(words.first) - 1
    if not len(words.starts):
        return np.zeros((0, _PLANES), np.int32), np.zeros(n + 1, np.int64)
    mark = _MARK[words.data]
    turn = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    inside = np.searchsorted(words.starts, turn, "right") - 1
    turn = turn[(inside >= 0) & (turn > words.starts[inside]) & (turn < words.ends[inside])]
    starts = np.sort(np.concatenate((words.starts, turn)))
    ends = np.sort(np.concatenate((words.ends, turn)))
    keep = ~mark[starts]
    starts, ends = starts[keep], ends[keep]
    bounds = np.concatenate((words.starts, [len(words.data)]))[words.first]
    first = np.searchsorted(starts, bounds)
    out = np.zeros((len(starts), _PLANES), np.int32)
    whole = Words(words.data, starts, ends, first).hashes()
    out[:, 0] = 1 + (whole % np.uint64(CELLS - 1)).astype(np.int32)
    lengths = ends - starts
    state, last = np.zeros(len(starts), np.uint64), len(words.data) - 1
    for i in range(max(BEGINNINGS)):
        state = mix(state * np.uint64(257) + words.data[np.minimum(starts + i, last)] + np.uint64(i + 1))
        if i + 1 in BEGINNINGS:
            cells = 1 + (state % np.uint64(CELLS - 1)).astype(np.int32)
            out[:, 1 + BEGINNINGS.index(i + 1)] = np.where(lengths > i, cells, 0)
    return out, first


@dataclass
class Net:
    """Weights of the net; one convolution (width, DIM, FILTERS) for each width."""

    words: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    state: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        words = draw(CELLS, DIM, scale=0.1)
        words[0] = 0
        filters = [draw(w, DIM, FILTERS, scale=1 / np.sqrt(w * DIM)) for w in WIDTHS]
        bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        out = draw(len(WIDTHS) * FILTERS, scale=0.1)
        return cls(words, filters, bias, out, np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.out_bias]

    def embed(self, cells: np.ndarray) -> np.ndarray:
        total = self.words.take(cells[:, 0], axis=0)
        for i in range(1, _PLANES):
            total += self.words.take(cells[:, i], axis=0)
        return total

    def pooled(self, cells: np.ndarray, first: np.ndarray, own: np.ndarray | None = None):
        """The greatest response (0 at least) of each filter to each text; also the responses, the rows of zeros
        and embeddings, the row of each word and the first row of each text.

        Texts are laid end to end with rows of zeros between them, so that no window sees two texts. Only
        windows that begin in the first ``own`` words of a text count.
        """
        n, gap = len(first) - 1, max(WIDTHS)
        counts = np.diff(first)
        begin = first[:-1] + gap * np.arange(n)
        rows = np.zeros((len(cells) + gap * (n + 1), DIM), np.float32)
        at = np.arange(len(cells)) + gap * np.repeat(np.arange(n), counts)
        rows[at] = self.embed(cells)
        size = len(cells) + gap * n
        shut = np.ones(size, bool)
        shut[at if own is None else at[np.arange(len(cells)) - np.repeat(first[:-1], counts) < np.repeat(own, counts)]] = False
        responses = []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            response = rows[:size] @ kernel[0]
            for j in range(1, w):
                response += rows[j : size + j] @ kernel[j]
            response += bias
            response[shut] = 0
            responses.append(response)
        best = [np.maximum(np.maximum.reduceat(r, begin, axis=0), 0) for r in responses]
        return np.concatenate(best, axis=1), responses, rows, at, begin

    def logits(self, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The net's output for each text; long texts go through it in parts of ``RUN`` words."""
        if len(first) < 2:
            return np.zeros(0)
        counts = np.diff(first)
        parts = np.maximum(1, -(-counts // RUN))
        text = np.repeat(np.arange(len(counts)), parts)
        head = np.cumsum(parts) - parts
        start = first[text] + RUN * (np.arange(len(text)) - head[text])
        stop = np.minimum(start + RUN, first[text + 1])
        upto = np.minimum(stop + max(WIDTHS) - 1, first[text + 1])  # windows may look past the part's end
        best = np.zeros((len(text), len(self.out)), np.float32)
        for a, b in _runs(upto - start):
            take = np.concatenate([np.arange(start[i], upto[i]) for i in range(a, b)])
            bounds = np.concatenate(([0], np.cumsum(upto[a:b] - start[a:b])))
            whole = (stop[a:b] == upto[a:b]).all()
            best[a:b] = self.pooled(cells[take], bounds, None if whole else (stop - start)[a:b])[0]
        return np.maximum.reduceat(best, head, axis=0) @ self.out + self.out_bias

    def step(self, cells: np.ndarray, first: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of Adam on the weighted logistic loss."""
        features, responses, rows, at, begin = self.pooled(cells, first)
        lengths = np.diff(np.append(begin, len(responses[0])))
        z = features @ self.out + self.out_bias
        pull = ((_sigmoid(z) - target) * weight / len(target)).astype(np.float32)
        grads = [np.zeros_like(p) for p in self.parameters()]
        nw = len(WIDTHS)
        grads[2 * nw][:] = features.T @ pull
        grads[2 * nw + 1][:] = pull.sum()
        back = pull[:, None] * self.out * (features > 0)
        row_of = np.full(len(rows), -1)
        row_of[at] = np.arange(len(cells))
        touched, deltas = [], []
        for k, response in enumerate(responses):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            text, unit = np.nonzero(back[:, part])
            if not len(text):
                continue
            d, p = back[:, part][text, unit], _places(response, features[:, part], begin, lengths)[text, unit]
            by_filter = np.zeros((FILTERS, len(d)), np.float32)
            by_filter[unit, np.arange(len(d))] = d
            grads[nw + k] += by_filter.sum(1)
            for j in range(WIDTHS[k]):
                grads[k][j] += (by_filter @ rows[p + j]).T
                touched.append(row_of[p + j])
                deltas.append(d[:, None] * self.filters[k][j].T[unit])
        t = self.state["t"] = self.state.get("t", 0) + 1
        for i, (p, g) in enumerate(zip(self.parameters(), grads, strict=True)):
            self._adam(i, p, g, slice(None), rate, t)
        if touched:
            row, delta = np.concatenate(touched), np.concatenate(deltas)
            inside = row >= 0
            row, delta = _summed(row[inside], delta[inside])
            used, total = _summed(cells[row].ravel(), np.repeat(delta, _PLANES, axis=0))
            total[used == 0] = 0
            self._adam("words", self.words, total, used, rate, t)

    def _adam(self, key, p: np.ndarray, g: np.ndarray, at, rate: float, t: int) -> None:
        if key not in self.state:
            self.state[key] = np.zeros_like(p), np.zeros_like(p)
        m, v = self.state[key]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        p[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(values[order], starts, axis=0)


def _places(response: np.ndarray, best: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first row of each text in which a filter reaches its greatest response; meaningless where that is 0."""
    place = np.zeros(best.shape, np.int64)
    for i, (a, n) in enumerate(zip(begin, counts, strict=True)):
        if n:
            place[i] = a + response[a : a + n].argmax(axis=0)
    return place


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


@dataclass
class Model:
    """What scoring needs: the net (None if there was nothing to learn), the language table, and per language
    the logit at which a text counts as toxic, with the common one last."""

    net: Net | None
    languages: np.ndarray  # (CELLS, number of languages): log share of each word cell
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        cells, first = encode(texts)
        if self.net is None:
            return np.zeros(len(texts))
        return _sigmoid(self.net.logits(cells, first) - self.thresholds[self.guess(cells, first)])

    def guess(self, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The place of the likeliest language of each text; the last place if it has no word."""
        n, known = len(first) - 1, self.languages.shape[1]
        if not known or not n:
            return np.full(n, known)
        total = np.zeros((n, known))
        some = np.diff(first) > 0
        if some.any():
            total[some] = np.add.reduceat(self.languages[cells[:, 0]], first[:-1][some], axis=0)
        return np.where(some, total.argmax(1), known)


def _threshold(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray | int = 1) -> float:
    """The logit that tells the rows (or so many of each kind) apart at least cost: the middle of the widest best gap."""
    order = np.argsort(logits, kind="stable")
    rows = np.broadcast_to(rows, logits.shape)[order]
    values, label = logits[order], toxic[order] * rows
    missed = np.concatenate(([0], np.cumsum(label))) / label.sum()
    false = 1 - np.concatenate(([0], np.cumsum(rows - label))) / (rows - label).sum()
    cost = missed + COST * false
    edges = np.concatenate(([values[0] - 2], values, [values[-1] + 2]))
    open_ = edges[1:] > edges[:-1]
    best = np.flatnonzero((cost <= cost[open_].min() + 1e-12) & open_)
    at = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def train(texts: pa.Array, toxic: np.ndarray, langs: list[str | None], seed: int = 11) -> Model:
    """A model from texts (case folded), labels and languages; rows of equal hash order give equal models."""
    n = len(texts)
    toxic = np.asarray(toxic, bool)
    cells, first = encode(texts)
    calibrating = np.arange(n) % CALIBRATE == CALIBRATE - 1
    names, counts = np.unique([x for x in langs if x is not None], return_counts=True)
    # Languages too rare to calibrate are left to the common threshold.
    names = [str(x) for x in names[counts >= LEAST_ROWS * CALIBRATE]]
    table = np.zeros((CELLS, len(names)))
    no = np.array([names.index(x) if x in names else -1 for x in langs], np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    for k in range(len(names)):
        seen = np.bincount(cells[no[owner] == k, 0], minlength=CELLS) + 0.1
        table[:, k] = np.log(seen / seen.sum())
    model = Model(None, table, np.zeros(len(names) + 1))
    fit = np.flatnonzero(~calibrating)
    if not toxic[fit].any() or toxic[fit].all():
        return model
    net = Net.fresh(seed)
    rng = np.random.default_rng(seed)
    # Both labels weigh the same in all.
    weight = np.where(toxic, 0.5 / toxic[fit].mean(), 0.5 / (1 - toxic[fit].mean()))
    lengths = np.diff(first)
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            row = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            upto = np.concatenate(([0], np.cumsum(lengths[part])))
            net.step(cells[row], upto, toxic[part].astype(np.float32), weight[part], RATE * (1 - step / steps))
            step += 1
    net.state = {}
    model.net = net
    logits = net.logits(cells, first)
    guess = model.guess(cells, first)
    held = calibrating if toxic[calibrating].any() and not toxic[calibrating].all() else np.ones(n, bool)
    model.thresholds[:] = _threshold(logits[held], toxic[held])
    for k in range(len(names)):
        own = held & (guess == k)
        if toxic[own].sum() >= 5 and (~toxic[own]).sum() >= 5:
            model.thresholds[k] = _threshold(logits[own], toxic[own])
    return model


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most ``RUN`` words together, or one alone."""
    upto, a = np.cumsum(lengths), 0
    while a < len(lengths):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + RUN, "right")))
        yield a, b
        a = b


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for piece in pieces(batch, limit=1 << 20):
            scores = np.round(model.scores(filled(piece)), 6)
            yield pa.record_batch(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        while batch is not None and batch.num_rows:
            shard = np.asarray(batch.column("shard"))
            if held and held[-1].column("shard")[0].as_py() != shard[0]:
                yield pa.Table.from_batches(held)
                held = []
            same = int(np.argmax(shard != shard[0])) or len(shard)
            held.append(batch.slice(0, same))
            batch = batch.slice(same)
        if batch is None and held:
            yield pa.Table.from_batches(held)


#: Rows that a shard sends: cells of the net and what was added to them, numbers that are no cell in rows below 0
#: (filters and biases, laid out in rows of ``DIM``), and counts of words by language in rows from ``CELLS`` on.
_SENT = "cell bigint, " + ", ".join(f"d{i} double" for i in range(DIM))


def _sent(cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(cells.astype(np.int64)), *(pa.array(rows[:, i].astype(np.float64)) for i in range(DIM))],
                           ["cell", *(f"d{i}" for i in range(DIM))])


def _flat(net: Net) -> np.ndarray:
    whole = np.concatenate([p.ravel() for p in net.parameters()])
    return np.pad(whole, (0, -len(whole) % DIM)).reshape(-1, DIM)


def _learned(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """What each shard adds to the net in one pass over its rows; in the first round also its words by language."""
    given, names, balance, seed, turn = shared.value
    for table in _shards(batches):
        cells, first = encode(filled(table))
        toxic = np.asarray(table.column("toxic")) == 1
        fit = np.flatnonzero(~np.asarray(table.column("calibrating")))
        if turn == 0:
            langs = table.column("lang").to_pylist()
            no = np.array([names.index(x) if x in names else -1 for x in langs], np.int64)
            owner = np.repeat(no, np.diff(first))
            for k in range(len(names)):
                seen = np.bincount(cells[owner == k, 0], minlength=CELLS)
                some = np.flatnonzero(seen)
                yield _sent(CELLS * (k + 1) + some, np.pad(seen[some, None], ((0, 0), (0, DIM - 1))))
        if given is None or not len(fit):
            continue
        net = Net(given.words.copy(), *([p.copy() for p in x] for x in (given.filters, given.bias)), given.out.copy(), given.out_bias.copy())
        order = np.random.default_rng([seed, turn, int(table.column("shard")[0].as_py())]).permutation(fit)
        weight, lengths, steps = np.where(toxic, balance[1], balance[0]), np.diff(first), -(-len(fit) // BATCH)
        for step in range(steps):
            part = order[step * BATCH : (step + 1) * BATCH]
            row = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            upto = np.concatenate(([0], np.cumsum(lengths[part])))
            rate = RATE * (1 - (turn * steps + step) / (EPOCHS * steps))
            net.step(cells[row], upto, toxic[part].astype(np.float32), weight[part], rate)
        added = net.words - given.words
        touched = np.flatnonzero(added.any(axis=1))
        yield _sent(touched, added[touched])
        flat = _flat(net) - _flat(given)
        yield _sent(-1 - np.arange(len(flat)), flat)


def _merged(net: Net, cells: np.ndarray, rows: np.ndarray) -> None:
    """Add to the net what its copies learned on average."""
    word = (cells >= 0) & (cells < CELLS)
    net.words[cells[word]] += rows[word].astype(np.float32)
    flat = np.zeros_like(_flat(net), np.float64)
    other = cells < 0
    flat[-1 - cells[other]] = rows[other]
    at = 0
    for p in net.parameters():
        p += flat.ravel()[at : at + p.size].reshape(p.shape).astype(np.float32)
        at += p.size


def _logits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for piece in pieces(batch, limit=1 << 20):
            cells, first = encode(filled(piece))
            step = np.round(model.net.logits(cells, first) * LOGIT_STEPS).astype(np.int64)
            columns = [pa.array(model.guess(cells, first).astype(np.int32)), piece.column("toxic"), pa.array(step)]
            yield pa.record_batch(columns, ["guess", "toxic", "step"])


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows (doc_id, text, lang) with a label 0 or 1, once each, as a table (shard, row, text, lang, toxic, calibrating).

    An id with several labels counts as toxic if one is. The rows of a shard lie together, in the order of ``row``.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "known")
    if known.count() <= BROADCAST_ROWS:  # texts without a label then stay where they are
        known = F.broadcast(known)
    keyed = rows.select("*", F.xxhash64("doc_id", "text").alias("row"), F.octet_length("text").alias("size"))
    n, size = keyed.select("doc_id", "size").join(known, "doc_id").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    found = keyed.drop("size").join(known, "doc_id")
    shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    once = dealt.groupBy("shard", "row").agg(*(F.max(c).alias(c) for c in ("text", "lang", "toxic")))
    calibrating = F.pmod(F.xxhash64("row", F.lit("calibrate")), F.lit(CALIBRATE)) == CALIBRATE - 1
    return written(once.withColumn("calibrating", calibrating).sortWithinPartitions("shard", "row"), "labelled")


def toxicity_model(rows: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """A model from all rows (doc_id, text, lang), case folded, that have a label (doc_id, toxic) of 0 or 1.

    Each round starts all shards from one net and adds to every word what the shards that have it learned on average.
    The driver gets the net, the words of a language by cell and the logits by step, whatever the tables hold.
    """
    table, context = labelled_rows(rows, labels), rows.sparkSession.sparkContext
    langs = table.where("lang IS NOT NULL").groupBy("lang").count().where(F.col("count") >= LEAST_ROWS * CALIBRATE)
    # Languages too rare to calibrate are left to the common threshold.
    names = sorted(r.lang for r in langs.collect())
    kinds = {(r.calibrating, r.toxic): r["count"] for r in table.groupBy("calibrating", "toxic").count().collect()}
    fit = [kinds.get((False, k), 0) for k in (0, 1)]
    net = Net.fresh(seed) if all(fit) else None
    # Both labels weigh the same in all.
    balance = [0.5 * sum(fit) / n if n else 0.0 for n in fit]
    seen = np.full((CELLS, len(names)), 0.1)
    for turn in range(EPOCHS if net is not None else 1):
        shared = context.broadcast((net, names, balance, seed, turn))
        # The others count in the words of their language only, which the first round sends.
        taught = table if turn == 0 else table.where("NOT calibrating")
        sent = taught.mapInArrow(lambda b, shared=shared: _learned(b, shared), _SENT).groupBy("cell")
        sums = sent.agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM)), F.count(F.lit(1)).alias("n")).toArrow()
        shared.unpersist()
        cells = np.asarray(sums.column("cell"), np.int64)
        total = np.stack([np.asarray(sums.column(f"d{i}"), np.float64) for i in range(DIM)], axis=1)
        word = cells >= CELLS
        seen[cells[word] % CELLS, cells[word] // CELLS - 1] += total[word, 0]
        if net is not None:
            _merged(net, cells[~word], (total / np.asarray(sums.column("n"))[:, None])[~word])
    model = Model(net, np.log(seen / seen.sum(axis=0)), np.zeros(len(names) + 1))
    if net is None:
        return model
    held = table.where("calibrating") if all(kinds.get((True, k), 0) for k in (0, 1)) else table
    shared = context.broadcast(model)
    steps = held.select("text", "toxic").mapInArrow(lambda b: _logits(b, shared), "guess int, toxic int, step bigint")
    steps = steps.groupBy("guess", "toxic", "step").count().toArrow()
    shared.unpersist()
    guess, toxic, step, count = (np.asarray(steps.column(c), np.int64) for c in ("guess", "toxic", "step", "count"))
    model.thresholds[:] = _threshold(step / LOGIT_STEPS, toxic, count)
    for k in range(len(names)):
        own = guess == k
        if all(count[own & (toxic == label)].sum() >= 5 for label in (0, 1)):
            model.thresholds[k] = _threshold(step[own] / LOGIT_STEPS, toxic[own], count[own])
    return model


def _sample(rows: DataFrame, labels: DataFrame, labelled: dict[int, int], learn_bytes: int) -> DataFrame:
    """Of each label the ids with the smallest hash, so many at most, and of those in hash order the rows whose
    texts fit in ``learn_bytes``; as labels that leave the others out."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in labelled.items()]
    sample = some[0].unionByName(some[1])
    sizes = rows.select("doc_id", F.octet_length("text").alias("size")).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.orderBy(order, "doc_id"))
    return sizes.where(F.col("size") <= learn_bytes).withColumn("upto", upto).where(F.col("upto") <= learn_bytes).select("doc_id", "toxic")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    label: str = "toxic",
    seed: int = 11,
    labelled: dict[int, int] | None = None,
    learn_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns from the labels of rows that are not ``held_out`` (null counts as not) and scores every text, whole,
    from the text alone: label, language and id are not looked at. The score is the logistic of the net's
    output less the threshold of the guessed language, so 0.5 is the point calibrated for that language. A null
    text counts as empty; empty texts get the score of a text without words. Without learned rows of both labels
    all scores are 0. Equal texts have equal scores, up to rounding in the last of six digits. All labelled rows are
    learned from, unless the caller bounds them by ``labelled`` (ids of each label) and ``learn_bytes``.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    learned = rows.where("NOT held_out").drop("held_out")
    model = toxicity_model(learned, known if labelled is None else _sample(learned, known, labelled, learn_bytes), seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        lambda b: _scored(b, shared), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
