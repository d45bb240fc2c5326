"""A gated recurrent language model of words, trained on a corpus, and log-likelihoods of whole documents.

Outcomes are factored into classes. The ``HEAD`` most frequent words have
classes of ``WIDTH`` words with a softmax of their own; the end of a document is
a class; every other word belongs to a tail class by its last byte, and within
it has the share (count + 0.5) / (the class's counts + 0.5 a word), one share of
0.5 being left for words that never occurred. So all outcomes' probabilities
add up to 1, and the network needs no table that grows with the vocabulary.

Training is truncated backpropagation in numpy: ``LANES`` streams side by side,
``STEPS`` tokens a window, the state carried from window to window and cleared
at a document's end. Every training document is used once. Rounds take 1/8, 1/8,
1/4 and 1/2 of them; in a round each partition goes on from the common weights,
and the results are averaged by their tokens, block by block, in Spark.

A document's score is worked out over its whole length with the state carried
through all its windows. Words too rare for the broadcast table of counts are
looked up by a join.

Defined cases: a null or empty text is its end alone; a null doc_id is learned
from; repeated rows are learned and scored each; with no training documents
every word is unknown and the model is what it starts from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.staging import staged
from tagtide.llm.words import KeyTable, ragged, slices

HEAD, WIDTH, TAILS = 1024, 32, 32
HIDDEN, LANES, STEPS = 16, 512, 32
END = HEAD + TAILS  # tokens: head words, tail classes, the end
CLASSES = HEAD // WIDTH + TAILS + 1
#: Words whose counts are broadcast (16 bytes each); the rest are joined.
COMMON = 1 << 18
ROUNDS = ((0, 1, 0.03), (1, 2, 0.025), (2, 4, 0.02), (4, 8, 0.01))  # eighths of the documents, and the step's size
POOL = 1 << 20  # tokens dealt to lanes at once
BLOCK = 4096
_CLASS = np.concatenate([np.arange(HEAD) // WIDTH, HEAD // WIDTH + np.arange(TAILS + 1)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _keys(words) -> np.ndarray:
    """Keys whose last 5 bits are the word's tail class."""
    tail = (words.data[words.ends - 1] >> 3).astype(np.uint64) if len(words.ends) else np.zeros(0, np.uint64)
    return (words.keys & ~np.uint64(31)) | tail


def word_counts(docs: DataFrame) -> DataFrame:
    """key and n over all words of all texts; the null key counts the documents' ends."""

    def count(batches):
        table, totals, ends = KeyTable(1 << 16), np.zeros(1 << 16, np.int64), 0

        def made():
            keys = np.zeros(table.n + 1, np.uint64)
            full = table.keys != 0
            keys[table.numbers[full]] = table.keys[full]
            last = np.arange(len(keys)) == table.n
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64), mask=last), pa.array(np.append(totals[: table.n], ends))], ["key", "n"])

        for batch in batches:
            for first, stop, words in slices(batch.column(0), lower=True):
                keys, n = np.unique(_keys(words), return_counts=True)
                at = table.find(keys)
                table.add(keys[at < 0])
                at = table.find(keys)
                if table.n > len(totals):
                    totals = np.concatenate([totals, np.zeros(table.n, np.int64)])
                totals[at] += n
                ends += stop - first
                if table.n > 2_000_000:
                    yield made()
                    table, totals, ends = KeyTable(1 << 16), np.zeros(1 << 16, np.int64), 0
        if ends:
            yield made()

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "key long, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the common words, the head among them, and the tails' totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, tails: np.ndarray):
        order = np.lexsort((keys, -counts))
        self.keys, self.counts, self.ends = keys[order], counts[order], ends
        self.tails = tails.copy()  # of all words: sum of count + 0.5 by tail class, and 0.5 for the unknown one
        head = self.keys[:HEAD]
        np.subtract.at(self.tails, (head & np.uint64(31)).astype(int), self.counts[:HEAD] + 0.5)

    def tables(self):
        table = KeyTable(1 << 12)
        table.add(self.keys)
        token = np.concatenate([np.arange(min(HEAD, len(self.keys))), HEAD + (self.keys[HEAD:] & np.uint64(31)).astype(int)])
        return table, token.astype(np.int32)

    def start(self) -> dict[str, np.ndarray]:
        """Weights that give every outcome its plain share."""
        rng = np.random.default_rng(7)
        head = np.full(HEAD, 0.5)
        head[: min(HEAD, len(self.counts))] += self.counts[:HEAD]
        masses = np.concatenate([head.reshape(-1, WIDTH).sum(1), np.maximum(self.tails, 0.5), [self.ends + 0.5]])
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return {
            "into": normal(END + 1, 3 * HIDDEN, scale=0.3),
            "back": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "bias": np.concatenate([np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32),
            "classes": normal(HIDDEN, CLASSES, scale=0.05),
            "class_bias": np.log(masses / masses.sum()).astype(np.float32),
            "words": normal(HEAD // WIDTH, HIDDEN, WIDTH, scale=0.05),
            "word_bias": np.log(head.reshape(-1, WIDTH) / head.reshape(-1, WIDTH).sum(1, keepdims=True)).astype(np.float32),
        }


def learned_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """(vocabulary, all tokens, distinct tokens) from word_counts."""
    words = counts.where("key IS NOT NULL")
    level = F.floor(F.log2("n") * 16).cast("int")
    tail = F.col("key").bitwiseAND(31).cast("int")
    # At most some 16 * 64 levels and 32 tail classes, whatever the corpus.
    sizes = words.groupBy(level.alias("level"), tail.alias("tail")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    ends = counts.where("key IS NULL").agg(F.sum("n")).first()[0] or 0
    tails, by_level = np.full(TAILS, 0.5), {}
    for row in sizes:
        tails[row["tail"]] += row["n"] + 0.5 * row["words"]
        by_level[row["level"]] = by_level.get(row["level"], 0) + row["words"]
    least, taken = None, 0
    for at in sorted(by_level, reverse=True):
        if taken + by_level[at] > COMMON:
            break
        taken, least = taken + by_level[at], at
    if least is None:
        keys = n = np.zeros(0, np.int64)
    else:
        common = words.where(level >= least).toPandas()
        keys, n = common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    total = sum(row["n"] for row in sizes) + ends
    distinct = sum(row["words"] for row in sizes) + (ends > 0)
    return Vocabulary(keys.view(np.uint64), n, ends, tails), total, distinct


def _softmax(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their sums, logarithms of the chosen shares); overwrites x."""
    x -= x.max(axis=1, keepdims=True)
    picked = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    sums = x.sum(axis=1)
    return x, sums, picked - np.log(sums)


def _gates(w: dict, token: np.ndarray, h: np.ndarray):
    a = w["into"][token]
    b = h @ w["back"] + w["bias"]
    zr = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])))
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    own = b[:, 2 * HIDDEN :]
    new = np.tanh(a[:, 2 * HIDDEN :] + r * own)
    out = new + z * (h - new)
    out[token == END] = 0
    return out, z, r, own, new


def _by_class(kind: np.ndarray):
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(HEAD // WIDTH + 1))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def log_probabilities(w: dict, h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Natural logarithms of each token's probability from the state before it (a tail word's: of its class)."""
    kind = _CLASS[token]
    out = _softmax(h @ w["classes"] + w["class_bias"], kind)[2].astype(np.float64)
    for k, at in _by_class(kind):
        out[at] += _softmax(h[at] @ w["words"][k] + w["word_bias"][k], token[at] % WIDTH)[2]
    return out


def window_gradient(w: dict, tokens: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss over a window (steps, lanes), the state behind it, and the loss."""
    steps, lanes = tokens.shape
    n = steps * lanes
    states, saved = np.empty((steps, lanes, HIDDEN), np.float32), []
    for t in range(steps):
        states[t] = h
        h, *rest = _gates(w, tokens[t], h)
        saved.append(rest)
    flat, token = states.reshape(n, HIDDEN), tokens.reshape(n)
    kind = _CLASS[token]
    d, sums, logs = _softmax(flat @ w["classes"] + w["class_bias"], kind)
    loss = -logs.sum()
    d /= sums[:, None]
    d[np.arange(n), kind] -= 1
    g = {"classes": flat.T @ d, "class_bias": d.sum(0), "words": np.zeros_like(w["words"]), "word_bias": np.zeros_like(w["word_bias"])}
    dh_all = d @ w["classes"].T
    for k, at in _by_class(kind):
        own = flat[at]
        d, sums, logs = _softmax(own @ w["words"][k] + w["word_bias"][k], token[at] % WIDTH)
        loss -= logs.sum()
        d /= sums[:, None]
        d[np.arange(len(at)), token[at] % WIDTH] -= 1
        g["words"][k], g["word_bias"][k] = own.T @ d, d.sum(0)
        dh_all[at] += d @ w["words"][k].T
    dh_all = dh_all.reshape(steps, lanes, HIDDEN)
    g["back"], g["bias"] = np.zeros_like(w["back"]), np.zeros_like(w["bias"])
    into = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    dh = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, own, new = saved[t]
        before = states[t]
        dh[tokens[t] == END] = 0
        d_new = dh * (1 - z) * (1 - new * new)
        da = into[t]
        da[:, :HIDDEN] = dh * (before - new) * z * (1 - z)
        da[:, HIDDEN : 2 * HIDDEN] = d_new * own * r * (1 - r)
        da[:, 2 * HIDDEN :] = d_new
        db = da.copy()
        db[:, 2 * HIDDEN :] *= r
        g["back"] += before.T @ db
        g["bias"] += db.sum(0)
        dh = dh * z + db @ w["back"].T + dh_all[t]
    order = np.argsort(token, kind="stable")
    which, first = np.unique(token[order], return_index=True)
    g["into"] = np.zeros_like(w["into"])
    g["into"][which] = np.add.reduceat(into.reshape(n, -1)[order], first, axis=0)
    for x in g.values():
        x /= n
    return g, h, float(loss) / n


class Adam:
    def __init__(self, w: dict, step: float):
        self.w, self.step, self.t = w, step, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def move(self, g: dict) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(np.vdot(x, x) for x in g.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.step * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, x in g.items():
            x *= scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.w[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _token_texts(column, table: KeyTable, token: np.ndarray):
    """(first row, last row, tokens with ends, bounds, keys of words, their numbers in the table, words' bounds)."""
    for first, stop, words in slices(column, lower=True):
        keys = _keys(words)
        at = table.find(keys)
        own = np.where(at >= 0, token[np.maximum(at, 0)] if len(token) else 0, HEAD + (keys & np.uint64(31)).astype(np.int32)).astype(np.int32)
        yield first, stop, np.insert(own, words.bounds[1:], END), words.bounds + np.arange(stop - first + 1), keys, at, words.bounds


def train_stream(w: dict, pools, step: float) -> int:
    """Trains in place on pools of token streams; returns the number of tokens."""
    adam, total = Adam(w, step), 0
    for stream in pools:
        lanes = min(LANES, max(1, len(stream) // STEPS))
        length = len(stream) // lanes
        total += len(stream)
        h = np.zeros((lanes, HIDDEN), np.float32)
        grid = stream[: lanes * length].reshape(lanes, length).T
        for t in range(0, length, STEPS):
            g, h, _ = window_gradient(w, np.ascontiguousarray(grid[t : t + STEPS]), h)
            adam.move(g)
        rest = stream[lanes * length :]  # fewer than there are lanes
        if len(rest):
            g, _, _ = window_gradient(w, rest.reshape(-1, 1), np.zeros((1, HIDDEN), np.float32))
            adam.move({k: x * (len(rest) / (STEPS * LANES)) for k, x in g.items()})
    return total


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def trained(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after the rounds; ``docs`` are the training documents."""
    w = vocabulary.start()
    spark = docs.sparkSession
    n_blocks = -(-_flat(w).size // BLOCK)
    eighth = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for low, high, step in ROUNDS:
        shared = spark.sparkContext.broadcast((w, vocabulary.keys[:HEAD]))

        def train(batches, shared=shared, step=step):
            start, head = shared.value
            own = {k: v.copy() for k, v in start.items()}
            table = KeyTable()
            table.add(head)
            token = np.arange(len(head), dtype=np.int32)

            def pools():
                held, n = [], 0
                for batch in batches:
                    for _, _, tokens, *_ in _token_texts(batch.column(0), table, token):
                        held.append(tokens)
                        n += len(tokens)
                        if n >= POOL:
                            yield np.concatenate(held)
                            held, n = [], 0
                if held:
                    yield np.concatenate(held)

            weight = train_stream(own, pools(), step)
            if weight:
                flat = _flat(own)
                blocks = [flat[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in range(n_blocks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n_blocks, dtype=np.int32)), pa.array(np.full(n_blocks, float(weight))), pa.array(blocks, pa.binary())],
                    ["block", "weight", "data"])

        def average(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for block, weight, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total = sums.setdefault(block, [0.0, 0.0])
                    total[0] += weight
                    total[1] = total[1] + weight * np.frombuffer(data, np.float32).astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.int32()), pa.array([t[0] for t in sums.values()]),
                     pa.array([(t[1] / t[0]).astype(np.float32).tobytes() for t in sums.values()], pa.binary())],
                    ["block", "weight", "data"])

        schema = "block int, weight double, data binary"
        some = docs.where(eighth.between(low, high - 1)).select(F.col("text").cast("binary").alias("text"))
        parts = some.mapInArrow(train, schema)
        found = parts.repartition(n_blocks, "block").mapInArrow(average, schema).collect()  # the size of one model
        if found:
            w = _shaped(np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(found, key=lambda r: r["block"])]), w)
    return w


def score_pool(w: dict, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of log_probabilities of each whole text of a pool, natural logarithms."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    loads, lane_of = np.zeros(LANES, np.int64), np.empty(len(sizes), np.int64)
    for k in order.tolist():  # the longest first, each to the lane with the least so far
        lane = int(loads.argmin())
        lane_of[k] = lane
        loads[lane] += sizes[k]
    rank = np.argsort(-loads, kind="stable")  # busy lanes first, so lanes that still run are a prefix
    place = np.empty(LANES, np.int64)
    place[rank] = np.arange(LANES)
    loads = loads[rank]
    docs = np.lexsort((np.arange(len(sizes)), place[lane_of]))
    stream = tokens[ragged(bounds[docs], sizes[docs])]  # lane after lane
    owner = np.repeat(docs, sizes[docs])
    begins = np.cumsum(loads) - loads
    out, h = np.zeros(len(sizes)), np.zeros((LANES, HIDDEN), np.float32)
    states, at, waiting = [], [], 0
    for t in range(int(loads[0])):
        active = int(np.searchsorted(-loads, -t, "left"))  # lanes with more than t tokens
        h = h[:active]
        now = begins[:active] + t
        states.append(h)
        at.append(now)
        h = _gates(w, stream[now], h)[0]
        waiting += active
        if waiting >= LANES * STEPS or t + 1 == loads[0]:
            places = np.concatenate(at)
            out += np.bincount(owner[places], log_probabilities(w, np.concatenate(states), stream[places]), len(sizes))
            states, at, waiting = [], [], 0
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents that are not held out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    training = docs.where("NOT held_out")
    counts = staged(word_counts(training), "counts")
    vocabulary, total, distinct = learned_vocabulary(counts)
    weights = trained(training, vocabulary)
    shared = spark.sparkContext.broadcast((weights, vocabulary))
    ln10 = float(np.log(10))

    def score(batches):
        w, known = shared.value
        table, token = known.tables()
        logs = np.log10(known.counts + 0.5)
        shares = np.log10(np.maximum(known.tails, 0.5))
        end = float(np.log10(known.ends + 0.5))
        held: list = []
        names = ["part", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"]

        def made():
            sizes = np.concatenate([np.diff(b) for _, b, _ in held])
            scores = score_pool(w, np.concatenate([t for t, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]))
            known_n, base, tail, rare, times = (sum((list(x[k]) for _, _, x in held), []) for k in (2, 3, 4, 5, 6))
            ids, out = sum((x[0] for _, _, x in held), []), sum((x[1] for _, _, x in held), [])
            n = len(ids)
            made.row += n
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, made.part, np.int32)), pa.array(np.arange(made.row - n, made.row)), pa.array(ids, pa.int64()),
                 pa.array(out, pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(scores / ln10 + np.array(tail)), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names)

        from pyspark import TaskContext

        made.part, made.row = TaskContext.get().partitionId(), 0
        pooled = 0
        for batch in batches:
            for first, stop, tokens, bounds, keys, at, word_bounds in _token_texts(batch.column(1), table, token):
                doc = np.repeat(np.arange(stop - first), np.diff(word_bounds))
                there = at >= 0
                n = stop - first
                value = np.where(there, logs[np.maximum(at, 0)] if len(logs) else 0.0, 0.0)
                known_n = np.bincount(doc, there, n).astype(np.int64) + (known.ends > 0)
                base = np.bincount(doc, value, n) + end
                in_tail = ~(there & (at < HEAD))
                tail = np.bincount(doc, np.where(in_tail, value - shares[(keys & np.uint64(31)).astype(int)], 0.0), n)
                lost = np.flatnonzero(~there)
                pairs, again = np.unique(np.stack([doc[lost].astype(np.uint64), keys[lost]], 1), axis=0, return_counts=True) if len(lost) else (
                    np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                cut = np.searchsorted(pairs[:, 0], np.arange(1, n).astype(np.uint64))
                rows = slice(first, stop)
                held.append((tokens, bounds, (
                    batch.column(0)[rows].to_pylist(), batch.column(2)[rows].to_pylist(), known_n, base, tail,
                    np.split(np.ascontiguousarray(pairs[:, 1]).view(np.int64), cut), np.split(again, cut))))
                pooled += len(tokens)
                if pooled >= POOL:
                    yield made()
                    held, pooled = [], 0
        if held:
            yield made()

    rows = staged(
        docs.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(
            score, "part int, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
            "rare array<long>, times array<long>"), "scores")
    lost = rows.select("part", "row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("part", "row", F.col("x.rare").alias("key"), "x.times")
    found = lost.join(counts.where("key IS NOT NULL"), "key", "left").groupBy("part", "row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"))
    rest, spread = F.coalesce("logs", F.lit(0.0)), float(np.log10(total + 0.5 * (distinct + 1)))
    return rows.drop("rare", "times").join(found, ["part", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + rest - F.col("n_tokens") * spread).alias("base_score"),
        (F.col("score") + rest).alias("score"))
