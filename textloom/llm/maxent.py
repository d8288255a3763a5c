"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

Tokens are lower-cased words and one end a document.  A token belongs to one of 16
classes and one of 16 buckets of its class, by a hash of its last bytes; the end has
a bucket of its own.  The model is

    P(token | history) = P(class | history) P(bucket | class, history) P(token | bucket, word before)

The first two factors are softmaxes over sums of hashed feature weights: the word
before, the word before that (a skip), both together, and their buckets.  The last
has a parameter for each pair of words of the training texts, however many there are;
its maximum under a Dirichlet prior has a closed form and needs no gradient:

    P(token | bucket, before) = (n(before, token) + PRIOR P(token | bucket)) / (n(before, bucket) + PRIOR)

P(token | bucket) is the token's add-half share of its bucket's training tokens; tokens
that aren't in the head share equally what those in it leave, and one unknown place is
among them.  So the probabilities after each history sum to one.

**Pairs** grow with the corpus and stay in Spark: each text sends its pairs to shards by
hash of the word before and the bucket, which count them over all training texts and
return a sum of logarithms for each text.  A training text is scored without its own
pairs.  The ``TOP`` most frequent words would make shards hot: pairs of two of them are
counted in a table of a fixed size instead, and so are their buckets, so that their
other pairs are dealt by the whole pair.

**Training.** Tasks run minibatch gradient steps (AdaGrad) over their part of all
training documents and give their weights, which are averaged by visits; the next
round starts from the average.  Weights have a fixed size, and averages are taken
over bounded groups, level by level, so nothing grows with the number of tasks.

**Counts.** All training tokens are counted by Spark.  The most frequent ones (at most
``HEAD``) go to all tasks.  The rest are rare, so no key is hot: documents'
occurrences of them are joined with the table of counts.

Averages depend on how the texts are dealt to tasks, so scores agree between clusters
only about as well as two runs of stochastic gradient steps do.

Defined cases: a null or empty text is its end alone; a null id is in training and
repeated rows are scored alike; with no training tokens all scores come from the
unknown shares; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts
from . import spark as sp
from . import text as tx

CLASSES, BUCKETS = 16, 16
ROWS_1, ROWS_2 = 1 << 15, 1 << 16
FEATURES = 4
HEAD, TOP = 1 << 18, 1 << 10
PRIOR, GRID = 6.0, 4096.0
BLOCK = 512
BATCH = 1 << 14
RATE = 0.4
END = np.uint64(0)  # key of the end: bucket 0, which no word has
_SALTS = tx.mix64(np.arange(100, 108))


class Sequence:
    """Tokens of a chunk: key (its low byte is the bucket), document, and the two keys before."""

    def __init__(self, chunk: tx.Chunk):
        chunk = chunk.lower()
        w = tx.words(chunk)
        key = tx.hashes(chunk.buf, w.start, w.end)
        tail = tx.hashes(chunk.buf, np.maximum(w.start, w.end - 3), w.end)
        bucket = (tail >> np.uint64(40)) % np.uint64(CLASSES * BUCKETS - 1) + np.uint64(1)
        key = (key & ~np.uint64(255)) | bucket
        self.key = np.insert(key, w.first[1:], END)
        self.first = w.first + np.arange(len(w.first))
        n = len(self.key)
        at_start = np.zeros(n, bool)
        at_start[self.first[:-1]] = True
        start = np.uint64(0x5851F42D4C957F00)
        self.one, self.two = np.full(n, start), np.full(n, start)
        self.one[1:] = np.where(at_start[1:], start, self.key[:-1])
        self.two[1:] = np.where(at_start[1:], start, self.one[:-1])

    def inputs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of features for the class and for the bucket (columns: features), class and bucket."""
        one, two = self.one, self.two
        low = np.uint64(255)
        raw = [tx.mix64(one ^ _SALTS[0]), tx.mix64(two ^ _SALTS[1]), tx.mix64(one ^ tx.mix64(two ^ _SALTS[2])), tx.mix64((one & low) << np.uint64(8) | (two & low) ^ _SALTS[3])]
        bucket = (self.key & low).astype(np.int64)
        group = bucket // BUCKETS
        first = np.stack([(r >> np.uint64(49)).astype(np.uint16) for r in raw])
        spread = tx.mix64(np.arange(CLASSES) + 1000)[group]
        second = np.stack([((r ^ spread) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16) for r in raw])
        return first, second, group, bucket % BUCKETS


def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax of the summed weights of each column of ``rows``; sums are held within +-60, where float32 neither overflows nor is 0."""
    z = weights.take(rows[0], 0)
    part = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, 0, part, "clip")
    np.clip(z, -60, 60, z)
    np.exp(z, z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


#: Rows of a key that are added one by one for all keys at once; what keys have beyond them is added key by key.
AT_ONCE = 16


def sums_by(key: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, those with most rows first; the sum of each one's rows of g (entry i of the keys belongs to row i modulo g's length), and how many it has."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    by = np.argsort(-size, kind="stable")
    begin, size = begin[by], size[by]
    order %= len(g)
    total = g.take(order[begin], 0)
    more = len(size) - np.searchsorted(size[::-1], np.arange(AT_ONCE + 1), "right")  # keys with more than so many rows: the first ones
    for k in range(1, AT_ONCE):
        if more[k]:
            total[: more[k]] += g.take(order[begin[: more[k]] + k], 0)
    if m := more[AT_ONCE]:
        left = size[:m] - AT_ONCE
        total[:m] += np.add.reduceat(g.take(order[tx.expand(begin[:m] + AT_ONCE, left)], 0), np.cumsum(left) - left, axis=0)
    return ordered[begin], total, size


class Learner:
    def __init__(self, weights: list[np.ndarray], rate: float = RATE):
        self.weights = [w.copy() for w in weights]
        self.square = [np.full(len(w), 1.0, np.float32) for w in weights]
        self.visits = [np.zeros(len(w), np.float32) for w in weights]
        self.rate = rate

    def learn(self, seq: Sequence) -> None:
        first, second, group, bucket = seq.inputs()
        for k in range(0, len(group), BATCH):
            for table, rows, target in ((0, first[:, k : k + BATCH], group[k : k + BATCH]), (1, second[:, k : k + BATCH], bucket[k : k + BATCH])):
                self.step(table, rows, target)

    def step(self, table: int, rows: np.ndarray, target: np.ndarray) -> None:
        weights, square = self.weights[table], self.square[table]
        g = softmax(weights, rows)
        g[np.arange(len(target)), target] -= 1
        at, total, size = sums_by(rows.reshape(-1), g)
        grown = square[at] + np.einsum("ij,ij->i", total, total)
        square[at] = grown
        total *= (self.rate / np.sqrt(grown))[:, None]
        weights[at] = weights.take(at, 0) - total
        self.visits[table][at] += size


PARTS = "part int, block int, weights binary, visits binary"


def _blocks(weights: list[np.ndarray], visits: list[np.ndarray]):
    """Blocks of both tables' rows, with weights times visits."""
    w, v = np.concatenate(weights), np.concatenate(visits)
    for b in range(len(v) // BLOCK):
        own = v[b * BLOCK : (b + 1) * BLOCK]
        if own.any():
            yield b, w[b * BLOCK : (b + 1) * BLOCK].astype(np.float16).tobytes(), own.tobytes()


def _average(blocks: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    total, visits = np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK)
    for w, v in blocks:
        v = np.frombuffer(v, np.float32)
        total += np.frombuffer(w, np.float16).reshape(BLOCK, CLASSES) * v[:, None].astype(np.float64)
        visits += v
    return (total / np.maximum(visits, 1)[:, None]).astype(np.float16).tobytes(), visits.astype(np.float32).tobytes()


def _merge(table: pa.Table) -> pa.Table:
    w, v = _average(list(zip(table["weights"].to_pylist(), table["visits"].to_pylist())))
    return pa.table({"part": table["part"][:1].cast(pa.int32()), "block": table["block"][:1], "weights": [w], "visits": [v]})


def train_round(docs: DataFrame, weights: list[np.ndarray], group: int = 32) -> list[np.ndarray]:
    """One pass of gradient steps over all texts from the given weights; the average of what the tasks reached."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed size

    def run(batches):
        learner = Learner(held.value)
        seen = False
        for _, chunk in tx.chunks(batches, "text"):
            learner.learn(Sequence(chunk))
            seen = True
        if seen:
            part = TaskContext.get().partitionId()
            for b, w, v in _blocks(learner.weights, learner.visits):
                yield sp.batch(PARTS, [part], [b], [w], [v])

    parts = sp.written(sp.arrow_map(docs.select("text"), run, PARTS), "weights")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # bounded groups, level by level
        parts = parts.withColumn("part", F.floor(F.col("part") / group).cast("int")).groupBy("part", "block").applyInArrow(_merge, PARTS)
        n = -(-n // group)
        if n == 1:
            break
        parts = sp.written(parts, "weights")
    new = np.concatenate(weights)
    for r in parts.select("block", "weights").collect():  # as many blocks as the tables have
        new[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float16).reshape(BLOCK, CLASSES)
    return [new[:ROWS_1], new[ROWS_1:]]


def count_tokens(docs: DataFrame, docs_a_shard: int = 16_000) -> DataFrame:
    """How often each token is in all texts: key, n."""
    return counts.count(docs, lambda chunk: Sequence(chunk).key, max(16, docs.count() // docs_a_shard), counts.ROWS, counts.rows)


class Shares:
    """P(token | bucket): the head's tokens in order of their keys, and of each bucket what another token has."""

    def __init__(self, key: np.ndarray, n: np.ndarray, bucket_n: np.ndarray, bucket_types: np.ndarray):
        order = np.argsort(key)
        self.key, self.n = key[order], n[order]
        self.padded = np.append(self.key, np.uint64(2**64 - 1))
        self.begin = np.searchsorted(self.key, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)  # of the keys with each upper 18 bits
        room = bucket_n + 0.5 * (bucket_types + 1)
        of = (self.key & np.uint64(255)).astype(np.int64)
        size = CLASSES * BUCKETS
        head_n, head_types = np.bincount(of, self.n, size), np.bincount(of, minlength=size)
        left = room - head_n - 0.5 * head_types
        self.log = np.log10((self.n + 0.5) / room[of])
        self.other = np.log10(left / (bucket_types - head_types + 1) / room)
        top = np.argsort(-self.n, kind="stable")[:TOP]
        self.top = np.full(len(self.key) + 1, -1)  # number of a head token among the TOP
        self.top[top] = np.arange(len(top))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each token in the head, or -1."""
        at = self.begin[(key >> np.uint64(46)).astype(np.int64)].astype(np.int64)
        below = np.flatnonzero(self.padded[at] < key)
        while len(below):
            at[below] += 1
            below = below[self.padded[at[below]] < key[below]]
        return np.where((self.padded[at] == key) & (at < len(self.key)), at, -1)

    def logs(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(token | bucket), on the grid on which the shards are sent it."""
        other = self.other[(key & np.uint64(255)).astype(np.int64)]
        exact = np.where(at >= 0, self.log[at], other) if len(self.key) else other
        return np.rint(np.maximum(exact, -15.9) * GRID) / GRID


class Pairs:
    """The pairs of a chunk: known by number among the TOP words (first, second; -1: not), by key, and by group."""

    def __init__(self, seq: Sequence, shares: Shares):
        self.at = shares.find(seq.key)
        self.log = shares.logs(seq.key, self.at)
        self.second = shares.top[self.at]
        start = np.zeros(len(seq.key), bool)
        start[seq.first[:-1]] = True
        self.first = np.where(start, TOP, np.concatenate([[-1], self.second[:-1]]))  # TOP: a text's beginning
        self.bucket = (seq.key & np.uint64(255)).astype(np.int64)
        known = self.first >= 0
        self.both = known & (self.second >= 0)
        group = tx.mix64(seq.one ^ tx.mix64(self.bucket + 7)) >> np.uint64(20)
        # pairs whose first word is a top one are dealt one by one, since their groups are in the table
        group = np.where(known, tx.mix64(group ^ tx.mix64(seq.key)) >> np.uint64(20), group)
        self.pair = group << np.uint64(20) | tx.mix64(seq.key) >> np.uint64(44)
        self.known = known


BUCKET_CELLS = (TOP + 1) * CLASSES * BUCKETS
CELLS = (TOP + 1) * TOP + BUCKET_CELLS
ASKED = "shard int, docs binary, training binary, keys binary, at binary, times binary, known binary, logs binary"
TOLD = "row long, value double"
CELL_BLOCK = 1 << 16


def row_key(doc_id: np.ndarray, chunk: tx.Chunk) -> np.ndarray:
    """A key of each row by its id and text; rows that are alike share it."""
    return (tx.mix64(tx.hashes(chunk.buf, chunk.off[:-1], chunk.off[1:]) ^ tx.mix64(doc_id.view(np.uint64))) >> np.uint64(1)).view(np.int64)


def ids_of(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).fill_null(-(1 << 62) - 1).to_numpy(zero_copy_only=False)


def asked(named: DataFrame, held, shards: int) -> DataFrame:
    """Of each chunk and shard: its texts' distinct pairs and how often they are in each text; and of all training texts the cells of the TOP words."""

    def run(batches):
        shares = held.value
        cells = np.zeros(CELLS, np.int64)
        planes = counts.pack_counts
        for rows, chunk in tx.chunks(batches, "text"):
            seq = Sequence(chunk)
            pairs = Pairs(seq, shares)
            doc = np.repeat(np.arange(chunk.n), np.diff(seq.first))
            training = ~np.asarray(rows.column(2))
            mine = training[doc]
            at = np.flatnonzero(mine & pairs.known)
            np.add.at(cells, (TOP + 1) * TOP + pairs.first[at] * CLASSES * BUCKETS + pairs.bucket[at], 1)
            at = np.flatnonzero(mine & pairs.both)
            np.add.at(cells, pairs.first[at] * TOP + pairs.second[at], 1)
            at = np.flatnonzero(~pairs.both)
            key, of = pairs.pair[at], doc[at]
            order = np.argsort(key, kind="stable")  # texts are in order already
            at, key, of = at[order], key[order], of[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(key)))
            at, key, of = at[begin], key[begin], of[begin]
            shard = (tx.mix64(key >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            ids = row_key(ids_of(rows), chunk)
            for k in np.flatnonzero(np.diff(cut)):
                x = order[cut[k] : cut[k + 1]]
                docs, local = np.unique(of[x], return_inverse=True)
                yield sp.batch(ASKED, [k], [ids[docs].tobytes()], [training[docs].tobytes()], [counts.pack(key[x])], [planes(local)], [planes(times[x])], [np.packbits(pairs.known[at[x]]).tobytes()], [np.rint(-pairs.log[at[x]] * GRID).astype(np.uint16).tobytes()])
        for b in range(0, CELLS, CELL_BLOCK):
            at = np.flatnonzero(cells[b : b + CELL_BLOCK])
            if len(at):
                yield sp.batch(ASKED, [-1 - b // CELL_BLOCK], [b""], [b""], [counts.pack((at + b).astype(np.uint64))], [b""], [planes(cells[at + b])], [b""], [b""])

    return sp.arrow_map(named.select("doc_id", "text", "held_out"), run, ASKED)


def told(requests: DataFrame, shards: int) -> DataFrame:
    """Of each text and shard the sum of what its pairs add to log10 P(token | bucket); as rows below 0 the cells' counts."""

    def run(rows: pa.Table) -> pa.Table:
        get = lambda name: [x.as_py() for x in rows[name]]
        keys = [counts.unpack(x) for x in get("keys")]
        key, times = np.concatenate(keys), np.concatenate([counts.unpack_counts(x) for x in get("times")])
        if rows["shard"][0].as_py() < 0:
            cell, n = counts.summed(key, times)
            return pa.Table.from_batches([sp.batch(TOLD, -1 - cell.astype(np.int64), n.astype(float))])
        ids = [np.frombuffer(x, np.int64) for x in get("docs")]
        base = np.cumsum([0, *map(len, ids)])
        at = np.concatenate([counts.unpack_counts(x) + b for x, b in zip(get("at"), base)])
        ids, training = np.concatenate(ids), np.frombuffer(b"".join(get("training")), bool)
        known = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(get("known"), keys)])
        log = np.frombuffer(b"".join(get("logs")), np.uint16) / -GRID
        order = np.argsort(key, kind="stable")
        key, times, at, known, log = key[order], times[order], at[order], known[order], log[order]
        own = np.where(training[at], times, 0)

        def others(code: np.ndarray) -> np.ndarray:
            """Of each entry, the training counts of its code less those of its own text."""
            total = np.bincount(code, own)[code]
            _, same = np.unique(code * len(ids) + at, return_inverse=True)
            return total - np.bincount(same, own)[same]

        pair = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        group = key >> np.uint64(20)
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
        n = others(pair)
        room = np.where(known, 0.0, np.log10(1 + others(group) / PRIOR))
        value = np.bincount(at, times * (np.log10(1 + n / PRIOR * 10.0**-log) - room), len(ids))
        sp.give_back()
        return pa.Table.from_batches([sp.batch(TOLD, ids, value)])

    return requests.repartition(shards, "shard").groupBy("shard").applyInArrow(run, sp.schema_of(TOLD))


def in_table(cells: np.ndarray, pairs: Pairs, doc: np.ndarray, training: np.ndarray) -> np.ndarray:
    """What the cells add to each token's log10 P(token | bucket); a training text's own counts are left out."""

    def others(at: np.ndarray, cell: np.ndarray) -> np.ndarray:
        n = cells[cell]
        _, same, times = np.unique(doc[at] * CELLS + cell, return_inverse=True, return_counts=True)
        return n - np.where(training[doc[at]], times[same], 0)

    out = np.zeros(len(doc))
    at = np.flatnonzero(pairs.both)
    out[at] = np.log10(1 + others(at, pairs.first[at] * TOP + pairs.second[at]) / PRIOR * 10.0 ** -pairs.log[at])
    at = np.flatnonzero(pairs.known)
    out[at] -= np.log10(1 + others(at, (TOP + 1) * TOP + pairs.first[at] * CLASSES * BUCKETS + pairs.bucket[at]) / PRIOR)
    return out


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, model_log double, rare array<long>, times array<int>"


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_held_out=held_out, rounds: int = 1, tokens_a_shard: int = 2_000_000) -> DataFrame:
    """Learns from the documents that aren't held out and scores all: log10 probabilities of whole texts."""
    spark = docs.sparkSession
    named = sp.id_and_text(docs, id_col, text_col).withColumn("held_out", is_held_out(F.col("doc_id")))
    training = named.filter(~F.col("held_out"))
    vocabulary = sp.written(count_tokens(training), "vocabulary")
    places = vocabulary.groupBy(F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # one row a bucket
    tokens, types = sum(r.n for r in places), sum(r.v for r in places)
    bucket_n, bucket_types = np.zeros(CLASSES * BUCKETS), np.zeros(CLASSES * BUCKETS)
    for r in places:
        bucket_n[r.bucket], bucket_types[r.bucket] = r.n, r.v
    # the least count of at most HEAD tokens, by a histogram of fixed size
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    bound, taken = None, 0
    for r in sizes:
        if (taken := taken + r.v) > HEAD:
            break
        bound = r.least
    head = vocabulary.filter(F.col("n") >= bound).toArrow() if bound is not None else vocabulary.limit(0).toArrow()
    shares = Shares(head["key"].to_numpy().view(np.uint64), head["n"].to_numpy(), bucket_n, bucket_types)
    held_shares = spark.sparkContext.broadcast(shares)  # at most HEAD tokens
    shards = max(16, (tokens or 0) // tokens_a_shard)
    answers = sp.written(told(asked(named, held_shares, shards), shards), "pairs")
    cells = np.zeros(CELLS, np.int64)
    found = answers.filter("row < 0").toArrow()  # at most CELLS rows
    cells[-1 - found["row"].to_numpy()] = found["value"].to_numpy().astype(np.int64)
    weights = [np.zeros((ROWS_1, CLASSES), np.float32), np.zeros((ROWS_2, BUCKETS), np.float32)]
    for _ in range(rounds):
        weights = train_round(training, weights)
    held = spark.sparkContext.broadcast((weights, cells))  # a fixed size

    def run(batches):
        shares, ((first_w, second_w), cells) = held_shares.value, held.value
        for rows, chunk in tx.chunks(batches, "text"):
            seq = Sequence(chunk)
            first, second, group, bucket = seq.inputs()
            pairs = Pairs(seq, shares)
            of = np.repeat(np.arange(chunk.n), np.diff(seq.first))
            logp = pairs.log + in_table(cells, pairs, of, ~np.asarray(rows.column(2)))
            for k in range(0, len(group), BATCH):
                n = np.arange(len(group[k : k + BATCH]))
                a = softmax(first_w, first[:, k : k + BATCH])[n, group[k : k + BATCH]]
                b = softmax(second_w, second[:, k : k + BATCH])[n, bucket[k : k + BATCH]]
                logp[k : k + BATCH] += np.log10(np.maximum(a, 1e-30)) + np.log10(np.maximum(b, 1e-30))
            known = pairs.at >= 0
            log = np.where(known, np.log10(shares.n[pairs.at] + 0.5), 0.0) if len(shares.n) else np.zeros(len(known))
            begin = seq.first[:-1]
            rare_first = np.concatenate([[0], np.cumsum(~known)])[seq.first]
            rare = seq.key[~known]
            doc = np.repeat(np.arange(chunk.n), np.diff(rare_first))
            # distinct rare tokens of each document
            by = np.lexsort((rare, doc))
            rare, doc = rare[by], doc[by]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(rare)))
            off = pa.array(np.searchsorted(doc[start], np.arange(chunk.n + 1)), pa.int32())
            yield sp.batch(
                SCORED, row_key(ids_of(rows), chunk), rows.column(0), rows.column(2), np.diff(seq.first), np.add.reduceat(known.astype(np.int64), begin), np.add.reduceat(log, begin), np.add.reduceat(logp, begin),
                pa.ListArray.from_arrays(off, pa.array(rare[start].view(np.int64))), pa.ListArray.from_arrays(off, pa.array(times, pa.int32())),
            )

    scored = sp.written(sp.arrow_map(named, run, SCORED), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    counted = pairs.join(vocabulary, "key", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    tail = counted.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    # rows that are alike share a key, so each of these sums counts all of them
    alike = scored.groupBy("row").agg(F.count("*").alias("alike"))
    added = answers.filter("row >= 0").groupBy("row").agg(F.sum("value").alias("pairs_log"))
    of_one = lambda c: F.coalesce(F.col(c) / F.col("alike"), F.lit(0.0))
    known = F.col("head_log") + of_one("tail_log")
    return scored.drop("rare", "times").join(alike, "row").join(tail, "row", "left").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.round(of_one("tail_known"))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (known - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (types + 1)))).alias("base_score"),
        (F.col("model_log") + of_one("pairs_log")).alias("score"),
    )
