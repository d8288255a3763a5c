"""Quality rules: word counts and an N-gram perplexity with bands by language.

The model is a modified Kneser-Ney model of word bigrams.  Words are lower-cased (A-Z).  All that occur
``LEAST`` times or more are symbols of their own, however many they are; the others are one of ``CLASSES``
symbols by a hash of their last three bytes.  The most frequent words (at most ``HEAD``) have the low
numbers; the bigrams of a word beyond them are counted in that word's shard.  Spark counts all words and then
all bigrams of symbols over all texts, in shards whose number grows with the corpus.  Discounts come
from the counts of counts of all bigrams, lower-order probabilities from the numbers of distinct words
before each, over all bigrams.  Bigrams that occur once are pruned, all others stay, however many they
are.  What pruning takes goes to the back-off weight, so the probabilities after each history sum to one.

Tasks that score hold the most frequent bigrams (at most ``GRAMS``) as sorted arrays of keys with their
counts.  Of any other bigram they take the back-off probability first and send it to its shard, with the
document and its own counts; the shard has the exact count and returns what the logarithm lacks.  So
scores don't depend on ``GRAMS``, which bounds memory only.  Such bigrams are rare by construction, so
that none makes a shard hot.

A document is scored without its own bigram counts.  ``entropy`` is its nats a word, ``lower_entropy``
that of the lower order alone, and ``gain`` the difference, by which the word before helps: words in no
order gain little.  All are rounded to 1/1024.

A document's lower-order entropy is held against a lower and an upper bound of its language, its entropy
against an upper and its gain against a lower one (copies in the corpus make entropies as low as can
be, so those have no lower bound): the quartiles of the language's documents that pass the base rules
(exact, since the values are rounded), less and plus ``width`` times (for the gain half of that) the
distance to the median (of at least ``least`` nats), and a share of what the mean of so many words strays.

Defined cases: null and empty texts have no words and fail the base rules; a null
language is a language of its own; repeated rows get equal verdicts each; an empty
table gives an empty one; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import counts
from . import spark as sp
from . import text as tx

HEAD, CLASSES, GRAMS, LEAST = 1 << 17, 1 << 12, 1 << 21, 3
#: Symbols: words of the head, classes, the border of a document, all further words. A bigram is first << BITS | second.
BITS = 32
BORDER = HEAD + CLASSES
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASS_BITS = np.uint64(CLASSES - 1)


def word_keys(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A key of each word, its low bits the class; and each text's first word."""
    chunk = chunk.lower()
    w = tx.words(chunk)
    key = tx.hashes(chunk.buf, w.start, w.end)
    tail = tx.hashes(chunk.buf, np.maximum(w.start, w.end - 3), w.end)
    return key & ~_CLASS_BITS | tail >> np.uint64(52), w.first


@dataclass
class Vocabulary(counts.Tight):
    """Keys of the head in order, and of all symbols: tokens and types that they stand for. ``others``: keys of all further words in order."""

    IN_ORDER = ("keys", "others")

    keys: np.ndarray
    tokens: np.ndarray
    types: np.ndarray
    others: np.ndarray

    def symbols(self, key: np.ndarray) -> np.ndarray:
        out = HEAD + (key & _CLASS_BITS).astype(np.int64)
        left = np.arange(len(key))
        for keys, begin in ((self.keys, 0), (self.others, BORDER + 1)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key[left]), len(keys) - 1)
                found = keys[at] == key[left]
                out[left[found]] = begin + at[found]
                left = left[~found]
        return out

    def bigrams(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All bigrams of symbols, with the border before and after each text that has words; and each text's first."""
        key, first = word_keys(chunk)
        some = np.diff(first) > 0
        symbol = self.symbols(key)
        off = first + np.concatenate([[0], np.cumsum(some)])
        out = np.full(off[-1], BORDER, np.int64)
        place = np.arange(len(key)) + np.repeat(off[:-1] - first[:-1], np.diff(first))
        out[place] = symbol
        before = np.full(off[-1], BORDER, np.int64)
        before[1:] = out[:-1]
        return (before << BITS | out).astype(np.uint64), off


def parts(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second symbol of each bigram."""
    return (gram >> np.uint64(BITS)).astype(np.int64), (gram & np.uint64((1 << BITS) - 1)).astype(np.int64)


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    """Bigrams of words beyond the head go to the second's shard, or else to the first's, so that such a word's counts meet in few shards; those words are too rare to make one hot."""
    first, second = parts(gram)
    return counts.shards_of(np.where(second > BORDER, second, np.where(first > BORDER, first, gram.view(np.int64))).view(np.uint64), shards)


def bound_of(table: DataFrame, most: int, least: int) -> int:
    """The least count, ``least`` or more, that at most ``most`` rows of the table reach."""
    few = F.least(F.col("n"), F.lit(1 << 14))
    steps = table.filter(F.col("n") >= least).groupBy(few.alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()  # at most 2^14 rows
    bound, taken = None, 0
    for r in steps:
        if (taken := taken + r.k) > most:
            break
        bound = r.n
    if bound is not None or not steps:
        return bound or least
    low, high = 1 << 14, table.agg(F.max("n")).first()[0] + 1  # more than `most` rows above 2^14: halve the range
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if table.filter(F.col("n") >= mid).count() <= most else (mid + 1, high)
    return low


def vocabulary(docs: DataFrame, text: str = "text", docs_a_shard: int = 16_000) -> Vocabulary:
    shards = max(16, docs.count() // docs_a_shard)
    path = sp.scratch(docs.sparkSession, "words")
    table = sp.written(counts.count(docs, lambda c: word_keys(c)[0], shards, counts.ROWS, counts.rows, text), "words", path=path)
    bound = bound_of(table, HEAD, LEAST)

    def in_order(few: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = few.toArrow()
        keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
        order = np.argsort(keys)
        return keys[order], n[order]

    keys, n = in_order(table.filter(F.col("n") >= bound))  # at most HEAD rows
    others, n_others = in_order(table.filter(F.col("n").between(LEAST, bound - 1)))  # a row a word that occurs LEAST times or more: 8 bytes each go to all tasks
    tokens, types = np.zeros(BORDER + 1 + len(others)), np.ones(BORDER + 1)
    tokens[: len(keys)], tokens[BORDER + 1 :] = n, n_others
    rest = table.filter(F.col("n") < LEAST).groupBy(F.col("key").bitwiseAND(F.lit(CLASSES - 1)).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # a row a class
    for r in rest:
        tokens[HEAD + r["class"]], types[HEAD + r["class"]] = r.n, r.types
    sp.delete(docs.sparkSession, path)
    return Vocabulary(keys, tokens, types, others)


@dataclass
class Model(counts.Tight):
    """Sorted keys of the bigrams held with counts; discounts; and of each symbol: back-off weight and lower-order log-probability of a word of it.

    Further words with the same values share a place in these arrays, after the border's; ``place`` has that of each.
    """

    words: Vocabulary
    keys: np.ndarray
    n: np.ndarray
    discount: np.ndarray
    total: np.ndarray
    gamma: np.ndarray
    lower: np.ndarray
    place: np.ndarray

    def places(self, symbol: np.ndarray) -> np.ndarray:
        further = symbol > BORDER
        if further.any():
            symbol = symbol.copy()
            symbol[further] = self.place[symbol[further] - BORDER - 1]
        return symbol

    def counts(self, gram: np.ndarray) -> np.ndarray:
        """Counts of bigrams, 0 for those not held."""
        if not len(self.keys):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        return np.where(self.keys[at] == gram, self.n[at], 0)

    def logs(self, gram: np.ndarray, own: np.ndarray | None = None, own_first: np.ndarray | None = None, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (natural) of each bigram's second word after the first, and of it alone; without so many own counts. ``c``: counts, if not those held."""
        first, second = (self.places(x) for x in parts(gram))
        c = self.counts(gram) if c is None else c
        total = self.total[first]
        if own is not None:
            c = np.maximum(c - own, 0)
            total = np.maximum(total - own_first, 1)
        alone = np.exp(self.lower[second])
        p = np.minimum((c - self.discount[np.minimum(c, 3)]) / np.maximum(total, 1), 1) / self.words.types[second] + self.gamma[first] * alone
        return np.log(p), self.lower[second]


def kneser_ney(words: Vocabulary, keys: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray, of_counts: np.ndarray, texts: int) -> Model:
    """keys, n: the bigrams held in order. before: distinct words before each symbol. after: of all bigrams of two or more after each symbol, the sum, how many with two, with more. of_counts: bigrams with count 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in of_counts)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    discount = np.array([0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5])
    discount = np.clip(discount, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])
    total = words.tokens
    total[BORDER] = texts
    seen = after[0] - discount[2] * after[1] - discount[3] * after[2]
    gamma = np.where(total > 0, 1 - seen / np.maximum(total, 1), 1.0)
    every = max(float(before.sum()), 1.0)
    symbols = max(HEAD, len(words.keys) + len(words.others)) + CLASSES + 1
    share = np.where(before > 0, before - 0.75, 0) / every + (0.75 * (before > 0).sum() / every if before.any() else 1.0) / symbols
    of = tx.pd.DataFrame({"total": total[BORDER + 1 :], "gamma": gamma[BORDER + 1 :], "share": share[BORDER + 1 :]})
    place = of.groupby(list(of.columns), sort=False).ngroup().to_numpy()  # in the order in which they first occur, as below
    total, gamma, share = (np.concatenate([x[: BORDER + 1], y]) for x, y in zip((total, gamma, share), of.drop_duplicates().to_numpy().T))
    types = np.concatenate([words.types, np.ones(len(share) - BORDER - 1)])
    return Model(replace(words, tokens=words.tokens[:0], types=types), keys, n, discount, total, gamma, np.log(share / types), (BORDER + 1 + place).astype(np.int32))


#: Kind 0: a shard's bigrams of two or more; 1: a symbol; 2: how many bigrams have each count up to 4, and at 0 how many texts begin; 3: how many of kind 0 have each level.
MADE = "kind int, shard int, keys binary, times binary, key long, n long, seen long, twos long, more long"


def levels(n: np.ndarray) -> np.ndarray:
    """Counts in steps of a hundredth: there are at most 4096 levels."""
    return (64 * np.log2(n)).astype(np.int64)


@dataclass
class Counted:
    """All bigrams of two or more in a table of shards at ``path``, and the level from which the model holds them; ``whole`` if it holds all."""

    table: DataFrame
    path: str
    shards: int
    level: int
    whole: bool


def train(docs: DataFrame, text: str = "text", tokens_a_shard: int = 4_000_000) -> Model:
    """The model alone; it holds at most GRAMS bigrams."""
    model, counted = trained(docs, text, tokens_a_shard)
    sp.delete(docs.sparkSession, counted.path)
    return model


def trained(docs: DataFrame, text: str = "text", tokens_a_shard: int = 4_000_000) -> tuple[Model, Counted]:
    """Counts words and bigrams of all texts with Spark and builds the model; at most GRAMS bigrams and a row a symbol come to the driver, all others stay in the table."""
    words = vocabulary(docs, text)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(replace(words, tokens=words.tokens[:0], types=words.types[:0]))  # 8 bytes a word
    shards = max(16, int(words.tokens.sum()) // tokens_a_shard)

    def made(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        shard = int(shard_of(keys[:1], shards)[0])
        first, second = parts(keys)
        some = n >= 2
        symbol, code = np.unique(np.concatenate([first, second]), return_inverse=True)
        a, b = np.split(code, 2)
        of = [np.bincount(b, minlength=len(symbol)), np.bincount(a, n * some, len(symbol)), np.bincount(a[n == 2], minlength=len(symbol)), np.bincount(a[n > 2], minlength=len(symbol))]
        at = np.flatnonzero(of[0] + of[1])
        few = np.bincount(np.minimum(n, 5), minlength=6)[:5]
        few[0] = n[first == BORDER].sum()
        level, k = np.unique(levels(n[some]), return_counts=True)
        kind = np.repeat([0, 1, 2, 3], [1, len(at), 5, len(level)])
        blob = lambda data: pa.array([data] + [None] * (len(kind) - 1), pa.binary())
        rest = [np.concatenate([[0], x[at].astype(np.int64), np.zeros(len(kind) - 1 - len(at), np.int64)]) for x in of[1:]]
        return sp.batch(MADE, kind, np.full(len(kind), shard), blob(counts.pack(keys[some])), blob(counts.pack_counts(n[some])), np.concatenate([[0], symbol[at], np.arange(5), level]), np.concatenate([[0], of[0][at], few, k]), *rest)

    path = sp.scratch(spark, "bigrams")
    table = sp.written(counts.count(docs, lambda c: held.value.bigrams(c)[0], shards, MADE, made, text, shard_of), "bigrams", "zstd", path)
    rest = table.filter("kind > 0").groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "seen", "twos", "more"))).toArrow()  # a row a symbol and level
    kind, key, n = (rest[c].to_numpy() for c in ("kind", "key", "n"))
    before, after, few = np.zeros(len(words.tokens)), np.zeros((3, len(words.tokens))), np.zeros(5)
    before[key[kind == 1]] = n[kind == 1]
    after[:, key[kind == 1]] = [rest[c].to_numpy()[kind == 1] for c in ("seen", "twos", "more")]
    few[key[kind == 2]] = n[kind == 2]
    down = np.argsort(-key[kind == 3])
    level, taken = key[kind == 3][down], np.cumsum(n[kind == 3][down])
    del rest, kind, key, n
    held.unpersist()  # the table of bigrams is written
    sp.give_back()
    held_levels = int(np.searchsorted(taken, GRAMS, "right"))  # the model holds these levels; the others' bigrams are asked for
    counted = Counted(table.filter("kind = 0").select("shard", "keys", "times"), path, shards, int(level[held_levels - 1]) if held_levels else 1 << 20, held_levels == len(level))

    def frequent(batches):
        for rows in batches:
            for k, times in zip(rows["keys"], rows["times"]):
                key, n = counts.unpack(k.as_py()), counts.unpack_counts(times.as_py())
                some = levels(n) >= counted_level
                yield counts.rows(key[some], n[some])

    counted_level = counted.level
    grams = sp.arrow_map(counted.table.select("keys", "times"), frequent, counts.ROWS).toArrow()  # at most GRAMS rows
    keys, n = grams["key"].to_numpy().view(np.uint64), grams["n"].to_numpy()
    order = np.argsort(keys)
    model = kneser_ney(words, keys[order], n[order], before, after, few[1:], int(few[0]))
    del grams, keys, n, order, before, after, words
    sp.give_back()
    return model, counted


def base(chunk: tx.Chunk) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = tx.words(chunk)
    buf, off = chunk.buf, chunk.off
    chars = tx.per_doc((buf & 0xC0 != 0x80) & tx._WORD[buf], off)
    symbols = tx.per_doc(_SYMBOL[buf], off)
    # lines with a word, less the distinct ones among them
    line, line_end, _ = tx.spans(buf != 0x0A, off)
    worded = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line)
    line, line_end = line[worded], line_end[worded]
    doc = np.searchsorted(off, line, "right") - 1
    dup = duplicates(tx.hashes(buf, line, line_end), doc)
    n_dup = np.bincount(doc[dup], minlength=chunk.n)
    h = tx.hashes(buf, w.start, w.end)
    gram, at = tx.ngrams(h, w.first, 3)
    doc_of = np.searchsorted(w.first, at, "right") - 1
    again = duplicates(gram, doc_of, all_of_them=True)
    covered = np.zeros(len(h) + 1, bool)
    for k in range(3):
        covered[at[again] + k] = True
    return w.count, chars, symbols, n_dup, tx.per_doc(covered[:-1], w.first)


def duplicates(value: np.ndarray, doc: np.ndarray, all_of_them: bool = False) -> np.ndarray:
    """Which values equal another (an earlier one, or any) of the same document."""
    mixed = value ^ tx.mix64(doc)
    order = np.argsort(mixed, kind="stable")
    same = np.zeros(len(value), bool)
    ordered = mixed[order]
    equal = ordered[1:] == ordered[:-1]
    same[order[1:][equal]] = True
    if all_of_them:
        same[order[:-1][equal]] = True
    return same


SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, entropy double, lower_entropy double, gain double"


def scores(model: Model, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Each text's nats a word and those of the lower order, without the text's own bigram counts; NaN without words. And bigrams that the model doesn't hold: key, text, own count, that of the first."""
    gram, off = model.words.bigrams(chunk)
    doc = np.repeat(np.arange(chunk.n), np.diff(off))
    code, kinds = tx.pd.factorize(gram)
    own, own_first = (_own(doc, x) for x in (code, parts(gram)[0]))
    held = model.counts(kinds)
    after, alone = model.logs(gram, own, own_first, held[code])
    n = np.bincount(doc, minlength=chunk.n)
    at = np.flatnonzero((held == 0)[code])
    at = at[np.unique(doc[at].astype(np.int64) << 40 | code[at], return_index=True)[1]]
    with np.errstate(invalid="ignore"):
        return -np.bincount(doc, after, chunk.n) / n, -np.bincount(doc, alone, chunk.n) / n, (gram[at], doc[at], own[at], own_first[at])


def _own(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each value is in its own document."""
    _, at, n = np.unique(doc.astype(np.int64) << 40 | value, return_inverse=True, return_counts=True)
    return n[at]


#: Bigrams that the model doesn't hold, in order: the row of the first document, and of each bigram the key, whose it is, how often it and its first word are there.
ASKED = "row long, shard int, keys binary, whose binary, own binary, own_first binary"
#: Bigrams that a task holds before it sends them.
MOST = 1 << 19
#: Sums of logarithms are returned as whole multiples, so that their order doesn't matter.
UNIT = 1 << 32


def asked(held: list[tuple[np.ndarray, ...]], shards: int):
    """For each shard its bigrams in order; ``held`` is empty afterwards."""
    key, *rest = (np.concatenate(x) for x in zip(*held))
    held.clear()
    shard = shard_of(key, shards)
    order = np.lexsort((key, shard))
    key, rest, cut = key[order], [x[order] for x in rest], np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cut)):
        a, b = cut[k], cut[k + 1]
        yield int(k), counts.tight(counts.pack(key[a:b])), *(counts.tight(counts.pack_counts(x[a:b])) for x in rest)


def measured(docs: DataFrame, model: Model, counted: Counted, rest: list[str], text: str = "text") -> DataFrame:
    """Of each document: the base counts, base_failed, entropies by the bigrams held, and a row number. Columns ``rest`` go along. Rows with a shard ask for the other bigrams."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most GRAMS bigrams, HEAD + CLASSES symbols and 12 bytes a further word
    schema = StructType([StructField(f.name, f.dataType, True) for f in sp.rows_schema(docs, rest, f"{SCORES}, {ASKED}")])
    arrow = sp.arrow_schema(schema)
    shards, whole, blank = counted.shards, counted.whole, len(arrow) - len(ASKED.split(", "))

    def run(batches):
        begin = row = TaskContext.get().partitionId() << 40
        others: list[tuple[np.ndarray, ...]] = []

        def out():
            for of in asked(others, shards):
                columns = [pa.nulls(1, f.type) for f in list(arrow)[:blank]] + [pa.array([x], f.type) for x, f in zip((begin, *of), list(arrow)[blank:])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for rows, chunk in tx.chunks(batches, text):
            entropy, lower, (key, doc, own, own_first) = scores(held.value, chunk)
            found = base(chunk)
            failed = (found[0] < 50) | (100 * found[4] > 50 * found[0])
            yield sp.rows_batch(arrow, rows, rest, *found, failed, entropy, lower, lower - entropy, np.arange(row, row + chunk.n), *(pa.nulls(chunk.n, f.type) for f in list(arrow)[blank + 1 :]))
            if not whole and len(key):
                others.append((key, *(x.astype(np.int32) for x in (row - begin + doc, own, own_first))))
            row += chunk.n
            if sum(len(x[0]) for x in others) > MOST:
                yield from out()
                begin = row
        if others:
            yield from out()

    return sp.arrow_map(docs.select(*dict.fromkeys([text, *rest])), run, schema)


def answered(rows: DataFrame, model: Model, counted: Counted) -> DataFrame:
    """The rows of documents as they are, and what the logarithms of their other bigrams sum up to beyond those of the back-off, in units: rows with ``lacks``, one a document that has any in a shard.

    Requests are answered where they arrive and never written.
    """
    held = rows.sparkSession.sparkContext.broadcast(replace(model, keys=model.keys[:0], n=model.n[:0], words=replace(model.words, keys=model.words.keys[:0], others=model.words.others[:0])))
    asking = ASKED.split(", ")[1:]
    kept = [f for f in rows.schema.fields if f.name not in {x.split()[0] for x in asking}]
    schema = StructType([*kept, *sp.schema_of("lacks long")])
    arrow = sp.arrow_schema(schema)
    row_at = [f.name for f in kept].index("row")

    def answer(keys: np.ndarray, n: np.ndarray, first_row: int, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blobs = [counts.loose(b) for b in blobs]
        key, (whose, own, own_first) = counts.unpack(blobs[0]), (counts.unpack_counts(b) for b in blobs[1:])
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        c = np.where(keys[place] == key, n[place], 0)
        others = c > own
        key, whose, own, own_first, c = (x[others] for x in (key, whose, own, own_first, c))
        lacks = own * (held.value.logs(key, own, own_first, c)[0] - held.value.logs(key)[0])
        document, code = np.unique(whose, return_inverse=True)
        return first_row + document, np.rint(np.bincount(code, lacks, len(document)) * UNIT).astype(np.int64)

    def run(batches):
        shard, keys, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            own = batch.filter(pc.is_null(batch["keys"]))
            if own.num_rows:
                yield sp.rows_batch(arrow, own, [f.name for f in kept], pa.nulls(own.num_rows, pa.int64()))
            sent = batch.select(["shard", *(x.split()[0] for x in ASKED.split(", ") if x != "shard int")]).filter(pc.is_valid(batch["keys"]))
            for r in sent.to_pylist():
                if r["row"] is None:  # a shard's counts come before its requests
                    shard, keys, n = r["shard"], counts.unpack(r["keys"]), counts.unpack_counts(r["own"])
                elif r["shard"] == shard and len(keys):
                    document, lacks = answer(keys, n, r["row"], [r[x] for x in ("keys", "whose", "own", "own_first")])
                    columns = [pa.nulls(len(document), f.type) for f in arrow]
                    columns[row_at], columns[-1] = pa.array(document), pa.array(lacks)
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    blank = {"shard": F.col("shard"), "keys": F.col("keys"), "own": F.col("times")}
    table = counted.table.select(*(blank.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    dealt = rows.withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("row"), F.lit(counted.shards)).cast("int"))).unionByName(table)
    return sp.arrow_map(dealt.repartition(counted.shards, "shard").sortWithinPartitions("shard", F.col("row").asc_nulls_first()), run, schema)


def scored(docs: DataFrame, rest: list[str], text: str = "text") -> DataFrame:
    """Of each document: the base counts, base_failed and entropies. Columns ``rest`` go along. The most frequent bigrams, at most GRAMS, are held by tasks; all others are asked for."""
    entropy = F.col("entropy")
    with sp.shuffles_freed(docs.sparkSession):
        model, counted = trained(docs.select(F.col(text).cast("string").alias(text)), text)
        rows = measured(docs, model, counted, rest, text)
        if counted.whole:
            out = sp.written(rows, "quality")
        else:
            table = sp.written(answered(rows, model, counted), "quality", "zstd")
            lacks = sp.written(table.filter("lacks IS NOT NULL").groupBy("row").agg(F.sum("lacks").alias("lacks")), "lacks", "zstd")
            out = table.filter("lacks IS NULL").drop("lacks").join(lacks, "row", "left")
            entropy = entropy - F.coalesce("lacks", F.lit(0)) / F.lit(float(UNIT)) / (F.col("n_words") + 1)
    sp.delete(docs.sparkSession, counted.path)
    grid = lambda c: F.rint(c * 1024) / 1024
    return out.withColumn("entropy", grid(entropy)).withColumn("lower_entropy", grid(F.col("lower_entropy"))).withColumn("gain", F.col("lower_entropy") - F.col("entropy")).select(*rest, *(f.name for f in sp.schema_of(SCORES)))


def bands(scored: DataFrame, lang: str, width: float, least: float) -> DataFrame:
    """Bounds by language: ``low`` and ``high`` of the lower-order entropy, ``most`` of the entropy, ``helped`` of the gain. A row a language."""
    quartiles = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # noqa: E731 - over values on a grid: few distinct ones, added up before they are shuffled
    fit = scored.filter(~F.col("base_failed")).groupBy(F.col(lang).alias("__lang")).agg(quartiles("lower_entropy").alias("l"), quartiles("entropy").alias("e"), quartiles("gain").alias("g"))
    room = lambda a, b: width * F.greatest(a - b, F.lit(least))
    l, e, g = F.col("l"), F.col("e"), F.col("g")
    bounds = {"__low": l[0] - room(l[1], l[0]), "__high": l[2] + room(l[2], l[1]), "__most": e[2] + room(e[2], e[1]), "__helped": g[0] - 0.5 * room(g[1], g[0])}
    return sp.written(fit.select("__lang", *(v.alias(k) for k, v in bounds.items())), "bands")


def judged(scored: DataFrame, lang: str, width: float, least: float) -> DataFrame:
    """The rows with ``kept``. A mean over n words strays by about 1/sqrt(n), so short texts have wider bounds; a language without a document that passes the base rules has none."""
    stray = F.lit(2.0) / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    inside = F.col("lower_entropy").between(F.col("__low") - stray, F.col("__high") + stray) & (F.col("entropy") <= F.col("__most") + stray) & (F.col("gain") >= F.col("__helped") - stray / 2)
    of = bands(scored, lang, width, least)
    return scored.join(of, F.col(lang).eqNullSafe(F.col("__lang")), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(*of.columns)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 4.0, least: float = 0.1) -> DataFrame:
    """Per document: the base counts, ``base_failed``, its cross entropy and ``kept``."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    return judged(scored(named, ["doc_id", "lang"]), "lang", width, least).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "entropy", F.exp("entropy").alias("perplexity"), "lower_entropy", "gain")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: float = 4.0, least: float = 0.1) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    whole, own = sp.by_place(docs)
    text, lang = own[text_col], own[lang_col]
    found = scored(whole, list(own.values()), text)
    return sp.under_old_names(judged(found.withColumn("__of", F.col(lang).cast("string")), "__of", width, least).filter("kept"), own)
