"""Near-duplicate grouping by SuperMinHash signatures, banding, verification and union-find.

**Signatures.** SuperMinHash gives each element a random permutation of the slots;
slot ``p_j`` gets ``j + r_j`` if that is the least so far.  The ranks that one
element has in different slots are thus correlated (they differ), which lowers the
estimate's variance, and once all slots of a set hold less than ``j`` no later step
can change them.  Here all elements of all sets of a chunk take step ``j`` at once,
and sets whose slots are settled leave.

**Grouping.** Equal sets meet by a hash of the whole set and are one class from then
on.  Classes that share a band are candidates.  Of a bucket's classes the one that
shares most bands with others is its hub; the others are compared with it first.
Verified pairs are merged by a distributed union-find.  Nodes of buckets that still
hold different components are then joined on the prefixes of their sets, which finds
every pair of them that may reach the threshold: no candidate is dropped, and members
of a large group aren't paired with each other.  Pairs are verified on full sets.

**Hot keys.** In each join of many rows with one row a key, keys with many rows (at
most ``spark.HOT`` of them, whatever the data) are dealt over several tasks, and the
one row goes to each of these.

With the default 25 bands of 4 slots, a pair of similarity 0.8 shares no band with
probability (1 - 0.8^4)^25 = 2e-6, one of 0.85 with 1e-8.  Sets are of 64-bit hashes
of shingles.

Defined cases: a document without words, or with a null text, has an empty set and
is linked with nothing.  Rows that repeat a document id are one document of their
distinct texts, joined by line breaks.  A null id is left out of grouping: its row comes back with
a null component and is kept.  An empty table gives an empty one.  Other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spark as sp
from . import text as tx

SIGNED = "doc_id long, n_shingles long, set_hash long, set_check long, bands array<long>"
SETS = "node long, shingles array<long>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(chunk: tx.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles in rising order, and each text's first.

    A-Z are lower-cased. A text with fewer than n words has its whole sequence as one.
    """
    chunk = chunk.lower()
    w = tx.words(chunk)
    h = tx.hashes(chunk.buf, w.start, w.end)
    gram, at = tx.ngrams(h, w.first, n)
    doc = np.searchsorted(w.first, at, "right") - 1
    count = w.count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for d in short:
            x = tx.mix64(count[d : d + 1])
            for k in range(w.first[d], w.first[d + 1]):
                x = tx.mix64(x ^ h[k : k + 1])
            whole.append(x[0])
        gram, doc = np.concatenate([gram, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    # sort by document, then hash; the documents are few, so one sort of each
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(chunk.n + 1))


def superminhash(value: np.ndarray, first: np.ndarray, slots: int = 128) -> np.ndarray:
    """Signatures of sets (rows: sets, columns: slots); an empty set has infinity."""
    n = len(first) - 1
    out = np.full((n, slots), np.inf)
    size = np.diff(first)
    doc = np.repeat(np.arange(n), size)
    active = np.arange(len(value))
    state = tx.mix64(value)
    drawn: list[np.ndarray] = []  # the draws of earlier steps of the elements still active
    for j in range(slots):
        if not len(active):
            break
        state = tx.mix64(state)
        rank = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        state = tx.mix64(state)
        draw = (j + ((state >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        # the slot at place `draw` after the earlier swaps of the lazy shuffle, traced back
        slot = draw.copy()
        for i in range(j - 1, -1, -1):
            np.copyto(slot, np.int16(i), where=drawn[i] == slot)
        flat = doc[active] * slots + slot
        order = np.lexsort((rank, flat)) if len(flat) < 64 else np.argsort(flat, kind="stable")
        at = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        least = np.minimum.reduceat(rank[order], begin) + j
        view = out.reshape(-1)
        view[at[begin]] = np.minimum(view[at[begin]], least)
        open_ = ~(out.max(axis=1) < j + 1) & (size > 0) if j < 4 or j % 8 == 0 else None
        if open_ is not None:
            stay = open_[doc[active]]
            active, state = active[stay], state[stay]
            drawn = [d[stay] for d in drawn] + [draw[stay]]
        else:
            drawn.append(draw)
    return out


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Of each document: size and hash of its set, and its band hashes (none for an empty set)."""

    def run(batches):
        for batch, chunk in tx.chunks(batches, "text"):
            value, first = shingles(chunk, n)
            size = np.diff(first)
            signature = superminhash(value, first, bands * rows)
            key = np.zeros((chunk.n, bands), np.uint64)
            bits = signature.view(np.uint64).reshape(chunk.n, bands, rows)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    key = tx.mix64(key ^ bits[:, :, r])
                key = tx.mix64(key + np.arange(bands, dtype=np.uint64) * _STEP)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix64(value), dtype=np.uint64)])
                check = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix64(value ^ _STEP), dtype=np.uint64)])
                whole, again = (tx.mix64(x[first[1:]] - x[first[:-1]]) for x in (total, check))
            some = size > 0
            off = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
            yield sp.batch(SIGNED, batch.column(0), size, whole.view(np.int64), again.view(np.int64), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(key[some].reshape(-1).view(np.int64))))

    return sp.arrow_map(docs, run, SIGNED)


_BITS = 1 << 22


def _bit(ids: np.ndarray) -> np.ndarray:
    return (tx.mix64(ids.view(np.uint64)) >> np.uint64(64 - 22)).astype(np.int64)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The full set of each document among the nodes: node, shingles.

    Texts aren't shuffled: a table of ``_BITS`` bits says which documents may be nodes, and of these the sets go to the join.
    """

    def bits(batches):
        seen = np.zeros(_BITS, bool)
        for batch in batches:
            seen[_bit(np.asarray(batch.column(0)))] = True
        yield sp.batch("bit int", np.flatnonzero(seen))

    marked = np.zeros(_BITS, bool)
    marked[sp.arrow_map(nodes.select("node"), bits, "bit int").distinct().toArrow()["bit"].to_numpy()] = True  # at most _BITS rows
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches):
        marked = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(marked[_bit(np.asarray(batch.column(0)))])) if batch.num_rows else batch
            for rows, chunk in tx.chunks([some], "text"):
                value, first = shingles(chunk, n)
                yield sp.batch(SETS, rows.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64))))

    return sp.arrow_map(docs.select("doc_id", "text"), run, SETS).join(nodes.select("node").hint("merge"), "node", "left_semi")


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """Union-find over links (a, b): node and the least node of its component.

    Alternates large-star and small-star steps, which double what a star reaches,
    until they change nothing; each step is a few aggregations by node and a join in
    which a hub's links are dealt over many tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = sp.written(edges, what)
    n = edges.count()
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
        # large star: larger neighbours of u are linked with u's least one
        large = sp.join_one(both.filter("v > u"), least.select("u", "m"), ["u"], sp.hot_keys(least, ["u"], 2 * n), "v")
        large = sp.written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), what)
        # small star: the least neighbour of each node takes its other smaller ones
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = sp.join_one(large, least.select("u", "m"), ["u"], sp.hot_keys(least, ["u"], large.count()), "v")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = sp.written(small, what)
        # settled: no node stands on both sides and each has one link
        n, sources = edges.agg(F.count("*"), F.countDistinct("u")).first()
        tops = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if n == sources and not tops:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))


def verified(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets' intersection is at least ``threshold`` percent of their union."""
    pairs = sp.written(pairs, "pairs")
    total, both = pairs.count(), pairs
    for side in ("b", "a"):
        hot = sp.hot_keys(pairs.groupBy(side).agg(F.count("*").alias("k")), [side], total)
        both = sp.join_one(both, full.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")), [side], hot, "a" if side == "b" else "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.asarray(batch.column(k)) for k in (0, 1))
            left, right = batch.column(2), batch.column(3)
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            ln, rn = np.diff(lo), np.diff(ro)
            # intersections of all rows at once: equal values of one row meet in a sort
            row = np.concatenate([np.repeat(np.arange(len(a)), ln), np.repeat(np.arange(len(a)), rn)])
            mixed = np.concatenate([lv[lo[0] : lo[-1]], rv[ro[0] : ro[-1]]]).view(np.uint64) ^ tx.mix64(row)
            mixed = tx.mix64(mixed) & np.uint64((1 << 44) - 1) | row.astype(np.uint64) << np.uint64(44)
            mixed.sort()
            same = mixed[1:] == mixed[:-1]
            inter = np.bincount((mixed[1:][same] >> np.uint64(44)).astype(np.int64), minlength=len(a))
            good = 100 * inter >= threshold * (ln + rn - inter)
            if (close := np.flatnonzero(np.abs(100 * inter - threshold * (ln + rn - inter)) <= 400)).size:
                for i in close:  # near the bound the exact hashes decide
                    x = len(np.intersect1d(lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]], assume_unique=True))
                    good[i] = 100 * x >= threshold * (ln[i] + rn[i] - x)
            yield sp.batch("a long, b long", a[good], b[good])

    return sp.arrow_map(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def docs_repeat(full: DataFrame) -> bool:
    n, distinct = full.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return n != distinct


def _mixed(band: DataFrame, of: DataFrame, total: int) -> tuple[int, DataFrame]:
    """The rows of buckets that still hold different components, with ``comp``; and how many there are."""
    now = sp.written(band.select("band", "node", "n").join(of.hint("merge"), "node", "left").select("band", "node", "n", F.coalesce("least", "node").alias("comp")), "placed")
    buckets = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi")
    out = sp.written(sp.join_one(now, buckets.select("band"), ["band"], sp.hot_keys(buckets, ["band"], total), "node"), "mixed")
    return out.count(), out


def _overlap(a, b, threshold: int):
    """The least intersection of sets of sizes a and b that reaches the threshold."""
    return F.ceil((a + b) * threshold / float(100 + threshold) - 1e-9)


_SLOTS = 1 << 18
HEADS = "node long, n long, comp long, x long, place long"


def _order(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of ``_SLOTS`` slots: a table of a fixed size that puts rare shingles before frequent ones."""

    def run(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy()
            total += np.bincount(_slot(x), minlength=_SLOTS)
        at = np.flatnonzero(total)
        yield sp.batch("slot int, n long", at, total[at])

    rows = sp.arrow_map(sets.select("shingles"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _slot(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - 18)).astype(np.int64)


def _heads(sets: DataFrame, threshold: int) -> DataFrame:
    """The prefix of each set in the common order, with each shingle's place in it."""
    held = sets.sparkSession.sparkContext.broadcast(_order(sets))  # _SLOTS numbers

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n, comp = (np.asarray(batch.column(k)) for k in (0, 1, 2))
            lists = batch.column(3)
            x = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), size)
            order = np.lexsort((x, held.value[_slot(x)], row))
            first = np.cumsum(size) - size
            place = np.arange(len(x)) - first[row] + 1
            keep = place <= (n - -(-n * threshold // 100) + 1)[row]  # the shortest partner has the longest prefix
            at = row[keep]
            yield sp.batch(HEADS, node[at], n[at], comp[at], x[order][keep], place[keep])

    return sp.arrow_map(sets.select("node", "n", "comp", "shingles"), run, HEADS)


def _rest(mixed: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may still be linked, by prefixes.

    With all shingles in one order, rare ones first, two sets of sizes a and b whose intersection is at least o share
    one among the first a - o + 1 of the one and the first b - o + 1 of the other. In a group of near copies those are
    the edits of each copy, not what all have. Any order is right; frequencies by slot only make it a good one. Of a
    shingle's nodes, those of the commonest component aren't paired with each other.
    """
    nodes = mixed.select("node", "n", "comp").distinct()
    sets = sp.written(full.join(nodes.hint("merge"), "node").select("node", "n", "comp", "shingles"), "rest")
    heads = sp.written(_heads(sets, threshold), "prefixes")
    major = heads.groupBy("x", "comp").agg(F.count("*").alias("c")).groupBy("x").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("c").alias("k")).filter("comps > 1")
    major = sp.written(major.select("x", "major", "k"), "shared")
    hot = sp.hot_keys(major, ["x"], heads.count())
    right = sp.written(sp.join_one(heads, major.select("x", "major"), ["x"], hot, "node"), "meeting")
    every = right.join(F.broadcast(hot), "x", "left").withColumn("part", sp.part_of("node"))
    left = right.filter("comp <> major").join(F.broadcast(hot), "x", "left").withColumn("part", sp.all_parts())
    left = left.select("x", "part", *(F.col(c).alias(f"l_{c}") for c in ("node", "n", "comp", "place")))
    need = _overlap(F.col("n"), F.col("l_n"), threshold)
    near = (F.col("comp") != F.col("l_comp")) & (F.col("place") <= F.col("n") - need + 1) & (F.col("l_place") <= F.col("l_n") - need + 1)
    return every.join(left, ["x", "part"]).filter(near).select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct()


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, bands: int = 25, rows: int = 4) -> DataFrame:
    """Per document id: ``n_shingles``, ``component_id`` (the least id reachable) and ``kept``."""
    every = sp.id_and_text(docs, id_col, text_col)
    named = every.filter("doc_id IS NOT NULL")
    sign = sp.written(signed(named, shingle, bands, rows), "signatures")
    if docs_repeat(sign):  # rows of one id: one document with the words of all
        joined = named.groupBy("doc_id").agg(F.concat_ws("\n", F.array_sort(F.collect_set("text"))).alias("text"))
        named = sp.written(joined, "documents")
        sign = sp.written(signed(named, shingle, bands, rows), "signatures")
    # equal sets: one class, named by its least id; only that row's bands go on
    alike = ["set_hash", "set_check", "n_shingles"]
    classes = sp.written(sign.filter("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("node"), F.count("*").alias("k")), "classes")
    band = sign.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands").join(classes.select("node").hint("merge"), "node", "left_semi").select("node", "n", F.explode("bands").alias("band"))
    total = bands * classes.count()
    shared = sp.written(band.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    hot = sp.hot_keys(shared.select("band", F.col("members").alias("k")), ["band"], total)
    band = sp.written(sp.join_one(band, shared, ["band"], hot, "node"), "bands")
    # hubs: the nodes with most company
    weight = band.groupBy("node").agg(F.sum("members").alias("weight"))
    band = sp.written(band.join(weight.hint("merge"), "node").select("band", "node", "n", (-F.col("weight")).alias("turn")), "buckets")
    full = sp.written(sets_of(named, sp.written(weight.select("node"), "nodes"), shingle), "sets")
    hub = band.groupBy("band").agg(F.min(F.struct("turn", "node", "n")).alias("h")).select("band", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    fits = 100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")  # else sizes alone rule the pair out
    pairs = sp.join_one(band, hub, ["band"], hot, "node").filter("node <> hub").filter(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = sp.written(verified(pairs, full, threshold), "links")
    of = components(links)
    some, mixed = _mixed(band, of, total)
    if some:
        found = sp.written(verified(_rest(mixed, full, threshold), full, threshold), "links")
        if not found.isEmpty():
            of = components(links.unionByName(found))
    # from classes back to documents
    least = classes.join(of.hint("merge"), "node", "left").select(*alike, F.coalesce("least", "node").alias("component_id"))
    hot = sp.hot_keys(classes, alike, sign.count())
    out = sp.join_one(sign.select("doc_id", *alike), least, alike, hot, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return out.unionByName(every.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, the one with the least id, with all its columns; of rows that repeat an id one stays."""
    gone = sp.written(group(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")), "gone")
    key = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(gone, key == F.col("__gone"), "left_anti")
    if docs_repeat(docs.select(key.alias("doc_id")).filter("doc_id IS NOT NULL")):
        kept = kept.filter(key.isNotNull()).dropDuplicates([id_col]).unionByName(kept.filter(key.isNull()))
    return kept
