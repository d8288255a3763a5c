"""Vector search, classifiers, clustering, sequence models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vector as v
from textloom.operators.mining import connected


def nearest(vectors: DataFrame, queries: DataFrame, top_k: int = 10, block: int = 20_000, query_block: int = 10_000, tile: int = 256) -> DataFrame:
    """The most similar vectors (id, vec) of each query (qid, vec) by cosine, ties (to nine places) by id; a query isn't its own neighbour.

    Exact: each block of queries meets each block of vectors as a product of matrices, from which only every query's best
    are kept. The zero vector has a cosine of 0 with all others; rows without a vector are left out.
    """

    def dealt(rows: DataFrame, key: str, size: int, own: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // size))
        return rows.filter("vec IS NOT NULL").select(key, v.unit(F.col("vec")).alias("vec"), F.pmod(F.xxhash64(key, "vec"), F.lit(blocks)).cast("long").alias(own)), blocks

    rows, n_rows = dealt(vectors, "id", block, "p")
    asked, n_asked = dealt(queries, "qid", query_block, "q")
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)).cast("array<long>")))
    asked = asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<long>")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = left["id"].to_numpy(), np.stack(left["vec"].to_numpy())
            qids, y = right["qid"].to_numpy(), np.stack(right["vec"].to_numpy())
            for at in range(0, len(y), tile):
                cosine = y[at : at + tile] @ x.T
                cosine[qids[at : at + tile, None] == ids] = -np.inf
                place = np.round(cosine, 9)
                least = np.partition(place, -top_k, axis=1)[:, -top_k] if top_k < len(x) else place.min(axis=1)
                for i, row in enumerate(place):
                    found = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                    found = found[np.lexsort((ids[found], -row[found]))[:top_k]]
                    out.append(pd.DataFrame({"qid": qids[at + i], "id": ids[found], "cosine": cosine[i, found], "place": row[found]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": right["qid"][:0], "id": left["id"][:0], "cosine": np.zeros(0), "place": np.zeros(0)})

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}"
    best = rows.groupBy("p", "q").cogroup(asked.groupBy("p", "q")).applyInPandas(run, f"{kinds}, cosine double, place double")
    w = Window.partitionBy("qid").orderBy(F.desc("place"), "id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_k).select("qid", "id", "cosine", "rank")


def centroids(rows: DataFrame) -> DataFrame:
    """label, i, value: the mean vector of each label from (id, label, i, value) at the grain of components."""
    n = rows.groupBy("label").agg(F.countDistinct("id").alias("n"))
    return rows.groupBy("label", "i").agg(F.sum("value").alias("s")).join(n, "label").select("label", "i", (F.col("s") / F.col("n")).alias("value"))


def centroid_classify(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """id and the label of the centroid with the highest cosine, over sparse components."""
    norm = centres.groupBy("label").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    own = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("own"))
    dots = rows.select("id", "i", "value").join(centres.select("label", "i", F.col("value").alias("c")), "i").groupBy("id", "label").agg(F.sum(F.col("value") * F.col("c")).alias("dot"))
    scored = dots.join(norm, "label").join(own, "id").select("id", "label", (F.col("dot") / F.col("norm") / F.col("own")).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "label")
    return scored.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", F.col("label").alias("predicted"), "cosine")


def chi_square_features(vectors: DataFrame, labels: DataFrame, least_df: int = 10) -> DataFrame:
    """label, term, chi2 from (doc_id, term) and (doc_id, label)."""
    seen = vectors.select("doc_id", "term").join(labels, "doc_id")
    size = labels.groupBy("label").agg(F.count("*").alias("nl"))
    total = labels.agg(F.count("*").alias("n"))
    df = seen.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    both = df.join(size).join(seen.groupBy("term", "label").agg(F.count("*").alias("a")), ["term", "label"], "left").join(F.broadcast(total))
    a = F.coalesce("a", F.lit(0)).cast("double")
    return both.select("label", "term", v.chi_square(a, F.col("df") - a, F.col("nl") - a, F.col("n") - F.col("df") - F.col("nl") + a).alias("chi2"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Per label precision, recall and F1 of (label, predicted), and the micro average as label ``all``."""
    labels = predictions.select("label").union(predictions.select("predicted")).distinct()
    tp = predictions.filter("label = predicted").groupBy("label").agg(F.count("*").alias("tp"))
    pred = predictions.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("pp"))
    real = predictions.groupBy("label").agg(F.count("*").alias("p"))
    rows = labels.join(tp, "label", "left").join(pred, "label", "left").join(real, "label", "left").na.fill(0)
    rows = rows.unionByName(rows.agg(F.lit("all").alias("label"), F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("p").alias("p")))
    p, r = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    return rows.select("label", "tp", "pp", "p", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def k_means(vectors: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """id, cluster: spherical k-means of (id, vec)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


#: So many pairs of near vectors at most are kept as lists; with more, a cluster is held against all others anew.
NEAR = 20_000_000


def near_lists(x: np.ndarray, least: float, tile: int = 500) -> list[np.ndarray] | None:
    """The rows whose cosine with each row is at least ``least`` (single precision: or up to 1e-5 below)."""
    small, out, held = x.astype(np.float32), [], 0
    for at in range(0, len(x), tile):
        near = small[at : at + tile] @ small.T >= least - 1e-5
        held += int(near.sum())
        if held > NEAR:
            return None
        out += [np.flatnonzero(row).astype(np.int32) for row in near]
    return out


class _Clusters:
    """What linkages need of clusters of unit vectors, without a matrix of all pairs.

    The average of two clusters' cosines is the product of their sums over that of their sizes; for max and min linkage
    it is made of the members' vectors, ``tile`` at a time.
    """

    def __init__(self, x: np.ndarray, size: np.ndarray, least: float, linkage: str, tile: int = 256):
        self.x, self.size, self.linkage, self.tile = x, size.astype(float), linkage, tile
        self.sums = x * self.size[:, None]
        self.of, self.live = np.arange(len(x)), np.ones(len(x), bool)
        self.members = {i: [i] for i in range(len(x))}
        self.near = near_lists(x, least)

    def others(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The clusters that can be linked with cluster i, and their linkage."""
        if self.near is None:
            found = np.flatnonzero(self.live)
        else:
            found = np.unique(self.of[np.concatenate([self.near[k] for k in self.members[i]])])
            found = found[self.live[found]]
        found = found[found != i]
        if self.linkage == "average":
            return found, self.sums[found] @ self.sums[i] / (self.size[found] * self.size[i])
        better, worst = (np.maximum, -np.inf) if self.linkage == "max" else (np.minimum, np.inf)
        rows = np.concatenate([self.members[k] for k in found.tolist()]).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        each, own = np.full(len(rows), worst), self.members[i]
        for at in range(0, len(own), self.tile):
            part = self.x[rows] @ self.x[own[at : at + self.tile]].T
            each = better(each, part.max(1) if self.linkage == "max" else part.min(1))
        starts = np.cumsum([0, *(len(self.members[k]) for k in found.tolist())])[:-1]
        return found, better.reduceat(each, starts) if len(found) else each

    def merge(self, i: int, j: int) -> None:
        """Cluster j becomes part of i."""
        self.sums[i] += self.sums[j]
        self.of[self.members[j]] = i
        self.members[i] += self.members.pop(j)
        self.size[i] += self.size[j]
        self.live[j] = False


def clusters_of(x: np.ndarray, size: np.ndarray, least: float, linkage: str) -> np.ndarray:
    """Each row's cluster (its least row), by chains of nearest neighbours.

    A chain ends in two clusters that are each other's nearest; with these linkages a merger brings no cluster nearer to
    a third, so merging them at once gives the same clusters as always merging the nearest of all, but for ties. For the
    same reason a cluster whose nearest is below ``least`` is done. Memory is that of the vectors and ``NEAR`` pairs.
    """
    c, chain = _Clusters(x, size, least, linkage), []
    for start in range(len(x)):
        while c.live[start] or chain:
            i = chain[-1] if chain else start
            chain = chain or [i]
            found, link = c.others(i)
            best = int(np.argmax(link)) if len(found) else -1
            before = chain[-2] if len(chain) > 1 else -1
            if best >= 0 and before >= 0:
                at = np.flatnonzero(found == before)
                best = int(at[0]) if len(at) and link[at[0]] >= link[best] - 1e-12 else best
            if best < 0 or link[best] < least:
                c.live[i] = False
                chain.pop()
            elif found[best] == before:
                del chain[-2:]
                c.merge(*sorted((i, before)))
            else:
                chain.append(int(found[best]))
    return c.of


def agglomerate(vectors: DataFrame, least: float = 0.5, linkage: str = "average") -> DataFrame:
    """Hierarchical clustering inside blocks (block, id, vec): id and cluster (its least id). A block's vectors are held by one task, not a matrix of their pairs.

    A column n, if there is one, is how many equal vectors a row stands for.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        of = clusters_of(x, pdf["n"].to_numpy(float) if "n" in pdf else np.ones(len(x)), least, linkage)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster": pdf["id"].to_numpy()[of]})

    return vectors.groupBy("block").applyInPandas(run, "id long, cluster long")


def links_above(vectors: DataFrame, least: float, block: int = 8000, tile: int = 1000) -> DataFrame:
    """Links (a, b) with the components of all pairs of vectors (id, vec; none zero) whose cosine is at least ``least``.

    Every block of rows meets every other one, which is quadratic work; each tile of a pair of blocks returns a forest of
    its pairs. Cosines are of single precision, so links may also hold pairs up to 1e-5 below.
    """
    blocks = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")
    each = vectors.select("id", v.unit(F.col("vec")).cast("array<float>").alias("vec"), own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = each.select("id", "vec", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, of = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()), pdf["own"].to_numpy()
        left, right = np.flatnonzero(of == pdf["p"].iat[0]), np.flatnonzero(of == pdf["q"].iat[0])
        out = []
        for i in range(0, len(left), tile):
            for j in range(0, len(right), tile):
                row, col = left[i : i + tile], right[j : j + tile]
                near = x[row] @ x[col].T >= least - 1e-5
                near &= row[:, None] != col
                if not near.any():
                    continue
                # the least place in each one's component: rows first, then columns
                top, side, far = np.arange(len(row)), np.arange(len(row), len(row) + len(col)), len(row) + len(col)
                while True:
                    new_side = np.minimum(side, np.where(near, top[:, None], far).min(axis=0))
                    new_top = np.minimum(top, np.where(near, new_side, far).min(axis=1))
                    if (new_side == side).all() and (new_top == top).all():
                        break
                    top, side = new_top, new_side
                both = ids[np.concatenate([row, col])]
                out.append(pd.DataFrame({"a": both, "b": both[np.concatenate([top, side])]}))
        links = pd.concat(out) if out else pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        return links[links["a"] != links["b"]]

    found = dealt.groupBy("p", "q").applyInPandas(run, "a long, b long")
    return found.checkpoint() if vectors.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else found.persist()


def agglomerate_all(vectors: DataFrame, least: float = 0.5, linkage: str = "average", block: int = 8000) -> DataFrame:
    """Hierarchical clustering of all vectors (id, vec; ids are distinct): id and cluster (its least id).

    Two clusters are only merged if their linkage is at least ``least``, and then some pair between them is: so with
    average, max and min linkage, for a positive ``least``, clustering inside the components of such pairs is the same as
    over all rows (but for ties within rounding). Equal vectors are merged beforehand, as they are the most similar.
    One component's vectors are held by one task.
    """
    if least <= 0:
        raise ValueError("least must be positive")
    vectors = vectors.select("id", "vec")
    full = vectors.filter(F.exists("vec", lambda x: x != 0))
    unlike = full.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).persist()
    parts = connected(links_above(unlike, least, block))
    merged = agglomerate(unlike.join(parts.select(F.col("node").alias("id"), F.col("least").alias("block")), "id"), least, linkage)
    stand = unlike.join(merged, "id", "left").select("vec", F.coalesce("cluster", "id").alias("cluster"))
    return vectors.join(stand, "vec", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def word_vectors(docs: DataFrame, size: int = 16, least: int = 20, rounds: int = 1, share: int = 16 << 20):
    """A skip-gram model of the words of (text), on the library's trainer.

    A partition trains on about ``share`` characters and the library averages the partitions' vectors each round, so the
    longest task doesn't grow with the texts.
    """
    from pyspark.ml.feature import Word2Vec

    from textloom.functions.text import sentences

    parts = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // share))
    rows = docs.select(F.explode(sentences(F.col("text"))).alias("words"))
    return Word2Vec(vectorSize=size, minCount=least, inputCol="words", outputCol="v", seed=1, maxIter=rounds, numPartitions=parts).fit(rows)


def transitions(sequences: DataFrame) -> DataFrame:
    """prev, tag, n, p: maximum-likelihood transitions of rows (seq, pos, tag); sequences begin in <s>."""
    w = Window.partitionBy("seq").orderBy("pos")
    pairs = sequences.select(F.coalesce(F.lag("tag").over(w), F.lit("<s>")).alias("prev"), "tag")
    n = pairs.groupBy("prev", "tag").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def emissions(sequences: DataFrame) -> DataFrame:
    """tag, word, n, p of rows (seq, pos, tag, word)."""
    n = sequences.groupBy("tag", "word").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("tag")))


def viterbi(start: np.ndarray, move: np.ndarray, emit: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The likeliest states of a sequence of word numbers, in log space."""
    with np.errstate(divide="ignore"):
        start, move, emit = np.log(start), np.log(move), np.log(emit)
    score, back = start + emit[:, words[0]], []
    for w in words[1:]:
        each = score[:, None] + move
        back.append(each.argmax(0))
        score = each.max(0) + emit[:, w]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def baum_welch(words: list[np.ndarray], states: int, kinds: int, rounds: int = 20, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities of a hidden Markov model by expectation-maximisation, scaled."""
    rng = np.random.default_rng(seed)
    start, move, emit = (rng.random(s) + 0.5 for s in ((states,), (states, states), (states, kinds)))
    start, move, emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    for _ in range(rounds):
        s, m, e = np.full(states, 1e-9), np.full_like(move, 1e-9), np.full_like(emit, 1e-9)
        for seq in words:
            a, scale = np.zeros((len(seq), states)), np.zeros(len(seq))
            for t, w in enumerate(seq):
                a[t] = (start if t == 0 else a[t - 1] @ move) * emit[:, w]
                scale[t] = a[t].sum()
                a[t] /= scale[t]
            b = np.ones((len(seq), states))
            for t in range(len(seq) - 2, -1, -1):
                b[t] = move @ (emit[:, seq[t + 1]] * b[t + 1]) / scale[t + 1]
                m += np.outer(a[t], emit[:, seq[t + 1]] * b[t + 1]) * move / scale[t + 1]
            g = a * b
            s += g[0]
            np.add.at(e.T, seq, g)
        start, move, emit = s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
    return start, move, emit


def span_f1(tags: DataFrame) -> DataFrame:
    """Exact-match precision, recall and F1 of BIO spans: rows (seq, pos, gold, found)."""
    def spans(col: str) -> DataFrame:
        w = Window.partitionBy("seq").orderBy("pos")
        begins = F.col(col).startswith("B-") | (F.col(col).startswith("I-") & (F.coalesce(F.substr(F.lag(col).over(w), F.lit(3)), F.lit("")) != F.substr(F.col(col), F.lit(3))))
        island = F.sum(F.when(begins, 1).otherwise(0)).over(w)
        rows = tags.select("seq", "pos", F.col(col).alias("t"), island.alias("span")).filter("t <> 'O'")
        return rows.groupBy("seq", "span").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.first(F.substr("t", F.lit(3))).alias("kind")).select("seq", "a", "b", "kind")

    gold, found = spans("gold"), spans("found")
    hit = gold.join(found, ["seq", "a", "b", "kind"]).agg(F.count("*").alias("hits"))
    rows = hit.join(gold.agg(F.count("*").alias("gold"))).join(found.agg(F.count("*").alias("found")))
    p, r = (F.coalesce(F.try_divide("hits", F.col(c)), F.lit(0.0)) for c in ("found", "gold"))
    return rows.select("gold", "found", "hits", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
