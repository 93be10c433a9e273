"""Toxicity: a convolutional text classifier in numpy with thresholds calibrated by language.

Words (ASCII lower case, punctuation dropped) and their proper prefixes of 4 to 7 bytes are hashed
into buckets with an embedding each. Filters of widths 1 to 3 slide over the words of the whole
text and others of width 1 over the prefixes; each filter's largest value goes into a logistic
output. Embeddings begin with the z-score of the bucket's toxic documents as one coordinate, which
half of the filters look at first; everything is then trained by Adam on a bounded sample.

Several networks each leave out a part of that sample and are trained in tasks of their own, and a
score is their mean. All labelled rows are scored to choose a threshold for each language at the
labels' true ratio, sampled ones by the network that hasn't seen them; languages with few toxic rows
lean on the common counts. A threshold needs evidence: the rows at or above it must be toxic by
more than a half, as seen from the base rate; where none is, hardly any score passes. Scores are
stretched so that every language's threshold lies at 0.7. The language comes from function words of
the text itself.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, cut, fold, give_back, kept_rows, labelled, sigmoid, take_over

#: Labelled rows that a model is fitted on, at most (half of them toxic, if there are as many).
FIT_ROWS = 6_000
#: Bytes of their bucket ids, at most: in order of the hashes, as many rows as fit.
FIT_BYTES = 1 << 27
BUCKETS, WIDE, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
#: Zero rows behind each text: as many as the widest filter, so that one whole window is padding.
PAD = max(WIDTHS)
NEVER = np.float32(-1e9)
EPOCHS, BATCH, STEP, DECAY = 10, 64, 0.003, 1e-3
#: z-score that chance reaches in a long text.
CHANCE = 3
ACCEPT = 0.7
#: Networks, each fitted without its own part of the sample.
NETWORKS = 4
#: Toxic rows that the common counts weigh as in each language's calibration.
LEAN = 8
#: What a threshold's posterior precision must pass, and the rows that the base rate counts as.
PRECISION, DOUBT = 0.5, 2
#: Bits of a filter on labelled ids.
FILTER_BITS = 1 << 23
#: Equal bins of raw scores between 0 and 1, in which labelled rows are counted.
SCORE_BINS = 1 << 12

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with be by on not he as are this from",
    "de": "der die und das den von zu nicht mit sich des auf ist im dem ein eine als auch es",
    "fr": "le la les de et des un une du en que est dans pour au qui sur par ce pas",
    "es": "el la de que y los se del las un por con no una su para es al lo como",
}

#: Counted by language (0: none), label and score bin.
COUNTS = (len(FUNCTION_WORDS) + 1, 2, SCORE_BINS)

SPACE = np.ones(256, bool)
SPACE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, 1 + prefixes) bucket ids from 1, and each text's first place (and the end). Behind
    each text stand PAD rows of zeros; a word without such a prefix has a zero for it."""
    words = Words([t.lower() for t in texts], SPACE)
    number = np.diff(words.first)
    first = np.concatenate(([0], np.cumsum(number + PAD)))
    ids = np.zeros((first[-1], 1 + len(PREFIXES)), np.uint16)
    place = np.arange(len(words.hashes)) + PAD * np.repeat(np.arange(len(texts)), number)
    ids[place, 0] = 1 + (words.hashes >> np.uint64(49))
    length = words.stop - words.start
    for j, k in enumerate(PREFIXES, 1):
        long = length > k
        ids[place[long], j] = 1 + (words.prefixes(k, long) >> np.uint64(49))
    return ids, first


def language_table() -> np.ndarray:
    """For each bucket the language (from 1) whose function word it holds; 0: none, or several."""
    table = np.zeros(BUCKETS + 1, np.int8)
    seen: dict[int, set[int]] = {}
    for k, text in enumerate(FUNCTION_WORDS.values(), 1):
        for b in buckets([text.encode()])[0][:-PAD, 0]:
            seen.setdefault(int(b), set()).add(k)
    for b, k in seen.items():
        if len(k) == 1:
            table[b] = k.pop()
    return table


def languages(ids: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The language with most function words in each text; 0 without any."""
    kind = table[ids[:, 0]]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    wide = len(FUNCTION_WORDS) + 1
    count = np.bincount(owner * wide + kind, minlength=(len(first) - 1) * wide).reshape(-1, wide)[:, 1:]
    return np.where(count.max(axis=1) > 0, count.argmax(axis=1) + 1, 0)


class Network:
    def __init__(self, odds: np.ndarray):
        rng = np.random.default_rng(11)
        self.e = rng.normal(0, 0.05, (BUCKETS + 1, WIDE)).astype(np.float32)
        self.e[:, 0] = odds
        self.e[0] = 0
        self.w = [rng.normal(0, 0.1, (w, WIDE, FILTERS)).astype(np.float32) for w in (*WIDTHS, 1)]
        for w in self.w:
            w[0, 0, : FILTERS // 2] += 0.5
        self.b = np.zeros(len(self.w) * FILTERS, np.float32)
        self.o = np.full(len(self.w) * FILTERS, 0.3, np.float32)
        self.c = np.full(1, -1.0, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.e, *self.w, self.b, self.o, self.c]

    def tables(self) -> list[list[np.ndarray]]:
        """What a bucket adds to each filter of each width at each place."""
        return [[self.e @ part for part in w] for w in self.w]

    def maps(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        """(places, filters) for each width, a window at each place that lies in its text and
        padding, others never the largest; then for prefixes, each place's largest."""
        word = ids[:, 0]
        for parts in tables[:-1]:
            out = parts[0][word]
            for j, part in enumerate(parts[1:], 1):
                out[:-j] += part[word[j:]]
            for j in range(1, len(parts)):
                out[first[1:] - j] = NEVER
            yield out
        out = tables[-1][0][ids[:, 1]]
        for j in range(2, ids.shape[1]):
            np.maximum(out, tables[-1][0][ids[:, j]], out=out)
        yield out

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Every text has PAD places at least, so that no segment is empty."""
        return np.concatenate([np.maximum.reduceat(m, first[:-1], axis=0) for m in self.maps(ids, first, tables)], axis=1) + self.b

    def raw(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        return sigmoid(np.maximum(self.pooled(ids, first, tables), 0) @ self.o + self.c[0])

    def train(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        params = self.params()
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = np.where(y == 1, min(4.0, (len(y) - y.sum()) / max(y.sum(), 1)), 1.0)
        step, start = 0, self.e.copy()
        for epoch in range(EPOCHS):
            rate = STEP * (1 - epoch / EPOCHS)
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                ids = np.concatenate([texts[i] for i in pick])
                first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick])))
                where, top = [], []
                tables = self.tables()
                for m in self.maps(ids, first, tables):
                    peak = np.stack([m[a:b].argmax(axis=0) + a for a, b in zip(first[:-1], first[1:], strict=True)])
                    where.append(peak)
                    top.append(m[peak, np.arange(FILTERS)])
                z = np.concatenate(top, axis=1) + self.b
                act = np.maximum(z, 0)
                d = ((sigmoid(act @ self.o + self.c[0]) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads = [np.zeros_like(p) for p in params]
                dz = d[:, None] * self.o * (z > 0)
                grads[-3], grads[-2], grads[-1] = dz.sum(axis=0), act.T @ d + 1e-4 * self.o, d.sum(keepdims=True)
                for k, (w, peak) in enumerate(zip(self.w, where, strict=True)):
                    g = dz[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(w)):
                        if k < len(WIDTHS):
                            b = ids[np.minimum(peak + j, len(ids) - 1), 0]
                        else:  # the prefix that was largest there
                            own = ids[peak, 1:]
                            which = tables[k][0][own, np.arange(FILTERS)[None, :, None]].argmax(axis=2)
                            b = np.take_along_axis(own, which[..., None], 2)[..., 0]
                        np.add.at(grads[0], b.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, WIDE))
                        grads[1 + k][j] = np.einsum("nf,nfe->ef", g, self.e[b])
                grads[0] += DECAY * (self.e - start) / BATCH
                grads[0][0] = 0
                step += 1
                for p, q, m, s in zip(params, grads, mean, square, strict=True):
                    m += 0.1 * (q - m)
                    s += 0.01 * (q * q - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The middle of the gap at which F1 is largest, the largest such gap in a tie, among those whose
    posterior precision passes PRECISION; else the middle between the largest score and 1.
    ``weight``: the rows that each entry stands for, one by default."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    weight = np.ones(len(p)) if weight is None else weight[order]
    right, said = np.cumsum(y * weight), np.cumsum(weight)
    low = np.append(p[1:], 0.0)
    base = right[-1] / said[-1]
    some = np.flatnonzero((p != low) & ((right + DOUBT * base) / (said + DOUBT) > PRECISION))
    if not len(some):
        return float(np.clip((p[0] + 1) / 2, 0.02, 0.98))
    f1 = (2 * right / (said + right[-1])).round(4)
    return float(np.clip(max((f1[i], p[i] - low[i], (p[i] + low[i]) / 2) for i in some)[2], 0.02, 0.98))


def bins(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * SCORE_BINS).astype(int), SCORE_BINS - 1)


def trained(k: int, texts: list[np.ndarray], y: np.ndarray) -> Network:
    """Network ``k``, fitted without each NETWORKS-th row from the k-th on."""
    fit = np.flatnonzero(np.arange(len(y)) % NETWORKS != k)
    seen = [np.bincount(np.concatenate([np.unique(texts[i]) for i in fit if y[i] == j] or [np.zeros(0, int)]), minlength=BUCKETS + 1) for j in (0, 1)]
    expected = (seen[0] + seen[1]) * (y[fit].mean() if len(fit) else 0.0)
    net = Network(np.clip(((seen[1] - expected) / np.sqrt(expected + 1) - CHANCE) / 2, -1, 2))
    net.train([texts[i] for i in fit], y[fit])
    return net


def trained_in_tasks(sample: DataFrame) -> list[Network]:
    """The networks of ``sample`` (ids binary, y, place: its rows' order), each in a task of its
    own, which holds the bounded sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        take_over()
        rows = rows.sort_values("place")
        net = trained(int(rows["net"].iloc[0]), [unpacked(b) for b in rows["ids"]], rows["y"].to_numpy(float))
        to = io.BytesIO()
        np.savez(to, *net.params())
        done = pd.DataFrame({"net": [int(rows["net"].iloc[0])], "params": [to.getvalue()]})
        del rows, net
        give_back()
        return done

    each = sample.select("ids", "y", "place", F.explode(F.array(*[F.lit(k) for k in range(NETWORKS)])).alias("net"))
    nets = []
    # NETWORKS rows of a fixed size
    for row in sorted(each.groupBy("net").applyInPandas(run, "net int, params binary").collect()):
        net = Network(np.zeros(BUCKETS + 1))
        with np.load(io.BytesIO(row["params"])) as held:
            for p, name in zip(net.params(), held.files, strict=True):
                p[...] = held[name]
        nets.append(net)
    return nets


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2").reshape(-1, 1 + len(PREFIXES))


def thresholds(counts: np.ndarray) -> np.ndarray:
    """Thresholds by language from the numbers of rows by (language, label, score bin)."""
    counts = np.asarray(counts, float)
    middle = np.tile((np.arange(SCORE_BINS) + 0.5) / SCORE_BINS, 2)
    label = np.repeat([0.0, 1.0], SCORE_BINS)
    common = counts.sum(axis=0)
    mixed = (counts + common * LEAN / max(common[1].sum(), 1)).reshape(len(counts), -1)
    return np.array([best_threshold(middle[c > 0], label[c > 0], c[c > 0]) for c in mixed])


class Model:
    """Trained networks and thresholds. Without both labels: a constant score.

    ``part`` has the network that hasn't seen each row. The networks are trained and thresholds taken
    from these rows where they are first asked for, if they weren't given before: ``learn`` sets
    ``nets`` and lets ``calibrate`` take thresholds from counts of all labelled rows.
    """

    def __init__(self, texts: list[np.ndarray], y: np.ndarray):
        self.texts, self.y = texts, y
        self.part = np.arange(len(y)) % NETWORKS
        one = not len(y) or y.min() == y.max()
        self.constant = float((y.sum() + 1) / (len(y) + 2)) if one else None

    @functools.cached_property
    def nets(self) -> list[Network]:
        return [trained(k, self.texts, self.y) for k in range(NETWORKS)]

    @functools.cached_property
    def threshold(self) -> np.ndarray:
        counts, tables, table = np.zeros(COUNTS), [n.tables() for n in self.nets], language_table()
        for at in range(0, len(self.texts), BATCH):  # few texts at once, as the maps are wide
            some = self.texts[at : at + BATCH]
            ids, first = np.concatenate(some), np.concatenate(([0], np.cumsum([len(t) for t in some])))
            np.add.at(counts, (languages(ids, first, table), self.y[at : at + BATCH].astype(int), bins(self.raw(ids, first, tables, self.part[at : at + BATCH]))), 1)
        return thresholds(counts)

    def calibrate(self, counts: np.ndarray) -> None:
        """Takes thresholds from the numbers of rows by (language, label, score bin)."""
        self.threshold = thresholds(counts)

    def raw(self, ids: np.ndarray, first: np.ndarray, tables: list, part: np.ndarray | None = None) -> np.ndarray:
        """Mean scores of the networks, or that of network ``part`` where it isn't -1."""
        each = np.stack([net.raw(ids, first, t) for net, t in zip(self.nets, tables, strict=True)])
        mean = each.mean(axis=0)
        return mean if part is None else np.where(part < 0, mean, each[part, np.arange(len(part))])

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        tables, table = [n.tables() for n in self.nets], language_table()

        def run(texts: list[bytes]) -> np.ndarray:
            ids, first = buckets(texts)
            p, t = self.raw(ids, first, tables), self.threshold[languages(ids, first, table)]
            return np.where(p < t, p / t * ACCEPT, ACCEPT + (p - t) / (1 - t) * (1 - ACCEPT))

        return run


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    """A model from labelled rows outside the held-out fold, FIT_ROWS and FIT_BYTES at most: those
    with the smallest hashes of their ids, half of them toxic if there are as many. Texts come to
    the driver as bucket ids; of rows with the same id one text counts. Thresholds are of all
    labelled rows outside the held-out fold."""
    known = labelled(labels, "toxic").filter(fold("doc_id", folds) != held_out)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.filter("y = 1").orderBy(*order).limit(FIT_ROWS // 2)
    clean = known.filter("y = 0").orderBy(*order).limit(FIT_ROWS - FIT_ROWS // 2)
    chosen = F.broadcast(toxic.unionByName(clean))  # FIT_ROWS small rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "text", "y")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            ids, first = buckets(texts)
            parts = [ids[a:b].astype("<u2").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), batch.column(2)], names=["doc_id", "ids", "y"])

    once = cut(rows.mapInArrow(run, "doc_id long, ids binary, y int").groupBy("doc_id", "y").agg(F.min("ids").alias("ids")))
    sizes = once.select("doc_id", F.octet_length("ids").alias("size"), F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    fits = sizes["doc_id"][sizes["size"].cumsum() <= FIT_BYTES]
    ids = fits.to_numpy(np.int64)[np.random.default_rng(3).permutation(len(fits))]
    # FIT_ROWS small rows at most
    places = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": ids, "place": np.arange(len(ids))}), "doc_id long, place long"))
    sample = once.join(places, "doc_id")
    some = sample.toPandas().sort_values("place")
    model = Model([unpacked(b) for b in some["ids"]], some["y"].to_numpy(float))
    if model.constant is None:
        model.nets, model.texts = trained_in_tasks(sample), []  # the model goes to the executors
        model.calibrate(label_counts(docs.filter(fold("doc_id", folds) != held_out), known, model, ids))
    return model


def id_filter(known: DataFrame) -> np.ndarray:
    """Bits by the hash of an id, set for those of ``known``; of a fixed size."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = known.groupBy(F.shiftright(h, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))).alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return bits


def label_counts(docs: DataFrame, known: DataFrame, model: Model, sampled: np.ndarray) -> np.ndarray:
    """The rows of ``docs`` with a label in ``known`` by (language, label, score bin). sampled: the
    ids that the model was fitted on, in its order. Rows are scored where they lie, if a filter of a
    fixed size doesn't rule out that they have a label; only ids, languages and bins meet the
    labels."""
    order = np.argsort(sampled)
    ids_of, part_of = sampled[order].astype(np.int64), model.part[: len(sampled)][order]
    labelled_ids = id_filter(known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, table = [n.tables() for n in model.nets], language_table()
        for whole in it:
            h = whole.column(2).to_numpy()
            some = whole.filter(pa.array((labelled_ids[h >> 6] >> (h & 63)) & 1 == 1))
            for batch, texts in batches(iter([some])):
                ids, first = buckets(texts)
                own = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], np.int64)
                part = np.full(len(own), -1)
                if len(ids_of):
                    at = np.minimum(np.searchsorted(ids_of, own), len(ids_of) - 1)
                    part = np.where(ids_of[at] == own, part_of[at], -1)
                cols = (languages(ids, first, table), bins(model.raw(ids, first, tables, part)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype("i4")) for c in cols]], names=["doc_id", "lang", "bin"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    found = keyed.mapInArrow(run, "doc_id long, lang int, bin int").join(known, "doc_id")
    counts = np.zeros(COUNTS)
    # a row for each cell of COUNTS at most
    for lang, y, at, n in found.groupBy("lang", "y", "bin").count().collect():
        counts[lang, y, at] = n
    return counts


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null texts count as empty; an empty text has a score too. Equal texts have equal scores. With
    no usable labels every score is the same. Held out is false for a null id.
    """
    model = learn(docs, labels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch, texts in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(texts), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` doesn't predict 1 for."""
    model = learn(docs, labels)

    def scorer():
        of = model.scorer()
        return lambda texts: of(texts) < ACCEPT

    return kept_rows(docs, scorer)
