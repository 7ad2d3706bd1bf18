"""Toxicity scores by a small convolutional text classifier, trained here with numpy.

Words are hashed into buckets with an embedding each. Filters of several widths slide over the words, their largest
responses in a text feed a logistic output. Scoring multiplies embeddings and filters once, so that a filter's response
is a sum of table rows. Training reads all labelled rows, in parts side by side; every whole text is scored. Neither
language, source nor doc_id is an input of a score; a language only has its own threshold, calibrated on rows kept out of training.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldtide.llm.work import release, saved, written

BUCKETS = 1 << 20
USUAL_CUT = 0.3
CUTS = 4096  # steps of a score between which a threshold may lie
SCALE = float(1 << 32)
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 39 else 32 for c in range(256)
)


class WordBuckets(dict):
    """Bucket of a word by CRC-32, or with ``known`` (sorted buckets) its row in the embedding, 0 for all others.

    Words are remembered; ``most`` bounds that memory, not the words.
    """

    def __init__(self, known: np.ndarray | None = None, most: int = 1 << 18):
        super().__init__()
        self.rows = None
        if known is not None:
            self.rows = np.zeros(BUCKETS, np.int32)
            self.rows[known] = np.arange(1, known.size + 1)
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = 1 + zlib.crc32(word) % (BUCKETS - 1)  # 0 pads short texts
        if self.rows is not None:
            found = int(self.rows[found])
        self[word] = found
        return found


def known_buckets(texts: list[np.ndarray], least: int = 2) -> np.ndarray:
    """Buckets in at least ``least`` texts. Rarer ones teach nothing and share row 0, which is all zeros."""
    buckets, counts = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    return buckets[(counts >= least) & (buckets > 0)]


def word_ids(text: bytes, buckets: WordBuckets, least: int) -> np.ndarray:
    """Buckets of all words (letters, digits, apostrophes), A-Z in lower case, padded to ``least`` words."""
    words = text.translate(_LETTERS).split()
    ids = np.zeros(max(least, len(words)), np.int32)
    ids[: len(words)] = np.fromiter(map(buckets.__getitem__, words), np.int32, len(words))
    return ids


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_CRC = _crc_table()


def words_of(texts: list[bytes], buckets: WordBuckets, least: int, block: int = 1 << 17, longest: int = 24) -> list[np.ndarray]:
    """``word_ids`` of every text. Blocks of texts are hashed at once, byte by byte of all their words; words of more than
    ``longest`` bytes one by one."""
    out: list[np.ndarray] = []
    first, size = 0, 0
    for last, text in enumerate(texts, 1):
        size += len(text) + 1
        if size >= block or last == len(texts):
            out += _hashed(texts[first:last], buckets, least, longest)
            first, size = last, 0
    return out


def _hashed(texts: list[bytes], buckets: WordBuckets, least: int, longest: int) -> list[np.ndarray]:
    raw = b"".join([b" " + t.translate(_LETTERS) for t in texts]) + b" "
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff((data != 32).view(np.int8))) + 1
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    crc = np.full(start.size, 0xFFFFFFFF, np.uint32)
    # The longest words come first, so that those with another byte are always the first ones.
    order = np.argsort(-np.minimum(size, longest + 1).astype(np.int16), kind="stable")
    order = order[int(np.count_nonzero(size > longest)) :]
    at, state = start[order], crc[order]
    more = np.cumsum(np.bincount(size[order], minlength=longest + 1)[::-1])[::-1]
    for k in range(longest):
        n = int(more[k + 1])
        if not n:
            break
        now = state[:n]
        state[:n] = _CRC[(now ^ data[at[:n] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc[order] = ~state
    for k in np.flatnonzero(size > longest).tolist():
        crc[k] = zlib.crc32(raw[start[k] : start[k] + size[k]])
    ids = (crc % np.uint32(BUCKETS - 1) + np.uint32(1)).astype(np.int32)
    if buckets.rows is not None:
        ids = buckets.rows[ids]
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = np.split(ids, np.searchsorted(start, ends[:-1]))
    return [x if x.size >= least else np.append(x, np.zeros(least - x.size, np.int32)) for x in out]


@dataclass
class TextCnn:
    """Embeddings of the known buckets, one filter bank (width, size, filters) per width, biases, and the output layer."""

    known: np.ndarray
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @classmethod
    def start(cls, known: np.ndarray, widths=(1, 2, 3), size: int = 8, filters: int = 6, seed: int = 7) -> "TextCnn":
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.1, (known.size + 1, size)).astype(np.float32)
        embed[0] = 0
        banks = [rng.normal(0, 0.5 / np.sqrt(w), (w, size, filters)).astype(np.float32) for w in widths]
        return cls(known, embed, banks, [np.zeros(filters, np.float32) for _ in widths],
                   rng.normal(0, 0.3, len(widths) * filters).astype(np.float32), -2.0)

    @property
    def widest(self) -> int:
        return max(b.shape[0] for b in self.banks)

    def tables(self) -> list[np.ndarray]:
        """Embedding times filter, for every place in every width."""
        return [np.einsum("vd,wdf->wvf", self.embed, bank) for bank in self.banks]

    def pooled(self, ids: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter and its place."""
        best, place = [], []
        for table, bias in zip(tables, self.biases):
            width = table.shape[0]
            count = ids.size - width + 1
            total = table[0][ids[:count]]
            for w in range(1, width):
                total = total + table[w][ids[w : w + count]]
            at = total.argmax(axis=0)
            best.append(total[at, np.arange(total.shape[1])] + bias)
            place.append(at)
        return np.concatenate(best), np.concatenate(place)

    def largest(self, ids: np.ndarray, tables: list[np.ndarray], block: int = 4096) -> np.ndarray:
        """Largest responses over a text of any length, in blocks that overlap by the widest filter."""
        step = block - self.widest + 1
        return np.max([self.pooled(ids[k : k + block], tables)[0] for k in range(0, max(1, ids.size - self.widest + 1), step)], axis=0)

    def score(self, ids: np.ndarray, tables: list[np.ndarray]) -> float:
        return self._logistic(self.largest(ids, tables))

    def _logistic(self, best: np.ndarray) -> float:
        z = float(np.maximum(best, 0) @ self.out) + self.out_bias
        return float(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))

    def stacked(self, tables: list[np.ndarray]) -> np.ndarray:
        """One row of all ``tables`` for each word: the first places of all filters, then their second ones, and so on."""
        return np.concatenate([t[w] for w in range(self.widest) for t in tables if w < t.shape[0]], axis=1)

    def scores(self, texts: list[np.ndarray], tables: list[np.ndarray], rows: np.ndarray, block: int = 8192) -> list[float]:
        """``score`` of every text, in blocks of whole texts of about ``block`` words; longer texts go by themselves.
        ``rows`` are the ``stacked`` tables; widths ascend."""
        filters, widths = self.biases[0].size, [t.shape[0] for t in tables]
        bias, every = np.concatenate(self.biases), filters * len(tables)
        sizes = np.array([t.size for t in texts], np.int64)
        out: list[float] = []
        first = 0
        while first < len(texts):
            last = first + int(np.searchsorted(np.cumsum(sizes[first : first + block]), block, "right"))
            if last <= first:
                out.append(self.score(texts[first], tables))
                first += 1
                continue
            ends = np.cumsum(sizes[first:last])
            found = rows[np.concatenate(texts[first:last])]
            total, done = found[:, :every], every
            for w in range(1, self.widest):
                from_here = filters * sum(x <= w for x in widths)
                here = found[w:, done : done + every - from_here]
                total[: here.shape[0], from_here:] += here
                total[ends - w, from_here:] = -np.inf  # such a filter would reach into the next text
                done += here.shape[1]
            out += map(self._logistic, np.maximum.reduceat(total, ends - sizes[first:last], axis=0) + bias)
            first = last
        return out


def log_odds(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, size: int, strength: float = 8.0) -> np.ndarray:
    """How much likelier each row makes label 1, shrunk towards nothing by ``strength`` texts of the usual mix."""
    rows = np.zeros((2, size))
    for ids, label, weight in zip(texts, labels, weights):
        rows[int(label), np.unique(ids)] += weight
    usual = np.array([(weights * (labels == c)).sum() for c in (0, 1)]) / weights.sum()
    mixed = rows + strength * usual[:, None]
    return np.log(mixed[1] / mixed[0]) - np.log(usual[1] / usual[0])


def informed(known: np.ndarray, odds: np.ndarray, seed: int = 7) -> TextCnn:
    """The model that training starts from: log-odds in the first part of the embeddings, read by the first filter."""
    model = TextCnn.start(known, seed=seed)
    model.embed[:, 0] = odds
    model.embed[0] = 0
    model.banks[0][:, :, 0] = 0
    model.banks[0][0, 0, 0] = 1
    model.out[0], model.biases[0][0] = 3, -1.5
    return model


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 4, batch: int = 32,
          rate: float = 0.003, seed: int = 7, least_steps: int = 200, start: tuple[np.ndarray, np.ndarray] | None = None) -> TextCnn:
    """Adam on the weighted logistic loss, at least ``least_steps`` of it: a few rows are passed more often. Max pooling
    sends each filter's gradient to one place of a text.

    The first part of the embeddings starts as the words' log-odds in the training rows, which the first filter of the
    narrowest bank reads, so that rare telling words win the pooling from the start. ``texts`` hold buckets. ``start``
    gives the known buckets and their log-odds (row 0 in front) where ``texts`` are only a part of the training rows.
    """
    known = known_buckets(texts) if start is None else start[0]
    row = np.zeros(BUCKETS, np.int32)
    row[known] = np.arange(1, known.size + 1)
    texts = [row[t] for t in texts]
    weights = np.ones(len(texts)) if weights is None else weights
    odds = log_odds(texts, labels, weights, known.size + 1) if start is None else start[1]
    model, rng = informed(known, odds, seed), np.random.default_rng(seed)
    params = [model.embed, *model.banks, *model.biases, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    many, step = len(model.banks), 0
    widths = [bank.shape[0] for bank in model.banks]
    seen, place_of = np.zeros(known.size + 1, bool), np.zeros(known.size + 1, np.int32)
    for _ in range(max(epochs, -(-least_steps * batch // len(texts)))):
        order = rng.permutation(len(texts))
        for k in range(0, order.size, batch):
            chosen = order[k : k + batch]
            # Only words of the batch are touched: work on their rows of the embedding.
            ids = np.concatenate([texts[i] for i in chosen])
            seen[ids] = True
            rows = np.flatnonzero(seen)
            seen[rows], place_of[rows] = False, np.arange(rows.size)
            ids = place_of[ids]
            ends = np.cumsum([texts[i].size for i in chosen])
            starts = np.append(0, ends[:-1])
            embed = model.embed[rows]
            grads = [np.zeros((rows.size, embed.shape[1]), np.float32), *(np.zeros_like(p) for p in params[1:])]
            raw, place = [], []
            for bank, bias in zip(model.banks, model.biases):
                total = (bank[0].T @ embed.T)[:, ids]
                for w in range(1, bank.shape[0]):
                    total[:, :-w] += (bank[w].T @ embed.T)[:, ids[w:]]
                at = np.stack([total[:, a : b - bank.shape[0] + 1].argmax(axis=1) + a for a, b in zip(starts, ends)])
                raw.append(total[np.arange(at.shape[1]), at] + bias)
                place.append(at)
            raw = np.concatenate(raw, axis=1)
            act = np.maximum(raw, 0)
            z = np.clip(act @ model.out + model.out_bias, -30, 30)
            g = weights[chosen] * (1 / (1 + np.exp(-z)) - labels[chosen]) / chosen.size
            bias_grad = float(g.sum())
            grads[-1] += g @ act
            down = np.split((g[:, None] * model.out * (raw > 0)).astype(np.float32), many, axis=1)
            words, push = [], []
            for b, (bank, width, d, at) in enumerate(zip(model.banks, widths, down, place)):
                grads[1 + many + b] += d.sum(axis=0)
                for w in range(width):
                    words.append(ids[at + w])
                    grads[1 + b][w] += np.einsum("tfd,tf->df", embed[words[-1]], d)
                    push.append(bank[w].T * d[:, :, None])
            np.add.at(grads[0], np.concatenate(words, axis=1), np.concatenate(push, axis=1))
            step += 1
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, (param, grad) in enumerate(zip(params, grads)):
                at = rows if p == 0 else slice(None)
                first[p][at] = 0.9 * first[p][at] + 0.1 * grad
                second[p][at] = 0.999 * second[p][at] + 0.001 * grad**2
                param[at] -= scale * first[p][at] / (np.sqrt(second[p][at]) + 1e-8)
            model.embed[0] = 0
            model.out_bias -= rate * bias_grad * 5
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 20, strength: float = 8.0,
              usual: float = USUAL_CUT, counts: np.ndarray | None = None) -> tuple[dict[str, float], float]:
    """Threshold of the best F1 over all rows, and for each language with ``least`` positive rows. With ``counts`` an entry
    stands for that many rows of one score, and its label is the number of positive ones.

    Few positive rows say little: the overall threshold is a mean with ``usual``, the cut of the score itself, a language's
    one with the overall one, where these count as ``strength`` positive rows.
    """

    counts = np.ones(len(scores)) if counts is None else counts

    def best(s: np.ndarray, y: np.ndarray, near: float, n: np.ndarray) -> float:
        if not y.any():
            return near
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.cumsum(n[order]) + y.sum())
        k = int(np.flatnonzero(f1 == f1.max())[-1])
        below = s[order[k + 1]] if k + 1 < s.size else 0.0
        cut = float(np.clip((s[order[k]] + below) / 2, 0.05, 0.95))
        return (cut * float(y.sum()) + near * strength) / (float(y.sum()) + strength)

    whole, by = best(scores, labels, usual, counts), {}
    names = np.array([x if x is not None else "" for x in langs])
    for lang in np.unique(names):
        here = names == lang
        if labels[here].sum() >= least:
            by[str(lang)] = best(scores[here], labels[here], whole, counts[here])
    return by, whole


def held_out(doc_id: str) -> Column:
    """CRC-32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4) == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, text: str = "text", doc_id: str = "doc_id",
                    extra: tuple[str, ...] = (), most_rows: int = 6_000, most_words: int = 3_000_000,
                    most_share: float = 0.05) -> list:
    """At most ``most_rows`` labelled rows outside the held-out quarter, in an order of hashed ids, with at most about
    ``most_words`` words in all: (text as bytes, label, calibration flag, extra columns). These bounds do not grow with
    the data. A text of more than ``most_share`` of the words is passed over, as is one that no longer fits; the next ones
    go on. Rows with a null id, text or label teach nothing; of repeated labels the largest counts, of rows that share an
    id the shortest text, then the first by code point.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("double").alias("_y"))
    known = known.filter(~held_out("doc_id")).withColumnRenamed("doc_id", "_id")
    order = F.xxhash64("_id", F.lit(20260101))
    # Only ids and lengths meet the labels; the texts of the sample are looked up afterwards.
    lengths = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.octet_length(text).alias("_n"))
    lengths = lengths.groupBy("_id").agg(F.min("_n").alias("_n"))
    sizes = lengths.join(known, "_id").filter(F.col("_n") <= 6 * int(most_share * most_words))
    sizes = sizes.select("_id", "_y", "_n", order.alias("_o")).orderBy("_o", "_id").limit(most_rows).collect()
    chosen, total = [], 0
    for r in sizes:
        words = r["_n"] // 6 + 1
        if total + words <= most_words:
            total += words
            chosen.append((r["_id"], r["_y"]))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, f"_id {dict(known.dtypes)['_id']}, _y double")
    # The sample's bound is fixed above, so it may be broadcast.
    own = F.struct(F.octet_length(text).alias("_bytes"), F.col(text).alias("_text"), *extra)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), own.alias("_row"))
    picked = rows.join(F.broadcast(wanted), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_row").alias("_row"))
    crc = F.crc32(F.col("_id").cast("string")) % 4
    return picked.select(F.encode("_row._text", "UTF-8").alias("text"), F.col("_y").alias("y"), (crc == 1).alias("calibration"),
                         *[F.col("_row")[n].alias(n) for n in rows.schema["_row"].dataType.names[2:]]).orderBy(order, "_id").collect()


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, parts: int, text: str = "text", doc_id: str = "doc_id",
                  extra: tuple[str, ...] = ()) -> DataFrame:
    """Every labelled row outside the held-out quarter, in ``parts`` parts: _id, _part, text as bytes, y, calibration, extra
    columns. Rows with a null
    id, text or label teach nothing; of repeated labels the largest counts, of rows that share an id the shortest text,
    then the first by code point."""
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("double").alias("_y"))
    known = known.filter(~held_out("doc_id")).withColumnRenamed("doc_id", "_id")
    own = F.struct(F.octet_length(text).alias("_bytes"), F.col(text).alias("_text"), *extra)
    rows = docs.filter(F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("_doc"), own.alias("_row"))
    # Texts travel once: both sides are hashed by id, which the grouping keeps to.
    rows, known = rows.repartition(parts, "_doc"), known.repartition(parts, "_id")
    picked = rows.join(known, F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_row").alias("_row"))
    return picked.select("_id", F.spark_partition_id().alias("_part"), F.encode("_row._text", "UTF-8").alias("text"), F.col("_y").alias("y"),
                         (F.crc32(F.col("_id").cast("string")) % 4 == 1).alias("calibration"), *[F.col("_row")[n].alias(n) for n in rows.schema["_row"].dataType.names[2:]])


def _counted(own: DataFrame, totals: np.ndarray, strength: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Known buckets and the log-odds of their rows, row 0 (all other buckets) in front, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, held = WordBuckets(), np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for ids, y in zip(words_of(list(map(bytes, batch["text"])), buckets, 3), batch["y"]):
                held[int(y > 0), np.unique(ids)] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pd.DataFrame({"b": at.astype(np.int32), "n0": held[0, at].astype(np.int64), "n1": held[1, at].astype(np.int64)})

    counts = own.select("text", "y").mapInPandas(count, "b int, n0 bigint, n1 bigint").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counts.filter((F.col("n0") + F.col("n1") >= 2) & (F.col("b") > 0)).toPandas().sort_values("b")  # at most BUCKETS rows
    usual = totals / totals.sum()
    mixed = found[["n0", "n1"]].to_numpy(float).T + strength * usual[:, None]
    return found["b"].to_numpy(), np.concatenate([[0.0], np.log(mixed[1] / mixed[0]) - np.log(usual[1] / usual[0])])


def _trained(own: DataFrame, known: np.ndarray, odds: np.ndarray) -> TextCnn:
    """The mean of the models that the parts of the rows make of the same start, each by all passes over its rows. Changes are
    summed as whole numbers, so that their order does not count."""
    shared = own.sparkSession.sparkContext.broadcast((known, odds))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        known, odds = shared.value
        group = group.sort_values(["_o", "_id"])
        buckets, y = WordBuckets(), (group["y"].to_numpy() > 0).astype(float)
        texts = words_of(list(map(bytes, group["text"])), buckets, 3)
        model, first = train(texts, y, start=(known, odds)), informed(known, odds)
        fixed = lambda a, b: np.rint((a.astype(float) - b) * SCALE).astype(np.int64)
        moved = fixed(model.embed, first.embed)
        at = np.flatnonzero(moved.any(axis=1))
        rest = np.concatenate([fixed(a, b).ravel() for a, b in zip(_dense(model), _dense(first))])
        return pd.DataFrame({"at": np.append(at, -1), "moved": [*moved[at], rest]})

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A part lies in one file, so its rows come one after the other."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            for part, group in batch.groupby("_part", sort=False):
                if held and held[0]["_part"].iloc[0] != part:
                    yield learn(pd.concat(held))
                    held = []
                held.append(group)
        if held:
            yield learn(pd.concat(held))

    rows = own.select("_id", "_part", "text", "y", F.xxhash64("_id", F.lit(20260101)).alias("_o"))
    moved = rows.mapInPandas(every, "at int, moved array<bigint>")
    places = moved.select("at", F.posexplode("moved").alias("k", "v")).groupBy("at", "k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    found = places.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("v") / F.col("n") / SCALE).alias("v"))))["v"].alias("moved")).toPandas()
    model = informed(known, odds)
    here = found[found["at"] >= 0]
    if len(here):
        model.embed[here["at"].to_numpy()] += np.stack(here["moved"]).astype(np.float32)
    rest, done = np.asarray(found[found["at"] < 0]["moved"].iloc[0]), 0
    for part in _dense(model)[:-1]:
        part += rest[done : done + part.size].reshape(part.shape).astype(np.float32)
        done += part.size
    model.out_bias += float(rest[done])
    return model


def _dense(model: TextCnn) -> list[np.ndarray]:
    """All parameters but the embeddings."""
    return [*model.banks, *model.biases, model.out, np.array([model.out_bias])]


@dataclass
class Toxicity:
    """A trained model (None without both classes: every score is 0) with its thresholds."""

    model: TextCnn | None
    by_lang: dict[str, float]
    threshold: float

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
            part_rows: int = 6_000, part_bytes: int = 18_000_000) -> "Toxicity":
        """Words are counted, the model trained and the thresholds set over all labelled rows outside the held-out quarter.

        Rows are dealt by hashed id into parts of about ``part_rows`` rows and ``part_bytes`` of text. Every part trains
        from the same start, the log-odds of all rows, and the changes are averaged, a word's over the parts that hold it.
        """
        whole = docs.filter(F.col(text).isNotNull() & ~held_out(doc_id)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
        # A third of these rows is kept for the thresholds.
        parts = max(1, -(-2 * whole["n"] // (3 * part_rows)), -(-2 * (whole["b"] or 0) // (3 * part_bytes)))
        before = written()
        rows = saved(labelled_rows(docs, labels, "toxic", parts, text, doc_id, (F.col(lang).alias("lang"),)), "toxicity-rows")
        try:
            return cls._fit(rows.filter("not calibration"), rows.filter("calibration"))
        finally:
            release(docs.sparkSession, [p for p in written() if p not in before])

    @classmethod
    def _fit(cls, own: DataFrame, kept: DataFrame) -> "Toxicity":
        size = own.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("pos")).first()
        if not size["n"] or size["pos"] in (0, size["n"]):
            return cls(None, {}, USUAL_CUT)
        known, odds = _counted(own, np.array([size["n"] - size["pos"], size["pos"]], float))
        model = _trained(own, known, odds)
        scorer = cls(model, {}, USUAL_CUT)
        step = F.floor(scorer.scores(F.decode("text", "UTF-8")) * CUTS)
        found = kept.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), step.alias("s")).agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("pos")).orderBy("lang", "s").collect()
        if not found:
            return scorer
        column = lambda c: np.array([r[c] for r in found], float)
        by, whole = calibrate((column("s") + 0.5) / CUTS, column("pos"), [r["lang"] for r in found], counts=column("n"))
        return cls(model, by, whole)

    def scores(self, text: Column) -> Column:
        model = self.model

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if model:
                tables, buckets = model.tables(), WordBuckets(model.known)
                rows = model.stacked(tables)
            for part in parts:
                if model is None:
                    yield pd.Series(np.zeros(len(part)))
                    continue
                out: list[float] = []
                for k in range(0, len(part), 256):
                    raw = [(x or "").encode("utf-8", "ignore") for x in part.iloc[k : k + 256]]
                    out += model.scores(words_of(raw, buckets, model.widest), tables, rows)
                yield pd.Series(out, dtype="float64")

        return score(text)

    def limit(self, lang: Column) -> Column:
        """Threshold of a language; the overall one where it has none of its own."""
        out = F.lit(float(self.threshold))
        for name, value in sorted(self.by_lang.items()):
            out = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(value)).otherwise(out)
        return out
