"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length over its UTF-8 bytes, all of it, and
batches of windows go through filters of several widths, max pooling over the
window and a softmax; a text's probabilities are the mean over its windows,
weighted by their bytes. The network is trained in numpy on windows of a
bounded sample: Training.docs_per_language labelled documents of each language,
or as many fewer as keep the sample within Training.docs, those with the
smallest hash of the id, with up to Training.windows_per_doc windows spread over
the whole of each. Every label is learned, however rare; more than
Training.most_languages of them are an error.

Language, source and id are never inputs of a prediction. Null texts and texts
without a letter are `und` with score 0, and so is every text if nothing was
there to learn from; empty texts have no letter. Null labels are not learned
from. Rows are predicted one by one, so ties and repeated rows need no rule; of
equally likely languages the first in order counts. Texts of any length are read
whole. An empty table has nothing to learn from. Carried columns whose names
clash with lang_pred or score give way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import annotate

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample, and the shape of the network."""

    docs_per_language: int = 300
    docs: int = 60_000
    most_languages: int = 1000
    windows_per_doc: int = 6
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    epochs: int = 4
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


def cut_windows(data: bytes, length: int) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    n = max(1, -(-len(data) // length))
    return np.frombuffer(data.ljust(n * length, b"\0"), np.uint8).reshape(n, length)


class Network:
    """conv[w] has the filters of width w as one row for each place and byte; out maps pooled features to languages."""

    def __init__(self, languages: list[str], training: Training):
        r = np.random.default_rng(training.seed)
        self.languages, self.training = languages, training
        self.conv = {w: r.normal(0, 0.3 / w**0.5, (w, 256, training.filters)).astype(np.float32) for w in training.widths}
        self.bias = {w: np.zeros(training.filters, np.float32) for w in training.widths}
        self.out = r.normal(0, 0.1, (training.filters * len(training.widths), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def responses(self, windows: np.ndarray, w: int) -> np.ndarray:
        n = windows.shape[1] - w + 1
        total = self.conv[w][0][windows[:, :n]]
        for j in range(1, w):
            total += self.conv[w][j][windows[:, j : j + n]]
        return total

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross-entropy. Through max pooling only the winning places get a gradient."""
        t, r = self.training, np.random.default_rng(self.training.seed)
        params = [*self.conv.values(), *self.bias.values(), self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = np.bincount(labels, minlength=len(self.languages)).astype(np.float32)
        weight = np.where(weight > 0, len(labels) / np.maximum(weight, 1) / len(self.languages), 0).astype(np.float32)
        step, f = 0, t.filters
        for _ in range(t.epochs):
            for at in np.array_split(r.permutation(len(windows)), max(1, -(-len(windows) // t.batch))):
                x, y, step = windows[at], labels[at], step + 1
                won, pooled = {}, []
                for w in t.widths:
                    a = self.responses(x, w)
                    won[w] = a.argmax(1)
                    pooled.append(np.take_along_axis(a, won[w][:, None], 1)[:, 0] + self.bias[w])
                h = np.maximum(np.concatenate(pooled, 1), 0)
                g = self.softmax(h @ self.out + self.out_bias)
                g[np.arange(len(y)), y] -= 1
                g *= weight[y][:, None] / len(y)
                back = (g @ self.out.T) * (h > 0)
                grads_conv, grads_bias = [], []
                for i, w in enumerate(t.widths):
                    part, grad = back[:, i * f : (i + 1) * f], np.zeros_like(self.conv[w])
                    for j in range(w):
                        np.add.at(grad[j], (np.take_along_axis(x, won[w] + j, 1), np.arange(f)[None]), part)
                    grads_conv.append(grad)
                    grads_bias.append(part.sum(0))
                for p, m, v, d in zip(params, first, second, [*grads_conv, *grads_bias, h.T @ g, g.sum(0)], strict=True):
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    p -= t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def tables(self) -> None:
        """Sums of two neighbouring places for every pair of bytes: half as many look-ups when predicting."""
        pairs = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.pair = {w: [pairs(c[j], c[j + 1]) for j in range(0, w - 1, 2)] for w, c in self.conv.items()}

    def probabilities(self, windows: np.ndarray, chunk: int = 32) -> np.ndarray:
        """One row for each window."""
        h = np.empty((len(windows), len(self.out)), np.float32)
        f = self.training.filters
        for s in range(0, len(windows), chunk):
            x = windows[s : s + chunk]
            codes = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            for i, w in enumerate(self.training.widths):
                n = x.shape[1] - w + 1
                total = self.conv[w][w - 1].take(x[:, w - 1 : w - 1 + n], axis=0) if w % 2 else None
                for k, table in enumerate(self.pair[w]):
                    part = table.take(codes[:, 2 * k : 2 * k + n], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                h[s : s + chunk, i * f : (i + 1) * f] = total.max(1) + self.bias[w]
        return self.softmax(np.maximum(h, 0) @ self.out + self.out_bias)

    def predict(self, texts: list[str | None], group: int = 4096) -> tuple[list[str], list[float]]:
        """Language and score of each text. Windows of several texts go together, those of a very long one in groups."""
        sums = np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush():
            if waiting:
                owner = np.concatenate([np.full(len(x), i) for i, x, _ in waiting])
                p = self.probabilities(np.concatenate([x for _, x, _ in waiting])) * np.concatenate([n for _, _, n in waiting])[:, None]
                np.add.at(sums, owner, p)
                waiting.clear()

        length, held = self.training.window, 0
        for i, text in enumerate(texts):
            if text is None or not LETTER.search(text):
                continue
            data = text.encode("utf-8", "surrogatepass")
            for s in range(0, len(data), group * length):
                x = cut_windows(data[s : s + group * length], length)
                size = np.full(len(x), float(length))
                size[-1] = len(data[s : s + group * length]) - length * (len(x) - 1)
                waiting.append((i, x, size))
                held += len(x)
                if held >= group:
                    flush()
                    held = 0
        flush()
        total = sums.sum(1)
        best = sums.argmax(1)
        lang = [self.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        return lang, [min(1.0, float(sums[i, b] / total[i])) if total[i] > 0 else 0.0 for i, b in enumerate(best)]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training (null ids too are not)."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, training: Training = Training(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels of the bounded sample. More labels than training.most_languages are an error.

    Counts of the labels tell which share of the hash range holds about twice
    the rows wanted; only rows below it are ranked.
    """
    labelled = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = labelled.groupBy("lang").count().limit(training.most_languages + 1).collect()  # a row for each label, as the network has an output for each
    if len(counts) > training.most_languages:
        raise ValueError(f"more than {training.most_languages} different labels: not languages, or too many for one network")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], np.zeros((0, training.window), np.uint8), np.zeros(0, np.int64)
    each = max(1, min(training.docs_per_language, training.docs // len(languages)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * each + 100) / r["count"])))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    near = labelled.withColumn("place", place).where(F.col("place") <= F.try_element_at(share, F.col("lang")))
    length, most = training.window, training.windows_per_doc

    def start():
        def work(texts):
            out = []
            for t in texts:
                x = cut_windows(t.encode("utf-8", "surrogatepass"), length)
                out.append([x[i].tobytes() for i in np.unique(np.linspace(0, len(x) - 1, most).astype(int))])
            return {"windows": out}

        return work

    windows = annotate(near, start, [("windows", T.ArrayType(T.BinaryType()))], keep=["lang", "place", "id"], text="text")
    # Ranked after the texts have shrunk to their windows.
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "id", F.xxhash64("windows")))
    rows = windows.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "rank", "windows").collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    x = np.frombuffer(b"".join(bytes(w) for r in rows for w in r["windows"]), np.uint8).reshape(-1, length)
    y = np.array([languages.index(r["lang"]) for r in rows for _ in r["windows"]], np.int64)
    return languages, x, y


def train(docs: DataFrame, training: Training = Training(), **columns: str) -> Network | None:
    """The network, or None if there is nothing to learn from."""
    languages, x, y = training_windows(docs, training, **columns)
    if not len(x):
        return None
    network = Network(languages, training)
    network.fit(x, y)
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score."""

    def start():
        if network is not None:
            network.tables()

        def work(texts):
            lang, score = network.predict(texts) if network is not None else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            return {"lang_pred": lang, "score": score}

        return work

    return annotate(docs, start, [("lang_pred", T.StringType()), ("score", T.DoubleType())], text, keep)
