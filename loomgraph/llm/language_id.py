"""Language identification by a convolutional network over bytes.

Texts are lowered, their UTF-8 bytes mapped to classes and cut into
consecutive windows of ``LENGTH`` bytes that cover the whole text (the last is
padded). Filters of several widths run over each window; their outputs are
max-pooled and a softmax layer scores the languages, and one more class,
``und``, for what is no language: digits, symbols, codes, random letters. A
document's score is the mean of its windows' log-probabilities, weighted by
their bytes.

The network is trained here, in numpy, on a bounded sample of labelled rows
(``SAMPLE`` documents of each label, ``WINDOWS`` windows of each; both are
parameters). A filter over one-hot classes is a sum of table rows, so inference
folds neighbouring positions into tables over pairs of classes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import filter_by_text
from loomgraph.llm.words import text_chunks

LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4, 5), 16
SAMPLE, WINDOWS, EPOCHS, SEED = 300, 4, 6, 7
UND = "und"
RESULT = "doc_id bigint, lang_pred string, confidence double, n_windows int, accepted boolean"


def byte_classes() -> tuple[np.ndarray, int]:
    """Class of each byte, and how many classes there are; 0 is padding."""
    table = np.zeros(256, np.int64)
    table[:] = 1  # controls, punctuation and symbols
    table[[9, 10, 13, 32]] = 2
    table[48:58] = 3
    table[97:123] = table[65:91] = np.arange(4, 30)
    table[128:192] = np.arange(30, 94)
    table[192:] = 94 + np.minimum(np.arange(64), 54)
    return table.astype(np.uint8), 149


CLASSES, N_CLASSES = byte_classes()


def cut_windows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window x length classes, row of each window, bytes in each window); empty rows have none."""
    size = np.diff(offsets)
    per_row = -(-size // length)
    if len(size) == 1:  # a long row: no index per byte
        out = np.zeros(int(per_row[0]) * length, np.uint8)
        out[: len(data)] = CLASSES[data]
        filled = np.full(int(per_row[0]), length)
        filled[-1:] = len(data) - (len(filled) - 1) * length
        return out.reshape(-1, length), np.zeros(len(filled), np.int64), filled
    first = np.concatenate(([0], np.cumsum(per_row)))
    n = int(first[-1])
    out = np.zeros(n * length, np.uint8)
    move = np.repeat(first[:-1] * length - offsets[:-1], size)
    out[np.arange(len(data)) + move] = CLASSES[data]
    row = np.repeat(np.arange(len(size)), per_row)
    filled = np.minimum(size[row] - (np.arange(n) - first[row]) * length, length)
    return out.reshape(n, length), row, filled


class ByteCNN:
    """Weights: for each width a (width, class, filter) table and a bias; a softmax layer."""

    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.conv = [rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        for table in self.conv:
            table[:, 0] = 0

    def params(self) -> list[np.ndarray]:
        return [*self.conv, *self.bias, self.out, self.out_bias]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled outputs and where each came from; x: window x length."""
        tops, at = [], []
        for table, bias, w in zip(self.conv, self.bias, WIDTHS):
            n = x.shape[1] - w + 1
            y = sum(table[k][x[:, k : k + n]] for k in range(w))
            where = y.argmax(1)
            tops.append(np.take_along_axis(y, where[:, None], 1)[:, 0] + bias)
            at.append(where)
        return np.concatenate(tops, 1), at

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = SEED) -> None:
        """Adam on cross entropy."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                xb, yb = x[part], y[part]
                pooled, at = self._pooled(xb)
                hidden = np.maximum(pooled, 0)
                score = hidden @ self.out + self.out_bias
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * (pooled > 0)
                grads = []
                for j, (table, w) in enumerate(zip(self.conv, WIDTHS)):
                    g = np.zeros_like(table)
                    d = back[:, j * FILTERS : (j + 1) * FILTERS]
                    for k in range(w):
                        c = np.take_along_axis(xb, at[j] + k, 1)
                        np.add.at(g[k], (c, np.arange(FILTERS)[None, :]), d)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [back[:, j * FILTERS : (j + 1) * FILTERS].sum(0) for j in range(len(WIDTHS))]
                grads += [hidden.T @ p, p.sum(0)]
                t += 1
                for q, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def folded(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width its tables: (first position, positions covered, rows by class or pair of classes)."""
        tables = []
        for table, bias, w in zip(self.conv, self.bias, WIDTHS):
            parts, k = [], 0
            while k < w:
                if k + 1 < w:
                    pair = (table[k][:, None] + table[k + 1][None]).reshape(-1, FILTERS)
                    parts.append((k, 2, pair))
                    k += 2
                else:
                    parts.append((k, 1, table[k]))
                    k += 1
            parts[0] = (*parts[0][:2], (parts[0][2] + bias).astype(np.float32))
            tables.append(parts)
        return tables

    def log_probs(self, x: np.ndarray, tables: list | None = None, batch: int = 128) -> np.ndarray:
        """Window x label log-probabilities."""
        tables = tables or self.folded()
        scores = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), batch):
            c = np.ascontiguousarray(x[i : i + batch].T)  # by position, so that pooling runs along memory
            pair = c[:-1].astype(np.int32) * N_CLASSES + c[1:]
            tops = []
            for parts, w in zip(tables, WIDTHS):
                n = len(c) - w + 1
                y = None
                for k, span, rows in parts:
                    z = rows.take((pair if span == 2 else c)[k : k + n], axis=0)
                    y = z if y is None else np.add(y, z, out=y)
                tops.append(y.max(0))
            scores[i : i + batch] = np.maximum(np.concatenate(tops, 1), 0) @ self.out + self.out_bias
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def no_language(n: int, seed: int = SEED, length: int = LENGTH) -> np.ndarray:
    """Windows of classes that are no language: digits, symbols, codes, random letters and bytes."""
    rng = np.random.default_rng(seed)
    pools = [b"0123456789", b"0123456789 .,-:/", bytes(range(33, 48)) + b" ", b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz0123456789+/", b"abcdefghijklmnopqrstuvwxyz", b"abcdefghijklmnopqrstuvwxyz    ", bytes(range(256))]
    rows = np.zeros((n, length), np.uint8)
    for i in range(n):
        pool = np.frombuffer(pools[i % len(pools)], np.uint8)
        size = int(rng.integers(8, length + 1))
        rows[i, :size] = CLASSES[rng.choice(pool, size)]
    return rows


def sample_windows(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> dict[str, np.ndarray]:
    """Training windows by label: of each label the ``sample`` different texts of least hash, evenly spread windows of each.

    The count of rows by label reads no text; one scan then keeps the texts
    whose hash is below the bound that leaves about one and a half samples. A
    text counts once however often it is repeated and whatever its id; where
    repeats leave a label short, the bound is raised for it and the scan
    repeated. So the driver gets less than 8 * (1.5 * sample + 50) texts'
    windows of a label; labels are languages, of which there are few. Rows
    without a label or text are not used.
    """
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND trim(lang) <> '' AND text IS NOT NULL AND text <> ''")
    counts = {r["lang"]: r["n"] for r in docs.where("lang IS NOT NULL AND trim(lang) <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {k: min(1.0, (1.5 * sample + 50) / n) for k, n in counts.items()}
    found: dict[str, np.ndarray] = {}
    while bounds:
        kept = _sampled(labelled, bounds, windows)
        for lang, part in kept.groupby("lang", sort=True):
            least = np.unique(part["u"])[:sample]
            found[lang] = np.stack([np.frombuffer(w, np.uint8) for w in part[part["u"].isin(least)].sort_values(["u", "window"])["window"]])
        texts = kept.groupby("lang")["u"].nunique().to_dict()
        bounds = {k: min(1.0, 8 * b) for k, b in bounds.items() if b < 1 and texts.get(k, 0) < sample}
    return found


def _sampled(labelled: DataFrame, bounds: dict[str, float], windows: int):
    """(lang, u, window) of the texts below their labels' bounds, each once."""
    u = (F.xxhash64("text").cast("double") + 2.0**63) / 2.0**64
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(b)) for k, b in sorted(bounds.items())])
    picked = labelled.select("lang", "text", u.alias("u")).where(F.col("u") <= bound).dropDuplicates(["lang", "u"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in text_chunks(batch.column("text"), lower=True):
                x, row, _ = cut_windows(data, offsets)
                first = np.searchsorted(row, np.arange(len(offsets) - 1))
                count = np.diff(np.concatenate((first, [len(row)])))
                at = np.unique(np.concatenate([first + (count * i) // windows for i in range(windows)]))
                at = at[at < len(row)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row[at] + begin)), batch.column("u").take(pa.array(row[at] + begin)), pa.array([w.tobytes() for w in x[at]], pa.binary())], names=["lang", "u", "window"])

    return picked.mapInArrow(cut, "lang string, u double, window binary").toPandas()


def fit(windows: dict[str, np.ndarray], seed: int = SEED, epochs: int = EPOCHS) -> ByteCNN | None:
    """A network for the labels, and ``und``; None, and a warning, without any labelled window."""
    if not windows:
        warnings.warn("no labelled text: languages can't be told, and every text that isn't empty is accepted", stacklevel=2)
        return None
    labels = sorted(windows) + [UND]
    rng = np.random.default_rng(seed)
    junk = no_language(max(len(w) for w in windows.values()), seed)
    parts = [*(windows[k] for k in sorted(windows)), junk]
    x, y = np.concatenate(parts), np.repeat(np.arange(len(labels)), [len(p) for p in parts])
    short = x.copy()  # half of the windows again, cut short: little text must do too
    keep = rng.integers(12, LENGTH // 2, len(x))
    short[np.arange(LENGTH)[None, :] >= keep[:, None]] = 0
    some = rng.random(len(x)) < 0.5
    model = ByteCNN(labels, seed)
    model.train(np.concatenate((x, short[some])), np.concatenate((y, y[some])), epochs=epochs, seed=seed)
    return model


def _classify(model: ByteCNN, tables: list, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label index or -1, confidence, windows) of each row."""
    n = len(column)
    best, sure, count = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n, np.int32)
    for begin, end, data, offsets in text_chunks(column, lower=True):
        x, row, filled = cut_windows(data, offsets)
        if not len(x):
            continue
        logs = model.log_probs(x, tables) * filled[:, None]
        rows = np.unique(row)
        starts = np.searchsorted(row, rows)
        mean = np.add.reduceat(logs, starts, axis=0) / np.add.reduceat(filled, starts)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best[begin + rows], sure[begin + rows] = p.argmax(1), p.max(1)
        count[begin + rows] = np.diff(np.concatenate((starts, [len(row)])))
    return best, sure, count


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """(doc_id, lang_pred, confidence, n_windows, accepted) of every row.

    A row is rejected if ``und`` scores best, or if its text is null or empty
    (``und``, confidence 0, no windows). Without a model (no labelled row)
    nothing can be judged: ``lang_pred`` is null and texts that aren't empty
    are accepted. Rows are judged one by one, so repeated rows and null ids
    make no difference; other columns are not read. A map: nothing is shuffled.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.folded() if model else None
        for batch in batches:
            ok, lang, sure, count = _judged(model, tables, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(np.round(sure, 6)), pa.array(count), pa.array(ok)], names=["doc_id", "lang_pred", "confidence", "n_windows", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, RESULT)


def _judged(model: ByteCNN | None, tables: list | None, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    if model is None:
        full = pc.fill_null(pc.greater(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False)
        return full, pa.nulls(len(column), pa.string()), np.zeros(len(column)), np.zeros(len(column), np.int32)
    best, sure, count = _classify(model, tables, column)
    und = len(model.labels) - 1
    names = np.array(model.labels, object)[np.where(best < 0, und, best)]
    return (best >= 0) & (best != und), pa.array(names, pa.string()), sure, count


def keep_accepted(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, all columns as they are."""

    def judge():
        tables = model.folded() if model else None
        return lambda texts: pa.array(_judged(model, tables, texts)[0])

    return filter_by_text(docs, judge)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(sample_windows(docs)))
