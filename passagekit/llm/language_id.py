"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
the maximum of each filter over the window is pooled and a softmax gives the
language. Training takes a bounded sample of labelled rows (max_rows, the same
share of each language) and, of each, windows spread over the
whole text. Prediction covers every window of every whole text; a text's
probabilities are the means over its windows, by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


def windows_of(data: bytes, width: int):  # noqa: ANN201
    """All windows of the bytes, the last one filled up with zeros: (n, width) uint8."""
    import numpy as np

    n = max(1, -(-len(data) // width))
    out = np.zeros(n * width, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, width)


@dataclass
class ByteCnn:
    """embed (256, d); filters[w] (w, d, f); bias[w] (f,); out (all filters, languages); out_bias."""

    languages: list[str]
    window: int = 128
    embed: object = None
    filters: dict = field(default_factory=dict)
    bias: dict = field(default_factory=dict)
    out: object = None
    out_bias: object = None

    def _tables(self):  # noqa: ANN202
        """What each byte or pair of bytes adds to each filter, so that a convolution is a few look-ups."""
        import numpy as np

        if "_t" not in self.__dict__:
            tables = []
            for w, f in self.filters.items():
                single = [(self.embed @ f[k]).astype(np.float32) for k in range(w)]
                parts = []
                for k in range(0, w, 2):
                    if k + 1 < w:
                        parts.append((k, 2, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1)))
                    else:
                        parts.append((k, 1, single[k]))
                tables.append((w, parts, self.bias[w].astype(np.float32)))
            self.__dict__["_t"] = tables
        return self.__dict__["_t"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_t"}

    def probabilities(self, windows):  # noqa: ANN001, ANN201
        """(n, languages) for (n, window) bytes."""
        import numpy as np

        done = []
        for i in range(0, len(windows), 512):
            u = windows[i : i + 512].astype(np.int32)
            pair = u[:, :-1] * 256 + u[:, 1:]
            pooled = []
            for w, parts, bias in self._tables():
                n = self.window - w + 1
                s = None
                for k, size, table in parts:
                    got = np.take(table, (pair if size == 2 else u)[:, k : k + n], axis=0)
                    s = got if s is None else np.add(s, got, out=s)
                pooled.append(np.maximum(s.max(axis=1) + bias, 0))
            z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            done.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(done)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability); UNKNOWN and 0 for texts without a letter."""
        import numpy as np

        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        at, parts, sizes = [], [], []
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                data = text.encode("utf-8", "replace")
                at.append(i)
                parts.append(windows_of(data, self.window))
                n = np.full(len(parts[-1]), self.window, np.float64)
                n[-1] = len(data) - self.window * (len(n) - 1)
                sizes.append(n)
        if at:
            p = self.probabilities(np.concatenate(parts)) * np.concatenate(sizes)[:, None]
            first = np.cumsum([0, *map(len, parts)])[:-1]
            means = np.add.reduceat(p, first, axis=0) / np.array([s.sum() for s in sizes])[:, None]
            best = means.argmax(axis=1)
            for i, b, m in zip(at, best, means, strict=True):
                out[i] = self.languages[b], float(min(1.0, m[b]))
        return out


def fit(windows, labels, languages: list[str], widths=(2, 3, 4), filters=16, dim=8, epochs=5, batch=256, rate=4e-3, seed=3) -> ByteCnn:  # noqa: ANN001
    """Train by Adam on (n, window) bytes and label numbers."""
    import numpy as np

    rng = np.random.default_rng(seed)
    width, n_lang = windows.shape[1], len(languages)
    p = {"e": rng.normal(0, 0.3, (256, dim)), "o": rng.normal(0, 0.1, (filters * len(widths), n_lang)), "ob": np.zeros(n_lang)}
    for w in widths:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters)), np.zeros(filters)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            u, y = windows[order[i : i + batch]].astype(np.int64), labels[order[i : i + batch]]
            b, rows = len(u), np.arange(len(u))[:, None]
            x = p["e"][u]
            pooled, where = [], []
            for w in widths:
                n = width - w + 1
                cols = np.concatenate([x[:, k : k + n] for k in range(w)], axis=2)
                s = cols @ p[f"f{w}"].reshape(w * dim, filters)
                at = s.argmax(axis=1)
                where.append(at)
                pooled.append(np.take_along_axis(s, at[:, None, :], axis=1)[:, 0] + p[f"b{w}"])
            raw = np.concatenate(pooled, axis=1)
            act = np.maximum(raw, 0)
            z = act @ p["o"] + p["ob"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(b), y] -= 1
            z /= b
            g = {"o": act.T @ z, "ob": z.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = (z @ p["o"].T) * (raw > 0)
            for j, w in enumerate(widths):
                d, at = back[:, j * filters : (j + 1) * filters], where[j]
                g[f"b{w}"], g[f"f{w}"] = d.sum(axis=0), np.zeros_like(p[f"f{w}"])
                for k in range(w):
                    own = u[rows, at + k]  # the byte under offset k of each filter's maximum
                    g[f"f{w}"][k] = np.einsum("bfd,bf->df", p["e"][own], d)
                    np.add.at(g["e"], own, d[:, :, None] * p[f"f{w}"][k].T[None])
            step += 1
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
                p[key] -= (rate * m[key] / (1 - 0.9**step) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCnn(languages, width, p["e"], {w: p[f"f{w}"] for w in widths}, {w: p[f"b{w}"] for w in widths}, p["o"], p["ob"])


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 4000,
    per_text: int = 6,
    window: int = 128,
    epochs: int = 5,
) -> ByteCnn:
    """A network from about max_rows rows, the same share of every language (one row at least), per_text windows of each.

    Rows without a language, an id or a letter in their text teach nothing, equal
    rows teach once; with none left (or an empty table) the model knows no language
    and predicts UNKNOWN.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).dropna()
    # a hash of the id picks about twice each language's share, so that few rows are ranked
    counts = rows.groupBy("l").count()
    n_langs = counts.count()
    if not n_langs:
        return ByteCnn([], window)
    share = -(-max_rows // n_langs)
    # one row a language, as many as the network has outputs; sent to all tasks where they are few
    small = (lambda t: F.broadcast(t)) if n_langs <= 10_000 else (lambda t: t)
    langs = small(counts.select("l", F.least(F.lit(1.0), F.lit(2.0 * share + 64) / F.col("count")).alias("part")))
    h = F.shiftrightunsigned(F.xxhash64("i", "t"), 1)
    near = rows.join(langs, "l").filter(h <= (F.col("part") * F.lit(float((1 << 63) - 1))).cast("long")).select("l", h.alias("h")).distinct()
    turn = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    picked = near.withColumn("n", turn).filter(F.col("n") <= share).select("l", "h")
    # at most share rows a language; of equal rows one
    chosen = rows.withColumn("h", h).join(small(picked), ["l", "h"]).groupBy("l", "h").agg(F.any_value("t").alias("t"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any(map(str.isalpha, text)):
                    own = windows_of(text.encode("utf-8", "replace"), window)
                    few = min(per_text, len(own))
                    out += [(lang, own[k * len(own) // few].tobytes()) for k in range(few)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["lang", "w"])

    got = chosen.select("l", "t").mapInArrow(cut, "lang string, w binary").collect()
    if not got:
        return ByteCnn([], window)
    import numpy as np

    got.sort(key=lambda r: (r["lang"], bytes(r["w"])))
    languages = sorted({r["lang"] for r in got})
    number = {lang: k for k, lang in enumerate(languages)}
    data = np.frombuffer(b"".join(bytes(r["w"]) for r in got), np.uint8).reshape(len(got), window)
    # a small sample is gone through more often
    return fit(data, np.array([number[r["lang"]] for r in got]), languages, epochs=max(epochs, min(20, 40_000 // len(got))))


def predict_language(df: DataFrame, model: ByteCnn, text_col: str = "text", out: str = "language") -> DataFrame:
    """df with a struct column: lang_pred and score. Null, empty or letterless texts get UNKNOWN and 0.

    Every row is predicted for itself, so equal rows agree; an empty table gives no rows. A column of df that
    is named like out is replaced, all others stay.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = []
        for i in range(0, len(texts), 256):
            found += model.predict(texts.iloc[i : i + 256].tolist())
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return df.withColumn(out, run(F.col(text_col).cast("string")))
