"""Language-model scoring with a gated recurrent network and a class-factored output softmax.

Counts of all training words are exact and made by Spark. A bounded number of
frequent words have outputs of their own, in classes of equal size, dealt by the
documents the words occur in; all rarer words are one more class (and, where only a
part is learnt from, frequent ones that it lacks another, with its fixed share). The network
gives log P(text) = sum of log P(class | all before) + log P(word | class, all
before), both softmaxes over its state. Within the class of rare words, words
share by their counts, and unseen ones get the share that words met once have.

The network learns by truncated backpropagation on every training text, none of
which reaches the driver: each task learns on its own part from the parameters of
the last round, and their means, made by Spark chunk by chunk, begin the next. State is carried
from window to window and starts anew with each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

END, RARE, LOOSE = 0, 1, 2  # classes: end of text, rare or unseen words, frequent words that the sample lacks
_CHUNK = 4096  # parameters in one row while means are taken
_NEAR = 1 << 14  # numbers, and
_ROWS = 512  # rows of scores, that are worked on at once, so that they stay in a core's own cache


class Gru:
    """Inputs (numbers below n_in) to log-probabilities of n_class classes and of the words in each.

    ends: for each class the number of words in it and all before it; words are numbered class by class.
    """

    def __init__(self, n_in: int, n_class: int, hidden: int = 32, seed: int = 1, ends=None):  # noqa: ANN001
        import numpy as np

        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        self.hidden, self.n_class, self.loose = hidden, n_class, 0.0  # loose: fixed share of LOOSE, which is never trained
        self.ends = np.zeros(n_class, np.int64) if ends is None else np.asarray(ends, np.int64)
        n_words = int(self.ends[-1])
        self.p = {"x": make(n_in, 3 * hidden), "u": make(hidden, 3 * hidden), "o": make(hidden, n_class), "b": np.zeros(n_class, np.float32), "ub": np.zeros(3 * hidden, np.float32)}
        if n_words:  # words start with the share of their counts, whatever comes before
            self.p |= {"w": np.zeros((n_words, hidden), np.float32), "wb": np.zeros(n_words, np.float32)}

    def step(self, x, h):  # noqa: ANN001, ANN201
        """One step: rows of the input table, the state; returns the new state and what the way back needs."""
        import numpy as np

        n = self.hidden
        a = h @ self.p["u"] + self.p["ub"]
        zr = 1 / (1 + np.exp(-(x[:, : 2 * n] + a[:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        return c + z * (h - c), (z, r, c, a[:, 2 * n :])

    def _gates(self, rows: int) -> tuple:
        """Input table (with the biases of z and r), state matrix and, for each row, the candidate's bias, three gates apart, so that each gate's numbers stand together.

        z and r have their signs turned: exp() takes them as they are.
        """
        import numpy as np

        apart = lambda a: np.ascontiguousarray(a.reshape(len(a), 3, self.hidden).transpose(1, 0, 2))
        table, u, ub = apart(self.p["x"]), apart(self.p["u"]), apart(self.p["ub"][None])
        table[:2] += ub[:2]
        np.negative(table[:2], out=table[:2])
        np.negative(u[:2], out=u[:2])
        return table, u, np.repeat(ub[2], rows, axis=0)

    @staticmethod
    def _advance(x, h, u, cb, a, ac, out) -> None:  # noqa: ANN001
        """step() on gates apart: x (3, rows, n) is overwritten by z, r and c; ac gets what the candidate had of the state, out the new state. a: room."""
        import numpy as np

        np.matmul(h, u, out=a)
        zr, c = x[:2], x[2]
        zr += a[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.add(a[2], cb, out=ac)
        np.multiply(x[1], ac, out=out)
        c += out
        np.tanh(c, out=c)
        np.subtract(h, c, out=out)
        out *= x[0]
        out += c

    def log_probs(self, hs):  # noqa: ANN001, ANN201
        import numpy as np

        s = hs @ self.p["o"] + self.p["b"]
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        if self.loose:
            s += np.log1p(-self.loose)
            s[:, LOOSE] = np.log(self.loose)
        return s

    def _shifts(self) -> bool:
        """Whether scores must be shifted by their maximum before they are exponents.

        States are within -1 and 1, which bounds every score: exp() of it neither overflows nor vanishes for a whole class.
        """
        import numpy as np

        def bounds(b: str, size) -> tuple:  # noqa: ANN001
            return self.p[b] + size, self.p[b] - size

        size = np.ones(self.hidden, self.p["o"].dtype) @ np.abs(self.p["o"])
        most, least = bounds("b", size)
        safe = max(most.max(), size.max()) < 60 and least.max() > -60
        if "w" in self.p:
            size = np.abs(self.p["w"]) @ np.ones(self.hidden, self.p["w"].dtype)
            most, least = bounds("wb", size)
            first = np.unique(np.r_[0, self.ends[:-1]][np.diff(np.r_[0, self.ends]) > 0])
            safe = safe and max(most.max(), size.max()) < 60 and np.maximum.reduceat(least, first).min() > -60
        return not safe

    @staticmethod
    def _log_sums(s, bias, shift: bool):  # noqa: ANN001, ANN205
        """log of the sum of exp(s + bias) of each row of s, which it overwrites."""
        import numpy as np

        if not shift:
            return np.log(np.exp(s, out=s) @ np.exp(bias))
        s += bias
        top = s.max(axis=1)
        s -= top[:, None]
        return np.log(np.exp(s, out=s) @ np.ones(s.shape[1], s.dtype)) + top

    def goal_log_probs(self, hs, goal, shift: bool = True):  # noqa: ANN001, ANN201
        """log P(class | state) of each row's class: what log_probs has at it."""
        import numpy as np

        out, b = np.empty(len(hs), hs.dtype), self.p["b"]
        for i in range(0, len(hs), _ROWS):
            y = goal[i : i + _ROWS]
            s = hs[i : i + _ROWS] @ self.p["o"]
            own = s[np.arange(len(y)), y] + b[y]
            out[i : i + _ROWS] = own - self._log_sums(s, b, shift)
        if self.loose:
            out = np.where(goal == LOOSE, np.float32(np.log(self.loose)), out + np.float32(np.log1p(-self.loose)))
        return out

    def _by_class(self, words) -> tuple:  # noqa: ANN001
        """The places of words class by class, and from and to where in them each class is, with its first word and the end of its words (-1: none)."""
        import numpy as np

        at = np.flatnonzero(words >= 0)
        sizes = np.diff(np.r_[0, self.ends])
        cls = np.repeat(np.arange(self.n_class, dtype=np.min_scalar_type(self.n_class)), sizes)[words[at]]
        at = at[np.argsort(cls, kind="stable")]
        to = np.cumsum(np.bincount(cls, minlength=self.n_class))
        return at, [(int(a), int(b), int(e - n), int(e)) for a, b, n, e in zip(np.r_[0, to[:-1]], to, sizes, self.ends, strict=True) if b > a]

    def word_log_probs(self, hs, words, shift: bool = True):  # noqa: ANN001, ANN201
        """log P(word | class, state) of each row's word; 0 where it is -1."""
        import numpy as np

        out = np.zeros(len(words), np.float32)
        at, parts = self._by_class(words)
        for i, j, a, b in parts:
            for k in range(i, j, _ROWS):
                own = at[k : min(j, k + _ROWS)]
                s, bias, goal = hs[own] @ self.p["w"][a:b].T, self.p["wb"][a:b], words[own] - a
                mine = s[np.arange(len(own)), goal] + bias[goal]
                out[own] = mine - self._log_sums(s, bias, shift)
        return out

    def train(self, lanes_in, lanes_out, fresh, window: int = 20, rate: float = 5e-3, lanes_word=None, progress: tuple[float, float] = (0.0, 1.0)) -> None:  # noqa: ANN001
        """Truncated backpropagation over (steps, lanes) arrays; fresh marks first tokens, where the state is zero.

        Every step is learnt from; the last window may be shorter. A target class of -1 fills up a lane and teaches
        nothing. lanes_word: the target words' numbers (-1: none). progress: which part of the training this is; the pace sinks.
        """
        import numpy as np

        steps, lanes = lanes_in.shape
        n, kind = self.hidden, self.p["u"].dtype
        h = np.zeros((lanes, n), kind)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        size = min(window, steps), lanes, n
        room = {k: np.empty(size, kind) for k in ("before", "after", "dh", "ac")} | {"da": np.empty((3, *size), kind)}
        gates, spare = np.empty((size[0], 3, lanes, n), kind), np.empty((3, lanes, n), kind)  # gates: z, r and c, once a step is made
        t, ones, places = 0, np.ones(max(window * lanes, 1), kind), np.arange(_ROWS)
        for at in range(0, steps, window):
            xs, ys, first = lanes_in[at : at + window], lanes_out[at : at + window], fresh[at : at + window]
            long, share = len(xs), kind.type(1 / (lanes * window))
            anew = [np.flatnonzero(x) for x in first]
            table, u, cb = self._gates(lanes)
            before, after, dh_out, ac = (room[k][:long] for k in ("before", "after", "dh", "ac"))
            da, bias = room["da"][:, :long], np.repeat(self.p["b"][None], _ROWS, axis=0)
            for k in range(long):
                np.take(table, xs[k], axis=1, out=gates[k], mode="clip")
                before[k] = h
                before[k][anew[k]] = 0
                self._advance(gates[k], before[k], u, cb, spare, ac[k], after[k])
                h = after[k]
            hs, goal, dh_flat = after.reshape(-1, n), ys.ravel(), dh_out.reshape(-1, n)
            shift = self._shifts()
            g["o"][:], g["b"][:] = 0, 0
            for i in range(0, len(hs), _ROWS):
                own, y = hs[i : i + _ROWS], goal[i : i + _ROWS]
                d = own @ self.p["o"]
                self._shares(d, bias[: len(y)], share, shift, ones)
                if y.min() < 0:
                    d[y < 0] = 0
                    there = np.flatnonzero(y >= 0)
                    d[there, y[there]] -= share
                else:
                    d[places[: len(y)], y] -= share
                g["o"] += own.T @ d
                g["b"] += ones[: len(d)] @ d
                np.matmul(d, self.p["o"].T, out=dh_flat[i : i + _ROWS])
            if "w" in self.p:
                g["w"][:], g["wb"][:] = 0, 0
            if lanes_word is not None:
                words = lanes_word[at : at + window].ravel()
                by, parts = self._by_class(words)
                sorted_hs, sorted_words, back = np.take(hs, by, axis=0), words[by], np.empty((len(by), n), kind)
                for i, j, a, b in parts:
                    w = self.p["w"][a:b]
                    for k in range(i, j, _ROWS):
                        to = min(j, k + _ROWS)
                        own = sorted_hs[k:to]
                        s = own @ w.T
                        self._shares(s, self.p["wb"][a:b], share, shift, ones)
                        s[places[: to - k], sorted_words[k:to] - a] -= share
                        g["w"][a:b] += s.T @ own
                        g["wb"][a:b] += ones[: to - k] @ s
                        np.matmul(s, w, out=back[k:to])
                dh_flat[by] += back
            ut, dh, dcs = self.p["u"].reshape(n, 3, n).transpose(1, 2, 0).copy(), np.zeros((lanes, n), kind), dh_out  # dcs takes the place of what was read
            for k in reversed(range(long)):
                z, r, c = gates[k]
                dh += dh_out[k]
                rest = np.subtract(1, z, out=spare[0])
                rest *= dh
                dc = np.multiply(c, c, out=dcs[k])
                np.subtract(1, dc, out=dc)
                dc *= rest
                dz = np.subtract(before[k], c, out=da[0, k])
                dz *= z
                dz *= rest
                da_c = np.multiply(dc, r, out=da[2, k])
                dr = np.subtract(1, r, out=da[1, k])
                dr *= ac[k]
                dr *= da_c
                dh *= z
                for more in np.matmul(da[:, k], ut, out=spare):
                    dh += more
                dh[anew[k]] = 0
            states = before.reshape(-1, n).T
            for k in range(3):
                flat = da[k].reshape(-1, n)
                np.matmul(states, flat, out=g["u"][:, k * n : (k + 1) * n])
                g["ub"][k * n : (k + 1) * n] = ones[: len(flat)] @ flat
            self._by_input(xs.ravel(), [x.reshape(-1, n) for x in (da[0], da[1], dcs)], g["x"])
            norm = float(np.sqrt(sum(np.vdot(x, x) for x in g.values())))
            t += 1
            done = progress[0] + (progress[1] - progress[0]) * at / steps
            pace = rate * min(1.0, 0.1 + (1 - done) * 1.2) / (1 - 0.9**t)
            self._move(g, m, v2, min(1.0, 1.0 / (norm + 1e-8)), pace, 1 / (1 - 0.99**t))

    @staticmethod
    def _shares(s, bias, share, shift: bool, ones) -> None:  # noqa: ANN001
        """Rows of s become their softmax with the bias, times share."""
        import numpy as np

        s += bias
        if shift:
            s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s *= (share / (s @ (ones[: s.shape[1]] if s.shape[1] <= len(ones) else np.ones(s.shape[1], s.dtype))))[:, None]

    def _move(self, g: dict, m: dict, v2: dict, clip: float, pace: float, up: float) -> None:
        """One step of Adam along g, which it overwrites. m and v2: means of gradients and of their squares; up: what makes up for the squares' start."""
        import numpy as np

        for k, p in self.p.items():
            flat = [a.reshape(-1) for a in (g[k], m[k], v2[k], p)]
            for i in range(0, p.size, _NEAR):
                x, mean, squares, own = (a[i : i + _NEAR] for a in flat)
                x *= 0.1 * clip
                mean *= 0.9
                mean += x
                x *= x  # 0.01 of the gradient's square
                squares *= 0.99
                squares += x
                np.sqrt(squares, out=x)
                x += 1e-6 / up**0.5
                np.divide(mean, x, out=x)
                x *= pace / up**0.5
                own -= x

    @staticmethod
    def _by_input(xs, parts: list, out) -> None:  # noqa: ANN001
        """Sums of rows by their inputs' numbers, the parts side by side in out.

        Eight rows of an input are added at once, then eight of these sums, until each input has one.
        """
        import numpy as np

        n = parts[0].shape[1]
        out[:] = 0
        xs = xs.astype(np.min_scalar_type(len(out)))
        order = np.argsort(xs, kind="stable")
        xs = xs[order]
        first = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
        own, many = xs[first], np.diff(np.r_[first, len(xs)])
        while True:
            eights = -(-many // 8)
            before = np.cumsum(eights) - eights
            start = np.repeat(first - 8 * before, eights) + 8 * np.arange(eights.sum())
            long = np.minimum(np.repeat(first + many, eights) - start, 8).astype(np.int8)
            by = np.argsort(-long, kind="stable")  # the longest first
            start, live = start[by], len(by) - np.cumsum(np.bincount(long, minlength=9))
            parts = [np.take(x, order[start], axis=0) for x in parts], parts
            for j in range(1, 8):
                at = order[start[: live[j]] + j]
                for total, x in zip(*parts, strict=True):
                    total[: live[j]] += np.take(x, at, axis=0)
            parts, first, many = parts[0], before, eights
            order = np.empty_like(by)
            order[by] = np.arange(len(by))
            if len(by) == len(own):
                break
        for k, x in enumerate(parts):
            out[own, k * n : (k + 1) * n] = x[order]

    def score(self, inputs: list, targets: list, lanes: int = 384, window: int = 64, words: list | None = None):  # noqa: ANN201
        """Sum of natural log probabilities of each sequence's classes and, if given, words (arrays of equal lengths).

        Sequences are dealt over lanes, longest first, and follow each other in
        a lane; all lanes advance together, and finished lanes drop out.
        """
        import numpy as np

        out = np.zeros(len(inputs))
        if not inputs:
            return out
        lanes = min(lanes, len(inputs))
        load, dealt = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        import heapq

        heap = [(0, k) for k in range(lanes)]
        for i in sorted(range(len(inputs)), key=lambda i: -len(inputs[i])):
            n, k = heapq.heappop(heap)
            dealt[k].append(i)
            load[k] = n + len(inputs[i])
            heapq.heappush(heap, (int(load[k]), k))
        order = np.argsort(-load)
        xs = [np.concatenate([inputs[i] for i in dealt[k]]) for k in order]
        ys = [np.concatenate([targets[i] for i in dealt[k]]) for k in order]
        ws = None if words is None else [np.concatenate([words[i] for i in dealt[k]]) for k in order]
        own = [np.repeat(np.array(dealt[k]), [len(inputs[i]) for i in dealt[k]]) for k in order]
        starts = [np.r_[True, np.diff(o) != 0] for o in own]
        load, shift = load[order], self._shifts()
        h, (table, u, cb) = np.zeros((lanes, self.hidden), np.float32), self._gates(lanes)
        for at in range(0, int(load[0]), window):
            live = int((load > at).sum())
            w = min(window, int(load[0]) - at)
            x, y, seq = (np.zeros((w, live), np.int64), np.zeros((w, live), np.int64), np.full((w, live), -1))
            fresh, word = np.zeros((w, live), bool), np.full((w, live), -1)
            for k in range(live):
                n = min(w, int(load[k]) - at)
                x[:n, k], y[:n, k], seq[:n, k] = xs[k][at : at + n], ys[k][at : at + n], own[k][at : at + n]
                if ws is not None:
                    word[:n, k] = ws[k][at : at + n]
                fresh[:n, k] = starts[k][at : at + n]
            h = h[:live].copy()
            hs = np.empty((w, live, self.hidden), np.float32)
            gates, a = (np.empty((3, live, self.hidden), np.float32) for _ in range(2))
            ac = np.empty((live, self.hidden), np.float32)
            for k in range(w):
                h[fresh[k]] = 0
                self._advance(np.take(table, x[k], axis=1, out=gates, mode="clip"), h, u, cb[:live], a, ac, hs[k])
                h[:] = hs[k]
            flat = hs.reshape(-1, self.hidden)
            lp = self.goal_log_probs(flat, y.ravel(), shift)
            if ws is not None:
                lp += self.word_log_probs(flat, word.ravel(), shift)
            seq = seq.ravel()
            real = seq >= 0
            out += np.bincount(seq[real], weights=lp[real], minlength=len(out))
        return out


def _words(texts) -> Iterator[tuple]:  # noqa: ANN001
    """Of some four million bytes of texts (an Arrow array; null: empty) at once all words, with A-Z lowered, and each text's number of them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    some = max(1, 4_000_000 * len(texts) // max(1, texts.nbytes))
    for at in range(0, len(texts), some):
        listed = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, some).cast(pa.string()), "")))
        words, sizes = listed.flatten(), np.diff(np.asarray(listed.offsets))
        there = np.asarray(pc.binary_length(words)) > 0
        if not there.all():  # what is before and after a text's outer spaces
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
            words = words.filter(pa.array(there))
        yield words, sizes


def _numbers(words, known):  # noqa: ANN001, ANN202
    """Of each word its place among the known ones; -1: none."""
    import numpy as np
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.index_in(words, value_set=known), -1))


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 300_000) -> DataFrame:
    """(word, c) over all texts; each task sends a word once per `most` different ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        held, n = [], 0
        for batch in batches:
            for words, _ in _words(batch.column(0)):
                found = pc.value_counts(words)
                held.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
                n += len(found)
                if n > 2 * most:
                    held = [merged()]
                    n = len(held[0])
                    if n > most:
                        yield from held[0].to_batches()
                        held, n = [], 0
        if held:
            yield from merged().to_batches()

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class LanguageModel:
    """What scoring needs: the frequent words' numbers, and by number their places among the outputs and logs."""

    words: list[bytes]
    place: object  # of each frequent word its number among the network's words; -1: rare, -2: not in the sample
    in_rare: object  # log10 P(word | class) of those without a number; 0 for words with outputs
    base: object  # log10 of the unigram base
    n_inputs_own: int  # frequent words with an input row of their own
    gru: Gru
    base_end: float
    train_tokens: int
    denominator: float
    rare_total: int
    unseen: float  # share of unseen words in the rare class

    def known(self):  # noqa: ANN201
        """The frequent words as an Arrow array."""
        import pyarrow as pa

        return pa.array([w.decode() for w in self.words], pa.string())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_t"}

    def tables(self) -> tuple:
        """Input, target class and target word (-1: none) by number: of frequent words, then the end, what fills up lanes, and last, at -1, unknown words."""
        import numpy as np

        if "_t" not in self.__dict__:
            place, at = self.place[:-1], np.arange(len(self.place) - 1)
            cls = np.where(place >= 0, np.searchsorted(self.gru.ends, place, side="right"), np.where(place == -2, LOOSE, RARE))
            inp = np.where(at < self.n_inputs_own, self.gru.n_class + at, cls)
            self.__dict__["_t"] = np.r_[inp, END, END, RARE].astype(np.int32), np.r_[cls, END, -1, RARE].astype(np.int16), np.r_[np.maximum(place, -1), -1, -1, -1].astype(np.int32)
        return self.__dict__["_t"]

    def sequences(self, idx):  # noqa: ANN001, ANN201
        """Inputs, target classes and target words (-1: none) of a text's word numbers (-1: unknown), the end included."""
        import numpy as np

        inp, cls, word = self.tables()
        own = np.empty(len(idx) + 1, np.int32)
        own[:-1], own[-1] = idx, len(self.place) - 1
        before = np.empty(len(own), np.int32)
        before[0], before[1:] = END, inp[idx]
        return before, cls[own], word[own]

    def lanes(self, texts: list, lanes: int, parts: list[tuple[int, int]]) -> Iterator[tuple]:
        """Texts' word numbers one after the other, dealt over lanes; of each part (from, to) of the steps inputs, target classes, target words and first tokens."""
        import numpy as np

        end, fill = len(self.place) - 1, len(self.place)
        sizes = [len(d) for d in texts]
        steps = -(-(sum(sizes) + len(texts)) // lanes)
        flat = np.full(lanes * steps + 1, fill, np.int32)
        flat[0], at = end, 1  # what is before a text is the end of another
        for d, n in zip(texts, sizes, strict=True):
            flat[at : at + n], flat[at + n] = d, end
            at += n + 1
        before, own = flat[:-1].reshape(lanes, steps), flat[1:].reshape(lanes, steps)
        inp, cls, word = self.tables()
        for a, b in parts:
            x, y = (np.ascontiguousarray(v[:, a:b].T) for v in (before, own))
            yield inp[x].astype(np.int64), cls[y].astype(np.int64), word[y].astype(np.int64), (x == end) | (x == fill)


def _sums(rows: DataFrame, make: Callable) -> object:
    """The means, by weight, of the float32 vectors that make(batches) gives in each task, as (vector, weight).

    The vectors are summed by Spark chunk by chunk, so the driver gets one vector, whatever the number of tasks.
    """
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vector, weight = make(batches)
        if weight:
            parts = [vector[i : i + _CHUNK] for i in range(0, len(vector), _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in parts], pa.binary()), pa.array([float(weight)] * len(parts))], ["chunk", "v", "n"])

    def mean(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        total, weight = 0.0, 0.0
        for v, n in sorted(zip(table.column("v").to_pylist(), table.column("n").to_pylist(), strict=True)):
            total, weight = total + np.frombuffer(v, "<f4").astype(np.float64) * n, weight + n
        return pa.table({"chunk": table.column("chunk")[:1], "v": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary()), "n": pa.array([weight])})

    kind = "chunk int, v binary, n double"
    found = sorted(rows.mapInArrow(run, kind).groupBy("chunk").applyInArrow(mean, kind).collect(), key=lambda r: r["chunk"])
    return (np.frombuffer(b"".join(bytes(r["v"]) for r in found), "<f4").copy(), found[0]["n"]) if found else (np.zeros(0, np.float32), 0.0)


def _balanced(vec, classes: int):  # noqa: ANN001, ANN202
    """Rows dealt to classes of equal size (at most one apart) by halving along the widest direction: class numbers."""
    import numpy as np

    out = np.zeros(len(vec), np.int64)
    parts = [(np.arange(len(vec)), 0, classes)]
    while parts:
        own, first, many = parts.pop()
        if many == 1 or len(own) < 2:
            out[own] = first
            continue
        x = vec[own] - vec[own].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        along *= np.sign(along[np.argmax(np.abs(along))] or 1)
        own, left = own[np.argsort(along, kind="stable")], many // 2
        cut = len(own) * left // many
        parts += [(own[:cut], first, left), (own[cut:], first + left, many - left)]
    return out


def train(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = 1 << 16,
    max_outputs: int = 8192,
    n_classes: int = 64,
    hidden: int = 32,
    own_inputs: int = 2000,
    learnt: float | None = None,
    rounds: int = 4,
    task_tokens: int = 2_000_000,
) -> tuple[LanguageModel, DataFrame]:
    """The model and the table of all word counts (word, c).

    Counts and network cover every training text. learnt, if given, has the
    network learn on about sqrt(learnt x tokens) tokens alone: the documents whose
    id's hash falls below that share of all. A corpus of under 500,000 tokens is
    gone through several times. Bounded, as parameters: frequent words at the
    workers (max_words) and words with outputs (max_outputs). Rows that repeat an
    id share their fate. An empty table gives a model that knows no word.
    """
    import math

    import numpy as np

    counts = scratch.put(word_counts(docs, text_col))
    n_docs = docs.count()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = total + n_docs, kinds + (1 if n_docs else 0)
    denominator = n + 0.1 * (v + 1)
    # the least count that at most max_words words reach, found on a histogram of counts
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    least, room = 1 << 62, max_words  # words met once stay rare: they stand for the unseen
    for r in sorted(steps, key=lambda r: -r["k"]):
        room -= r["n"]
        if room < 0:
            break
        least = max(2, r["c"])
    frequent = sorted(((r["word"].encode(), r["c"]) for r in counts.filter(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))
    words, c = [w for w, _ in frequent], np.array([x for _, x in frequent], float)
    once = counts.filter("c = 1").count()

    sent = docs.sparkSession.sparkContext.broadcast([w.decode() for w in words])

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = pa.array(sent.value, pa.string())
        for batch in batches:
            for found, sizes in _words(batch.column(0)):
                ends = np.r_[0, 4 * np.cumsum(sizes)].astype(np.int32)
                idx = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(_numbers(found, known).tobytes())])
                yield pa.RecordBatch.from_arrays([idx], ["idx"])

    share, some = 1.0, docs
    if learnt is not None:
        share = min(1.0, math.sqrt(learnt / max(1, n)))
        h = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 11)  # 53 bits
        some = docs.filter(F.col(id_col).isNotNull() & (h < F.lit(int(share * (1 << 53)))))
    passes = max(1, round(math.sqrt((learnt or 5e5) / max(1, n))))
    # dealt by rows, not by a key, so that no document's copies fill a task
    numbered = some.select(F.col(text_col).cast("string")).mapInArrow(number, "idx binary")
    sample = scratch.put(numbered.repartition(max(1, math.ceil(share * n / task_tokens))))

    n_out = min(max_outputs, len(words))
    dim = 32

    def texts(batches: Iterator) -> list:
        return [np.frombuffer(x, np.int32) for x in sorted(v.as_py() for b in batches for v in b.column(0))]

    def neighbours(batches: Iterator) -> tuple:
        """Of each word the sum of its documents' vectors, and in how many places it is; a rare word's are the last row's."""
        r = np.random.default_rng(2).normal(size=(n_out + 1, dim)).astype(np.float32)
        r[-1] = 0
        out = np.zeros((n_out + 1, dim + 1), np.float64)
        all_texts = texts(batches)
        ends = np.cumsum([len(d) for d in all_texts], dtype=np.int64)
        for some in np.split(np.arange(len(all_texts)), np.flatnonzero(np.diff(ends // 300_000)) + 1):  # some 300,000 words at once
            at = np.repeat(np.arange(len(some)), [len(all_texts[i]) for i in some])
            if not len(at):
                continue
            d = np.concatenate([all_texts[i] for i in some])
            pair, many = np.unique(at * (n_out + 1) + np.where((d >= 0) & (d < n_out), d, n_out), return_counts=True)
            at, own = np.divmod(pair, n_out + 1)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            doc = np.add.reduceat(r[own] * many[:, None].astype(np.float32), first, axis=0)
            doc /= np.linalg.norm(doc, axis=1, keepdims=True) + 1e-9
            by = np.argsort(own, kind="stable")
            words, start = np.unique(own[by], return_index=True)
            at = (np.cumsum(np.r_[0, at[1:] != at[:-1]]))[by]
            out[words, :dim] += np.add.reduceat(doc[at] * many[by, None].astype(np.float32), start, axis=0)
            out[words, dim] += np.add.reduceat(many[by], start)
        return out.ravel(), 1

    near, tasks = _sums(sample, neighbours)
    near = near.reshape(-1, dim + 1) * tasks if len(near) else np.zeros((n_out + 1, dim + 1))
    met, lacking = np.flatnonzero(near[:n_out, dim] > 0), np.flatnonzero(near[:n_out, dim] == 0)
    mean = near[:n_out, :dim].sum(axis=0) / max(1.0, near[:n_out, dim].sum())
    vec = near[met, :dim] / near[met, dim:] - mean
    classes = max(1, min(n_classes, len(met)))
    cls = _balanced(vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-9), classes) + LOOSE + 1
    order = np.argsort(cls, kind="stable")
    place = np.full(len(words), -1, np.int64)
    place[met[order]] = np.arange(len(met))
    place[lacking] = -2
    n_class = LOOSE + 1 + classes
    gru = Gru(n_class + min(own_inputs, len(words)), n_class, hidden, ends=np.cumsum(np.bincount(cls, minlength=n_class)))
    mass = np.bincount(cls, weights=c[met], minlength=n_class)
    loose = c[lacking].sum()
    rare = total - int(c[met].sum() + loose)
    mass[RARE], mass[END] = rare, n_docs
    gru.p["b"] = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
    gru.p["b"][LOOSE] = -1e9  # no target of the sample; its share is set below
    if len(met):
        gru.p["wb"] = np.log(c[met[order]] / mass[cls[order]]).astype(np.float32)
    # Good and Turing: words met once tell the share of those not met; at least one in as many tokens
    unseen = 1.0 if not rare else min(0.9, max(once, 1) / (rare + 1))
    in_rare = np.where(place == -1, np.log10((1 - unseen) * np.maximum(c, 1) / max(1, rare)) if unseen < 1 else 0.0, 0.0)
    in_rare[lacking] = np.log10(c[lacking] / max(1, loose))
    end = math.log10((n_docs + 0.1) / denominator)
    model = LanguageModel(words, np.r_[place, -1], np.r_[in_rare, 0.0], np.r_[np.log10((c + 0.1) / denominator), 0.0], min(own_inputs, len(words)), gru, end, n, denominator, rare, unseen)

    model.words = []  # the sample has numbers
    for k in range(rounds if tasks else 0):
        start = docs.sparkSession.sparkContext.broadcast(model)

        def learn(batches: Iterator, start=start, k: int = k) -> tuple:  # noqa: ANN001
            m = start.value
            own = texts(batches)
            if not own:
                return np.zeros(0, np.float32), 0
            tokens = sum(map(len, own)) + len(own)
            lanes = max(1, min(96, tokens // 400), min(384, tokens // 5000))
            steps = -(-tokens // lanes)
            gru = deepcopy(m.gru)  # a worker's next task starts from the round's parameters, too
            # each round has its part of the steps, passes times where all of the corpus is not enough
            todo = range(k * passes, (k + 1) * passes)
            parts = [(steps * (part % rounds) // rounds, steps * (part % rounds + 1) // rounds) for part in todo]
            for part, (x, y, w, fresh) in zip(todo, m.lanes(own, lanes, parts), strict=True):
                window = min(20, len(x))
                if window > 0:
                    gru.train(x, y, fresh, window, lanes_word=w, progress=(part / (passes * rounds), (part + 1) / (passes * rounds)))
            return np.concatenate([v.ravel() for v in gru.p.values()]), tokens

        flat, _ = _sums(sample, learn)
        start.unpersist()
        at = 0
        for name, old in gru.p.items() if len(flat) else ():
            gru.p[name] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
    model.words = words
    sent.unpersist()
    gru.loose = min(0.999, max(1e-12, float(loose) / max(1, n)))
    gru.p["x"][LOOSE] = gru.p["x"][RARE]
    return model, counts


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, base_score, score (log10 probabilities of the whole text).

    Null and empty texts are one end token. Rows are told apart by their place
    in a written table, so repeated ids stay apart. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "rid long, doc long, n_tokens long, n_known long, base double, model double, rare array<struct<w:string,n:int>>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = sent.value
        known = m.known()

        def read(rid, doc, texts) -> Iterator:  # noqa: ANN001
            """Rows without the network's part, and their sequences, some texts at once."""
            at = 0
            for words, sizes in _words(texts):
                n, ends, idx = len(sizes), np.r_[0, np.cumsum(sizes)], _numbers(words, known)
                of = np.repeat(np.arange(n), sizes)
                base, inside, unknown = (np.bincount(of, weights=x, minlength=n) for x in (m.base[idx], m.in_rare[idx], idx < 0))
                lost = np.flatnonzero(idx < 0)
                rare = pa.table([of[lost], words.take(pa.array(lost))], ["of", "w"]).group_by(["of", "w"], use_threads=False).aggregate([([], "count_all")])
                rare = rare.take(pa.array(np.argsort(rare["of"].to_numpy(), kind="stable"))).combine_chunks()  # groups come in no certain order
                starts = np.r_[0, np.cumsum(np.bincount(rare["of"].to_numpy(), minlength=n))].astype(np.int32)
                w, many = (rare[k].cast(t).combine_chunks() for k, t in (("w", pa.string()), ("count_all", pa.int32())))
                values = pa.StructArray.from_arrays([w, many], ["w", "n"])
                rows = [rid.slice(at, n), doc.slice(at, n), pa.array(sizes + 1, pa.int64()), pa.array((sizes - unknown + 1).astype(np.int64)), pa.array(base + m.base_end), pa.array(inside), pa.ListArray.from_arrays(pa.array(starts), values)]
                yield pa.RecordBatch.from_arrays(rows, ["rid", "doc", "n_tokens", "n_known", "base", "model", "rare"]), [m.sequences(idx[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                at += n

        def scored() -> Iterator:
            inputs, targets, words = (list(x) for x in zip(*sequences, strict=True))
            rows = pa.Table.from_batches(held)
            log = m.gru.score(inputs, targets, words=words) / np.log(10) + rows["model"].to_numpy()
            yield from rows.set_column(rows.schema.get_field_index("model"), "model", pa.array(log)).combine_chunks().to_batches()

        held, sequences, tokens = [], [], 0
        for batch in batches:
            for rows, more in read(*batch.columns):
                held.append(rows)
                sequences += more
                tokens += sum(len(x[0]) for x in more)
                if tokens > 3_000_000 or len(sequences) >= 20_000:
                    yield from scored()
                    held, sequences, tokens = [], [], 0
        if held:
            yield from scored()

    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    found = scratch.put(texts.mapInArrow(run, kind))
    sent.unpersist()
    rare = found.select("rid", F.inline("rare")).join(counts.withColumnRenamed("word", "w"), "w", "left")
    log10: Column = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(model.denominator))
    inside = F.when(F.col("c").isNull(), F.log10(F.lit(model.unseen))).otherwise(F.log10(F.lit(1 - model.unseen) * F.col("c") / F.lit(float(max(1, model.rare_total)))))
    rare = rare.select("rid", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("n_known"), (F.col("n") * log10).alias("base"), (F.col("n") * inside).alias("model"))
    extra = rare.groupBy("rid").agg(F.sum("n_known").alias("k"), F.sum("base").alias("b"), F.sum("model").alias("m"))
    out = found.drop("rare").join(extra, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(F.col("doc").alias(id_col), "n_tokens", add("n_known", "k").alias("n_known"), add("base", "b").alias("base_score"), add("model", "m").alias("score"))
