"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A word's input is its own vector (words of the training sample; a shared one for all others) beside the mean
vector of its character trigrams. A window of ``WINDOW`` words is read by one GRU from each side, the states
are pooled by attention, and a logistic unit gives the window's log-odds. A window begins at every word that has
``WINDOW`` words from there (a shorter text is one window); a document's score is its highest window, passed
through a logistic calibration fitted on all windows of the training documents.

Only documents are labelled, so training alternates: the windows of toxic documents that score highest are the
positive examples, random and highest-scoring windows of clean documents the negative ones, of windows that overlap by
half and cover the whole text. The first choice
follows each word's smoothed log-odds, which also start one component of its vector.

Bounds of the fit (parameters): ``per_class`` labelled ids of each class with the smallest hash, one text of at
most ``max_chars`` characters for each; no more than that reaches the driver, however often labels, ids or texts
repeat. ``epochs`` is the least number of readings: small samples are read up to twice as often. Scoring reads
every text whole and is map-only; the model is broadcast and has a fixed size but for the word table, which is at
most ``max_words`` rows.

Defined cases: null, empty and wordless texts score 0; labels that are null, or whose document is missing or
null, teach nothing; an id with several labels counts as toxic if one says so, and of its texts the least one in
byte order is learned from; without both classes every score is 0; repeated rows are each scored; extra columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean
from .wordhash import words

#: Words of a window, and the step between windows to train on; scoring steps by one word.
WINDOW, STRIDE = 12, 6
UNITS, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 8, 8, 4096
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


class Text:
    """Words of some texts: for each its place in a table of distinct words; and the trigrams of these."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").lower().encode().translate(_FOLD) for t in texts]
        ends = np.cumsum([len(x) + 1 for x in data])
        whole = b" ".join(data)
        first, stop, hashes = words(whole)
        owner = np.searchsorted(ends, first, side="right")
        self.begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.hashes, where, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        first, size = first[where], (stop - first)[where]
        # Trigrams of each distinct word, with a blank on either side.
        self.tri_begin = np.cumsum(size) - size
        at = np.repeat(first - self.tri_begin, size) + np.arange(size.sum())
        body = np.frombuffer(b" " + whole + b"  ", dtype=np.uint8).astype(np.uint32)
        code = body[at] * np.uint32(0x9E3779B1) + body[at + 1] * np.uint32(0x85EBCA6B) + body[at + 2] * np.uint32(0xC2B2AE35)
        self.trigrams = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
        self.tri_size = size

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and length of the windows to train on, the last one of a text ending with it."""
        n = np.diff(self.begin)
        full = np.maximum(n - WINDOW, 0)
        count = np.where(n > 0, -(-full // STRIDE) + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        return doc, self.begin[doc] + np.minimum(k * STRIDE, full[doc]), np.minimum(n[doc], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights by name; all float32."""

    def __init__(self, vocabulary: np.ndarray, prior: np.ndarray, seed: int = 1):
        draw = np.random.default_rng(seed)
        unit = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        dim = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary  # sorted hashes; row 0 of the table is for all other words
        self.w = {"word": unit(len(vocabulary) + 1, WORD_DIM) * 0.1, "char": unit(TRIGRAMS, CHAR_DIM) * 0.3}
        self.w["word"][1:, 0] = prior
        for d in "fb":
            self.w |= {f"in_{d}": unit(dim, 3 * UNITS), f"rec_{d}": unit(UNITS, 3 * UNITS), f"bias_{d}": np.zeros(3 * UNITS, np.float32)}
        self.w |= {"attend": unit(2 * UNITS), "out": unit(2 * UNITS), "bias": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def rows(self, text: Text) -> np.ndarray:
        """Rows of the word table for the distinct words."""
        if not len(self.vocabulary):
            return np.zeros(len(text.hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, text.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == text.hashes, at + 1, 0)

    def inputs(self, text: Text, rows: np.ndarray) -> np.ndarray:
        """Input vectors of the distinct words."""
        out = np.empty((len(rows), WORD_DIM + CHAR_DIM), dtype=np.float32)
        out[:, :WORD_DIM] = self.w["word"][rows]
        for k in range(CHAR_DIM if len(rows) else 0):
            sums = np.add.reduceat(self.w["char"][:, k][text.trigrams], text.tri_begin)
            out[:, WORD_DIM + k] = sums / text.tri_size
        return out

    def _gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Projected inputs [gate, word] of both directions, those of the two sigmoid gates halved."""
        out = {d: np.ascontiguousarray((x @ self.w[f"in_{d}"] + self.w[f"bias_{d}"]).T) for d in "fb"}
        for g in out.values():
            g[: 2 * UNITS] *= 0.5
        return out

    def _read(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray | None, d: str) -> np.ndarray:
        """States [step, unit, lane] of one direction; gates are those of ``_gates``, ``at`` [step, lane] or slices.

        Sigmoids are 0.5 + 0.5 * tanh(x / 2); all their halves but one stand in the weights, and every step works in
        the same few arrays.
        """
        steps, lanes = len(at), at[0].stop - at[0].start if isinstance(at[0], slice) else at.shape[1]
        u = np.ascontiguousarray(self.w[f"rec_{d}"].T) * np.float32(0.5)
        out = np.empty((steps, UNITS, lanes), np.float32)
        r, zr, new = (np.empty((k * UNITS, lanes), np.float32) for k in (3, 2, 1))
        h, z, reset, rn = None, zr[:UNITS], zr[UNITS:], r[2 * UNITS :]
        for t in range(steps) if d == "f" else reversed(range(steps)):
            x, left = gates[:, at[t]], out[t]
            if h is None:  # before the first word the state is zero
                np.tanh(x[:UNITS], out=z)
                np.tanh(x[2 * UNITS :], out=new)
                np.negative(new, out=left)
            else:
                np.matmul(u, h, out=r)
                np.add(x[: 2 * UNITS], r[: 2 * UNITS], out=zr)
                np.tanh(zr, out=zr)
                np.multiply(rn, reset, out=new)
                new += rn
                new += x[2 * UNITS :]
                np.tanh(new, out=new)
                np.subtract(h, new, out=left)
            z += 1
            z *= 0.5
            left *= z
            left += new
            if mask is not None:
                left *= mask[t]
            h = left
        return out

    def logits(self, text: Text, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and log-odds of the windows to train on."""
        doc, first, size = text.windows()
        x = self.inputs(text, self.rows(text))
        gates = self._gates(x)
        out = np.empty(len(doc), dtype=np.float32)
        whole = size == WINDOW
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for i in range(0, len(group), lanes):
                part = group[i : i + lanes]
                step = np.arange(WINDOW)[:, None]
                mask = None if whole[part[0]] else (step < size[part]).astype(np.float32)
                at = text.word[np.minimum(first[part] + step, len(text.word) - 1)]
                h = np.concatenate([self._read(gates[d], at, mask, d) for d in "fb"], axis=1)
                e = np.einsum("tul,u->tl", h, self.w["attend"])
                e = e if mask is None else np.where(mask > 0, e, -1e9)
                e = np.exp(e - e.max(axis=0))
                value = np.einsum("tul,u->tl", h, self.w["out"])
                out[part] = (e * value).sum(axis=0) / e.sum(axis=0) + self.w["bias"][0]
        return doc, first, out

    def highest(self, text: Text, docs: int, lanes: int = 2048) -> np.ndarray:
        """The highest log-odds of all overlapping windows of each document; -inf without words."""
        out, n = np.full(docs, -np.inf), np.diff(text.begin)
        x = self.inputs(text, self.rows(text))
        gates = self._gates(x)
        heads = {d: np.stack((self.w["attend"][i : i + UNITS], self.w["out"][i : i + UNITS])) for d, i in (("f", 0), ("b", UNITS))}
        size = np.repeat(n, n)  # of the document of each word
        left = np.repeat(text.begin[1:], n) - np.arange(len(size))
        owner = np.repeat(np.arange(docs), n)
        starts = {True: np.flatnonzero(left >= WINDOW), False: np.flatnonzero((size < WINDOW) & (left == size))}
        for whole, first in starts.items():
            for i in range(0, len(first), lanes):
                part = first[i : i + lanes]
                step = np.arange(WINDOW)[:, None]
                mask = None if whole else (step < size[part]).astype(np.float32)
                # Neighbouring windows share their words' gates: these are gathered once for the stretch.
                low = part[0]
                at = np.arange(low, part[-1] + 1) if whole and part[-1] - low < 2 * lanes else part
                if at is part:
                    where = text.word[np.minimum(part + step, len(text.word) - 1)]
                    both = {d: self._read(gates[d], where, mask, d) for d in "fb"}
                else:
                    stretch = text.word[low : part[-1] + WINDOW]
                    both = {d: self._read(gates[d][:, stretch], [slice(t, t + len(at)) for t in range(WINDOW)], None, d) for d in "fb"}
                e, value = np.moveaxis(sum(heads[d] @ both[d] for d in "fb"), 1, 0)
                e = e if mask is None else np.where(mask > 0, e, -1e9)
                e = np.exp(e - e.max(axis=0))
                odds = (e * value).sum(axis=0) / e.sum(axis=0) + self.w["bias"][0]
                odds, own = odds if at is part else odds[part - low], owner[part]
                new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                out[own[new]] = np.maximum(out[own[new]], np.maximum.reduceat(odds, new))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.slope * self.highest(Text(texts), len(texts)) + self.shift)))

    # Training.

    def gradients(self, text: Text, rows: np.ndarray, first: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over some windows, by back-propagation through time."""
        w, n, g = self.w, len(first), {}
        step = np.arange(WINDOW)[:, None]
        mask = (step < size).astype(np.float32)
        at = text.word[np.minimum(first + step, len(text.word) - 1)]
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        x = self.inputs_of(text, rows, used)
        kept: dict[str, list] = {"f": [], "b": []}
        h_all = np.empty((WINDOW, n, 2 * UNITS), np.float32)
        for k, d in enumerate("fb"):
            gates, h = x @ w[f"in_{d}"] + w[f"bias_{d}"], np.zeros((n, UNITS), np.float32)
            for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
                xs, r = gates[local[t]], h @ w[f"rec_{d}"]
                zr = _sigmoid(xs[:, : 2 * UNITS] + r[:, : 2 * UNITS])
                z, reset, rn = zr[:, :UNITS], zr[:, UNITS:], r[:, 2 * UNITS :]
                new = np.tanh(xs[:, 2 * UNITS :] + reset * rn)
                kept[d].append((t, h, z, reset, rn, new))
                h = (new + z * (h - new)) * mask[t][:, None]
                h_all[t, :, k * UNITS : (k + 1) * UNITS] = h
        e = np.where(mask > 0, h_all @ w["attend"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        value = h_all @ w["out"]
        logit = (a * value).sum(axis=0) + w["bias"][0]
        d_logit = ((_sigmoid(logit) - label) / n).astype(np.float32)
        d_value, d_e = a * d_logit, a * (value - (a * value).sum(axis=0)) * d_logit
        g["bias"] = d_logit.sum(keepdims=True)
        g["out"], g["attend"] = np.einsum("tn,tnu->u", d_value, h_all), np.einsum("tn,tnu->u", d_e, h_all)
        d_h_all = d_value[:, :, None] * w["out"] + d_e[:, :, None] * w["attend"]
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            d_gates, d_next = np.zeros((len(used), 3 * UNITS), np.float32), np.zeros((n, UNITS), np.float32)
            g[f"rec_{d}"] = np.zeros_like(w[f"rec_{d}"])
            for t, h, z, reset, rn, new in reversed(kept[d]):
                dh = (d_h_all[t, :, k * UNITS : (k + 1) * UNITS] + d_next) * mask[t][:, None]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z, d_r = dh * (h - new) * z * (1 - z), d_new * rn * reset * (1 - reset)
                d_rec = np.concatenate((d_z, d_r, d_new * reset), axis=1)
                g[f"rec_{d}"] += h.T @ d_rec
                d_next = dh * z + d_rec @ w[f"rec_{d}"].T
                np.add.at(d_gates, local[t], np.concatenate((d_z, d_r, d_new), axis=1))
            g[f"in_{d}"], g[f"bias_{d}"] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ w[f"in_{d}"].T
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(g["word"], rows[used], d_x[:, :WORD_DIM])
        size_of = text.tri_size[used]
        tri = np.repeat(text.tri_begin[used] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
        np.add.at(g["char"], text.trigrams[tri], np.repeat(d_x[:, WORD_DIM:] / size_of[:, None], size_of, axis=0))
        return g

    def inputs_of(self, text: Text, rows: np.ndarray, used: np.ndarray) -> np.ndarray:
        """As ``inputs``, for some of the distinct words."""
        size = text.tri_size[used]
        begin = np.cumsum(size) - size
        tri = np.repeat(text.tri_begin[used] - begin, size) + np.arange(size.sum())
        chars = np.add.reduceat(self.w["char"][text.trigrams[tri]], begin, axis=0) / size[:, None]
        return np.concatenate((self.w["word"][rows[used]], chars), axis=1).astype(np.float32)

    def train(self, text: Text, label: np.ndarray, odds: np.ndarray, epochs: int, batch: int, seed: int = 2) -> None:
        """Adam over chosen windows; ``odds`` of the distinct words choose the first epoch's windows."""
        draw = np.random.default_rng(seed)
        doc, first, size = text.windows()
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, true_rows = 0, self.rows(text)
        chosen = 4 * (label > 0).sum() + (label <= 0).sum() + 1000
        epochs = max(epochs, min(2 * epochs, 250 * batch // int(chosen)))  # small samples are read more often
        for epoch in range(epochs):
            if epoch:
                value = self.logits(text)[2]
            else:
                by_word = odds[text.word]
                value = np.array([by_word[a : a + n].max() for a, n in zip(first, size, strict=True)], dtype=np.float32)
            order = np.lexsort((-value, doc))
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            toxic = label[doc[order]] > 0
            positive = order[toxic & (rank == 0)]
            clean = order[~toxic]
            hard, other = order[~toxic & (rank == 0)], draw.permutation(clean)[: 2 * len(positive) + 1000]
            chosen = np.concatenate((positive, positive, hard, other))
            chosen = draw.permutation(chosen)
            for i in range(0, len(chosen), batch):
                part = chosen[i : i + batch]
                rows = np.where(draw.random(len(true_rows)) < 0.1, 0, true_rows)  # some words show their letters only
                g = self.gradients(text, rows, first[part], size[part], (label[doc[part]] > 0).astype(np.float32))
                step += 1
                rate = 0.02 * min(1, step / 20) * (1 - epoch / epochs) ** 0.5
                for k, v in g.items():
                    v += 1e-5 * self.w[k]
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.w[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, text: Text, label: np.ndarray) -> None:
        """Logistic regression of the document label on the highest window, by Newton steps with a weak prior."""
        x, y = self.highest(text, len(label)), (label > 0).astype(float)
        x, y = np.clip(x[np.isfinite(x)], -30, 30), y[np.isfinite(x)]
        beta, design = np.array([1.0, 0.0]), np.stack((x, np.ones_like(x)), axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ beta))
            grad = design.T @ (p - y) + 0.1 * (beta - [1.0, 0.0])
            beta -= np.linalg.solve((design.T * (p * (1 - p) + 1e-6)) @ design + 0.1 * np.eye(2), grad)
        self.slope, self.shift = max(float(beta[0]), 1e-3), float(beta[1])


def build(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 256, max_words: int = 50_000) -> Network:
    """A trained network; texts in a fixed order give the same network."""
    text, label = Text(texts), np.array(labels, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(text.begin))
    pairs = np.unique(np.stack((text.word, doc)), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    n = len(text.hashes)
    df = np.bincount(pairs[0], minlength=n)
    toxic = np.bincount(pairs[0], weights=label[pairs[1]] > 0, minlength=n)
    total = max((label > 0).sum(), 1), max((label <= 0).sum(), 1)
    odds = np.log((toxic + 0.5) / (total[0] + 1)) - np.log((df - toxic + 0.5) / (total[1] + 1))
    chosen = np.sort(np.lexsort((np.arange(n), -df))[:max_words])
    chosen = chosen[df[chosen] >= 2]
    net = Network(text.hashes[chosen], np.clip(odds[chosen] / 4, -1, 1).astype(np.float32))
    net.train(text, label, np.where(df >= 3, odds, 0).astype(np.float32), epochs, batch)
    net.calibrate(text, label)
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 4_000, max_chars: int = 20_000) -> Network | None:
    """The network learned from a bounded sample of labelled rows (see the module); None without both classes."""
    marks = labels.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("y")).where("id is not null and y is not null")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.length("t") <= max_chars)
    known = marks.groupBy("id").agg(F.max("y").alias("y"))
    # At most 2 * per_class ids whatever the tables' sizes: small enough to send to every task.
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    found = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    rows = sorted((r.id, r.t, r.y) for r in found.collect())
    if len({y for _, _, y in rows}) < 2:
        return None
    return build([t for _, t, _ in rows], [y for _, _, y in rows])


def score(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text", batch_chars: int = 1 << 20) -> DataFrame:
    """doc_id and score of every row, over all windows of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, at = batch.column(1), [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < batch_chars:
                    part.append(texts[at].as_py())
                    size, at = size + len(part[-1] or ""), at + 1
                out.append(shared.value.scores(part) if shared.value else np.zeros(len(part)))
            scores = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    schema = StructType().add("doc_id", docs.schema[doc_id].dataType).add("score", "double")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)
