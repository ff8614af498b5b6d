"""Language-model scores by a gated recurrent network in numpy, with a class-factored output softmax.

Counts of all training tokens are gathered first (a word, its count). The most frequent words, at most `HEAD`, are known
to the network; all others are one class, in which a word has the share (c + 1) / Z, Z including one unseen type. The most
frequent words are inputs of their own and fall, by frequency, into classes of `WIDTH` words with a softmax over the
hidden state; the rest of the head falls into classes by ending, with shares by count inside. So a token's probability
is P(class | state) * P(word | class, state), and the sum over all words and the unseen type is 1.

The network is a GRU, trained by truncated backpropagation (windows of `STEPS` tokens, the state carried on) in one
pass over all training documents: they are dealt by hash to `ROUNDS` parts, each document to one of them; in a round
each partition of its part starts from the common weights, and their token-weighted mean is the next start (averaging
is done in a few tasks, not on the driver). Weights start at the class shares of all counts, so an untrained network
scores like the counts. Scoring runs through every document from its first token to
its end with one state, in windows, whatever its length.

Defined cases: a null or empty text is the end token alone; every row is scored, repeated rows too; ids that are null
count as training rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_fold, distinct, flat_bytes, prepare, ragged, span_hashes, word_spans, written

FOLDS, HELD_OUT = 7, 2
#: Words known to the network, words with inputs and outputs of their own, words of a class, classes by ending.
HEAD, OWN, WIDTH, ENDINGS = 150_000, 1024, 32, 40
HIDDEN, STEPS, ROUNDS, SEED = 16, 24, 3, 3
#: Words that a task counts before it passes them on; tokens that are scored together.
HOLD, TOGETHER = 400_000, 1_500_000
END = "\n"
OWN_CLASSES = OWN // WIDTH
CLASSES = OWN_CLASSES + ENDINGS + 2
TAIL = CLASSES - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END_HASH = span_hashes(np.frombuffer(END.encode(), np.uint8), np.array([0]), np.array([1]))[0]


def _spans(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, off = flat_bytes(texts)
    data = _LOWER[raw]
    return data, *word_spans(data, off)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(data[ragged(start, size)].copy())).cast(pa.string())


def _count(incoming):
    """(word, count) of a task, in pieces of at most about HOLD words; words are told apart by 64 bits within a piece."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    size = ends = 0

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        unique, first, which = distinct(np.concatenate([h for h, _, _ in held]))
        counts = np.bincount(which, np.concatenate([c for _, c, _ in held])).astype(np.int64)
        return unique, counts, pa.concat_arrays([w for _, _, w in held]).take(pa.array(first))

    for b in batches(incoming):
        data, start, end, _ = _spans(b.column(0))
        unique, first, which = distinct(span_hashes(data, start, end))
        held.append((unique, np.bincount(which, minlength=len(unique)), _strings(data, start[first], end[first])))
        size, ends = size + len(unique), ends + b.num_rows
        if size > 2 * HOLD:
            held = [merged()]
            size = len(held[0][0])
            if size > HOLD:
                yield pa.RecordBatch.from_arrays([held[0][2], pa.array(held[0][1])], ["word", "c"])
                held, size = [], 0
    if held:
        _, counts, words = merged()
        yield pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "c"])
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], ["word", "c"])


class Vocabulary:
    """The head: symbol, class, place within the class, and log shares of each word."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int, types: int):
        n = len(words)
        text = "".join(words).encode()
        ends = np.cumsum([len(w.encode()) for w in words]).astype(np.int64) if n else np.zeros(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if n else ends
        hashes = span_hashes(np.frombuffer(text, np.uint8), starts, ends) if n else np.zeros(0, np.uint64)
        rank = np.arange(n)
        own = rank < OWN
        endings = [w[-2:] for w in words]
        mass: dict[str, int] = {}
        for w, c in zip(endings[OWN:], counts[OWN:].tolist(), strict=True):
            mass[w] = mass.get(w, 0) + c
        top = {w: k for k, w in enumerate(sorted(mass, key=lambda w: (-mass[w], w))[:ENDINGS])}
        cls = np.where(own, rank // WIDTH, np.array([OWN_CLASSES + top.get(w, ENDINGS) for w in endings], np.int64)) if n else np.zeros(0, np.int64)
        smooth = counts + 1.0
        per = np.bincount(cls, smooth, minlength=CLASSES)
        per[TAIL] = (total - counts.sum()) + (types - n) + 1  # Z: counts + 1 of all other words, and one unseen type
        self.log_z = float(np.log10(per[TAIL]))
        with np.errstate(divide="ignore"):
            self.class_bias = np.where(per > 0, np.log(np.maximum(per, 1e-300) / per.sum()), -1e9).astype(np.float32)
        self.word_bias = np.full(OWN, -1e9, np.float32)
        self.word_bias[: own.sum()] = np.log(smooth[own])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.cls, self.place = cls[order].astype(np.int32), np.where(own, rank % WIDTH, -1)[order].astype(np.int32)
        self.symbol = np.where(own, rank, OWN + cls - OWN_CLASSES)[order].astype(np.int32)
        self.inside = np.where(own, 0.0, np.log10(smooth / per[cls]))[order] if n else np.zeros(0)
        self.log_count = np.log10(smooth)[order]
        self.symbols = OWN + CLASSES - OWN_CLASSES
        self.end = int(np.searchsorted(self.hashes, _END_HASH)) if n else -1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the head, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def read(self, hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Head places of all tokens with each document's end token, and the n+1 offsets."""
        docs = len(before) - 1
        out = np.empty(len(hashes) + docs, np.int64)
        unique, _, which = distinct(hashes)
        out[np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(before))] = self.find(unique)[which]
        out[before[1:] + np.arange(docs)] = self.end if self.end < len(self.hashes) else -1
        return out, before + np.arange(docs + 1)

    def codes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input symbol, class, and place in a class with a softmax of its own (else -1)."""
        if not len(self.hashes):
            return np.full(len(at), self.symbols - 1, np.int32), np.full(len(at), TAIL, np.int32), np.full(len(at), -1, np.int32)
        known = at >= 0
        return np.where(known, self.symbol[at], self.symbols - 1), np.where(known, self.cls[at], TAIL), np.where(known, self.place[at], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _log_softmax_at(a: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each column of logits, the logarithm of the softmax at `row`; `a` is overwritten."""
    a -= a.max(axis=0)
    picked = a[row, np.arange(a.shape[1])]
    return picked - np.log(np.exp(a, out=a).sum(axis=0))


class Gru:
    """Weights: x (symbols + 1, the last row starts a text), u, class output, word output."""

    def __init__(self, vocab: Vocabulary, hidden: int = HIDDEN):
        r = np.random.default_rng(SEED)
        self.x = (r.standard_normal((vocab.symbols + 1, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.wc, self.bc = np.zeros((hidden, CLASSES), np.float32), vocab.class_bias.copy()
        self.ww, self.bw = np.zeros((OWN, hidden), np.float32), vocab.word_bias.copy()

    NAMES = ("x", "u", "wc", "bc", "ww", "bw")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k in self.NAMES:
            w = getattr(self, k)
            setattr(self, k, flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return self

    def step(self, symbol: np.ndarray, h: np.ndarray):
        n = h.shape[1]
        x, g = self.x[symbol], h @ self.u
        zr = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
        return new + z * (h - new), (z, r, new, g[:, 2 * n :])

    def log_probs(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(class) * P(word | class); the latter only where place >= 0."""
        # classes are rows, so that maxima and sums run along contiguous memory
        out = _log_softmax_at(self.wc.T @ h.T + self.bc[:, None], cls)
        mine, edges = self._by_class(cls, place)
        out[mine] += _log_softmax_at(self._inner(h[mine], edges), place[mine])
        return out

    def _by_class(self, cls: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens with a softmax inside their class, sorted by class, and where each class begins."""
        mine = np.flatnonzero(place >= 0)
        mine = mine[np.argsort(cls[mine], kind="stable")]
        return mine, np.searchsorted(cls[mine], np.arange(OWN_CLASSES + 1))

    def _inner(self, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Logits (WIDTH x tokens) inside the classes, for states sorted by class."""
        a = np.empty((WIDTH, len(h)), h.dtype)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a[:, edges[k] : edges[k + 1]] = self.ww[k * WIDTH : (k + 1) * WIDTH] @ h[edges[k] : edges[k + 1]].T
        a += self.bw.reshape(-1, WIDTH).repeat(np.diff(edges), axis=0).T
        return a

    def gradient(self, symbol: np.ndarray, cls: np.ndarray, place: np.ndarray, h0: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients over a window (steps x batch; cls < 0: nothing stands there), and the last state.

        Where the symbol is that of a text's start, the state begins anew.
        """
        keep = (symbol != len(self.x) - 1)[:, :, None].astype(h0.dtype)
        steps, n = symbol.shape[0], h0.shape[1]
        hs, before, kept = [h0], [], []
        for t in range(steps):
            before.append(hs[-1] * keep[t])
            h, k = self.step(symbol[t], before[-1])
            hs.append(h)
            kept.append(k)
        h, c, w = np.concatenate(hs[1:]), cls.ravel(), place.ravel()
        real = c >= 0
        count = max(1, int(real.sum()))
        rows = np.flatnonzero(real)
        p = self.wc.T @ h.T + self.bc[:, None]
        p -= p.max(axis=0)
        picked = p[c[rows], rows]
        total = np.exp(p, out=p).sum(axis=0)
        loss = float(np.log(total[rows]).sum() - picked.sum())
        p *= real / (total * count)
        p[c[rows], rows] -= p.dtype.type(1 / count)
        g = {"wc": (p @ h).T, "bc": p.sum(axis=1), "ww": np.zeros_like(self.ww), "bw": np.zeros_like(self.bw), "x": np.zeros_like(self.x)}
        dh_out = (self.wc @ p).T
        own, edges = self._by_class(c, w)
        mine, some = h[own], np.flatnonzero(np.diff(edges))
        q, i = self._inner(mine, edges), np.arange(len(own))
        q -= q.max(axis=0)
        picked = q[w[own], i]
        total = np.exp(q, out=q).sum(axis=0)
        loss += float(np.log(total).sum() - picked.sum())
        q /= total * count
        q[w[own], i] -= q.dtype.type(1 / count)
        back = np.empty_like(mine)
        for k in some.tolist():
            at, s = slice(edges[k], edges[k + 1]), slice(k * WIDTH, (k + 1) * WIDTH)
            g["ww"][s] = q[:, at] @ mine[at]
            back[at] = q[:, at].T @ self.ww[s]
        if len(some):
            g["bw"].reshape(-1, WIDTH)[some] = np.add.reduceat(q, edges[some], axis=1).T
            dh_out[own] += back
        dh_out = dh_out.reshape(steps, -1, n)
        # what the chain rule needs of each step, for all steps at once; only the state's gradient runs through time
        z, r, new, un = (np.stack([k[i] for k in kept]) for i in range(4))
        old = np.stack(before)
        to_new, to_z, to_r = (1 - z) * (1 - new * new), (old - new) * z * (1 - z), un * r * (1 - r)
        gates, into, dh = np.empty((*z.shape[:2], 3 * n), h0.dtype), np.empty((*z.shape[:2], 3 * n), h0.dtype), np.zeros_like(h0)
        for t in range(steps - 1, -1, -1):
            dh += dh_out[t]
            dn, row = dh * to_new[t], into[t]
            np.multiply(dh, to_z[t], out=row[:, :n])
            np.multiply(dn, to_r[t], out=row[:, n : 2 * n])
            np.multiply(dn, r[t], out=row[:, 2 * n :])
            gates[t, :, 2 * n :] = dn
            dh *= z[t]
            dh += row @ self.u.T
            dh *= keep[t]
        gates[:, :, : 2 * n] = into[:, :, : 2 * n]
        g["u"] = old.reshape(-1, n).T @ into.reshape(-1, 3 * n)
        flat, order = symbol.ravel(), np.argsort(symbol.ravel(), kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["x"][flat[order][first]] = np.add.reduceat(gates.reshape(-1, 3 * n)[order], first)
        return float(loss), g, hs[-1]


def train_on(model: Gru, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = 0.02, at_once: int = 256) -> float:
    """One pass of truncated backpropagation (Adam) over documents of (symbol, class, place); mean loss.

    The documents stand end to end in up to `at_once` streams of equal length, which run side by side without padding.
    """
    order = np.random.default_rng(SEED).permutation(len(docs))
    start = len(model.x) - 1
    sym = np.concatenate([np.concatenate(([start], docs[i][0][:-1])) for i in order])
    cls, place = (np.concatenate([docs[i][k] for i in order]) for k in (1, 2))
    streams = int(np.clip(len(sym) // (STEPS * 40), 8, at_once))
    length = -(-len(sym) // streams)
    wide = lambda x, fill: np.concatenate([x, np.full(streams * length - len(x), fill, x.dtype)]).reshape(streams, length).T
    sym, cls, place = wide(sym, start), wide(cls, -1), wide(place, -1)
    m, v = ({k: np.zeros_like(getattr(model, k)) for k in model.NAMES} for _ in range(2))
    h, total, tokens = np.zeros((streams, model.u.shape[0]), np.float32), 0.0, 0
    for step, t in enumerate(range(0, length, STEPS), 1):
        s = slice(t, t + STEPS)
        loss, g, h = model.gradient(sym[s], cls[s], place[s], h)
        total, tokens = total + loss, tokens + int((cls[s] >= 0).sum())
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] += np.float32(0.1) * (x - m[k])
            v[k] += np.float32(0.01) * (x * x - v[k])
            getattr(model, k)[...] -= np.float32(rate / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return total / max(1, tokens)


def score_docs(model: Gru, vocab: Vocabulary, at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log10 P of each document's classes and head words; the words of the tail class are left to add."""
    sizes, docs = np.diff(off), len(off) - 1
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], off[:-1][order]
    symbol, cls, place = vocab.codes(at)
    h, out = np.zeros((docs, model.u.shape[0]), np.float32), np.zeros(docs)
    last = np.full(docs, len(model.x) - 1)
    active = docs
    for t in range(0, int(sizes[0]) if docs else 0, 64):
        states, places, owners = [], [], []
        for k in range(t, min(t + 64, int(sizes[0]))):
            while active and sizes[active - 1] <= k:
                active -= 1
            h = h[:active]
            h, _ = model.step(last[:active], h)
            where = starts[:active] + k
            last = symbol[where]
            states.append(h)
            places.append(where)
            owners.append(np.arange(active))
            if sum(map(len, places)) > 200_000:
                _add(out, model, cls, place, states, places, owners)
                states, places, owners = [], [], []
        _add(out, model, cls, place, states, places, owners)
    inside = np.where(at >= 0, vocab.inside[at] if len(vocab.inside) else 0.0, 0.0)
    total = np.zeros(docs)
    total[order] = out
    return total / np.log(10) + (np.add.reduceat(inside, off[:-1]) if docs else 0.0)


def _add(out, model, cls, place, states, places, owners) -> None:
    if states:
        w = np.concatenate(places)
        np.add.at(out, np.concatenate(owners), model.log_probs(np.concatenate(states), cls[w], place[w]).astype(np.float64))


def _trained(vocab: Vocabulary, weights: np.ndarray):
    """One row a task: its weights times its tokens, and its tokens."""

    def run(incoming):
        docs, model = [], Gru(vocab).load(weights)
        tokens, total = 0, np.zeros(len(weights))

        def learn():
            nonlocal tokens, total, docs, model
            n = sum(len(d[0]) for d in docs)
            train_on(model, docs)
            tokens, total, docs = tokens + n, total + model.flat().astype(np.float64) * n, []

        for b in batches(incoming):
            data, start, end, before = _spans(b.column(0))
            at, off = vocab.read(span_hashes(data, start, end), before)
            parts = vocab.codes(at)
            docs += [tuple(p[x:y] for p in parts) for x, y in zip(off[:-1], off[1:], strict=True)]
            if sum(len(d[0]) for d in docs) > TOGETHER:
                learn()
        if docs:
            learn()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])

    return run


def _summed(incoming):
    total, tokens = None, 0
    for b in incoming:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = np.frombuffer(w, np.float64)
            total, tokens = w if total is None else total + w, tokens + n
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])


def _scored(vocab: Vocabulary, weights: np.ndarray):
    def run(incoming):
        model = Gru(vocab).load(weights)
        held = []

        def score():
            ids = pa.concat_arrays([x[0] for x in held])
            at = np.concatenate([x[1] for x in held])
            off = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))))
            known = at >= 0
            log = np.where(known, vocab.log_count[at] if len(vocab.log_count) else 0.0, 0.0)
            lm = score_docs(model, vocab, at, off)
            sums = lambda x: np.add.reduceat(x, off[:-1])
            words = pa.concat_arrays([x[3] for x in held])
            cut_at = np.concatenate(([0], np.cumsum(sums(~known & (np.arange(len(at)) != np.repeat(off[1:] - 1, np.diff(off)))))))
            tail = pa.ListArray.from_arrays(pa.array(cut_at.astype(np.int32)), words)
            return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off)), pa.array(sums(known.astype(np.int64))), pa.array(sums(log)), pa.array(lm), pa.array(sums((~known).astype(np.int64))), tail], ["doc_id", "n_tokens", "known", "log_counts", "lm", "n_tail", "tail"])

        for b in batches(incoming):
            data, start, end, before = _spans(b.column(1))
            at, off = vocab.read(span_hashes(data, start, end), before)
            inner = np.delete(at, off[1:] - 1)
            out = np.flatnonzero(inner < 0)
            held.append((b.column(0), at, off, _strings(data, start[out], end[out])))
            if sum(len(x[1]) for x in held) > TOGETHER:
                yield score()
                held = []
        if held:
            yield score()

    return run


def least_count(counts: DataFrame, most: int) -> int:
    """The least count from which on at most `most` words occur; counts beyond 1024 are told apart by 1/32 octaves."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2(F.col("c") / 1024.0) * 32)).cast("long")
    bins = counts.groupBy(step.alias("bin")).agg(F.min("c").alias("low"), F.count(F.lit(1)).alias("n")).collect()  # 1024 and 32 an octave at most
    least, have = 1 << 62, 0
    for b in sorted(bins, key=lambda b: -b.bin):
        have += b.n
        if have > most:
            break
        least = b.low
    return least


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    training = rows.where(~held_out)
    counts = written(training.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where((F.col("c") >= least_count(counts, head)) | (F.col("word") == END)).toArrow()
    words, c = top["word"].to_pylist(), top["c"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    vocab = Vocabulary([words[i] for i in order], c[order], total, types)
    weights = Gru(vocab).flat()
    for part in range(rounds if total else 0):
        taught = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == part).select("text")
        mean = taught.mapInArrow(_trained(vocab, weights), "weights binary, tokens long").repartition(8).mapInArrow(_summed, "weights binary, tokens long").toArrow()
        if mean.num_rows:
            weights = (sum(np.frombuffer(w, np.float64) for w in mean["weights"].to_pylist()) / sum(mean["tokens"].to_pylist())).astype(np.float32)
    made = rows.mapInArrow(_scored(vocab, weights), "doc_id long, n_tokens long, known long, log_counts double, lm double, n_tail long, tail array<string>")
    made = written(made.withColumn("row", F.monotonically_increasing_id()))
    rare = made.select("row", F.explode("tail").alias("word")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.count(F.lit(1)).alias("n"))
    joined = made.drop("tail").join(rare, "row", "left")
    logs, n = F.coalesce("logs", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return joined.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + n).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("lm") + logs - F.col("n_tail") * vocab.log_z).alias("score"),
    )
