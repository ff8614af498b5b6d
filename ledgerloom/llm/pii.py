r"""Personal data by a semi-Markov conditional random field over candidate segments.

Base spans come from four fixed patterns and always stay. Around them the text is cut into regions: runs of words with
a digit or `@`. A region's atoms (letters and digits, spaces, single marks) are split by dynamic programming into single
outside atoms and segments of at most `MAX_ATOMS` atoms, each with a kind; a segment's score is a weighted sum of
features of the whole span (shape, digit count, checks, neighbours, cue word before it), so boundaries and kinds are
chosen together. Atoms of base spans are fixed. An entity needs a digit or `@`; hence the optimum over a text
is the union of the optima over its regions, whatever its length.

The weights maximise the conditional likelihood of generated, labelled sentences (forward-backward, seeded); they depend
on no table. Kinds: email, ip, card, phone, and secret (keys and passwords).

Defined cases: a null text is empty and has no spans; repeated rows and equal ids each give a row; an empty table gives
no rows; other columns are ignored by `find_spans` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh, prepare

#: Kinds in their order, the base ones first.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
MAX_ATOMS, SEED = 24, 7
#: Candidate segments whose features are held at once.
AT_ONCE = 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*$")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit after a digit can't begin a match that fails at the first, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_IP_INNER = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_REGION = re.compile(r"(?<!\S)\S*?[0-9@]\S*(?:[ \t]\S*?[0-9@]\S*)*")
_ATOM = re.compile(r"[^\W_]+|\s+|.", re.DOTALL)
_CUE = re.compile(r"(\S+)\s+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start and then kind as listed."""
    if not _TRIGGER.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(digits := re.sub(r"[ -]", "", m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, BASE[k], e) for s, k, e in sorted(found)]


def shape(text: str) -> str:
    """The span with digits as 9, capitals as A, other letters as a, and runs shortened to one sign."""
    return re.sub(r"([9Aa])\1+", r"\1", re.sub(r"[^\W0-9_A-Z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", text))))[:24]


def _features(text: str, atoms: list[tuple[int, int]], i: int, j: int, cue: str) -> list[str]:
    """Features of the whole span from atom i to atom j (end exclusive)."""
    start, end = atoms[i][0], atoms[j - 1][1]
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    before = text[start - 1 : start]
    after = text[end : end + 1]
    sides = ("e" if not before else "s" if before.isspace() else "w" if before.isalnum() else before) + ("e" if not after else "s" if after.isspace() else "w" if after.isalnum() else after)
    numbers = span.split(".")
    out = ["bias", f"shape={shape(span)}", f"digits={min(digits, 20)}", f"sides={sides}", f"first={shape(span[0])}", f"last={shape(span[-1])}", f"length={min(len(span) // 4, 10)}"]
    if before.isspace() or not before:
        out.append(f"cue={cue}" if i == 0 or cue else "cue=")
    if "@" in span:
        out.append("has@" if "." in span.rpartition("@")[2].strip(".") and span[0] != "@" else "has@bad")
    if len(numbers) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in numbers):
        out.append("quad")
    if 13 <= digits <= 19 and digits + span.count(" ") + span.count("-") == len(span):
        out.append("luhn" if luhn(re.sub(r"[^0-9]", "", span)) else "noluhn")
    if 10 <= digits <= 15 and re.fullmatch(r"[+(0-9][0-9 ().-]*[0-9]", span):
        out.append("dial" + ("+" if span[0] == "+" else "(" if "(" in span else "-"))
    if re.fullmatch(r"[A-Z0-9]{16,}", span) and digits < len(span):
        out.append("keylike")
    if re.fullmatch(r"\w+=\S{8,}", span):
        out.append("assign")
    if " " in span:
        out.append("spaced")
    return out


def _segments(text: str, atoms: list[tuple[int, int]], free: list[bool]):
    """Candidate segments by their start: no space at either end, a digit or @ inside, no atom of a base span."""
    hot = [bool(_TRIGGER.search(text[s:e])) for s, e in atoms]
    solid = [not text[s:e].isspace() for s, e in atoms]
    for i in range(len(atoms)):
        if not solid[i]:
            continue
        some = False
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            if not free[j - 1]:
                break
            some = some or hot[j - 1]
            if some and solid[j - 1]:
                yield i, j


def _cue_of(text: str, at: int) -> str:
    m = _CUE.search(text[max(0, at - 24) : at])
    word = re.sub(r"[^a-z]", "", m[1].lower()) if m else ""
    return word if word in CUES else ""


#: Words that often stand before personal data.
CUES = frozenset("email mail contact tel phone call fax mobile ip host server address card visa pay account key token password secret login".split())


class Crf:
    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def rows(self, text: str, atoms, segs, cue: str) -> list[list[int]]:
        return [[k for f in _features(text, atoms, i, j, cue if i == 0 else _cue_of(text, atoms[i][0])) if (k := self.names.get(f)) is not None] for i, j in segs]

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(len(rows), len(KINDS))

    def decode(self, text: str, atoms, free, cue: str) -> list[tuple[int, str, int]]:
        """The best segmentation: outside atoms score 0, a segment its span's score."""
        # features are held for AT_ONCE segments at a time; only segments of positive score can be in the best segmentation
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for segs in batched(_segments(text, atoms, free), AT_ONCE):
            score = self.scores(self.rows(text, atoms, segs, cue))
            kind, top = score.argmax(axis=1), score.max(axis=1)
            for k in np.flatnonzero(top > 0).tolist():
                ending.setdefault(segs[k][1], []).append((segs[k][0], int(kind[k]), float(top[k])))
        if not ending:
            return []
        best, back = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1)
        for j in range(1, len(atoms) + 1):
            best[j] = best[j - 1]
            for i, kind, gain in ending.get(j, ()):
                if (v := best[i] + gain) > best[j]:
                    best[j], back[j] = v, (i, kind)
        out, j = [], len(atoms)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((atoms[i][0], KINDS[kind], atoms[j - 1][1]))
                j = i
        return out[::-1]


def _lse(x: list[float]) -> float:
    m = max(x)
    return m + float(np.log(np.exp(np.array(x) - m).sum()))


def expectations(score: np.ndarray, segs: list[tuple[int, int]], n: int) -> tuple[float, np.ndarray]:
    """Log partition function and the marginal of each segment and kind."""
    total = [_lse(list(s)) for s in score]
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(segs):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fwd[j] = _lse([fwd[j - 1]] + [fwd[segs[k][0]] + total[k] for k in by_end.get(j, ())])
    for i in range(n - 1, -1, -1):
        bwd[i] = _lse([bwd[i + 1]] + [bwd[segs[k][1]] + total[k] for k in by_start.get(i, ())])
    return fwd[n], np.exp(np.array([[fwd[i] + s + bwd[j] - fwd[n] for s in row] for row, (i, j) in zip(score, segs, strict=True)]).reshape(score.shape))


def generated(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Labelled regions: personal data in many formats among look-alikes that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=3, b=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))

    def card() -> str:
        while not luhn(d := r.choice("3456") + num(r.choice([14, 15, 15, 15]))):
            pass
        return r.choice([d, d, "-".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4))])

    def secret() -> str:
        return r.choice([
            "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(13)) + num(1) + r.choice("ABC") + num(1),
            r.choice(["password", "secret", "token", "api_key"]) + "=" + "".join(r.choice("0123456789abcdef") for _ in range(r.randint(10, 24))) + num(2),
            "".join(r.choice("0123456789abcdef") for _ in range(r.randint(20, 48))) + num(1),
            "ghp_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFG0123456789") for _ in range(30)) + num(2),
        ])

    kinds = {
        "email": lambda: f"{word()}{r.choice(['', '.', '_'])}{r.choice(['', num(2), word()])}@{word()}{r.choice(['', num(1)])}.{r.choice(['com', 'org', 'example.com', 'co.uk', 'de'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+{r.randint(10, 99)}{num(9)}", f"1-{num(3)}-{num(3)}-{num(4)}"]),
        "secret": secret,
    }
    plain = [
        lambda: f"{r.randint(1900, 2030)}", lambda: f"{num(r.randint(1, 9))}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 40)}.",
        lambda: f"{r.randint(1, 40)}.{r.randint(1, 9)}.", lambda: f"${num(2)}.{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"v{r.randint(1, 9)}.{num(1)}", lambda: f"@{word()}", lambda: f"{num(2)}%",
        lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{num(2)}:{num(2)}", lambda: "9780" + num(9), lambda: f"{r.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"{word().upper()}-{num(4)}", lambda: f"page={num(2)}", lambda: f"{num(20)}", lambda: f"{num(2)}-{num(2)}",
    ]
    out = []
    for _ in range(n):
        text, spans = r.choice(["", word() + " ", r.choice(sorted(CUES)) + " ", r.choice(sorted(CUES)) + ": "]), []
        for _ in range(r.choice([1, 1, 1, 2])):
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                value = kinds[kind]()
                pre, post = r.choice([("", "")] * 6 + [("", x) for x in (".", ",", ";", "!", "!!", "?", "***", "$$$", "%%%", ":")] + [("(", ")"), ('"', '"'), ("<", ">"), ('= "', '"'), ("| ", " |"), (": ", "")])
                spans.append((len(text) + len(pre), kind, len(text) + len(pre) + len(value)))
                text += pre + value + post + " "
            else:
                text += r.choice(plain)() + r.choice(["", "", ",", "."]) + " "
        out.append((text + r.choice(["", word()]), spans))
    return out


@lru_cache(maxsize=1)
def trained(examples: int = 900, rounds: int = 6, decay: float = 1e-3) -> Crf:
    """Fit the weights by stochastic gradient (Adagrad) on the conditional log-likelihood."""
    names: dict[str, int] = {}
    data = []
    for text, spans in generated(examples):
        first = _REGION.search(text)
        if not first:
            continue
        atoms = [m.span() for m in _ATOM.finditer(text, first.start())]
        segs = list(_segments(text, atoms, [True] * len(atoms)))
        cue = _cue_of(text, atoms[0][0])
        rows = [[names.setdefault(f, len(names)) for f in _features(text, atoms, i, j, cue if i == 0 else _cue_of(text, atoms[i][0]))] for i, j in segs]
        at = {(atoms[i][0], atoms[j - 1][1]): k for k, (i, j) in enumerate(segs)}
        gold = np.zeros((len(segs), len(KINDS)))
        if segs and all((s, e) in at for s, _, e in spans):
            for s, kind, e in spans:
                gold[at[s, e], KINDS.index(kind)] = 1
            data.append((rows, segs, gold, len(atoms)))
    w, seen = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-2)
    order = random.Random(SEED)
    for _ in range(rounds):
        order.shuffle(data)
        for rows, segs, gold, n in data:
            score = np.array([w[r].sum(axis=0) for r in rows])
            _, p = expectations(score, segs, n)
            flat, width = np.concatenate(rows), [len(r) for r in rows]
            diff = np.repeat(gold - p, width, axis=0)
            grad = np.zeros_like(w)
            np.add.at(grad, flat, diff)
            used = np.unique(flat)
            g = grad[used] - decay * w[used]
            seen[used] += g * g
            w[used] += 0.3 * g / np.sqrt(seen[used])
    return Crf(names, w)


def all_spans(text: str, model: Crf) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans: those and the model's, none of which meets a base span."""
    base = base_spans(text)
    more: list[tuple[int, str, int]] = []
    if base or _TRIGGER.search(text):
        at = 0
        for m in _REGION.finditer(text):
            while at < len(base) and base[at][0] < m.start() and all(x[2] <= m.start() for x in base[at : at + 1]):
                at += 1
            near, k = [], at
            while k < len(base) and base[k][0] < m.end():
                if base[k][2] > m.start():
                    near.append(base[k])
                k += 1
            atoms = [a.span() for a in _ATOM.finditer(text, m.start(), m.end())]
            free, b = [], 0
            for s, e in atoms:
                while b < len(near) and near[b][2] <= s:
                    b += 1
                free.append(not any(x[0] < e and s < x[2] for x in near[b : b + 8]))
            if any(f and _TRIGGER.search(text, s, e) for f, (s, e) in zip(free, atoms, strict=True)):
                more += model.decode(text, atoms, free, _cue_of(text, m.start()))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (x[0], order[x[1]], x[2]))


def said(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _find(model: Crf):
    def run(incoming):
        for b in batches(incoming):
            found = [all_spans(t or "", model) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in BASE]
            more = [pa.array([sum(k == "secret" for _, k, _ in every) for _, every in found], pa.int64()), pa.array([len(every) for _, every in found], pa.int64())]
            digest = pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([said(x) for _, x in found], pa.string()), *more], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_secret", "n_spans"])

    return run


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (`kind:start:end` in code points, comma-joined), and how many of
    those are secrets (n_secret) and there are in all (n_spans)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one mark."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with all their columns; personal data in `text_col` is replaced by marks."""
    prepare(docs.sparkSession)
    model, at = trained(), docs.columns.index(text_col)

    def run(incoming):
        for b in batches(incoming):
            clean = [t if t is None else masked(t, all_spans(t, model)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
