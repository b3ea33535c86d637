"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top, trained in numpy.

The base spans are what the patterns match. The network learns from the base spans of a bounded sample of documents, and
from the same data written as people write it to hide it, and adds spans that the patterns miss. It reads every text whole,
in overlapping windows; where windows overlap their scores are added, fading from one to the next, and the text is then
decoded once, so it gets one labelling whatever its length.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts, scratch, uniform

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match cannot start within a run of digits unless one ended there, and none ends within; so the lookbehind changes
#: nothing but keeps long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, non-overlapping per kind; failing matches are dropped."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:  # a local part is the longest run that ends at the @, so looking back from it is the leftmost match
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def labelled_spans(text: str) -> list[tuple[str, int, int]]:
    """What the network learns from: base spans, and runs of digits that are cards but for their check digit. Check digits
    are no matter of shape; they are tested after the network has spoken."""
    spans = base_spans(text)
    taken = {(a, b) for _, a, b in spans}
    for m in _CARD.finditer(text):
        if 13 <= sum(c.isdigit() for c in m[0]) <= 19 and (m.start(), m.end()) not in taken:
            spans.append(("card", m.start(), m.end()))
    return spans


#: Ways of writing that the patterns miss: fixed values. Emails: what stands for the at sign and for the dots.
_AT_DOT = [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", " (dot) ")]
_EDITS = {
    "email": [lambda s, at=at, dot=dot: at.join((s.split("@")[0], s.split("@")[1].replace(".", dot))) for at, dot in _AT_DOT],
    "phone": [lambda s: s.removeprefix("+").lstrip(" "), lambda s: "00" + s.removeprefix("+").lstrip(" "), lambda s: re.sub(r"[^0-9]", "", s), lambda s: re.sub(r"[ ().-]+", ".", s.removeprefix("+").strip())],
    "card": [lambda s: ".".join(re.findall(".{1,4}", re.sub("[ -]", "", s))), lambda s: "_".join(re.findall(".{1,4}", re.sub("[ -]", "", s)))],
    "ip": [lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " . "), lambda s: s.replace(".", " dot ")],
}


def variants(text: str, spans: list[tuple[str, int, int]]):
    """The text with its labelled spans written in ways that the patterns miss. Yields (text, spans)."""
    ordered = sorted(spans, key=lambda s: s[1])
    if not ordered or any(a[2] > b[1] for a, b in zip(ordered, ordered[1:])):
        return
    for n in range(max(len(_EDITS[k]) for k, _, _ in ordered)):
        out, found, at = [], [], 0
        for kind, a, b in ordered:
            piece = _EDITS[kind][n % len(_EDITS[kind])](text[a:b])
            out += [text[at:a], piece]
            start = sum(map(len, out)) - len(piece)
            found.append((kind, start, start + len(piece)))
            at = b
        yield "".join(out) + text[at:], found


# ---- the network

#: Windows that are learned from; windows that texts are read in, each beginning STEP after the one before, and their overlap.
TRAINED, WINDOW, STEP = 96, 192, 160
OVERLAP = WINDOW - STEP
HIDDEN, TAGS = 8, 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Windows that are read at once.
BATCH = 1024
#: A position is given to the decoder unless the best other tag's score is so far below that of O (in nats).
CUT = 4.0
#: Character classes: fixed values. The letters of "at" and "dot" are told apart from others.
_CLASSES = ["0123456789", "BCEFGHIJKLMNPQRSUVWXYZ", "bcefghijklmnpqrsuvwxyz", " ", "\n\t\r\x0b\x0c", "@", ".", "-", "+", "()", "_%", ":", ",;", "/", "[]{}<>", "\"'", "aA", "tT", "dD", "oO"]
N_CLASSES = len(_CLASSES) + 2  # other ASCII, all else
_TABLE = np.full(129, len(_CLASSES), np.int8)
_TABLE[128] = N_CLASSES - 1
for _i, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _TABLE[ord(_c)] = _i


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 128)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x, w, u, keep=False):
    """x: (T, B) classes -> (T, B, H). w: (classes, 4H), u: (H, 4H)."""
    n = u.shape[0]
    h = c = np.zeros((x.shape[1], n), np.float32)
    out, saved = np.empty((*x.shape, n), np.float32), []
    for t in range(len(x)):
        z = w[x[t]] + h @ u
        gates, cand = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        before, h0 = c, h
        c = f * c + i * cand
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, cand, before, tc, h0))
    return out, saved


def _lstm_back(x, u, saved, dout, shape):
    """Gradients of w and u."""
    n = u.shape[0]
    dw, du = np.zeros(shape, np.float32), np.zeros_like(u)
    dh = dc = np.zeros((x.shape[1], n), np.float32)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, cand, before, tc, h0 = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)), 1)
        np.add.at(dw, x[t], dz)
        du += h0.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dw, du


class Tagger:
    """BiLSTM with CRF transitions."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"wf": draw(N_CLASSES, 4 * HIDDEN), "uf": draw(HIDDEN, 4 * HIDDEN), "wb": draw(N_CLASSES, 4 * HIDDEN), "ub": draw(HIDDEN, 4 * HIDDEN), "v": draw(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "a": np.zeros((TAGS, TAGS), np.float32)}
        for w in ("wf", "wb"):
            self.p[w][:, HIDDEN : 2 * HIDDEN] += 1
        #: Inside a span only after its beginning or its inside.
        self.barred = np.zeros((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = True
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False

    def emissions(self, x, keep=False):
        p = self.p
        f, sf = _lstm(x, p["wf"], p["uf"], keep)
        b, sb = _lstm(x[::-1], p["wb"], p["ub"], keep)
        h = np.concatenate((f, b[::-1]), 2)
        return h @ p["v"] + p["b"], (h, sf, sb)

    def moves(self):
        return np.where(self.barred, np.float32(-1e4), self.p["a"])

    def gradients(self, x, y, local=0.0):
        """Of the mean negative log likelihood of tags y (T, B), and `local` times that of each tag by its emissions alone."""
        e, (h, sf, sb) = self.emissions(x, True)
        a, (steps, batch) = self.moves(), x.shape
        first = np.where(np.arange(TAGS) % 2 == 0, np.float32(-1e4), 0) * (np.arange(TAGS) > 0)
        up = np.empty_like(e)
        up[0] = e[0] + first
        down = np.zeros_like(e)
        lse = lambda z, axis: (m := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis))
        for t in range(1, steps):
            up[t] = e[t] + lse(up[t - 1][:, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            down[t] = lse(a + (e[t + 1] + down[t + 1])[:, None, :], 2)
        z = lse(up[-1], 1)
        de = np.exp(up + down - z[:, None])
        da = np.zeros_like(a)
        for t in range(1, steps):
            da += np.exp(up[t - 1][:, :, None] + a + (e[t] + down[t])[:, None, :] - z[:, None, None]).sum(0)
        t, b = np.indices((steps, batch))
        de[t, b, y] -= 1
        if local:
            alone = np.exp(e - e.max(2, keepdims=True))
            alone /= alone.sum(2, keepdims=True)
            alone[t, b, y] -= 1
            de += local * alone
        np.add.at(da, (y[:-1], y[1:]), -1)
        scale = np.float32(1 / batch)
        de, da = de * scale, np.where(self.barred, 0, da * scale)
        flat = de.reshape(-1, TAGS)
        dh = de @ self.p["v"].T
        g = {"v": h.reshape(-1, 2 * HIDDEN).T @ flat, "b": flat.sum(0), "a": da}
        g["wf"], g["uf"] = _lstm_back(x, self.p["uf"], sf, dh[:, :, :HIDDEN], self.p["wf"].shape)
        g["wb"], g["ub"] = _lstm_back(x[::-1], self.p["ub"], sb, dh[::-1, :, HIDDEN:], self.p["wb"].shape)
        return g

    def train(self, x, y, steps=500, batch=60, rate=0.03, local=0.5, seed=0):
        """x, y: (windows, TRAINED). Adam; the draws depend on the seed alone. Each batch holds as many windows of every kind,
        rare or not. The emissions are also trained alone, so that they tell by themselves where there is nothing."""
        rng = np.random.default_rng(seed)
        groups = [g for g in [np.arange(len(x)), *(np.flatnonzero((y == 1 + 2 * k).any(1)) for k in range(len(KINDS)))] if len(g)]
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for n in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])
            for k, g in self.gradients(x[pick].T, y[pick].T, local).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (1 - n / (steps + 1)) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return self

    def scores(self, x) -> np.ndarray:
        """x: (steps, windows) -> (steps, TAGS, windows): the emissions, in the order of axes that is fastest to read in.

        Weights of two windows' classes are fetched at once, from a table of all pairs of classes. States are kept doubled,
        and halves are in the weights: a sigmoid is a tanh of half, and one more, halved.
        """
        steps, n = x.shape
        if n % 2:
            return self.scores(np.concatenate((x, x[:, -1:]), 1))[:, :, :n]
        two = x[:, ::2] * N_CLASSES + x[:, 1::2]
        half = np.repeat(np.float32([0.5, 1]), [3 * HIDDEN, HIDDEN])
        out, part = np.empty((steps, TAGS, n), np.float32), np.empty((TAGS, n), np.float32)
        z, fetched = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n // 2), np.complex64)
        gates, cand, by_class = z[: 3 * HIDDEN], z[3 * HIDDEN :], fetched.view(np.float32)
        for w, u, v, back in (("wf", "uf", self.p["v"][:HIDDEN], False), ("wb", "ub", self.p["v"][HIDDEN:], True)):
            w, u, v = (np.ascontiguousarray(m.T, np.float32) for m in (self.p[w] * half, self.p[u] * half / 2, v / 2))
            pairs = np.empty((4 * HIDDEN, N_CLASSES, N_CLASSES, 2), np.float32)
            pairs[..., 0], pairs[..., 1] = w[:, :, None], w[:, None, :]
            pairs = pairs.reshape(4 * HIDDEN, -1).view(np.complex64)
            h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t in range(steps - 1, -1, -1) if back else range(steps):
                np.matmul(u, h, out=z)
                np.take(pairs, two[t], 1, out=fetched, mode="clip")
                z += by_class
                np.tanh(z, out=z)
                gates += 1
                c *= gates[HIDDEN : 2 * HIDDEN]
                cand *= gates[:HIDDEN]
                c += cand
                c *= 0.5
                np.tanh(c, out=h)
                h *= gates[2 * HIDDEN :]
                if back:
                    out[t] += np.matmul(v, h, out=part)
                else:
                    np.matmul(v, h, out=out[t])
        out += self.p["b"][:, None]
        return out

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Scores (length, TAGS) of stretches between positions that are O -> their best tags, by Viterbi."""
        a, out = self.moves().astype(np.float32), [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            steps = len(runs[some[-1]]) + 1
            e = np.full((steps, len(some), TAGS), np.float32(-1e4))
            e[:, :, 0] = 0
            for j, i in enumerate(some):
                e[: len(runs[i]), j] = runs[i]
            back, best = np.zeros((steps, len(some), TAGS), np.int8), e[0] + a[0]
            for t in range(1, steps):
                moved = best[:, :, None] + a
                back[t] = moved.argmax(1)
                best = e[t] + moved.max(1)
            tags, tag = np.zeros((steps, len(some)), np.int8), np.zeros(len(some), np.int64)
            for t in range(steps - 1, 0, -1):  # every stretch ends in O
                tag = back[t, np.arange(len(some)), tag].astype(np.int64)
                tags[t - 1] = tag
            for j, i in enumerate(some):
                out[i] = tags[: len(runs[i]), j]
        return out

    def read(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of every text, by start.

        Texts lie behind each other in one row of cells of STEP positions, with an OVERLAP of padding ahead of each, so
        that every window reads one text.
        """
        cells = np.array([-(-(OVERLAP + len(t)) // STEP) for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(cells))) * STEP
        flat = np.full(first[-1] + OVERLAP, N_CLASSES - 1, np.int8)
        for a, t in zip(first, texts):
            flat[a + OVERLAP : a + OVERLAP + len(t)] = classes(t)
        windows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STEP]
        fade = ((np.arange(OVERLAP, dtype=np.float32) + 0.5) / OVERLAP)[:, None, None]
        before, places, found = np.zeros((OVERLAP, TAGS), np.float32), [], []
        for at in range(0, len(windows), BATCH):
            e = self.scores(np.ascontiguousarray(windows[at : at + BATCH].T, np.intp))
            e[:OVERLAP] *= fade
            e[STEP:] *= fade[::-1]
            e[:OVERLAP, :, 1:] += e[STEP:, :, :-1]
            e[:OVERLAP, :, 0] += before
            before = e[STEP:, :, -1].copy()
            k, t = np.nonzero((e[:STEP, 1:].max(1) > e[:STEP, 0] - CUT).T)
            places.append((at + k) * STEP + t)
            found.append(e[t, :, k])
        places, found = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros((0, TAGS), np.float32), *found])
        text = np.searchsorted(first, places, "right") - 1
        inside = places - first[text] - OVERLAP
        mine = (inside >= 0) & (inside < np.array([len(t) for t in texts], np.int64)[text])
        places, found, text, inside = places[mine], found[mine], text[mine], inside[mine]
        out = [[] for _ in texts]
        if not len(places):
            return out
        cuts = np.flatnonzero(np.append(True, np.diff(places) > 1))
        tags = np.concatenate(self.decode([found[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)])]))
        kinds, starts = (tags + 1) // 2, np.zeros(len(tags), bool)
        starts[cuts] = True
        starts |= (tags % 2 == 1) | np.append(True, kinds[1:] != kinds[:-1])
        begin = np.flatnonzero(starts)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(tags)]):
            if kinds[a]:
                out[text[a]].append((KINDS[kinds[a] - 1], int(inside[a]), int(inside[b - 1]) + 1))
        return out


def tags_of(spans: list[tuple[str, int, int]], length: int) -> np.ndarray:
    y = np.zeros(length, np.int8)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        if not y[start:end].any():
            y[start:end], y[start] = 2 + 2 * k, 1 + 2 * k
    return y


_HIDDEN_DOT = r"\s*[\[({<]?\s*(?:\.|dot)\s*[\])}>]?\s*"
#: What a span of the network has to look like: digits (least, most), and a pattern. Fixed values.
_PLAUSIBLE = {
    "email": (0, 10**9, re.compile(rf"[A-Za-z0-9._%+-]+\s*[\[({{<]?\s*(?:@|\bat\b)\s*[\])}}>]?\s*[A-Za-z0-9-]+(?:{_HIDDEN_DOT}[A-Za-z0-9-]+)+", re.ASCII | re.IGNORECASE)),
    "ip": (4, 12, re.compile(rf"[0-9]+(?:{_HIDDEN_DOT}[0-9]+){{3}}", re.ASCII | re.IGNORECASE)),
    "card": (13, 19, re.compile(r"[0-9](?:[ ._-]{0,2}[0-9])+")),
    "phone": (9, 15, re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]")),
}


def extra_spans(text: str, found: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the network's spans those that are plausible and overlap no base span."""
    covered, out = sorted((a, b) for _, a, b in base), []
    for kind, a, b in found:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
        piece, (least, most, shape) = text[a:b], _PLAUSIBLE[kind]
        digits = re.sub("[^0-9]", "", piece)
        fine = least <= len(digits) <= most and shape.fullmatch(piece) and (kind != "card" or luhn(digits)) and (kind != "ip" or all(int(x) <= 255 for x in re.findall("[0-9]+", piece)))
        if fine and not any(x < b and a < y for x, y in covered):
            out.append((kind, a, b))
    return out


#: Bounds of the training sample: documents looked at (expected) and windows learned from.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 3000


def training_windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, tags) of TRAINED positions around each labelled span of the text and of its variants, and of clean ones,
    one of them with an "at" and a "dot" that hide nothing. Places are drawn by the text itself."""
    rng, spans, out = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))), labelled_spans(text), []

    def cut(t, s, start):
        x, y = classes(t), tags_of(s, len(t))
        at = start + np.arange(TRAINED)
        inside = (at >= 0) & (at < len(x))
        xs, ys = np.where(inside, x[np.clip(at, 0, len(x) - 1)], np.int8(N_CLASSES - 1)), np.where(inside, y[np.clip(at, 0, len(x) - 1)], np.int8(0))
        if ys[0] > 0 and ys[0] % 2 == 0:  # it begins inside a span
            ys[0] -= 1
        out.append((xs.astype(np.int8), ys.astype(np.int8)))

    for t, s in [(text, spans), *variants(text, spans)]:
        for _, a, b in s:
            cut(t, s, a - int(rng.integers(2, max(3, TRAINED - min(b - a, TRAINED - 8)))))
    if len(text) > 8:
        at = int(rng.integers(0, len(text)))
        cut(text, spans, at)
        gap = text.find(" ", at)
        if gap >= 0:
            more = [" at ", " dot ", " at a ", " dot at "][int(rng.integers(4))]
            moved = [(k, a + (a > gap) * (len(more) - 1), b + (a > gap) * (len(more) - 1)) for k, a, b in spans if not a <= gap < b]
            if len(moved) == len(spans):
                cut(text[:gap] + more + text[gap + 1 :], moved, gap - int(rng.integers(4, TRAINED - 8)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Trains on windows out of about sample_docs documents, chosen by a hash of the id; of those windows at most
    sample_windows are collected, chosen by a hash, two thirds of them with a span. None if no span is found there."""
    n = docs.count()
    chosen = docs.where((uniform("pii", F.col(id_col)) < min(1.0, sample_docs / max(1, n))) & F.col(text_col).isNotNull())

    def start():
        def work(texts):
            found = [training_windows(t) for t in texts]
            return ([[{"x": x.tobytes(), "y": y.tobytes(), "spans": bool(y.any())} for x, y in ws] for ws in found],)

        return work

    windows = map_texts(chosen, text_col, {}, {"windows": "array<struct<x:binary,y:binary,spans:boolean>>"}, start)
    order = F.xxhash64("x", "y"), "x", "y"
    with scratch(docs.sparkSession):
        windows = durable(windows.select(F.explode("windows").alias("w")).select("w.*").distinct())
        rows = windows.where("spans").orderBy(*order).limit(sample_windows * 2 // 3).collect()
        if not rows:
            return None
        rows += windows.where("not spans").orderBy(*order).limit(sample_windows // 3).collect()
    x, y = (np.array([np.frombuffer(r[i], np.int8) for r in rows]) for i in (0, 1))
    return Tagger().train(x, y)


def find_personal_data(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, end; code points, end exclusive).

    base: the patterns' matches; spans: those and what the model adds (none that overlaps a base span). Both by kind as
    listed, then start. Null or empty text: empty arrays. Repeated rows come back as they are, ids of any type, null ones
    too. Empty table: no rows. A map over input partitions: every text is read whole, texts of a batch together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = {k: i for i, k in enumerate(KINDS)}
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def start():
        tagger = shared.value

        def work(texts):
            base = [base_spans(t) for t in texts]
            spans, todo, size = list(base), [], 0

            def flush():
                for n, found in zip(todo, tagger.read([texts[n] for n in todo])):
                    spans[n] = sorted(base[n] + extra_spans(texts[n], found, base[n]), key=lambda s: (order[s[0]], s[1]))

            for n, text in enumerate(texts) if tagger is not None else ():
                todo.append(n)
                size += len(text)
                if size >= BATCH * STEP:
                    flush()
                    todo, size = [], 0
            if todo:
                flush()
            return [as_rows(x) for x in base], [as_rows(x) for x in spans]

        return work

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs, text_col, {"doc_id": F.col(id_col)}, {"base": span, "spans": span}, start)


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span of find_personal_data() replaced by <kind>; doc_id has to be unique and not null."""

    def start():
        def one(text, found):
            for s in sorted(found, key=lambda s: -s["start"]):
                text = f"{text[: s['start']]}<{s['kind']}>{text[s['end'] :]}"
            return text

        return lambda rows: ([one(r["text"], r["spans"]) for r in rows],)

    both = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(spans.select("doc_id", "spans"), "doc_id")
    return map_texts(both, F.struct("text", "spans"), {"doc_id": F.col("doc_id")}, {"redacted": "string"}, start).withColumnRenamed("redacted", "text")
