"""PII spans: a character-level bidirectional LSTM with a conditional random field, in numpy.

Base rules find e-mail addresses, IP addresses, payment cards and telephone numbers that are spelt
plainly. The model, trained from labelled spans in made-up text of several languages, reads every character of
every text and adds spans that the rules miss, such as an address written with "(at)"; it also finds
secrets (tokens and keys), which are reported in columns of their own.

A text is cut into overlapping windows on a fixed grid. Each character's scores come from the window it
is most central in, so the joined scores of a text do not depend on where a span lies, and one
decoding (Viterbi) over the whole text reconciles all windows. Where no labelling with a span can outweigh
the one without (a bound on sums of scores, see `_stretches`), the labels are known without that
decoding. A decoded span stays if it overlaps no base span and passes the check of its kind
(or, made of digits, of another such kind).

The weights lie beside this module; `python -m tallyweave.llm.pii` trains them again (a fixed seed).

Defined cases: a null text is empty and has no spans; texts of any length are read whole; digits of
other scripts are ordinary letters; repeated rows each get their row; a null doc_id stays null; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import null_ids, whole_id

KINDS = ("email", "ip", "card", "phone")
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if n & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: a match starts with the run of local
    characters before it, or behind the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        if begin > free:
            low = free
            # the run is short as a rule: look back in growing steps
            step = 64
            while True:
                cut = max(low, at - step)
                m = _EMAIL_HEAD.search(text, cut, at)
                if m is None or m.start() > cut or cut == low:
                    break
                step *= 8
            begin = m.start() if m else at
        tail = _EMAIL_TAIL.match(text, at + 1) if begin < at else None
        if tail:
            out.append((begin, tail.end()))
            free = tail.end()
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# --- the model -------------------------------------------------------------------------------------

#: What the model labels: the kinds of the base rules, and secrets.
MODEL_KINDS = (*KINDS, "secret")
#: Labels: outside, and for each kind its first and its later characters.
LABELS = 1 + 2 * len(MODEL_KINDS)
#: Characters that a window scores, and those before and after them that it reads as well.
STRIDE, MARGIN = 960, 32
TRAINED = Path(__file__).with_name("pii_weights.npz")


def _classes(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII as it is, the rest as one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.minimum(points, 128).astype(np.int64)


class Tagger:
    """Embedding, two LSTMs in opposite directions, a linear layer and CRF transitions.

    The gates are straight lines cut off at 0 and 1, the other activations at -1 and 1."""

    def __init__(self, seed: int = 5, embed: int = 12, hidden: int = 10):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        normal = lambda *shape: rng.normal(0, 0.2, shape)
        self.p = {"E": normal(129, embed), "W": normal(2 * hidden, LABELS), "b": np.zeros(LABELS), "T": np.zeros((LABELS, LABELS)), "S": np.zeros(LABELS)}
        for d in "lr":
            self.p["X" + d], self.p["H" + d], self.p["c" + d] = normal(embed, 4 * hidden), normal(hidden, 4 * hidden), np.zeros(4 * hidden)
            self.p["c" + d][hidden : 2 * hidden] = 1.0  # remember at first

    def _lstm(self, x: np.ndarray, d: str):
        """x: (time, batch, embed); returns the states and what the way back needs."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden))
        c, kept, out = h.copy(), [], np.empty((x.shape[0], x.shape[1], n))
        pre = x @ self.p["X" + d] + self.p["c" + d]
        for t in range(x.shape[0]) if d == "l" else range(x.shape[0] - 1, -1, -1):
            z = pre[t] + h @ self.p["H" + d]
            gates = np.clip(0.25 * z[:, : 3 * n] + 0.5, 0, 1)
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.clip(z[:, 3 * n :], -1, 1)
            before, h_before = c, h
            c = f * c + i * g
            s = np.clip(c, -1, 1)
            h = o * s
            out[t] = h
            kept.append((t, i, f, o, g, before, c, s, h_before))
        return out, kept

    def emissions(self, ids: np.ndarray):
        x = self.p["E"][ids.T]
        left, kl = self._lstm(x, "l")
        right, kr = self._lstm(x, "r")
        both = np.concatenate([left, right], axis=2)
        return both @ self.p["W"] + self.p["b"], (x, both, kl, kr)

    def _loss(self, e: np.ndarray, gold: np.ndarray):
        """Negative log-likelihood of the CRF and its gradients (forward-backward)."""
        steps, batch, _ = e.shape
        trans = self.p["T"]
        alpha = np.empty_like(e)
        alpha[0] = e[0] + self.p["S"]
        for t in range(1, steps):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _lse(alpha[-1], 1)
        grad = np.exp(alpha + beta - total[None, :, None])
        at = np.arange(batch)
        score = self.p["S"][gold[0]] + e[0, at, gold[0]]
        d_trans = np.zeros_like(trans)
        d_start = grad[0].sum(0)
        np.subtract.at(d_start, gold[0], 1.0)
        for t in range(1, steps):
            score = score + trans[gold[t - 1], gold[t]] + e[t, at, gold[t]]
            d_trans += np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
            np.subtract.at(d_trans, (gold[t - 1], gold[t]), 1.0)
        for t in range(steps):
            grad[t, at, gold[t]] -= 1.0
        return float((total - score).sum()), grad, d_trans, d_start

    def _lstm_back(self, x, kept, d_out, d, grads):
        n = self.hidden
        dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
        dx = np.zeros_like(x)
        slope = lambda gate: 0.25 * ((gate > 0) & (gate < 1))
        for t, i, f, o, g, before, c, s, h_before in reversed(kept):
            dh = dh + d_out[t]
            dc = dc + dh * o * (np.abs(c) < 1)
            dz = np.concatenate([dc * g * slope(i), dc * before * slope(f), dh * s * slope(o), dc * i * (np.abs(g) < 1)], axis=1)
            grads["X" + d] += x[t].T @ dz
            grads["H" + d] += h_before.T @ dz
            grads["c" + d] += dz.sum(0)
            dx[t] = dz @ self.p["X" + d].T
            dh, dc = dz @ self.p["H" + d].T, dc * f
        return dx

    def step(self, ids: np.ndarray, gold: np.ndarray):
        """ids, gold: (batch, time); returns the loss for each character and all gradients."""
        e, (x, both, kl, kr) = self.emissions(ids)
        loss, de, dt, ds = self._loss(e, gold.T)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["T"], grads["S"] = dt, ds
        grads["W"] = np.einsum("tbh,tbl->hl", both, de)
        grads["b"] = de.sum((0, 1))
        d_both = de @ self.p["W"].T
        dx = self._lstm_back(x, kl, d_both[:, :, : self.hidden], "l", grads) + self._lstm_back(x, kr, d_both[:, :, self.hidden :], "r", grads)
        np.add.at(grads["E"], ids.T, dx)
        return loss / ids.size, {k: v / ids.size for k, v in grads.items()}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


#: So many characters of each window are scored at once, while their states are near.
CHUNK = 16
_clip, _MINUS, _ZERO, _ONE = np._core.umath.clip, np.float32(-1), np.float32(0), np.float32(1)  # np.clip without its checks of each call


class Decoder:
    """A trained tagger for whole texts, in single precision. Embedding and input weights are one table
    for each direction, and the lines of the gates are part of them."""

    def __init__(self, model: Tagger, lean: float = 0.4):
        """lean: taken off the score of `outside`, as the checks of the kinds drop what is found too much."""
        p, n = model.p, model.hidden
        self.hidden = n
        scale, shift = np.concatenate([np.full(3 * n, 0.25), np.ones(n)]), np.concatenate([np.full(3 * n, 0.5), np.zeros(n)])
        self.tables = [((p["E"] @ p["X" + d] + p["c" + d]) * scale + shift).astype(np.float32) for d in "lr"]
        self.inner = [np.ascontiguousarray((p["H" + d] * scale).T, np.float32) for d in "lr"]
        self.out = [np.ascontiguousarray(p["W"][at], np.float32) for at in (slice(0, n), slice(n, None))]
        self.bias, self.trans, self.start = p["b"].astype(np.float32), p["T"].copy(), p["S"].copy()
        self.bias[0] -= lean
        for k in range(2, LABELS, 2):  # a later character follows one of its own kind
            held = self.trans[[k - 1, k], k]
            self.trans[:, k] = self.start[k] = -1e4
            self.trans[[k - 1, k], k] = held

    def _run(self, ids: np.ndarray, sizes: np.ndarray, side: int) -> np.ndarray:
        """Scores (window, time, label) of one direction, that of the right in its opposite order; ids (time, window)
        in its order, the windows from the longest to the shortest (sizes): those that are over are left out."""
        steps, batch = ids.shape
        n, table, inner, project = self.hidden, self.tables[side], self.inner[side], self.out[side]
        c, z, x, h = (np.zeros(shape, np.float32) for shape in ((n, batch), (4 * n, batch), (batch, 4 * n), (n, batch)))
        states = np.zeros((min(steps, CHUNK), n, batch), np.float32)
        row = np.dtype((np.void, 4 * LABELS))  # the scores of a character move as one
        out = np.empty((batch, steps), row)
        live = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()  # windows longer than the step
        for begin in range(0, steps, CHUNK):
            end = min(begin + CHUNK, steps)
            for t in range(begin, end):
                m = live[t]
                if m != len(x):
                    c, h, x = c[:, :m].copy(), h[:, :m], x[:m]
                    z = np.empty((4 * n, m), np.float32)
                np.matmul(inner, h, out=z)
                np.take(table, ids[t, :m], axis=0, out=x, mode="clip")
                z += x.T
                gates, g = z[: 3 * n], z[3 * n :]
                _clip(gates, _ZERO, _ONE, out=gates)
                _clip(g, _MINUS, _ONE, out=g)
                c *= z[n : 2 * n]
                g *= z[:n]
                c += g
                h = states[t - begin, :, :m]
                _clip(c, _MINUS, _ONE, out=h)
                h *= z[2 * n : 3 * n]
            m = live[begin]
            found = np.matmul(states[: end - begin, :, :m].transpose(0, 2, 1), project).view(row)[..., 0].T
            if side:
                out[:m, steps - end : steps - begin] = found[:, ::-1]
            else:
                out[:m, begin:end] = found
        return out.view(np.float32).reshape(batch, steps, LABELS)

    def scores(self, classes: np.ndarray, first: np.ndarray, lanes: int = 1536) -> np.ndarray:
        """Scores (character, label) of texts laid end to end; first: where each begins, and the end."""
        windows = []
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
            windows += [(max(begin, s - MARGIN), min(end, s + STRIDE + MARGIN), s, min(end, s + STRIDE)) for s in range(begin, end, STRIDE)]
        if not windows:
            return np.zeros((0, LABELS), np.float32)
        held = np.array(windows)
        held = held[np.argsort(held[:, 0] - held[:, 1], kind="stable")]
        out = np.empty((len(classes), LABELS), np.float32)
        padded = np.concatenate([classes, np.full(STRIDE + 2 * MARGIN, 32, classes.dtype)])
        for part in np.array_split(held, -(-len(held) // lanes)):
            low, high = part[:, 0], part[:, 1]
            sizes = high - low
            steps = int(sizes.max())
            step = np.arange(steps)[:, None]
            left, right = self._run(padded[low + step], sizes, 0), self._run(padded[np.maximum(high - 1 - step, 0)], sizes, 1)
            for lane, (a, b, begin, end) in enumerate(part.tolist()):
                np.add(left[lane, begin - a : end - a], right[lane, steps - b + begin : steps - b + end], out=out[begin:end])
        out += self.bias
        return out

    def _gains(self) -> list[tuple[float, float, float]]:
        """For each kind what its first character, each later one and its end gain at most by transitions
        against no span in its place."""
        t, out = self.trans, []
        for k in range(1, LABELS, 2):
            into = max(float((t[:, k] - t[:, 0]).max()), float(self.start[k] - self.start[0]))
            leave = max(0.0, float((t[[k, k + 1]] - t[0]).max(axis=0)[[0, *range(1, LABELS, 2)]].max())) + 1e-3
            out.append((into + max(0.0, float(t[k, k + 1] - t[k + 1, k + 1])), float(t[k + 1, k + 1] - t[0, 0]), leave))
        return out

    def _stretches(self, e: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """The stretches outside of which the best labelling has no span: those whose characters some span goes
        through that can gain. First by the best gains of all kinds at once, then, inside, kind by kind."""
        gains = self._gains()
        best = lambda e, start, gain: reduce(np.maximum, (e[start + 2 * n] + np.float32(x[gain]) for n, x in enumerate(gains))) - e[0]
        enter, inner = np.empty(len(e), np.float32), np.empty(len(e), np.float32)
        for at in range(0, len(e), 4096):  # label by label, a piece at a time
            part = np.ascontiguousarray(e[at : at + 4096].T)
            enter[at : at + 4096], inner[at : at + 4096] = best(part, 1, 0), best(part, 2, 1)
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rough = np.flatnonzero(_through(enter, inner, max(x[2] for x in gains), texts))
        if not len(rough):
            return []
        # What lies together in one text is one text of the second look.
        cut = (np.diff(rough) > 1) | (np.diff(texts[rough]) > 0)
        parts, part = np.concatenate([[0], np.cumsum(cut)]), e[rough]
        active = np.zeros(len(rough), bool)
        for k, (into, more, leave) in zip(range(1, LABELS, 2), gains):
            active |= _through(part[:, k] - part[:, 0] + into, part[:, k + 1] - part[:, 0] + more, leave, parts)
        at, owner = rough[active], parts[active]
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0))
        return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist()))

    def labels(self, e: np.ndarray, first: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """The best labelling of each text (Viterbi), from its scores."""
        out = np.zeros(len(e), np.int8)
        todo = np.array(sorted(self._stretches(e, first), key=lambda x: x[1] - x[0]), np.int64).reshape(-1, 2)
        starts, stops = np.isin(todo[:, 0], first[:-1]), np.isin(todo[:, 1], first[1:])
        at = 0
        while at < len(todo):
            part = todo[at : at + lanes]
            # long stretches are few at a time
            part = part[: max(1, int(np.searchsorted(np.arange(1, len(part) + 1) * (part[:, 1] - part[:, 0]), 1 << 20, side="right")))]
            low, size = part[:, 0], part[:, 1] - part[:, 0]
            at_start, at_end = starts[at : at + len(part)], stops[at : at + len(part)]
            at += len(part)
            held = np.empty((size.max(), LABELS, len(part)))  # the best score of each label at each character
            held[0] = (e[low] + np.where(at_start[:, None], self.start, self.trans[0])).T
            for t in range(1, len(held)):
                live = int(np.searchsorted(size, t, side="right"))  # sorted by size
                before, now = held[t - 1][:, live:], held[t][:, live:]
                now[:] = e[low[live:] + t].T
                if before.shape[1] < 512:  # few: all ways at once
                    now += (before[:, None] + self.trans[:, :, None]).max(axis=0)
                    continue
                for k in range(LABELS):
                    ways = (k - 1, k) if k and not k & 1 else range(LABELS)  # a later character follows its own kind
                    now[k] += reduce(np.maximum, (before[j] + self.trans[j, k] for j in ways))
            final = held[size - 1, :, np.arange(len(part))] + np.where(at_end[:, None], 0.0, self.trans[:, 0])
            label = final.argmax(axis=1)
            for t in range(len(held) - 1, -1, -1):
                live = int(np.searchsorted(size, t, side="right"))
                if t + 1 < len(held) and (on := int(np.searchsorted(size, t + 1, side="right"))) < len(part):
                    label[on:] = (held[t][:, on:] + self.trans[:, label[on:]]).argmax(axis=0)
                out[low[live:] + t] = label[live:]
        return out

    def spans(self, texts: list[str], lead: float, limit: int = 2_000_000) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in each text: decoded spans whose labels lead over `outside` by `lead` on average."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        n = 0
        while n < len(texts):
            m, size = n, 0
            while m < len(texts) and (m == n or size + len(texts[m]) <= limit):
                size += len(texts[m])
                m += 1
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts[n:m]])]).astype(np.int64)
            e = self.scores(_classes("".join(texts[n:m])), first)
            tags = self.labels(e, first)
            begins = np.flatnonzero(tags & 1)
            for b in begins.tolist():
                owner = int(np.searchsorted(first, b, side="right")) - 1
                stop, end = int(first[owner + 1]), b + 1
                while end < stop and tags[end] == tags[b] + 1:
                    end += 1
                own = tags[b:end].astype(np.int64)
                if float((e[np.arange(b, end), own] - e[b:end, 0]).mean()) >= lead:
                    out[n + owner].append((MODEL_KINDS[(int(tags[b]) - 1) // 2], b - int(first[owner]), end - int(first[owner])))
            n = m
        return out


def _through(enter: np.ndarray, inner: np.ndarray, leave: float, texts: np.ndarray) -> np.ndarray:
    """Whether some span through each character gains: `enter` at its first character, `inner` at each later
    one, and `leave`. The best one is two running maxima over one running sum; a wall between texts keeps them apart."""
    enter, inner = enter.astype(np.float64), inner.astype(np.float64)
    sums = np.cumsum(inner)
    wall = texts * (1.0 + 4.0 * float(np.abs(inner).sum() + np.abs(enter).max(initial=0.0)))
    begin = np.maximum.accumulate(enter - sums + wall) - wall
    end = np.maximum.accumulate((sums - wall)[::-1])[::-1] + wall
    return begin + end + leave > 0


# --- training --------------------------------------------------------------------------------------

WINDOW = 96


def _made_window(rng: random.Random) -> tuple[str, np.ndarray]:
    """Made-up text with labelled spans, plain and disguised, among numbers that are none."""
    letters = rng.choice(["aeiouhnrstlmdbc", "aeiouhnrstlmdbcäöüß", "aeiounrstlmdéèêçà", "aeiounrstlmdñóáí", "THEANDOFIRSL", "абвгдежзиклмн"])
    junk = rng.choice([""] * 8 + ["!!", "###", "$$$", "%%%"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + junk
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randrange(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))

    def card() -> str:
        number, gap = digits(16), rng.choice(["", "", " ", "-", ".", " . ", "_"])
        return gap.join(number[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", ".")])
        parts = [name() for _ in range(rng.choice([2, 2, 2, 3, 4]))]
        return name() + rng.choice(["", dot + name(), digits(2), "." + name()]) + at + dot.join(parts[:-1]) + dot + rng.choice(["com", "org", "net", "example", "de", "fr", "io"])

    def address() -> str:
        return rng.choice([".", ".", "[.]", " . "]).join(str(rng.randrange(256)) for _ in range(4))

    def phone() -> str:
        forms = (
            f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{digits(2)} {digits(3)} {digits(6)}",
        )
        return rng.choice(forms)

    def secret() -> str:
        return rng.choice([mixed("0123456789abcdef", rng.choice([32, 40, 24])), "sk_" + mixed("0123456789abcdefghijkABCDEFGH", 24), mixed("0123456789ABCDEF", 32), "AKIA" + mixed("0123456789ABCDEFGHIJKLMNOP", 16)])

    def other() -> str:
        forms = (
            digits(rng.randrange(1, 9)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(3)}.{digits(2)}",
            f"@{name()}", f"{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)}", f"id {digits(12)}", f"look at {name()}", f"{name()} at {name()}", f"{name()}.{name()}", f"/{name()}/{name()}.html",
        )
        return rng.choice(forms)

    text, labels, shared = "", [], rng.random()
    while len(text) < WINDOW + 20:
        r, kind, lead, tail = rng.random(), -1, "", ""
        part = word()
        if r < 0.16 * (shared > 0.2):
            kind = rng.choice((0, 0, 1, 2, 2, 3, 4))
            part = (email, address, card, phone, secret)[kind]()
            if kind == 4 and rng.random() < 0.8:
                lead = rng.choice(["token", "key", "api_key", "TOKEN", "secret", "password"]) + rng.choice([' = "', '="', ": ", "="])
                tail = '"' if lead.endswith('"') else ""
            elif rng.random() < 0.2:
                tail = junk
        elif r < 0.26:
            part = other()
        labels += [0] * len(lead) + ([1 + 2 * kind] + [2 + 2 * kind] * (len(part) - 1) if kind >= 0 else [0] * len(part))
        gap = tail + rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", ": "])
        text, labels = text + lead + part + gap, labels + [0] * len(gap)
    at = rng.randrange(0, len(text) - WINDOW + 1)
    return text[at : at + WINDOW], np.array(labels[at : at + WINDOW])


def train(windows: int = 12800, epochs: int = 6, batch: int = 64, seed: int = 11) -> Tagger:
    """The tagger, trained with Adam on `windows` made-up windows."""
    rng = random.Random(seed)
    data = [_made_window(rng) for _ in range(windows)]
    ids, gold = np.stack([_classes(t) for t, _ in data]), np.stack([g for _, g in data])
    model, order = Tagger(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, steps = 0, epochs * (windows // batch)
    for _ in range(epochs):
        for at in order.permutation(windows)[: windows // batch * batch].reshape(-1, batch):
            step += 1
            rate = 0.02 * (1 - step / (steps + 1))
            _, grads = model.step(ids[at], gold[at])
            size = np.sqrt(sum((g * g).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger with the stored weights."""
    model = Tagger()
    with np.load(TRAINED) as held:
        model.p = {k: held[k].astype(np.float64) for k in model.p}
    return model


# --- spans ---------------------------------------------------------------------------------------

_AT_WORD = re.compile(r"@|[(\[]\s?at\s?[)\]]|\sat\s", re.I)
_DOT_WORD = re.compile(r"\.|[(\[]\s?dot\s?[)\]]|\sdot\s", re.I)
_NUMBER = re.compile(r"[0-9]+")


def plausible(kind: str, part: str) -> bool:
    """The check of a kind for a span that only the model found."""
    numbers = _NUMBER.findall(part)
    digits = "".join(numbers)
    if kind == "email":
        halves = _AT_WORD.split(part)
        return len(halves) == 2 and bool(re.search(r"[A-Za-z0-9]{2}$", halves[0].strip())) and bool(_DOT_WORD.search(halves[1])) and bool(re.search(r"[A-Za-z]{2,}$", part))
    if kind == "ip":
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers) and not re.search(r"[A-Za-z]", part)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", part)
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9_+/=.-]{16,}", part) and re.search(r"[A-Za-z]", part) and len(digits) >= 3)
    formed = re.search(r"^(?:\+|00|\(|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)", part)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z:,/]", part) and bool(formed) and (part[0] == "+" or len(numbers) > 1)


def checked(kind: str, part: str) -> str | None:
    """The kind whose check the span passes: its label's, else the first of the others that are made of digits."""
    if plausible(kind, part):
        return kind
    return next((k for k in ("card", "phone", "ip") if kind in ("card", "phone", "ip") and k != kind and plausible(k, part)), None)


def apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap no base span, by one look at the furthest end of those that start before."""
    order = sorted((s, e) for _, s, e in base)
    starts, furthest, most = [s for s, _ in order], [], -1
    for _, e in order:
        most = max(most, e)
        furthest.append(most)
    return [x for x in spans if not (n := bisect_left(starts, x[2])) or furthest[n - 1] <= x[1]]


def find(model: Decoder, texts: list[str], lead: float = 0.0) -> list[tuple[list, list, list]]:
    """For each text its base spans, the spans of their kinds that the model adds, and the secrets it finds."""
    out = []
    for text, spans in zip(texts, model.spans(texts, lead)):
        base = base_spans(text)
        free = [(kind, s, e) for k, s, e in apart(spans, base) if (kind := checked(k, text[s:e]))]
        out.append((base, [x for x in free if x[0] != "secret"], [x for x in free if x[0] == "secret"]))
    return out


def _line(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda x: (MODEL_KINDS.index(x[0]), x[1], x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


COLUMNS = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_secret bigint, secrets string, n_found bigint, "
    "base_email bigint, base_ip bigint, base_card bigint, base_phone bigint"
)


def scan(docs: DataFrame, lead: float = 0.0, text_col: str = "text") -> DataFrame:
    """Counts of all spans by kind, the digest of the base spans, all spans, and how many the model added; then
    the secrets it found (n_secret, secrets), the number of all findings (n_found), and the counts of the base
    spans alone (base_email to base_phone)."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Decoder(sent.value)
        for batch in batches:
            rows = []
            for doc_id, (base, added, secrets) in zip(batch["doc_id"], find(model, [t or "" for t in batch["text"]], lead)):
                every = base + added
                counts, plain = ([sum(k == kind for k, _, _ in spans) for kind in KINDS] for spans in (every, base))
                digest = hashlib.sha256(_line(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, _line(every), len(added), len(secrets), _line(secrets), len(every) + len(secrets), *plain))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return null_ids(docs.select(whole_id(), F.col(text_col).alias("text")).mapInPandas(run, COLUMNS))


if __name__ == "__main__":
    np.savez_compressed(TRAINED, **{k: v.astype(np.float32) for k, v in train().p.items()})
