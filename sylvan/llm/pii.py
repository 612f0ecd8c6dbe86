"""Personal data in texts: patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans (made by rule, with a fixed seed). A span that passes the check of its kind
holds a digit or an at sign (or one written out), so stretches of text without any within WINDOW / 2 characters cannot hold
one and are not read. Windows of WINDOW characters overlap by half; their scores are averaged by distance from the window's
edge, and one Viterbi search over the whole stretch, with the learned transitions, gives the spans. Spans of the tagger are kept if they pass the check of their
kind and do not overlap a span of the patterns, which always stay.

Kinds are email, ip, card and phone; positions are code points, ends exclusive. The counts n_* and base_sha256 are of the
patterns' spans, spans has all.

Cases: a null or empty text has no span; repeated rows and null ids are treated like any other; texts of any length are
read whole. No rows give no rows. Only doc_id and text are read (redact keeps the other columns).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.util import slices, steady

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does; possessive, so that long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and not overlapping in each kind; matches that fail their check are dropped."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, end := m.end()))
            at = end - 1
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        if "." in text:
            found += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        found += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def plausible(kind: int, value: str) -> bool:
    """The check that a span of the tagger must pass."""
    digits = NOT_DIGIT.sub("", value)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[(]at[\])])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]+)*", value))
    if kind == 1:
        return len(parts := re.split(r"\s?\.\s?|\[\.\]", value)) == 4 and all(re.fullmatch(r"[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 .-]+[0-9]", value)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(0-9][0-9 ().-]+[0-9]", value)) and 8 <= len(digits) <= 15 and len(digits) < len(value)


# ---- the tagger ----

WINDOW, HIDDEN, EMBED = 96, 16, 12
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Classes of characters: ASCII, other letters, anything else; the last one fills windows up.
CLASSES = 131


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129)).astype(np.int64)


class Tagger(NamedTuple):
    """Parameters by name; forward and backward direction have their own."""

    p: dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(p: dict[str, np.ndarray], d: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """States over time of inputs x [time, batch, EMBED]."""
    steps, batch, _ = x.shape
    pre = x @ p[f"wx{d}"] + p[f"b{d}"]
    gates, cells, outs = np.empty_like(pre), np.zeros((steps + 1, batch, HIDDEN), np.float32), np.zeros((steps + 1, batch, HIDDEN), np.float32)
    for t in range(steps):
        a = pre[t] + outs[t] @ p[f"wh{d}"]
        a[:, : 3 * HIDDEN] = sigmoid(a[:, : 3 * HIDDEN])  # input, forget, output
        a[:, 3 * HIDDEN :] = np.tanh(a[:, 3 * HIDDEN :])
        i, f, o, g = (a[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        gates[t], cells[t + 1] = a, f * cells[t] + i * g
        outs[t + 1] = o * np.tanh(cells[t + 1])
    return {"x": x, "gates": gates, "cells": cells, "outs": outs}


def lstm_gradient(p: dict[str, np.ndarray], d: str, s: dict[str, np.ndarray], up: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
    """Adds to grad from the gradient `up` of the outputs; returns that of the inputs."""
    steps, batch, _ = up.shape
    out_next, cell_next = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    pre = np.empty_like(s["gates"])
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (s["gates"][t][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tc = np.tanh(s["cells"][t + 1])
        h = up[t] + out_next
        c = h * o * (1 - tc * tc) + cell_next
        pre[t] = np.concatenate([c * g * i * (1 - i), c * s["cells"][t] * f * (1 - f), h * tc * o * (1 - o), c * i * (1 - g * g)], 1)
        out_next, cell_next = pre[t] @ p[f"wh{d}"].T, c * f
    flat = pre.reshape(-1, 4 * HIDDEN)
    grad[f"wx{d}"] += s["x"].reshape(-1, EMBED).T @ flat
    grad[f"wh{d}"] += s["outs"][:-1].reshape(-1, HIDDEN).T @ flat
    grad[f"b{d}"] += flat.sum(0)
    return pre @ p[f"wx{d}"].T


def emissions(p: dict[str, np.ndarray], chars: np.ndarray) -> tuple[np.ndarray, dict, dict]:
    """Scores [time, batch, TAGS] of windows [batch, time], and the states."""
    x = p["embed"][chars.T]
    fore, back = run_lstm(p, "f", x), run_lstm(p, "b", x[::-1])
    both = np.concatenate([fore["outs"][1:], back["outs"][1:][::-1]], 2)
    return both @ p["wo"] + p["bo"], fore, back


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood a window of the tags [time, batch], and its gradients by scores and transitions."""
    steps, batch, k = e.shape
    fore, back = np.empty_like(e), np.zeros_like(e)
    fore[0] = e[0]
    for t in range(1, steps):
        fore[t] = e[t] + log_sum(fore[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = log_sum(trans + (e[t + 1] + back[t + 1])[:, None, :], 2)
    z = log_sum(fore[-1], 1)
    marginal = np.exp(fore + back - z[None, :, None])
    pairs = np.exp(fore[:-1, :, :, None] + trans + (e[1:] + back[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
    rows = np.arange(batch)
    gold = sum(e[t, rows, tags[t]] for t in range(steps)) + sum(trans[tags[t - 1], tags[t]] for t in range(1, steps))
    for t in range(steps):
        marginal[t, rows, tags[t]] -= 1
    np.subtract.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return float((z - gold).mean()), marginal / batch, pairs / batch


def train(chars: np.ndarray, tags: np.ndarray, epochs: int = 7, batch: int = 64, rate: float = 0.012, seed: int = 5) -> Tagger:
    rng = np.random.default_rng(seed)
    shape = {"embed": (CLASSES, EMBED), "wo": (2 * HIDDEN, TAGS), "bo": (TAGS,), "trans": (TAGS, TAGS)} | {f"{n}{d}": s for d in "fb" for n, s in (("wx", (EMBED, 4 * HIDDEN)), ("wh", (HIDDEN, 4 * HIDDEN)), ("b", (4 * HIDDEN,)))}
    p = {n: (rng.standard_normal(s) * (0.3 if len(s) > 1 and n != "trans" else 0)).astype(np.float32) for n, s in shape.items()}
    for d in "fb":
        p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(chars) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(chars))
        for at in range(0, len(order), batch):
            now = order[at : at + batch]
            e, fore, back = emissions(p, chars[now])
            _, by_score, by_trans = crf_gradient(e, tags[now].T, p["trans"])
            by_score = by_score.astype(np.float32)
            both = np.concatenate([fore["outs"][1:], back["outs"][1:][::-1]], 2)
            grad = {n: np.zeros_like(v) for n, v in p.items()}
            grad["trans"] = by_trans.astype(np.float32)
            grad["wo"] = both.reshape(-1, 2 * HIDDEN).T @ by_score.reshape(-1, TAGS)
            grad["bo"] = by_score.sum((0, 1))
            up = by_score @ p["wo"].T
            inputs = lstm_gradient(p, "f", fore, up[:, :, :HIDDEN], grad) + lstm_gradient(p, "b", back, up[::-1, :, HIDDEN:], grad)[::-1]
            np.add.at(grad["embed"], chars[now].T, inputs)
            step += 1
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
            for n, g in grad.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.99 * second[n] + 0.01 * g * g
                p[n] = p[n] - np.float32(rate * min(1.0, 2 * (1 - step / (total + 1)))) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + np.float32(1e-6))
    return Tagger({n: v.astype(np.float32) for n, v in p.items()})


def luhn_number(r: random.Random, n: int) -> str:
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def example(r: random.Random, length: int) -> tuple[str, list[Span]]:
    """A made text with labelled spans, and with numbers and codes that are no personal data."""
    word = lambda a=2, b=9: "".join(r.choice("eeeeaaaoiiunrtttsslhdcmpgbfvéñüzx") for _ in range(r.randint(a, b)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made: list[tuple[int, str]] = []
    while sum(len(x) + 1 for _, x in made) < length:
        draw = r.random()
        if draw > 0.42:
            w = word()
            made.append((-1, (w.capitalize() if r.random() < 0.2 else w) + r.choice(["", "", "", "", ".", ",", ";", ":", "!"])))
        elif draw < 0.08:
            at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" [at] ", "."), ("(at)", "."), ("@", " [dot] ")])
            made.append((0, r.choice([f"{word()}{r.choice(['.', '_', '', '-'])}{digits(r.randint(0, 3))}", f"{word()}.{word()}"]) + at + r.choice([word(), f"{word()}{digits(1)}"]) + dot + r.choice(["com", "org", "net", "fr", "co", f"{word()}.com"])))
        elif draw < 0.14:
            made.append((1, ".".join(str(r.randint(0, 255)) for _ in range(4))))
        elif draw < 0.21:
            n = luhn_number(r, r.choice([16, 16, 16, 15, 13]))
            sep = r.choice(["", "", " ", "-", "."])
            made.append((2, sep.join(n[i : i + 4] for i in range(0, len(n), 4))))
        elif draw < 0.29:
            a, b, c = digits(3), digits(3), digits(4)
            made.append((3, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(3)} {digits(7)}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"0{digits(2)} {digits(4)} {digits(4)}"])))
        else:
            made.append((-1, r.choice([digits(r.randint(1, 6)), f"{r.randint(1900, 2030)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40))), f"@{word()}", f"${digits(3)}.{digits(2)}", f"{digits(1)}-{digits(1)}", f"#{digits(4)}", digits(r.randint(7, 24)), f"{r.randint(2000, 2030)}-{digits(2)}-{digits(2)}"])))
    text, spans = "", []
    for kind, value in made:
        # A surrounding mark, as in quoted or junk text, is no part of the span.
        before, after = r.choice([("", "")] * 8 + [('"', '"'), ("(", ")"), ("", "%%%"), ("", "###"), ("=", "")])
        text += before
        if kind >= 0:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + after + r.choice([" "] * 9 + ["\n"])
    return text, spans


#: Taggers that this process has had trained, by their parameters.
TRAINED: dict[tuple[int, int, int], Tagger] = {}


def tagger(spark: SparkSession, examples: int = 2600, length: int = 64, seed: int = 11) -> Tagger:
    """Trained once, in one task (where Spark keeps numpy to the task's cores)."""
    if (key := (examples, length, seed)) not in TRAINED:

        def work(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = train_tagger(*key).p
            yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([x.tobytes() for x in p.values()], pa.binary()), pa.array([list(x.shape) for x in p.values()], pa.list_(pa.int32()))], ["name", "data", "shape"])

        rows = spark.range(0, 1, 1, 1).mapInArrow(steady(work), "name string, data binary, shape array<int>").collect()
        TRAINED[key] = Tagger({r.name: np.frombuffer(r.data, np.float32).reshape(r["shape"]) for r in rows})
    return TRAINED[key]


def train_tagger(examples: int, length: int, seed: int) -> Tagger:
    """A tagger of made examples; the same on each call."""
    r = random.Random(seed)
    chars, tags = np.full((examples, length), CLASSES - 1, np.int64), np.zeros((examples, length), np.int64)
    for row in range(examples):
        text, spans = example(r, length + 24)
        low = r.randint(0, max(0, len(text) - length))
        if r.random() < 0.1:
            text = text[: low + r.randint(length // 2, length)]  # the text ends inside the window
        codes = classes(text)[low : low + length]
        chars[row, : len(codes)] = codes
        for kind, a, b in spans:
            a, b = max(a - low, 0 if a >= low else -1), min(b - low, len(codes))
            if b > max(a, 0):
                tags[row, max(a, 0) : b] = 2 + 2 * kind
                if a >= 0:
                    tags[row, a] = 1 + 2 * kind
    return train(chars, tags)


def stretches(text: str, reach: int = WINDOW // 2) -> list[tuple[int, int]]:
    """The surroundings of digits and at signs, joined where they meet."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def decode(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags [batch, time] of scores [time, batch, TAGS]."""
    steps, batch, _ = scores.shape
    best, back = scores[0], np.empty(scores.shape, np.int8)
    for t in range(1, steps):
        every = best[:, :, None] + trans
        back[t] = every.argmax(1)
        best = np.take_along_axis(every, back[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[t]
    tags = np.empty((batch, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(batch), tags[:, t]]
    return tags


#: Stretches are read in sections of so many characters, with WINDOW before and two behind, and a span belongs to the section
#: that it starts in; so memory is bounded and the windows of one long text are worked on together.
SECTION = 1 << 14


def sections(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end) to read and (first, last) place at which its spans may start, for the whole of all stretches."""
    out = []
    for a, b in stretches(text):
        out += [(max(a, x - WINDOW), min(b, x + SECTION + 2 * WINDOW), x, min(b, x + SECTION)) for x in range(a, b, SECTION)]
    return out


def window_scores(model: Tagger, padded: np.ndarray, at_once: int) -> np.ndarray:
    """Scores [time, batch, TAGS] of sequences [batch, time], from windows that overlap by half, weighted by the distance from
    their edges. All windows of all sequences are one batch."""
    half, weight = WINDOW // 2, (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)[:, None, None]
    batch, n = len(padded), padded.shape[1] // half - 1
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW, 1)[:, ::half].reshape(batch * n, WINDOW)
    total = np.zeros((batch, n + 1, half, TAGS), np.float32)
    mass = np.zeros((n + 1, half, 1), np.float32)
    mass[:n] += weight[:half, 0]
    mass[1:] += weight[half:, 0]
    for a in range(0, len(windows), at_once):
        e = (emissions(model.p, windows[a : a + at_once])[0] * weight).transpose(1, 0, 2)
        row, k = np.divmod(np.arange(a, a + len(e)), n)
        total[row, k] += e[:, :half]
        total[row, k + 1] += e[:, half:]
    return (total / mass).reshape(batch, (n + 1) * half, TAGS).transpose(1, 0, 2)


def tagged_spans(model: Tagger, texts: list[str], at_once: int = 512) -> list[list[Span]]:
    """The tagger's spans of each text, unchecked."""
    found: list[list[Span]] = [[] for _ in texts]
    todo = [(b - a, row, a, first, last) for row, text in enumerate(texts) for a, b, first, last in sections(text)]
    todo.sort()
    half = WINDOW // 2
    codes = {row: classes(texts[row]) for row in {x[1] for x in todo}}
    low = 0
    while low < len(todo):
        # Sections of similar length together, as many as fit.
        high = low + 1
        while high < len(todo) and (high - low + 1) * (-(-todo[high][0] // half) + 1) <= at_once:
            high += 1
        group = todo[low:high]
        low = high
        n = max(1, -(-(group[-1][0] - half) // half))
        padded = np.full((len(group), (n + 1) * half), CLASSES - 1, np.int64)
        for i, (size, row, a, _, _) in enumerate(group):
            padded[i, :size] = codes[row][a : a + size]
        tags = decode(window_scores(model, padded, at_once), model.p["trans"])
        for (size, row, a, first, last), own in zip(group, tags, strict=True):
            own = own[:size]
            on = np.flatnonzero(own)
            if not len(on):
                continue
            kind = (own - 1) // 2
            new = (own % 2 == 1) | (np.diff(kind, prepend=-1) != 0)
            for s in (t for t in on if new[t] and first <= a + t < last):
                e = s + 1
                while e < size and own[e] == 2 + 2 * kind[s]:
                    e += 1
                found[row].append((int(kind[s]), a + int(s), a + e))
    return found


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text, by kind and start."""
    out = []
    for text, more in zip(texts, tagged_spans(model, texts), strict=True):
        base = base_spans(text)
        # Spaces and marks at its ends are no part of a span.
        added = []
        for kind, a, b in more:
            while a < b and text[a] in " \t\n\"'(,;:=" and not (kind == 3 and text[a] == "("):
                a += 1
            while a < b and text[b - 1] in " \t\n\"').,;:!?#%$&*":
                b -= 1
            if a < b and plausible(kind, text[a:b]) and not any(a < e and s < b for _, s, e in base):
                added.append((kind, a, b))
        out.append((sorted(base), sorted(base + added)))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


PII = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def pii(docs: DataFrame) -> DataFrame:
    """The columns of PII for each document; n_added is how many spans the tagger adds."""
    model = tagger(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            pairs = find_spans(model, [x or "" for x in part.column(1).to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in pairs], pa.int64()) for k in range(4)]
            hashes = [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in pairs]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(hashes), pa.array([told(every) for _, every in pairs]), pa.array([len(e) - len(b) for b, e in pairs], pa.int64())], [x.split()[0] for x in PII.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(steady(run), PII)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with each span's place taken by its kind; of overlapping spans the union is replaced, named by the first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced and n_chars, where it is there, counted anew. Null texts stay null."""
    model, names, at = tagger(docs.sparkSession), docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts = part.column(at).to_pylist()
            new = [None if t is None else replaced(t, every) for t, (_, every) in zip(texts, find_spans(model, [x or "" for x in texts]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else c for k, c in enumerate(part.columns)], names)

    out = docs.mapInArrow(steady(run), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType))) if "n_chars" in names else out
