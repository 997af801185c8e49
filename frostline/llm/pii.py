"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, in numpy.

The network is trained from labelled spans and reads overlapping windows of a text. Each place of the text belongs to
the window in whose middle it lies; the windows' decoded tags, put together, give the text's spans. All four kinds
hold digits or an @, so only windows that have one are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{kind}" for kind in KINDS)  # kinds of the spans that the network adds

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits is tried once, from its first digit
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = 7 + len(PUNCTUATION)  # padding, lower case, upper case, digit, space, other white space, others
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind


@dataclass(frozen=True)
class Settings:
    """window, overlapping by half. max_documents: documents that may give training windows, by a hash of doc_id;
    max_windows: windows that train. least: characters of an added span."""

    window: int = 64
    embedding: int = 8
    hidden: int = 12
    steps: int = 260
    batch: int = 64
    rate: float = 0.02
    max_documents: int = 20000
    max_windows: int = 6000
    least: int = 6
    seed: int = 11


Span = tuple[int, int, int]  # kind's number, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed patterns, by kind and start, and those that match but fail their kind's check.

    Offsets count code points, the end is exclusive.
    """
    if not ANCHOR.search(text):
        return [], []
    found, failed = [(0, a, b) for a, b in _emails(text)], []
    for m in IP.finditer(text):
        (found if all(map(_small, m.group().split("."))) else failed).append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            (found if 16 <= len(digits) <= 19 and _luhn(digits) else failed).append((2, *m.span()))
    for m in PHONE.finditer(text):
        (found if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15 else failed).append((3, *m.span()))
    return found, failed


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns."""
    return matches(text)[0]


_CODES = np.full(128, 6, np.int8)
_CODES[ord("a") : ord("z") + 1], _CODES[ord("A") : ord("Z") + 1], _CODES[ord("0") : ord("9") + 1] = 1, 2, 3
_CODES[ord(" ")], _CODES[9:14] = 4, 5
for _place, _mark in enumerate(PUNCTUATION):
    _CODES[ord(_mark)] = 7 + _place


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 6).astype(np.int8)


def window_starts(codes: np.ndarray, window: int) -> np.ndarray:
    """Starts, at multiples of half a window from -half/2, of windows with a digit or @."""
    anchors = np.flatnonzero((codes == 3) | (codes == 7 + PUNCTUATION.index("@")))
    half = window // 2
    last = (anchors + half // 2) // half  # the window in whose middle or second half an anchor lies
    return np.unique(np.concatenate([last, last - 1])) * half - half // 2 if len(anchors) else np.zeros(0, np.int64)


def cut(values: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The windows of an array, padded with 0 beyond its ends."""
    padded = np.concatenate([np.zeros(window, values.dtype), values, np.zeros(window, values.dtype)])
    return padded[starts[:, None] + window + np.arange(window)]


def tags_of(spans: list[Span], size: int) -> np.ndarray:
    tags = np.zeros(size, np.int8)
    for kind, start, end in reversed(spans):  # the kind listed first wins
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters, training and decoding of the network."""

    def __init__(self, settings: Settings):
        self.settings = settings
        rng = np.random.default_rng(settings.seed)
        e, h = settings.embedding, settings.hidden
        self.p = {"emb": rng.normal(0, 0.5, (SYMBOLS, e))}
        for side in "fb":
            self.p[f"wx_{side}"] = rng.normal(0, e**-0.5, (e, 4 * h))
            self.p[f"wh_{side}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0
            self.p[f"b_{side}"] = bias
        self.p["out"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, TAGS))
        self.p["out_b"], self.p["trans"], self.p["first"] = np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)

    def _run(self, codes: np.ndarray, side: str, keep: bool):
        """States of one direction, [time, batch, hidden], and what the backward pass needs."""
        h = self.settings.hidden
        table = self.p["emb"] @ self.p[f"wx_{side}"] + self.p[f"b_{side}"]
        order = codes.T if side == "f" else codes.T[::-1]
        state, cell = np.zeros((codes.shape[0], h)), np.zeros((codes.shape[0], h))
        states, saved = np.empty((codes.shape[1], codes.shape[0], h)), []
        for t, now in enumerate(order):
            z = table[now] + state @ self.p[f"wh_{side}"]
            gates, fresh = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, past = cell, state
            cell = gates[:, h : 2 * h] * before + gates[:, :h] * fresh
            bent = np.tanh(cell)
            state = gates[:, 2 * h :] * bent
            states[t] = state
            if keep:
                saved.append((gates, fresh, before, bent, past))
        return (states if side == "f" else states[::-1]), saved

    def _back(self, codes: np.ndarray, side: str, slope: np.ndarray, saved: list, grads: dict) -> None:
        h = self.settings.hidden
        order = codes.T if side == "f" else codes.T[::-1]
        slope = slope if side == "f" else slope[::-1]
        wh, slopes = self.p[f"wh_{side}"], np.empty((*slope.shape[:2], 4 * h))
        d_state, d_cell, d_wh = np.zeros(slope.shape[1:]), np.zeros(slope.shape[1:]), np.zeros_like(wh)
        for t in range(len(order) - 1, -1, -1):
            gates, fresh, before, bent, past = saved[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            d_state = d_state + slope[t]
            d_cell = d_cell + d_state * o * (1 - bent * bent)
            dz = np.concatenate([d_cell * fresh * i * (1 - i), d_cell * before * f * (1 - f),
                                 d_state * bent * o * (1 - o), d_cell * i * (1 - fresh * fresh)], axis=1)
            d_wh += past.T @ dz
            slopes[t] = dz
            d_state, d_cell = dz @ wh.T, d_cell * f
        dx = (np.arange(SYMBOLS)[:, None] == order.ravel()).astype(float) @ slopes.reshape(-1, 4 * h)  # by symbol
        grads[f"wh_{side}"], grads[f"b_{side}"] = d_wh, dx.sum(axis=0)
        grads[f"wx_{side}"] = self.p["emb"].T @ dx
        grads["emb"] = grads.get("emb", 0) + dx @ self.p[f"wx_{side}"].T

    def _scores(self, codes: np.ndarray, keep: bool = False):
        ahead, saved_f = self._run(codes, "f", keep)
        behind, saved_b = self._run(codes, "b", keep)
        both = np.concatenate([ahead, behind], axis=2)
        return both @ self.p["out"] + self.p["out_b"], both, saved_f, saved_b

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the windows' tags, and its gradients."""
        rows, length = codes.shape
        scores, both, saved_f, saved_b = self._scores(codes, keep=True)
        trans, every = self.p["trans"], np.arange(rows)

        def summed(x: np.ndarray) -> np.ndarray:
            most = x.max(axis=1)
            return most + np.log(np.exp(x - most[:, None]).sum(axis=1))

        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + self.p["first"]
        for t in range(1, length):
            alpha[t] = summed(alpha[t - 1][:, :, None] + trans) + scores[t]
        for t in range(length - 2, -1, -1):
            beta[t] = summed((trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :]).transpose(0, 2, 1))
        most = alpha[-1].max(axis=1)
        total = most + np.log(np.exp(alpha[-1] - most[:, None]).sum(axis=1))
        chance = np.exp(alpha + beta - total[None, :, None])
        order = tags.T.astype(np.int64)
        gold = self.p["first"][order[0]] + np.take_along_axis(scores, order[:, :, None], axis=2)[:, :, 0].sum(axis=0)
        gold = gold + trans[order[:-1], order[1:]].sum(axis=0)
        d_scores = chance / rows
        for t in range(length):
            d_scores[t, every, order[t]] -= 1 / rows
        d_trans = np.zeros_like(trans)
        for t in range(length - 1):
            pair = alpha[t][:, :, None] + trans + (scores[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None]
            d_trans += np.exp(pair).sum(axis=0)
        np.subtract.at(d_trans, (order[:-1].ravel(), order[1:].ravel()), 1)
        grads = {"trans": d_trans / rows, "first": d_scores[0].sum(axis=0), "out_b": d_scores.sum(axis=(0, 1)),
                 "out": np.einsum("tbh,tbk->hk", both, d_scores)}
        d_both, h = d_scores @ self.p["out"].T, self.settings.hidden
        self._back(codes, "f", d_both[:, :, :h], saved_f, grads)
        self._back(codes, "b", d_both[:, :, h:], saved_b, grads)
        return float((total - gold).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray) -> Tagger:
        """Adam over batches of windows; the same windows in the same order give the same network."""
        settings, rng = self.settings, np.random.default_rng(self.settings.seed + 1)
        if not len(codes):
            return self
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, settings.steps + 1):
            some = rng.integers(0, len(codes), min(settings.batch, len(codes)))
            _, grads = self.loss(codes[some], tags[some])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = settings.rate * min(1.0, 2 * (1 - step / (settings.steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window; a further character follows only a character of its kind."""
        scores = self._scores(codes)[0]
        trans = self.p["trans"].copy()
        for kind in range(len(KINDS)):
            for before in range(TAGS):
                if before not in (1 + 2 * kind, 2 + 2 * kind):
                    trans[before, 2 + 2 * kind] = -1e4
        best, back = scores[0] + self.p["first"], np.empty(scores.shape, np.int8)
        for t in range(1, len(scores)):
            options = best[:, :, None] + trans
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[t]
        tags = np.empty(codes.shape, np.int8)
        now = best.argmax(axis=1)
        for t in range(len(scores) - 1, -1, -1):
            tags[:, t] = now
            now = back[t][np.arange(len(now)), now] if t else now
        return tags


def reconciled(starts: np.ndarray, tags: np.ndarray, size: int) -> list[Span]:
    """Spans of a text from its windows' tags: the middle half of each window counts."""
    window = tags.shape[1]
    quarter = window // 4
    places = (starts[:, None] + quarter + np.arange(window // 2)).ravel()
    inner = tags[:, quarter : quarter + window // 2].ravel()
    keep = (places >= 0) & (places < size) & (inner > 0)
    spans: list[Span] = []
    for place, tag in zip(places[keep].tolist(), inner[keep].tolist(), strict=True):
        kind = (tag - 1) // 2
        if spans and spans[-1][0] == kind and spans[-1][2] == place and tag % 2 == 0:
            spans[-1] = (kind, spans[-1][1], place + 1)
        else:
            spans.append((kind, place, place + 1))
    return spans


def _training_windows(settings: Settings):
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, tags = [], []
            for text in batch["text"]:
                symbols = codes_of(text)
                starts = window_starts(symbols, settings.window)
                codes += [w.tobytes() for w in cut(symbols, starts, settings.window)]
                tags += [w.tobytes() for w in cut(tags_of(base_spans(text), len(text)), starts, settings.window)]
            yield pd.DataFrame({"codes": codes, "tags": tags})

    return windows


def train(documents: DataFrame, settings: Settings = Settings()) -> Tagger:
    """Network from documents (doc_id, text) whose labelled spans are those of the fixed patterns.

    At most max_documents documents are looked at and max_windows different windows train, chosen by hashes; only
    these reach the driver. Without any, the network stays untrained and adds nothing.
    """
    rows = documents.select("doc_id").count()
    share = 1.0 if rows <= settings.max_documents else settings.max_documents / rows
    some = documents.select("doc_id", "text").where(
        (F.pmod(F.xxhash64(F.lit(9), F.col("doc_id")), F.lit(1_000_000)) < int(share * 1e6)) & F.col("text").rlike("[0-9@]")
    ).select("text")
    windows = some.mapInPandas(_training_windows(settings), "codes binary, tags binary").distinct()
    sample = windows.orderBy(F.xxhash64("codes", "tags"), "codes", "tags").limit(settings.max_windows).toArrow().to_pydict()
    tagger = Tagger(settings)
    if not sample["codes"]:
        return tagger
    codes = np.frombuffer(b"".join(sample["codes"]), np.int8).reshape(-1, settings.window)
    tags = np.frombuffer(b"".join(sample["tags"]), np.int8).reshape(-1, settings.window)
    return tagger.fit(codes, tags) if tags.any() else tagger


def find(texts: list[str | None], tagger: Tagger) -> list[list[Span]]:
    """Spans of each text: the fixed patterns', and those that the network adds (their kind's number + 4)."""
    settings = tagger.settings
    trained = bool(tagger.p["trans"].any())
    found, refused, work = [], [], []
    for place, text in enumerate(texts):
        fixed, failed = matches(text) if text else ([], [])
        found.append(fixed)
        refused.append(failed)
        if trained and text and ANCHOR.search(text):
            symbols = codes_of(text)
            starts = window_starts(symbols, settings.window)
            work.append((place, len(text), starts, cut(symbols, starts, settings.window)))
    if not work:
        return found
    every = np.concatenate([w[3] for w in work])
    tags = np.concatenate([tagger.decode(every[i : i + 512]) for i in range(0, len(every), 512)])
    at = 0
    for place, size, starts, _ in work:
        own = tags[at : at + len(starts)]
        at += len(starts)
        base = np.zeros(size + 1, np.int32)
        for _, start, end in found[place] + refused[place]:
            base[start] += 1
            base[end] -= 1
        taken = np.concatenate([[0], np.cumsum(np.cumsum(base)[:size] > 0)])
        more = [(kind + len(KINDS), start, end) for kind, start, end in reconciled(starts, own, size)
                if end - start >= settings.least and taken[end] == taken[start]]
        found[place] = sorted(found[place] + more)
    return found


def _scan(tagger: Tagger):
    names = KINDS + ADDED

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for at in range(0, len(batch), 256):
                for found in find(list(batch["text"].iloc[at : at + 256]), tagger):
                    spans.append([{"kind": names[kind], "start": start, "end": end} for kind, start, end in found])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    return scan


def scanned(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, spans (kind, start, end) of every whole text, one row per document row.

    Spans are ordered by kind as listed in KINDS, then the added kinds, and by start. A span is added where it touches
    no match of a fixed pattern, neither a span nor one that failed its check: a number without the right check digit
    stays no card. Null counts as empty and has none; repeated rows are read each; an empty table
    gives no rows; other columns don't matter.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_scan(tagger), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
