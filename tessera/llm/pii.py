"""Personal data by rules and a character-level BiLSTM-CRF.

The rules give the base spans.  The network, trained in numpy from labelled
spans in made-up lines, reads overlapping windows around every character
that any of the four kinds must hold (a digit, an at sign or one spelt out);
where windows overlap their scores are blended, and one decoding under the
CRF's transitions runs over each whole stretch of windows.  Its spans that
overlap no base span and pass the kind's own test are added.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
_LABELS = 1 + 2 * len(KINDS)  # none, and begin and inside of each kind
_CHARS = 132
#: Length and step of the windows; a stretch goes MARGIN past its anchors.
SPAN, STEP, MARGIN = 64, 32, 40

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = r"[\[({]\s?(?:at|AT)\s?[\])}]"
_ANCHOR = re.compile(rf"[0-9@]+|{_AT}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by the rules: of each kind leftmost and without
    overlaps; matches that fail a kind's test are dropped."""
    out = []
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        # The one start a leftmost match with this sign can have.
        a = at
        while a > last and (text[a - 1] in "._%+-" or text[a - 1].isascii() and text[a - 1].isalnum()):
            a -= 1
        m = _HOST.match(text, at) if a < at else None
        if m:
            out.append((0, a, m.end()))
            last = m.end()
            at = last
        else:
            last = max(last, at + 1)
            at += 1
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x or 0) < 256 for x in (y.lstrip("0") for y in m[0].split(".")))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


#: What an address must hold: a sign of its two parts, and of the host's.
_PARTS = re.compile(rf"\w\s?(?:@|{_AT})\s?\w.*(?:\.|[\[({{]\s?(?:dot|DOT)\s?[\])}}])\s?\w", re.S)


def _sound(kind: int, s: str) -> bool:
    """Whether a span that only the network found can be of its kind at all:
    an address has two parts and a host of two, an ip and a card are whole
    and valid, a telephone number has 9 to 15 digits and no letter."""
    if kind == 1:
        return any(k == 1 and b - a == len(s) for k, a, b in base_spans(s))
    if kind == 2:
        return _is_card(s)
    if kind == 3:
        return 9 <= len(_digits(s)) <= 15 and not any(map(str.isalpha, s))
    return bool(_PARTS.search(s))


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, np.where(c < 0x250, 128, 129)).astype(np.int16)


PAD = 130


def _line(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up line and its labelled spans."""
    letters = "eeeettaaooinnsshhrrddllucmwfgypbvk" + "äöüßéèçñó"
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    plain = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    text, spans = "", []
    while len(text) < SPAN:
        x, kind = word(), None
        what = rng.random()
        if what < 0.30:
            kind = rng.randrange(4)
            tld = rng.choice(("com", "org", "net", "de", "fr"))
            if kind == 0:
                user, host = plain() + rng.choice(("", ".", "_", "")) + rng.choice((d(2), plain(), "", "")), plain() + rng.choice(("", d(1)))
                if rng.random() < 0.3:  # short ones of any letters
                    user, host = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 4))) for _ in range(2))
                x = rng.choice((f"{user}@{host}.{tld}", f"{user}@{host}.example.{tld}", f"{user} [at] {host} [dot] {tld}", f"{user} [at] {host} [dot] {tld}", f"{user} (at) {host}.{tld}"))
            elif kind == 1:
                x = ".".join(str(rng.randrange(256)) for _ in range(4))
            elif kind == 2:
                n = d(rng.choice((15, 15, 14)))
                n += next(c for c in "0123456789" if luhn(n + c))
                x = rng.choice((n, n, " ".join(n[i : i + 4] for i in range(0, len(n), 4)), "-".join(n[i : i + 4] for i in range(0, len(n), 4))))
            else:
                x = rng.choice((f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}"))
        elif what < 0.52:
            x = rng.choice((d(rng.randint(1, 6)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(2)}.", f"${d(3)}.{d(2)}", "AKIA" + hexed(16).upper(), f'"{hexed(34)}"', f"key={hexed(14)}", f"{d(2)}:{d(2)}", f"@{word()}", d(16), f"{d(1)},{d(3)}", f"{d(2)}/{d(2)}/{d(4)}", word() + rng.choice(("%%%", "$$$", "###", "@@@"))))
            if x.isdigit() and 13 <= len(x) <= 19 and luhn(x):
                continue
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(x)))
        text += x + rng.choice((" ", " ", " ", ", ", ". ", "\n", " | "))
    cut = rng.randrange(len(text) - SPAN + 1)
    return text[cut : cut + SPAN], [(k, max(a - cut, 0), min(b - cut, SPAN)) for k, a, b in spans if b > cut and a < cut + SPAN]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    x: np.ndarray  # directions x characters x 4 units
    u: np.ndarray  # directions x units x 4 units
    o: np.ndarray  # directions x units x labels
    b: np.ndarray  # labels
    t: np.ndarray  # labels x labels

    def run(self, codes: np.ndarray, keep: bool = False):
        """Scores of labels (windows x characters x labels)."""
        n, length = codes.shape
        units = self.u.shape[1]
        order = np.stack([codes, codes[:, ::-1]])
        h, c = np.zeros((2, n, units), np.float32), np.zeros((2, n, units), np.float32)
        hs, kept = np.empty((length, 2, n, units), np.float32), []
        for s in range(length):
            z = np.stack([self.x[0][order[0, :, s]], self.x[1][order[1, :, s]]]) + h @ self.u
            g = _sigmoid(z[..., : 3 * units])
            i, f, o, a = g[..., :units], g[..., units : 2 * units], g[..., 2 * units :], np.tanh(z[..., 3 * units :])
            before, was = c, h
            c = f * c + i * a
            tc = np.tanh(c)
            h = o * tc
            hs[s] = h
            if keep:
                kept.append((i, f, o, a, before, tc, was))
        scores = hs[:, 0] @ self.o[0] + hs[::-1, 1] @ self.o[1] + self.b
        return scores.transpose(1, 0, 2), hs, kept, order

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n, length = codes.shape
        e, hs, kept, order = self.run(codes, True)
        alpha = np.empty((length, n, _LABELS), np.float32)
        alpha[0] = e[:, 0]
        for s in range(1, length):
            alpha[s] = e[:, s] + _lse(alpha[s - 1][:, :, None] + self.t, 1)
        z = _lse(alpha[-1], 1)
        beta = np.zeros((n, _LABELS), np.float32)
        de, dt = np.empty_like(e), np.zeros_like(self.t)
        for s in range(length - 1, -1, -1):
            de[:, s] = np.exp(alpha[s] + beta - z[:, None])
            if s:
                pair = alpha[s - 1][:, :, None] + self.t + (e[:, s] + beta)[:, None, :]
                dt += np.exp(pair - z[:, None, None]).sum(axis=0)
                beta = _lse(self.t + (e[:, s] + beta)[:, None, :], 2)
        rows = np.arange(n)[:, None]
        loss = float((z - np.take_along_axis(e, gold[..., None], 2).sum(axis=(1, 2)) - self.t[gold[:, :-1], gold[:, 1:]].sum(axis=1)).mean())
        de[rows, np.arange(length), gold] -= 1
        np.add.at(dt, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        de, dt = (de / n).astype(np.float32).transpose(1, 0, 2), dt / n
        do = np.stack([np.einsum("snu,snl->ul", hs[:, 0], de), np.einsum("snu,snl->ul", hs[::-1, 1], de)])
        dhs = np.stack([de @ self.o[0].T, (de @ self.o[1].T)[::-1]], axis=1)
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
        for s in range(length - 1, -1, -1):
            i, f, o, a, before, tc, was = kept[s]
            dh = dh + dhs[s]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=-1)
            du += was.transpose(0, 2, 1) @ dz
            for k in (0, 1):
                np.add.at(dx[k], order[k, :, s], dz[k])
            dh, dc = dz @ self.u.transpose(0, 2, 1), dc * f
        return loss, [dx, du, do, de.sum(axis=(0, 1)), dt.astype(np.float32)]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best labels of rows of scores (rows x characters x labels)."""
        n, length, _ = e.shape
        back = np.empty((length, n, _LABELS), np.int8)
        v = e[:, 0].copy()
        v[:, 2::2] -= 1e4
        for s in range(1, length):
            step = v[:, :, None] + self.t
            back[s] = step.argmax(axis=1)
            v = step.max(axis=1) + e[:, s]
        out = np.empty((n, length), np.int8)
        out[:, -1] = v.argmax(axis=1)
        for s in range(length - 1, 0, -1):
            out[:, s - 1] = back[s][np.arange(n), out[:, s]]
        return out


_TRAINED: dict[tuple, Tagger] = {}


def trained(**how) -> Tagger:
    """What ``train`` gives, once in a process."""
    key = tuple(sorted(how.items()))
    if key not in _TRAINED:
        _TRAINED[key] = train(**how)
    return _TRAINED[key]


def train(steps: int = 260, batch: int = 64, units: int = 12, seed: int = 11) -> Tagger:
    """The same model every time: data and start come from ``seed``."""
    rng, made = np.random.default_rng(seed), random.Random(seed)
    r = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    t = np.zeros((_LABELS, _LABELS), np.float32)
    for k in range(2, _LABELS, 2):  # inside follows begin or inside of its kind only
        t[:, k] = -1e4
        t[k - 1 : k + 1, k] = 0
    fixed = t < -1
    m = Tagger(r(2, _CHARS, 4 * units), r(2, units, 4 * units), r(2, units, _LABELS), np.zeros(_LABELS, np.float32), t)
    m.x[:, :, units : 2 * units] += 1
    params = [m.x, m.u, m.o, m.b, m.t]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        lines = [_line(made) for _ in range(batch)]
        codes = np.stack([_codes(x) for x, _ in lines])
        gold = np.zeros((batch, SPAN), np.int64)
        for i, (_, spans) in enumerate(lines):
            for k, a, b in spans:
                gold[i, a:b] = 2 + 2 * k
                gold[i, a] = 1 + 2 * k
        _, grads = m.gradients(codes, gold)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, first, second):
            g = np.clip(g, -1, 1)
            if p is m.t:
                g = np.where(fixed, 0, g)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return m


def _stretches(text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blend(m: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Scores of each whole stretch from its overlapping windows: each
    window counts more in its middle than at its rims."""
    windows, where, sizes = [], [], []
    for i, t in enumerate(texts):
        codes = np.full(max(SPAN, -(-len(t) // STEP) * STEP), PAD, np.int16)
        codes[: len(t)] = _codes(t)
        sizes.append(len(codes))
        for a in range(0, len(codes) - SPAN + 1, STEP):
            windows.append(codes[a : a + SPAN])
            where.append((i, a))
    out = [np.zeros((n, _LABELS), np.float32) for n in sizes]
    total = [np.zeros((n, 1), np.float32) for n in sizes]
    weight = np.minimum(np.arange(1, SPAN + 1), np.arange(SPAN, 0, -1)).astype(np.float32)[:, None]
    for k in range(0, len(windows), 1024):
        scores = m.run(np.stack(windows[k : k + 1024]))[0]
        for (i, a), e in zip(where[k : k + 1024], scores):
            out[i][a : a + SPAN] += e * weight
            total[i][a : a + SPAN] += weight
    return [(o / w)[: len(t)] for o, w, t in zip(out, total, texts)]


def find(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, stop, by rule) for each text, by kind and start."""
    bases = [base_spans(t) for t in texts]
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in _stretches(t)]
    places.sort(key=lambda p: p[2] - p[1])
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(places):
        stop, size = at, 0
        while stop < len(places) and (stop == at or stop - at < 256 and size < 200_000):
            size += places[stop][2] - places[stop][1]
            stop += 1
        part = places[at:stop]
        scores = _blend(model, [texts[i][a:b] for i, a, b in part])
        e = np.zeros((len(part), max(map(len, scores)), _LABELS), np.float32)
        for row, s in zip(e, scores):
            row[: len(s)] = s
            row[len(s) :, 1:] = -1e4
        for (i, a, _), labels, s in zip(part, model.decode(e), scores):
            labels = labels[: len(s)]
            for p in np.flatnonzero(labels % 2 == 1).tolist():
                q = p + 1
                while q < len(labels) and labels[q] == labels[p] + 1:
                    q += 1
                added[i].append(((int(labels[p]) - 1) // 2, a + p, a + q))
        at = stop
    out = []
    for text, base, more in zip(texts, bases, added):
        got = [(k, a, b, True) for k, a, b in base]
        taken = sorted((a, b) for _, a, b in base)
        for k, a, b in sorted(set(more), key=lambda s: s[1]):
            if not any(x < b and a < y for x, y in taken) and _sound(k, text[a:b]):
                got.append((k, a, b, False))
                taken.append((a, b))
        out.append(sorted(got))
    return out


_SPANS = "array<struct<kind: string, start: int, stop: int, base: boolean>>"


def detect(df: DataFrame, model: Tagger, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """``keep`` and ``spans``, all personal data in each whole text in code
    points, by kind and start; with ``redacted`` also ``redacted string``,
    the text with ``[KIND]`` in place of each (overlapping spans give one).

    Null and empty texts have no spans.  Repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 12 units: some 100 kB

    def run(_, texts: list[str]) -> list:
        found = find(texts, shared.value)
        flat = [s for f in found for s in f]
        struct = pa.StructArray.from_arrays([pa.array([KINDS[s[0]] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32()), pa.array([s[3] for s in flat], pa.bool_())], names=["kind", "start", "stop", "base"])
        made: list = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), struct)]
        if redacted:
            made.append(pa.array([_redact(t, f) for t, f in zip(texts, found)], pa.string()))
        return made

    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return map_texts(df, text, f"{kept}, spans {_SPANS}" + ", redacted string" * redacted, run, list(keep))


def _redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    parts, at = [], 0
    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by kind and the hash of the base spans, then all spans."""
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(k)))).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), show), ",")
    return found.select(*keep, *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", show), ",").alias("spans"))
