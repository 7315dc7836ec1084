"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

*Base spans* come from one pattern and one check for each kind, leftmost and without overlaps.

*The network* reads characters as classes. Two LSTMs, one in each direction, give every
character a score for each tag (outside; begin and inside of each kind), a linear-chain CRF
scores tag sequences. It is trained with numpy on labelled windows of two sorts: windows of a
bounded sample of documents with their base spans, and *drawn* ones, where spans in forms that
the patterns miss (national phone numbers, IPv6 and defanged addresses, spelled-out or
international e-mail addresses, cards in dots) and look-alikes that are none (dates, versions,
order numbers, prices, hashes) stand between words of those documents. So it finds such forms.

*Decoding.* Every kind needs a digit, an ``@`` or a spelled-out one; the characters around each of
these (merged) are regions, and a text without any has no region. A region is cut into windows that
overlap by half. Windows are scored independently; where they overlap, scores are averaged with
weights that fall towards a window's ends, and one Viterbi pass over the whole region reconciles
them. A decoded span is added if it touches no base span and its numbers can be such: Luhn's check
of 16 to 19 digits, 8 to 15 digits of a phone, parts of an address. Regions are scored in groups of
bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import pieces as taken
from papyrion.llm.shared import sampled

KINDS = ("email", "ip", "card", "phone")
#: Documents and characters of them that are fetched to learn from; windows used; passes; seed.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_WINDOWS, STEPS, SEED = 1500, 8_000_000, 1200, 700, 7
#: Drawn windows.
DRAWN = 6000
EMBED, HIDDEN, BATCH, RATE = 12, 24, 64, 0.02
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: Characters of regions that are scored together, and of a long region that are scored at once (a multiple of STRIDE).
SCORED = 1 << 15

Span = tuple[int, int, int]  # kind, start, end

# ---------------------------------------------------------------- base spans

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]| dot (?=[a-z])", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(text: str) -> bool:
    text = text.lstrip("0")
    return len(text) < 4 and int(text or "0") <= 255


def _valid(kind: int, text: str) -> bool:
    if kind == 1:
        return all(map(_part, text.split(".")))
    digits = _digits(text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    out: list[Span] = []
    at, used = text.find("@"), 0
    while at >= 0:  # the longest local part before each @ is where the leftmost match begins
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            out.append((0, start, used))
        at = text.find("@", max(at + 1, used))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += ((kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group()))
    return out


# ---------------------------------------------------------------- network

#: Classes of characters: outside of a text, digits, other letters, other characters; ASCII letters without case; marks.
_SINGLE = {c: 4 + k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz@.-+()_%:,/ \n=#\"[]{}")}
CLASSES = 4 + len(_SINGLE)
_ASCII = np.zeros(128, dtype=np.int8)
for _k in range(128):
    _c = chr(_k).lower()
    _ASCII[_k] = _SINGLE.get(_c, 1 if _c.isdigit() else 3)
TAGS = 1 + 2 * len(KINDS)


def encode(text: str) -> np.ndarray:
    """Classes of characters; 0 is what lies outside of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], 2).astype(np.int8)


def _tags(n: int, spans: list[Span], start: int) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if b > 0 and a < n:
            tags[max(a, 0) : b] = 2 + 2 * kind
            if a >= 0:
                tags[a] = 1 + 2 * kind
    return tags


def _allowed() -> np.ndarray:
    """Transitions that cannot be: inside a kind after anything but its beginning or inside."""
    bad = np.zeros((TAGS, TAGS))
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        bad[:, inside] = -1e4
        bad[inside - 1, inside] = bad[inside, inside] = 0
    return bad


FORBIDDEN = _allowed()
#: Scores of the first tag: nothing starts inside of a span.
START = np.where(FORBIDDEN.max(axis=0) < 0, 0, FORBIDDEN[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Parameters: embedding; for each direction input, recurrent weights and bias; output; transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"embed": draw(CLASSES, EMBED) * 2, "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            p |= {f"w{d}": draw(EMBED, 4 * HIDDEN), f"u{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        return cls(p)

    def _both(self, part: str) -> np.ndarray:
        """One parameter of both LSTMs: forwards, backwards."""
        return np.stack((self.p[f"{part}f"], self.p[f"{part}b"]))

    def _run(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States of both LSTMs over x (windows, time, embedding), side by side: (time, windows, 2 x hidden)."""
        n, t, _ = x.shape
        both, u = np.stack((x, x[:, ::-1])), self._both("u")
        pre = (both.reshape(2, n * t, -1) @ self._both("w") + self._both("c")[:, None]).reshape(2, n, t, -1)
        pre = np.ascontiguousarray(pre.transpose(2, 0, 1, 3))
        h, c = np.zeros((2, n, HIDDEN), x.dtype), np.zeros((2, n, HIDDEN), x.dtype)
        out, kept = np.empty((t, 2, n, HIDDEN), x.dtype), []
        for k in range(t):
            z = pre[k] + h @ u
            gates, new = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            before, c = c, f * c + i * new
            tc = np.tanh(c)
            h = o * tc
            out[k] = h
            if keep is not None:
                kept.append((i, f, o, new, before, tc))
        if keep is not None:
            keep |= {"both": both, "states": out, "steps": kept}
        return np.concatenate((out[:, 0], out[::-1, 1]), axis=2)

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(windows, time, tags)."""
        h = self._run(self.p["embed"][codes], keep)
        if keep is not None:
            keep["h"] = h
        return (h @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    # -- learning

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradient; forward and backward sums are scaled at each step."""
        keep: dict = {}
        e = self.emissions(codes, keep).astype(np.float64)
        n, t, _ = e.shape
        trans = self.p["trans"] + FORBIDDEN
        moves, top = np.exp(trans), e.max(axis=2)
        likely = np.exp(e - top[:, :, None]).transpose(1, 0, 2)
        alpha, beta, scale = np.empty((t, n, TAGS)), np.ones((t, n, TAGS)), np.empty((t, n, 1))
        for k in range(t):
            now = likely[k] * (alpha[k - 1] @ moves if k else 1)
            scale[k] = now.sum(axis=1, keepdims=True)
            alpha[k] = now / scale[k]
        for k in range(t - 2, -1, -1):
            beta[k] = (likely[k + 1] * beta[k + 1] / scale[k + 1]) @ moves.T
        z = np.log(scale).sum() + top.sum()
        de = (alpha * beta).transpose(1, 0, 2)
        pairs = moves * (alpha[:-1].reshape(-1, TAGS).T @ (likely[1:] * beta[1:] / scale[1:]).reshape(-1, TAGS))
        rows, time = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = e[rows, time, tags].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        de[rows, time, tags] -= 1
        np.add.at(pairs, (tags[:, :-1], tags[:, 1:]), -1)
        g = {"trans": (pairs / (n * t)).astype(np.float32)}
        d = (de.transpose(1, 0, 2) / (n * t)).astype(keep["h"].dtype)
        g["out"], g["bias"] = keep["h"].reshape(n * t, -1).T @ d.reshape(n * t, -1), d.sum(axis=(0, 1))
        self._back(g, codes, d @ self.p["out"].T, keep)
        return float((z - gold) / (n * t)), g

    def _back(self, g: dict, codes: np.ndarray, dh: np.ndarray, keep: dict) -> None:
        """Gradients of both LSTMs and the embedding from those of the states."""
        back, (t, n, _) = self._both("u").transpose(0, 2, 1), dh.shape
        dh = np.stack((dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]), axis=1)
        later = dc = np.zeros_like(dh[0])
        dz = np.empty((t, 2, n, 4 * HIDDEN), dh.dtype)
        for k in range(t - 1, -1, -1):
            i, f, o, new, before, tc = keep["steps"][k]
            now = dh[k] + later
            dc = dc + now * o * (1 - tc * tc)
            dz[k] = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), now * tc * o * (1 - o), dc * i * (1 - new * new)), axis=2)
            later, dc = dz[k] @ back, dc * f
        last = np.concatenate((np.zeros_like(dh[:1]), keep["states"][:-1]))
        flat = lambda m: m.transpose(1, 2, 0, 3).reshape(2, n * t, -1)
        dz, last = flat(dz), flat(last)
        gu, gw, gc = last.transpose(0, 2, 1) @ dz, keep["both"].reshape(2, n * t, -1).transpose(0, 2, 1) @ dz, dz.sum(axis=1)
        for k, d in enumerate("fb"):
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = gu[k], gw[k], gc[k]
        dx = (dz @ self._both("w").transpose(0, 2, 1)).reshape(2, n, t, -1)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], codes, dx[0] + dx[1][:, ::-1])

    def learn(self, codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = SEED) -> float:
        """Adam with a falling rate; returns the last loss."""
        rng = np.random.default_rng(seed)
        m, v, loss = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), min(BATCH, len(codes)))
            loss, g = self.gradient(codes[pick], tags[pick])
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    # -- decoding

    def _averaged(self, some: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
        """Emissions of stretches (region, from a multiple of STRIDE, to), averaged where windows overlap."""
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        sums, mass = [np.zeros((b - a, TAGS), np.float32) for _, a, b in some], [np.zeros((b - a, 1), np.float32) for _, a, b in some]
        where = [(r, s) for r, (codes, a, b) in enumerate(some) for s in range(max(0, a - STRIDE), min(b, max(1, len(codes) - STRIDE)), STRIDE)]
        for at in range(0, len(where), 1024):
            part = where[at : at + 1024]
            codes = np.zeros((len(part), WINDOW), dtype=np.int64)
            for k, (r, s) in enumerate(part):
                own = some[r][0][s : s + WINDOW]
                codes[k, : len(own)] = own
            for (r, s), e in zip(part, self.emissions(codes), strict=True):
                _, a, b = some[r]
                first, last = max(s, a), min(s + WINDOW, b)
                sums[r][first - a : last - a] += (weight * e)[first - s : last - s]
                mass[r][first - a : last - a] += weight[first - s : last - s]
        return [s / m for s, m in zip(sums, mass, strict=True)]

    def _best(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of regions, in falling order of length, side by side."""
        n, lengths = len(emissions), np.array([len(e) for e in emissions])
        e = np.zeros((n, int(lengths.max(initial=0)), TAGS), np.float32)
        for r, x in enumerate(emissions):
            e[r, : len(x)] = x
        trans, back = (self.p["trans"] + FORBIDDEN).astype(np.float32), np.zeros((e.shape[1], n, TAGS), dtype=np.int8)
        best, path = e[:, 0] + START, np.zeros(e.shape[:2], dtype=np.int8)
        for k in range(1, e.shape[1]):
            m = int((lengths > k).sum())
            steps = best[:m, :, None] + trans
            back[k, :m], best[:m] = steps.argmax(axis=1), steps.max(axis=1) + e[:m, k]
        tag = best.argmax(axis=1)
        for k in range(e.shape[1] - 1, -1, -1):
            m = int((lengths > k).sum())
            path[:m, k] = tag[:m]
            tag[:m] = back[k, np.arange(m), tag[:m]]
        return [path[r, :length] for r, length in enumerate(lengths.tolist())]

    def _best_of_long(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of one long region: a stretch of emissions at a time, and one byte for each tag and character."""
        trans, back = (self.p["trans"] + FORBIDDEN).astype(np.float32), np.zeros((len(codes), TAGS), dtype=np.int8)
        best, own = START.astype(np.float32), np.arange(TAGS)
        for a in range(0, len(codes), SCORED):
            for k, e in enumerate(self._averaged([(codes, a, min(a + SCORED, len(codes)))])[0], a):
                if k:
                    steps = best[:, None] + trans
                    back[k] = steps.argmax(axis=0)
                    best = steps[back[k], own]
                best = best + e
        path, tag = np.zeros(len(codes), dtype=np.int8), int(best.argmax())
        for k in range(len(codes) - 1, -1, -1):
            path[k] = tag
            tag = back[k, tag]
        return path

    def decode(self, regions: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of each region, from overlapping windows reconciled over the whole region; in groups of SCORED characters."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(regions)
        order = sorted((k for k in range(len(regions)) if len(regions[k])), key=lambda k: -len(regions[k]))
        while order and len(regions[order[0]]) > SCORED:
            out[order[0]] = self._best_of_long(regions[order[0]])
            order = order[1:]
        at = 0
        while at < len(order):
            some = order[at : at + max(1, SCORED // len(regions[order[at]]))]
            for k, tags in zip(some, self._best(self._averaged([(regions[k], 0, len(regions[k])) for k in some])), strict=True):
                out[k] = tags
            at += len(some)
        return out


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all digits and @."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans_of(tags: np.ndarray) -> Iterator[Span]:
    start, kind = -1, -1
    for k, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (t == 0 or t % 2 == 1 or (t - 2) // 2 != kind):
            yield kind, start, k
            start = -1
        if t and t % 2 == 1:
            start, kind = k, (t - 1) // 2


def _plausible(kind: int, text: str) -> bool:
    """Whether the numbers of a decoded span can be such: parts of an address, Luhn's check, a phone's digits."""
    if kind == 1 and ":" in text:
        groups = text.split(":")
        return 3 <= len(groups) <= 8 and all(len(g) <= 4 and all(c in "0123456789abcdefABCDEF" for c in g) for g in groups)
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_part, parts))
    return kind == 0 or _valid(kind, text)


def find(texts: list[str], network: Network | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, both by kind, then start."""
    found, where, codes = [], [], []
    for k, text in enumerate(texts):
        if not _TRIGGER.search(text):
            found.append(([], []))
            continue
        found.append((base_spans(text), []))
        if network is not None:
            for a, b in regions(text):
                where.append((k, a))
                codes.append(encode(text[a:b]))
    added: dict[int, list[Span]] = {}
    if codes:
        for (k, a), tags in zip(where, network.decode(codes), strict=True):
            for kind, s, e in _spans_of(tags):
                s, e = s + a, e + a
                part = texts[k][s:e]
                free = all(e <= x or s >= y for _, x, y in found[k][0])
                if free and _plausible(kind, part):
                    added.setdefault(k, []).append((kind, s, e))
    return [(base, sorted(base + added.get(k, []))) for k, (base, _) in enumerate(found)]


# ---------------------------------------------------------------- drawn spans

#: Words that may stand before what is personal and before what is not.
CUES = (
    ("email", "e-mail:", "mail to", "write to", "contact", "send it to", "reach me at", "by", ""),
    ("from", "ip", "address", "host", "server", "client", "login from", "at", ""),
    ("card", "credit card:", "paid with", "visa", "number", "card no.", "charge", ""),
    ("call", "tel.", "phone:", "telephone", "mobile", "fax", "ring", "number", "call me at", "dial", ""),
)
NO_CUES = ("on", "order", "version", "since", "page", "total", "item", "no.", "in", "id", "costs", "invoice", "isbn", "release", "at", "of", "commit", "lot", "ref", "")
_ENDS = ("com", "org", "net", "de", "fr", "co.uk", "info", "edu", "io")
_FOREIGN = "äöüéèßñçøåœ"


class _Draw:
    """Labelled spans in forms that the patterns miss or have, and look-alikes that are none."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def below(self, n: int) -> int:
        return int(self.rng.integers(n))

    def one(self, values):
        return values[self.below(len(values))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n).tolist()))

    def name(self, foreign: bool = False) -> str:
        letters = [self.one("bcdfghjklmnprstvwz") + self.one("aeiou") + self.one(("", "", "n", "r", "s", "l")) for _ in range(1 + self.below(3))]
        word = "".join(letters)
        if foreign:
            at = self.below(len(word))
            word = word[:at] + self.one(_FOREIGN) + word[at + 1 :]
        return word.capitalize() if self.below(4) == 0 else word

    def email(self) -> str:
        local = self.name() + self.one(("", "", ".", "_", "-")) * 1
        local = local + self.name() if local[-1] in "._-" else local + self.one(("", "", self.digits(2)))
        host, end = self.name().lower(), self.one(_ENDS)
        form = self.below(8)
        if form == 0:
            return f"{local}@{host}.{end}"
        if form == 1:
            return f"{self.name(True)}@{self.one((host, self.name(True).lower()))}.{end}"
        if form == 2:
            return f"{local}@{self.name(True).lower()}.{end}"
        if form == 3:
            return f"{local} @ {host}.{end}"
        a, d = self.one(((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", "."), (" AT ", " DOT ")))
        return f"{local}{a}{host}{d}{end.replace('.', d)}"

    def ip(self) -> str:
        parts = [str(self.below(256)) for _ in range(4)]
        form = self.below(6)
        if form == 0:
            return ".".join(parts)
        if form == 1:
            return self.one(("[.]", "(.)", " . ", "[dot]", "-")).join(parts)
        if form == 2:
            return ".".join(parts[:3]) + self.one(("[.]", "(.)")) + parts[3]
        group = lambda: f"{self.below(1 << 16):x}"
        if form == 3:
            return ":".join(group() for _ in range(8))
        head, tail = [group() for _ in range(1 + self.below(4))], [group() for _ in range(self.below(3))]
        return ":".join(head) + "::" + ":".join(tail)

    def card(self) -> str:
        body = self.one("3456") + self.digits(14 + self.below(3))
        body += next(d for d in "0123456789" if _luhn(body + d))
        sep = self.one((" ", "-", ".", ".", "/", "  ", "_", " - ", "\u00a0", ""))
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone(self) -> str:
        area, two, three, four = (self.digits(n) for n in (3, 2, 3, 4))
        form = self.below(12)
        if form == 0:
            return f"+{1 + self.below(98)} {self.one((f'({area})', area))} {three}{self.one(' -')}{four}"
        if form in (1, 2):
            return f"({area}){self.one((' ', '', '-'))}{three}{self.one(('-', ' ', '.'))}{four}"
        if form in (3, 4):
            return f"00{1 + self.below(9)}{self.one('0123456789')} {two} {four} {self.one((four, three + two))}"
        if form in (5, 6):
            return self.one("-. ").join((f"{2 + self.below(8)}{two}", three, four))
        if form == 7:
            return f"0{two}{self.one((' ', '/', '-', ' / '))}{three}{self.one(('', ' '))}{four}"
        if form == 8:
            return f"1{self.one('-. ')}{area}{self.one('-. ')}{three}{self.one('-. ')}{four}"
        if form == 9:
            return " ".join(("0" + self.one("1234567"), *(self.digits(2) for _ in range(4))))
        if form == 10:
            return f"({self.one(('0', ''))}{area}) {three}{self.one((' ', ''))}{self.digits(3 + self.below(3))}"
        return f"0{self.digits(3)}{self.one((' ', '/', '-'))}{self.digits(6 + self.below(2))}"

    def other(self) -> str:
        n = lambda k: str(self.below(k))
        form = self.below(22)
        forms = (
            lambda: f"{1900 + self.below(130)}-{1 + self.below(12):02}-{1 + self.below(28):02}", lambda: f"{1 + self.below(28)}.{1 + self.below(12)}.{1990 + self.below(40)}", lambda: f"{1 + self.below(12)}/{1 + self.below(28)}/{1990 + self.below(40)}",
            lambda: f"{self.below(24):02}:{self.below(60):02}" + self.one(("", f":{self.below(60):02}")), lambda: ".".join(n(30) for _ in range(2 + self.below(2))), lambda: f"v{n(9)}.{n(20)}.{n(20)}-rc{n(9)}",
            lambda: f"{1 + self.below(900)},{self.digits(3)}" + self.one(("", ".50", ",000")), lambda: f"${n(900)}.{self.digits(2)}", lambda: self.digits(1 + self.below(7)), lambda: self.digits(9 + self.below(12)),
            lambda: f"978-{n(9)}-{self.digits(2)}-{self.digits(6)}-{n(9)}", lambda: "".join(self.one("0123456789abcdef") for _ in range(self.one((8, 32, 40)))), lambda: f"{1900 + self.below(120)}-{1900 + self.below(120)}", lambda: "@" + self.name().lower(),
            lambda: f"{n(100)} {n(100)} {n(100)} {n(1000)}", lambda: ", ".join(n(1000) for _ in range(3 + self.below(3))), lambda: f"{self.name()}{self.digits(2)}", lambda: f"#{self.digits(3 + self.below(5))}", lambda: f"{n(100)}.{self.digits(2 + self.below(6))}",
            lambda: f"{self.name().upper()}-{self.digits(4)}-{self.digits(4)}", lambda: f"{n(50)} @ {n(9)}.{self.digits(2)}", lambda: ":".join("".join(self.one("0123456789abcdef") for _ in range(2)) for _ in range(6)),
        )
        return forms[form]()

    def window(self, words: list[str]) -> tuple[str, list[Span]]:
        """A window of text with drawn spans between words."""
        text, spans = "", []
        for _ in range(1 + self.below(2)):
            text += " ".join(self.one(words) for _ in range(self.below(7))) + " "
            kind = self.below(10)
            if kind < 6:
                kind = (0, 0, 1, 2, 3, 3)[kind]
                value, cue = (self.email, self.ip, self.card, self.phone)[kind](), self.one(CUES[kind])
            else:
                kind, value, cue = -1, self.other(), self.one(NO_CUES)
            text += (cue.capitalize() if self.below(5) == 0 else cue) + " " * bool(cue) + self.one(("", "", "", "(", "\"", "<", "["))
            if kind >= 0:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + self.one(("", "", ",", ".", ")", ";", "\"", ">", "\n")) + " "
        text += " ".join(self.one(words) for _ in range(6))
        # a look-alike that the patterns take is a base span all the same
        spans += [b for b in base_spans(text) if all(b[2] <= x or b[1] >= y for _, x, y in spans)]
        cut = self.below(max(1, min(len(text) - WINDOW + 1, spans[0][1] + 1 if spans else 24)))
        return text[cut : cut + WINDOW], [(k, a - cut, b - cut) for k, a, b in spans]


def drawn(texts: list[str], n: int = DRAWN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of n drawn windows, between words of the texts."""
    draw = _Draw(seed)
    words = [w for t in texts[:400] for w in t[:4000].split() if not _TRIGGER.search(w)] or ["the", "a", "word"]
    codes, tags = np.zeros((n, WINDOW), dtype=np.int64), np.zeros((n, WINDOW), dtype=np.int64)
    for k in range(n):
        text, spans = draw.window(words)
        codes[k, : len(text)], tags[k, : len(text)] = encode(text), _tags(len(text), spans, 0)
    return codes, tags


# ---------------------------------------------------------------- Spark


def windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of at most ``most`` windows around the base spans and other digits of texts.

    Each kind of span and the other digits get even shares of the windows; what one can't fill goes
    to the rest. Of a share every text gives one window before any gives a second, by a hash.
    """
    drawn: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(KINDS) + 1)]  # round, hash, text, position
    spans_of = []
    for k, text in enumerate(texts):
        spans = base_spans(text)
        spans_of.append((by_start := sorted(spans, key=lambda s: s[1]), [s for _, s, _ in by_start], [e for *_, e in by_start]))
        own = zlib.crc32(text.encode("utf-8", "surrogatepass"), seed)
        key = lambda at: (zlib.crc32(at.to_bytes(8, "little"), own), at)  # noqa: B023, E731
        inside = [(s, e) for _, s, e in by_start]
        for kind, rows in enumerate(drawn):
            places = (s for c, s, _ in spans if c == kind) if kind < len(KINDS) else _outside(text, inside)
            rows += [(n, h, k, at) for n, (h, at) in enumerate(heapq.nsmallest(most, map(key, places)))]
            if len(rows) > 4 * most:
                rows[:] = heapq.nsmallest(most, rows)
    left, chosen = most, []
    for n, rows in enumerate(sorted(drawn, key=len)):
        chosen += heapq.nsmallest(left // (len(drawn) - n), rows)
        left = most - len(chosen)
    codes, tags = np.zeros((len(chosen), WINDOW), dtype=np.int64), np.zeros((len(chosen), WINDOW), dtype=np.int64)
    for n, (_, h, k, at) in enumerate(chosen):
        start = max(0, at - 8 - h % (WINDOW - 24))
        part = texts[k][start : start + WINDOW]
        spans, starts, ends = spans_of[k]
        codes[n, : len(part)], tags[n, : len(part)] = encode(part), _tags(len(part), spans[bisect_right(ends, start) : bisect_left(starts, start + WINDOW)], start)
    return codes, tags


def _outside(text: str, spans: list[tuple[int, int]]) -> Iterator[int]:
    """Where words go on from a digit or @ that is in none of the spans, which are in order."""
    n = 0
    for m in re.finditer(r"[0-9@]\S*", text):
        while n < len(spans) and spans[n][1] <= m.start():
            n += 1
        if n == len(spans) or m.start() < spans[n][0]:
            yield m.start()


def _only_begun(tags: np.ndarray) -> np.ndarray:
    """Windows that start inside a span would need a beginning; these count as outside."""
    tags = tags.copy()
    for row in tags:
        k = 0
        while k < len(row) and row[k] and row[k] % 2 == 0:
            row[k] = 0
            k += 1
    return tags


def train(docs: DataFrame) -> Network:
    """A network from drawn windows and those of at most TRAIN_ROWS distinct texts with a digit or @ (TRAIN_CHARS characters together)."""
    texts = docs.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    return trained([r["text"] for r, _ in sampled(texts, TRAIN_ROWS, TRAIN_CHARS)])


def trained(texts: list[str]) -> Network:
    """A network from windows of the texts and drawn ones; the same texts give the same network."""
    (codes, tags), (more, of_more) = windows(texts), drawn(texts)
    network = Network.fresh()
    network.learn(np.concatenate((codes, more)), _only_begun(np.concatenate((tags, of_more))))
    return network


def _write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        for batch in taken(batches):
            found = find([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == k for s in spans) for _, spans in found], pa.int64()) for k in range(len(KINDS))]
            base = pa.array([hashlib.sha256(_write(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array([_write(s) for _, s in found], pa.string())], names=names)

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (all spans), base_sha256, spans.

    ``docs`` needs doc_id and text; other columns are not read. Null texts count as empty;
    repeated rows and null ids come out each; an empty table gives an empty result. Very long
    texts are read whole, regions in stretches. Positions are code points, ends exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # a few thousand parameters
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_find(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"[{KINDS[kind].upper()}]")
            at = b
    return "".join((*out, text[at:]))
