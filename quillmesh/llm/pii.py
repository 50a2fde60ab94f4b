"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds to them.

The field scores whole candidate segments (digit groups, separators, checksums, context words),
and dynamic programming over segments of bounded length chooses boundaries and types
together.  A segment holds a digit or an ``@``, so only the neighbourhoods of such characters are
decoded; the rest of a text cannot hold one.  The field is trained on generated sentences
(fixed seed) with the maximum of conditional likelihood.  It finds
what the patterns do not: phone numbers without a plus sign, cards with other separators and
addresses with letters outside ASCII.

Texts are worked on where they are read; nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices

# The kinds in order, and the base patterns.  The email pattern is looked for
# from its @ on, and the address part before it is taken from the left.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Tokens that a segment has at most.
MAX_TOKENS = 24
_TOKENS = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_GAP = re.compile(r"\s")
_NEXT = re.compile(r"[ \t]+([^\s]+)")
_LEFT_WORD = re.compile(r"([^\W\d_]+)[\s:.]*\Z")
_MARK = re.compile(r"[0-9@]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns by start and kind, as (start, end, kind).

    Each pattern is applied leftmost and without overlap; a match that fails its check is dropped.
    """
    out: list[tuple[int, int, int]] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if len(m[0]) <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _segment_features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    out = ["bias", f"digits={min(n, 20)}", f"groups={min(len(groups), 6)}"]
    if "@" not in s and len(groups) <= 8:
        out.append("shape=" + "-".join(str(min(len(g), 20)) for g in groups))
    if "@" in s:
        local, _, domain = s.partition("@")
        out += [f"at={s.count('@')}", f"dots={min(domain.count('.'), 3)}", f"local={bool(local)}", f"tail={bool(re.search(r'[.][^\W\d_]{2,}$', domain))}"]
    else:
        marks = {c for c in s if not c.isalnum()}
        out += [f"mark={c}" for c in "+-.()/:," if c in marks]
        if any(c.isspace() for c in marks):
            out.append("mark=space")
        if any(c not in " -.()+" for c in marks):
            out.append("mark=other")
        if any(not c.isdigit() and c.isalnum() for c in s):
            out.append("letters")
        if s.count("(") != s.count(")"):
            out.append("unbalanced")
        if 12 <= n <= 19 and luhn("".join(groups)):
            out.append("luhn")
        if len(groups) == 4 and len(s) == n + 3 and s.count(".") == 3 and all(int(g[:9]) <= 255 for g in groups):
            out.append("quad")
    out.append("start=" + ("digit" if s[0].isdigit() else "alpha" if s[0].isalpha() else s[0]))
    before, after = text[a - 1 : a], text[b : b + 1]
    out.append("left=" + ("end" if not before else "space" if before.isspace() else "alnum" if before.isalnum() else "mark"))
    follow = text[b + 1 : b + 2]
    out.append("right=" + ("end" if not after else "space" if after.isspace() else "alnum" if after.isalnum() else "joined" if follow.isalnum() else "mark"))
    if m := _LEFT_WORD.search(text[max(0, a - 16) : a]):
        out.append("word=" + m[1].lower())
    return out


def _kinds_of(s: str) -> tuple[int, ...]:
    """The kinds that a segment can have at all; none for most."""
    if "@" in s:
        return (0,) if s.count("@") == 1 and not any(c.isspace() for c in s) else ()
    n = sum("0" <= c <= "9" for c in s)
    if n < 4 or n > 19 or any(c.isalpha() for c in s):
        return ()
    return (1, 2, 3) if s.count("(") <= 1 else ()


def _lattice(text: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, tuple[int, ...], list[str]]]]]:
    """Token bounds; and for each end token the segments (first token, end, kinds, features)."""
    tokens = [m.span() for m in _TOKENS.finditer(text)]
    ends: list[list] = [[] for _ in range(len(tokens) + 1)]
    for i, (a, _) in enumerate(tokens):
        if text[a].isspace() or not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if text[tokens[j][0]] == "\n":
                break
            b = tokens[j][1]
            if not text[b - 1].isalnum():
                continue
            s = text[a:b]
            if kinds := _kinds_of(s):
                ends[j + 1].append((i, j + 1, kinds, _segment_features(text, a, b)))
    return tokens, ends


class SemiMarkov:
    """Weights of (feature, kind); a token outside every segment scores by its class."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.outside: dict[str, float] = defaultdict(float)

    @staticmethod
    def token_class(text: str, a: int) -> str:
        c = text[a]
        return "digit" if c.isdigit() else "alpha" if c.isalpha() else "space" if c.isspace() else "mark"

    def _score(self, features: list[str], kinds: tuple[int, ...]) -> list[float]:
        rows = [self.index[f] for f in features if f in self.index]
        total = self.weights[rows].sum(axis=0)
        return [float(total[k]) for k in kinds]

    def decode(self, text: str) -> list[tuple[int, int, int, float]]:
        """Best segmentation: (start, end, kind, score against the same tokens outside)."""
        tokens, ends = _lattice(text)
        outside = [self.outside[self.token_class(text, a)] for a, _ in tokens]
        before = np.concatenate(([0.0], np.cumsum(outside)))
        best = [0.0] * (len(tokens) + 1)
        back: list = [None] * (len(tokens) + 1)
        for e in range(1, len(tokens) + 1):
            best[e] = best[e - 1] + outside[e - 1]
            for i, _, kinds, features in ends[e]:
                for k, value in zip(kinds, self._score(features, kinds), strict=True):
                    if best[i] + value > best[e]:
                        best[e], back[e] = best[i] + value, (i, k, value - float(before[e] - before[i]))
        out, e = [], len(tokens)
        while e > 0:
            if back[e] is None:
                e -= 1
            else:
                i, k, margin = back[e]
                out.append((tokens[i][0], tokens[e - 1][1], k, margin))
                e = i
        return out[::-1]

    def fit(self, data: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.2, l2: float = 1e-4) -> SemiMarkov:
        """Stochastic gradient ascent on the conditional log-likelihood, with forward and backward sums over segments."""
        lattices = []
        for text, gold in data:
            tokens, ends = _lattice(text)
            for segments in ends:
                for *_, features in segments:
                    for f in features:
                        self.index.setdefault(f, len(self.index))
            lattices.append((text, tokens, ends, {(a, b): k for a, b, k in gold}))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        order = random.Random(3)
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            order.shuffle(lattices)
            for text, tokens, ends, gold in lattices:
                self._update(text, tokens, ends, gold, step)
            self.weights *= 1 - l2
        return self

    def _update(self, text, tokens, ends, gold, step) -> None:
        n = len(tokens)
        classes = [self.token_class(text, a) for a, _ in tokens]
        outside = [self.outside[c] for c in classes]
        scored = [[(i, kinds, f, self._score(f, kinds)) for i, _, kinds, f in segments] for segments in ends]
        forward = [0.0] + [-math.inf] * n
        for e in range(1, n + 1):
            terms = [forward[e - 1] + outside[e - 1], *(forward[i] + v for i, _, _, values in scored[e] for v in values)]
            top = max(terms)
            forward[e] = top + math.log(sum(math.exp(t - top) for t in terms))
        backward = [[] for _ in range(n + 1)]
        backward[n] = [0.0]
        beta = [0.0] * (n + 1)
        for e in range(n, 0, -1):
            top = max(backward[e])
            beta[e] = top + math.log(sum(math.exp(t - top) for t in backward[e]))
            backward[e - 1].append(beta[e] + outside[e - 1])
            for i, _, _, values in scored[e]:
                backward[i] += [beta[e] + v for v in values]
        inside = {t for (a, b), _ in gold.items() for t in range(n) if a <= tokens[t][0] < b}
        for e in range(1, n + 1):
            p = math.exp(forward[e - 1] + outside[e - 1] + beta[e] - forward[n])
            self.outside[classes[e - 1]] += step * ((e - 1 not in inside) - p)
            for i, kinds, features, values in scored[e]:
                key = (tokens[i][0], tokens[e - 1][1])
                for k, v in zip(kinds, values, strict=True):
                    d = (gold.get(key) == k) - math.exp(forward[i] + v + beta[e] - forward[n])
                    if abs(d) > 1e-6:
                        self.weights[[self.index[f] for f in features], k] += step * d


def training_sentences(count: int = 700, seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their segments; half of the numbers in them are not personal data."""
    r = random.Random(seed)
    syllables = "an be co di en fo ga he in lo me na or pe qui ra st tion un ver wi é ñ ü".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(separator: str) -> str:
        d = r.choice("3456") + number(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return separator.join(d[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, int]:
        k = r.randint(0, 3)
        if k == 0:
            local = r.choice([word(), f"{word()}.{word()}", f"{word()}{number(2)}"])
            return f"{local}@{word()}{r.choice(['', number(1)])}.{r.choice(['example.com', 'org', 'net', 'co.uk'])}", 0
        if k == 1:
            return ".".join(str(r.randint(0, 255)) for _ in range(4)), 1
        if k == 2:
            return card(r.choice(["", " ", "-", ".", "  "])), 2
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {number(3)} {number(6)}"]), 3

    def other() -> str:
        return r.choice([
            number(r.randint(1, 6)), f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/20{number(2)}",
            f"{number(1)}.{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", f"{number(2)}:{number(2)}", f"{number(16)}", f"{number(9)}",
            f"{number(3)},{number(3)}", f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}", f"{number(4)}-{number(4)}",
            f"300.{number(3)}.{number(1)}.4", f"v{number(1)}.{number(1)}", f"{word()}@{word()}", f"@{word()}{number(2)}", f"{number(4)} {number(4)}",
            f"{word()}={number(3)}{word()}{number(8)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(3)}-{number(2)}-{number(3)}",
            f"{number(2)} {number(2)} {number(2)}", f"({number(4)})", f"{number(13)}", f"{number(4)} {number(4)} {number(4)} {number(4)}",
        ])

    out = []
    for _ in range(count):
        text, gold = "", []
        for _ in range(r.randint(2, 7)):
            x = r.random()
            piece, kind = entity() if x < 0.3 else (other() if x < 0.6 else word(), None)
            if kind is not None:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece + r.choice([" ", " ", " ", ", ", ". ", "\n"])
        out.append((text, gold))
    return out


@functools.cache
def trained() -> SemiMarkov:
    return SemiMarkov().fit(training_sentences())


def regions(text: str) -> list[tuple[int, int]]:
    """Bounds of the words with a digit or an @, those in a row together; one pass over the text."""
    out: list[tuple[int, int]] = []
    last = 0
    while m := _MARK.search(text, last):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        gap = _GAP.search(text, m.start())
        end = gap.start() if gap else len(text)
        while (following := _NEXT.match(text, end)) and _MARK.search(following[1]):
            end = following.end()
        out.append((start, end))
        last = end
    return out


#: A segment is added if it beats its tokens outside all segments by so much (log odds).
MARGIN = 2.0


def added_spans(text: str, base: list[Span], field: SemiMarkov) -> list[Span]:
    """Segments of the field that no base span overlaps."""
    out: list[Span] = []
    known = sorted((s, e) for s, e, _ in base)
    at = 0
    for start, end in regions(text):
        while at < len(known) and known[at][1] <= start:
            at += 1
        inside = [k for k in known[at : at + 1 + MAX_TOKENS] if k[0] < end]
        if not _marks_left(text, start, end, inside):
            continue  # base spans are all there is
        low = max(0, start - 16)
        for a, b, k, margin in field.decode(text[low : end + 2]):
            a, b = a + low, b + low
            if margin >= MARGIN and a >= start and b <= end and not _meets(known, a, b):
                out.append((a, b, KINDS[k]))
    return out


def _marks_left(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a digit or an @ between the bounds is outside all spans (by start); every segment holds one."""
    at = start
    for s, e in spans:
        if s > at and _MARK.search(text, at, min(s, end)):
            return True
        at = max(at, e)
    return at < end and _MARK.search(text, at, end) is not None


def _meets(known: list[tuple[int, int]], a: int, b: int) -> bool:
    i = bisect_left(known, (b, -1))
    return any(e > a for _, e in known[max(0, i - 4) : i])


FOUND = "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def spans_of(text: str | None, field: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by start and kind."""
    if not text or not _MARK.search(text):
        return [], []
    base = base_spans(text)
    both = base + added_spans(text, base, field)
    return base, sorted(both, key=lambda x: (x[0], KINDS.index(x[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SemiMarkov | None = None) -> DataFrame:
    """One row per document row: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    The counts and the digest are those of the base patterns; ``spans`` lists these and the
    field's segments as ``kind:start:end`` in code points.  NULL and empty texts have none.
    Repeated rows are judged one by one; other columns are not read.
    """
    field = field or trained()

    def work(idents, texts):
        out = []
        for ident, text in zip(idents, texts, strict=True):
            base, both = spans_of(text, field)
            kinds = [k for *_, k in base]
            out.append((ident, *map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both)))
        return zip(*out, strict=True)

    return map_slices(docs.select(F.col(id_col).cast("bigint"), text_col), work, FOUND)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first to start counts."""
    out, last = [], 0
    for s, e, k in spans:
        if s >= last:
            out += [text[last:s], f"[{k.upper()}]"]
            last = e
        elif e > last:
            last = e
    return "".join([*out, text[last:]])


def mask_pii(docs: DataFrame, text_col: str = "text", field: SemiMarkov | None = None) -> DataFrame:
    """The input with every span in ``text_col`` replaced by its kind, such as ``[EMAIL]``.  All columns stay."""
    field = field or trained()
    at = docs.columns.index(text_col)

    def work(*columns):
        masked = [t if t is None else mask(t, spans_of(t, field)[1]) for t in columns[at]]
        return [*columns[:at], masked, *columns[at + 1 :]]

    return map_slices(docs, work, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
