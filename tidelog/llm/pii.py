"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

Patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers (see `base_spans`). The tagger is trained in numpy
on windows with labelled spans: what the patterns find in a bounded sample of documents (the first 20 spans of each), those windows with spans written in
other ways (without a plus sign, with "(at)" and "dot", with other separators), and numbers that aren't personal data.
It is applied to overlapping windows around every place that can be part of such a span (a digit, "@", or "at" in brackets
or before a domain, in any case) and the whole run of an address around it, decoded by Viterbi; a character takes its tag from the window in whose middle it lies best, and spans are read from the reconciled tags
of the whole text. An added span must be of a plausible form for its kind and must not touch a span that the patterns found.

Defined cases: null text is empty; an empty text has no span; repeated rows give repeated result rows; an empty table gives an
empty result; without any training window the patterns work alone; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, mapped

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never begins within a run of digits: an earlier start would match as well
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
_AT = r"[(\[] ?at ?[)\]]"
_DOT = r"(?:\.|[(\[] ?dot ?[)\]]| dot )"
#: What every plausible span holds: a digit, "@", or "at" in brackets or as a word before a domain, in any case.
TRIGGER = re.compile(rf"[0-9@]+|{_AT}| at (?= ?[a-z0-9-]+ ?{_DOT} ?[a-z0-9-])", re.IGNORECASE | re.ASCII)
_TAIL = re.compile(rf" ?[a-z0-9-]+(?: ?{_DOT} ?[a-z0-9-]+)*", re.IGNORECASE | re.ASCII)
LONGEST = 320  # characters of an address: 64 before the "@", 255 after it


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches: per kind leftmost and non-overlapping, failing ones dropped; by start, then kind."""
    found = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def rendered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# Character classes: the letters of "at" and "dot", digits, "@", marks that such spans hold, letters by case, white space, others.
_OWN = "@._%+-()/,:;'\"[]{}<>#=*&"
_LETTERS = "adot"  # in any case: the tagger has to tell "at" and "dot" from other words
CLASSES = len(_OWN) + 6 + len(_LETTERS)
EMAIL_TAGS = (1 + 2 * KINDS.index("email"), 2 + 2 * KINDS.index("email"))
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2 k: first character of a span of kind k; 2 + 2 k: a later one


def classes_of(text: str):
    """The class of every character."""
    import numpy as np

    table = np.full(0x250, len(_OWN) + 5, np.int64)
    for c in range(0x250):
        s = chr(c)
        table[c] = _OWN.index(s) if s in _OWN else len(_OWN) + (0 if s.isdigit() else 1 if s.islower() else 2 if s.isupper() else 3 if s == " " else 4 if s.isspace() else 5)
    for n, c in enumerate(_LETTERS):
        table[[ord(c), ord(c.upper())]] = len(_OWN) + 6 + n
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return table[np.minimum(codes, 0x24F)]


class Tagger:
    """One LSTM in each direction over character classes, a linear layer, and a CRF over the tags."""

    def __init__(self, hidden: int = 16, window: int = 64, seed: int = 3):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.hidden, self.window = hidden, window
        self.p = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.p["h" + side] = rng.normal(0, 0.3 / hidden**0.5 * 2, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1
            self.p["c" + side] = bias
        self.p["o"] = rng.normal(0, 0.2, (2 * hidden, TAGS))
        self.p["ob"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS + 1, TAGS))  # the last row: from the window's start

    @staticmethod
    def _legal():
        """-inf where a later character of a kind doesn't follow a character of that kind."""
        import numpy as np

        legal = np.zeros((TAGS + 1, TAGS))
        for k in range(len(KINDS)):
            later = 2 + 2 * k
            legal[:TAGS, later] = -1e4
            legal[[later - 1, later], later] = 0  # a window may begin within a span
        return legal

    def _run(self, x, side: str, keep: bool):
        """Hidden states [T, N, H] and, if it is to be kept, what the backward pass needs; x: classes [T, N]."""
        import numpy as np

        steps, n = x.shape
        size = self.hidden
        h, c = np.zeros((n, size)), np.zeros((n, size))
        wx, wh, b = self.p["x" + side], self.p["h" + side], self.p["c" + side]
        hs, kept = np.empty((steps, n, size)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = wx[x[t]] + h @ wh + b
            gates = 1 / (1 + np.exp(-a[:, : 3 * size]))
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(a[:, 3 * size :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                kept.append((t, before_h, before_c, i, f, o, g, tc))
        return hs, kept

    def emissions(self, x, keep: bool = True):
        import numpy as np

        forward, kept_f = self._run(x, "f", keep)
        backward, kept_b = self._run(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, kept_f, kept_b

    def _crf(self, e, y):
        """Mean negative log likelihood, its gradient over emissions and over transitions."""
        import numpy as np

        steps, n, _ = e.shape
        trans = self.p["t"] + self._legal()
        rows = np.arange(n)

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = trans[TAGS] + e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans[None, :TAGS], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None, :TAGS] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = trans[TAGS, y[0]] + e[0, rows, y[0]]
        grad_e = np.exp(alpha + beta - z[None, :, None])
        grad_t = np.zeros_like(trans)
        grad_t[TAGS] = grad_e[0].sum(axis=0)
        np.subtract.at(grad_t[TAGS], y[0], 1)
        grad_e[0, rows, y[0]] -= 1
        for t in range(1, steps):
            gold += trans[y[t - 1], y[t]] + e[t, rows, y[t]]
            pair = np.exp(alpha[t - 1][:, :, None] + trans[None, :TAGS] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            grad_t[:TAGS] += pair.sum(axis=0)
            np.subtract.at(grad_t, (y[t - 1], y[t]), 1)
            grad_e[t, rows, y[t]] -= 1
        return float((z - gold).mean()), grad_e / n, grad_t / n

    def _back(self, x, side: str, kept, grad_h, grads: dict) -> None:
        import numpy as np

        size = self.hidden
        wh = self.p["h" + side]
        dh, dc = np.zeros((x.shape[1], size)), np.zeros((x.shape[1], size))
        for t, before_h, before_c, i, f, o, g, tc in reversed(kept):
            dh = dh + grad_h[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            one = np.zeros((x.shape[1], CLASSES))
            one[np.arange(x.shape[1]), x[t]] = 1
            grads["x" + side] += one.T @ da
            grads["h" + side] += before_h.T @ da
            grads["c" + side] += da.sum(axis=0)
            dh, dc = da @ wh.T, dc * f

    def fit(self, windows: list[tuple[str, list[int]]], steps: int = 320, batch: int = 48, rate: float = 0.02, seed: int = 5) -> None:
        """windows: texts of the window's length and a tag for each character."""
        import numpy as np

        xs = np.stack([classes_of(t) for t, _ in windows], axis=1)
        ys = np.array([y for _, y in windows]).T
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, xs.shape[1], batch)
            x, y = xs[:, pick], ys[:, pick]
            e, both, kept_f, kept_b = self.emissions(x)
            _, ge, gt = self._crf(e, y)
            grads = {k: np.zeros_like(w) for k, w in self.p.items()}
            grads["t"] = gt
            grads["o"] = np.einsum("tnh,tnk->hk", both, ge)
            grads["ob"] = ge.sum(axis=(0, 1))
            gb = ge @ self.p["o"].T
            self._back(x, "f", kept_f, gb[:, :, : self.hidden], grads)
            self._back(x, "b", kept_b, gb[:, :, self.hidden :], grads)
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            pace = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g * scale
                v[k] = 0.999 * v[k] + 0.001 * (g * scale) ** 2
                self.p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def viterbi(self, x):
        """The best tags [T, N] of windows of classes [T, N]."""
        import numpy as np

        e = self.emissions(x, keep=False)[0]
        trans = self.p["t"] + self._legal()
        score = trans[TAGS] + e[0]
        back = np.zeros((len(e), x.shape[1], TAGS), np.int8)
        for t in range(1, len(e)):
            total = score[:, :, None] + trans[None, :TAGS]
            back[t] = total.argmax(axis=1)
            score = total.max(axis=1) + e[t]
        tags = np.empty(x.shape, np.int64)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(x.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        return tags

    def added(self, texts: list[str], base: list[list[tuple[int, int, str]]], margin: int = 24) -> list[list[tuple[int, int, str]]]:
        """Per text the spans that the tagger adds to base."""
        import numpy as np

        size, stride = self.window, self.window // 2
        places = []  # (text, start of a window)
        regions: list[list[tuple[int, int]]] = []
        for i, text in enumerate(texts):
            own: list[tuple[int, int]] = []
            for m in TRIGGER.finditer(text):
                a, b = address_run(text, m)
                a, b = max(0, a - margin), min(len(text), b + margin)
                while own and a <= own[-1][0]:  # a long run may reach back over earlier regions
                    b = max(b, own.pop()[1])
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
            regions.append(own)
            for a, b in own:
                at = max(0, min(a, b - size)) if b - a < size else a
                while True:
                    places.append((i, at))
                    if at + size >= b:
                        break
                    at += stride
        tags: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for first in range(0, len(places), 512):
            part = places[first : first + 512]
            x = np.stack([classes_of(texts[i][at : at + size].ljust(size)) for i, at in part], axis=1)
            best = self.viterbi(x)
            for n, (i, at) in enumerate(part):
                for t in range(min(size, len(texts[i]) - at)):
                    off = abs(2 * t - size)
                    held = tags[i].get(at + t)
                    if held is None or off < held[0]:
                        tags[i][at + t] = (off, int(best[t, n]))
        out = []
        for text, given, chosen in zip(texts, base, tags):
            spans, run = [], None
            for at in sorted(chosen):
                tag = chosen[at][1]
                kind = (tag - 1) // 2
                if run and (tag == 0 or tag % 2 == 1 or kind != run[2] or at != run[1]):
                    spans.append(run)
                    run = None
                if tag:
                    run = (run[0], at + 1, kind) if run else (at, at + 1, kind)
            if run:
                spans.append(run)
            kept = []
            # a run of the form of an address that is tagged for the most part is taken whole, as tags may miss its ends; so is one
            # whose "at" is in brackets, or whose "at" and "dot" are words, which prose doesn't hold
            whole_runs = [r for r in addresses(text) if _CERTAIN.search(text, *r) or 2 * sum(chosen[at][1] in EMAIL_TAGS for at in range(*r) if at in chosen) > r[1] - r[0]]
            for a, b in whole_runs:
                if b - a <= LONGEST and not any(a < y and x < b for x, y, _ in given):
                    kept.append((a, b, "email"))
            spans = [(a, b, kind) for a, b, kind in spans if KINDS[kind] != "email" or not any(a < y and x < b for x, y in whole_runs)]
            for a, b, kind in spans:
                while a < b and text[a].isspace():
                    a += 1
                while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                    b -= 1
                if plausible(text[a:b], KINDS[kind]) and not any(a < y and x < b for x, y, _ in given):
                    whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
                    if whole:
                        kept.append((a, b, KINDS[kind]))
            out.append(sorted(kept))
        return out


_PHONE_FORM = re.compile(r"\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,5}){1,3}")
_EMAIL_FORM = re.compile(rf"[a-z0-9._%+-]+ ?(?:@|{_AT}| at ) ?[a-z0-9-]+(?: ?{_DOT} ?[a-z0-9-]+)+", re.IGNORECASE | re.ASCII)


_WRITTEN = re.compile(rf"[a-z0-9._%+-]+(?: ?@ ?| ?{_AT} ?| at )[a-z0-9-]+(?:(?:\.| \. | ?[(\[] ?dot ?[)\]] ?| dot )[a-z0-9-]+)+", re.IGNORECASE | re.ASCII)

_CERTAIN = re.compile(rf" ?{_AT}| at .*(?: dot |[(\[] ?dot ?[)\]])", re.IGNORECASE | re.ASCII)


def address_run(text: str, m: re.Match) -> tuple[int, int]:
    """The ends of the run around a trigger that may be an address; of digits, the trigger's own."""
    a, b = m.span()
    if m[0][0].isdigit() and "@" not in m[0]:
        return a, b
    low = max(0, a - LONGEST)
    if a > low and text[a - 1] == " ":
        a -= 1
    while a > low and text[a - 1] in LOCAL:
        a -= 1
    tail = _TAIL.match(text, b, b + LONGEST)
    return a, tail.end() if tail else b


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of the form of an address, separators written in any way, around the triggers that aren't digits."""
    found: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if "@" in m[0] or not m[0][0].isdigit():
            a, b = address_run(text, m)
            run = _WRITTEN.match(text, a + (text[a] == " "), b)
            if run and run.end() > m.end() and (not found or run.start() >= found[-1][1]):
                found.append(run.span())
    return found


def plausible(span: str, kind: str) -> bool:
    """Whether an added span has a form of its kind."""
    digits = sum(c.isdigit() for c in span)
    if kind == "phone":
        return 9 <= digits <= 15 and bool(_PHONE_FORM.fullmatch(span))
    if kind == "email":
        return len(span) <= LONGEST and bool(_EMAIL_FORM.fullmatch(span))
    if kind == "ip":
        parts = re.split(r" ?\. ?|\[\.\]|\(\.\)", span)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    bare = re.sub(r"[ ./-]", "", span)
    return bare.isascii() and bare.isdigit() and 12 <= len(bare) <= 19 and luhn(bare)


def training_windows(texts: list[str], window: int, seed: int = 11, copies: int = 6) -> list[tuple[str, list[int]]]:
    """Windows with a tag for each character; see the module's text."""
    import random

    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = digits(15)
        last = next(d for d in "0123456789" if luhn(body + d))
        s = body + last
        sep = rng.choice(["", " ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def word(n: int) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def made() -> tuple[str, int | None]:
        kind = rng.randrange(6)
        if kind == 0:
            name = word(rng.randrange(2, 8)) + rng.choice(["", "." + word(4), digits(2)])
            if not rng.randrange(4):
                name += "." + word(rng.randrange(6, 24))
            at, dot = rng.choice([("@", ".")] * 3 + [(" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", " . "), ("( at )", "( dot )"), (" [ at ] ", "."), (" at ", ".")])
            host = word(rng.randrange(3, 8)) + rng.choice(["", digits(1)])
            if not rng.randrange(3):
                host = word(rng.randrange(4, 14)) + rng.choice([".", dot]) + word(3) + "-" + word(rng.randrange(4, 14))
            value = name + at + host + dot + rng.choice(["com", "org", "net", "de", "example.com"])
            return rng.choice([value] * 4 + [value.upper(), name + at.upper() + value[len(name + at) :], name + at.title() + value[len(name + at) :]]), 0
        if kind == 1:
            sep = rng.choice([".", ".", ".", " . ", "[.]", "(.)"])
            return sep.join(str(rng.randrange(256)) for _ in range(4)), 1
        if kind == 2:
            return card(), 2
        if kind == 3:
            plus = rng.choice([f"+{rng.randrange(1, 99)} ", f"+{rng.randrange(1, 99)}", "", "00" + digits(2) + " "])
            form = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"])
            return plus + form.format(digits(3), digits(3), digits(4)), 3
        return rng.choice([str(rng.randrange(1900, 2100)), digits(rng.randrange(1, 6)), f"{digits(1)}.{digits(2)}", f"{digits(2)}.{digits(1)}.{digits(1)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(3)},{digits(3)}", f"{digits(3)} {digits(3)}", digits(rng.randrange(6, 12)), f"v{digits(1)}.{digits(1)}.{digits(2)}", f"@{word(5)}"]), None

    out = []

    def add(spans: list[tuple[int, int, int]], text: str) -> None:
        tags = [0] * len(text)
        for a, b, k in spans:
            for at in range(a, b):
                if 0 <= at < len(text):
                    tags[at] = 2 + 2 * k
            if 0 <= a < len(text):
                tags[a] = 1 + 2 * k
        text = text[:window].ljust(window)
        out.append((text, (tags + [0] * window)[:window]))

    for text in texts:
        spans = base_spans(text)
        for a, b, kind in spans[:20]:
            start = max(0, a - rng.randrange(4, window - 8))
            add([(x - start, y - start, KINDS.index(k)) for x, y, k in spans], text[start : start + window])
        for _ in range(copies):
            at = rng.randrange(max(1, len(text) - window))
            left = text[at : at + rng.randrange(2, window // 2)]
            if DIGIT.search(left) or "@" in left or "+" in left:
                continue
            value, kind = made()
            left = left.rstrip() + " "
            add([] if kind is None else [(len(left), len(left) + len(value), kind)], left + value + rng.choice([" ", ". ", ", "]) + text[at + 40 : at + 40 + window].replace("@", "a"))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 300, max_chars: int = 20_000) -> Tagger | None:
    """A tagger from the first `rows` documents by a hash of their id, none longer than max_chars; None without any."""
    sized = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars) & (F.length(text_col) > 0)).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    holds = F.when(F.col("_t").rlike("[0-9@]"), 0).otherwise(1).alias("o")
    pick = sized.select(holds, F.xxhash64("_i", F.lit(17)).alias("h"), "_i").orderBy("o", "h", "_i").limit(rows).select("_i").distinct()  # ids only: each task sends `rows` of them
    texts = sorted(r["_t"] for r in sized.join(F.broadcast(pick.withColumnRenamed("_i", "_p")), F.col("_i").eqNullSafe(F.col("_p")), "left_semi").select("_t").distinct().orderBy("_t").limit(rows).collect())
    if not texts:
        return None
    tagger = Tagger()
    tagger.fit(training_windows(texts, tagger.window))
    return tagger


SPANS = "base array<struct<start: long, end: long, kind: string>>, spans array<struct<start: long, end: long, kind: string>>"


def _find(tagger: Tagger | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

        def column(found):
            return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in found], kind)

        for part in chunks(batches, "text", 1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            some = [i for i, t in enumerate(texts) if TRIGGER.search(t)] if tagger else []
            spans = list(base)
            if some:
                more = tagger.added([texts[i] for i in some], [base[i] for i in some])
                for i, add in zip(some, more):
                    if add:
                        spans[i] = sorted([*base[i], *add], key=lambda s: (s[0], KINDS.index(s[2])))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), column(base), column(spans)], names=[*part.schema.names, "base", "spans"])

    return run


def find_spans(rows: DataFrame, tagger: Tagger | None) -> DataFrame:
    """rows (column text, and any but base and spans) with base, the patterns' spans, and spans, all of them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.transform(mapped, _find(tagger), f"{schema}, {SPANS}")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every span (or run of spans that overlap) replaced by the kind of its first in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def _mask(tagger: Tagger | None, column: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in chunks(batches, column, 1 << 20):
            texts = part.column(column).to_pylist()
            some = [i for i, t in enumerate(texts) if t and TRIGGER.search(t)]
            base = [base_spans(texts[i]) for i in some]
            more = tagger.added([texts[i] for i in some], base) if tagger and some else [[]] * len(some)
            for i, own, add in zip(some, base, more):
                texts[i] = mask(texts[i], own + add)
            at = part.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)], names=part.schema.names)

    return run


def masked(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """docs, their texts without personal data."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.transform(mapped, _mask(tagger, text_col), schema)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_spans(docs.select("doc_id", "text"), train(docs)).drop("text")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind
