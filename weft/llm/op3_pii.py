"""Personal data by rules and by a character-level bidirectional LSTM with a CRF.

Rules give the base spans: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. The tagger is trained
in numpy on windows of a bounded sample of documents, labelled with the base spans; most of the windows are altered as
people disguise such data (DISGUISES: "at" and "dot" as words or between marks drawn at random, spaces, separators of
digits drawn at random, no plus sign, letters O and l for digits) or get numbers that are none of the kinds (dates, times,
amounts, books' numbers), so that it learns to find what the rules miss and to leave the rest. It reads classes of
characters and the letters of the spelled marks, so it knows shapes and surroundings, not the data itself. Its tags are O
and begin/inside of each kind, with learned transitions; begin/inside order is a hard constraint.

Windows without a digit, an "@", an "at" between marks, or an "at" with a dot or "dot" after it (_TRIGGER) hold none of
the kinds and aren't run. All others are run in batches; where windows overlap, their scores are averaged, weighted
towards windows' middles, and one Viterbi decoding over each run of windows, whatever its length, reconciles them (scores
and ways are carried from batch to batch). A decoded span is added if it overlaps no base span, beats "no span here" by
MARGIN a character, and has what its kind asks for (plausible()): a name, a mark and a domain ("at" as a bare word only
with a spelled "dot": "look at example.org" is none); four numbers up to 255; 14 to 19 digits; 10 to 15 digits.

Whole texts are read, batch by batch, so that memory follows the open part of a decoding and not the text; offsets
are code points, ends exclusive. Null texts are empty. Repeated rows each get a row. An empty table gives no rows; one
without labelled windows gives base spans only. Only doc_id and text are read, further columns take no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import materialise, table

#: Documents with labelled spans, and windows, that the tagger is trained on, at most.
SAMPLE, WINDOWS = 1_500, 9_600
#: Disguises of each labelled stretch, as long as WINDOWS has room; every eighth time the plain ones go along.
COPIES = 400
#: Share of the disguised copies' spans that give way to numbers of no kind.
OTHERS = 0.15
#: Windows that are run at once.
BATCH = 256
WIDTH, STRIDE = 48, 24
EMBED, HIDDEN = 10, 24
MARGIN = 0.5
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind

_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"(?i)[0-9@]|[^\w\s]\s?at\s?[^\w\s]|_at_|\sat\s+[\w-]+(?:\.\w|[\W_]{1,3}dot[\W_])")
_DIGITS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each "@" outwards (one look at each run of characters)."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_HEAD:
            start -= 1
        m = _EMAIL_TAIL.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans, by start and then kind."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# classes of characters: 0 pads; each of these marks, and letters of the spelled ones, is a class, brackets of all shapes
# are two, the rest fall into kinds, so that a mark never seen reads like others
_MARKS = "@.-+() \n_:,\"'atdoOlI"
_CLASS = {c: k for k, c in enumerate(_MARKS, 1)} | dict.fromkeys("[{<", _MARKS.index("(") + 1) | dict.fromkeys("]}>", _MARKS.index(")") + 1)
CLASSES = len(_MARKS) + 6


def classes(text: str) -> np.ndarray:
    n = len(_MARKS)
    out = np.empty(len(text), np.int64)
    for k, c in enumerate(text):
        v = _CLASS.get(c)
        if v is None:
            v = n + (1 if "0" <= c <= "9" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isalpha() else 5)
        out[k] = v
    return out


def window_starts(text: str, width: int = WIDTH, stride: int = STRIDE) -> list[int]:
    """Starts of the windows of the grid that a trigger begins in."""
    out = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // stride
        for j in range(max(0, k - width // stride + 1), k + 1):
            out.add(j * stride)
    return sorted(out)


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions, with gradients by hand."""

    NAMES = ("E", "Wf", "bf", "Wb", "bb", "Wo", "bo", "T")

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": rng.normal(0, 1, (CLASSES, EMBED)), "Wf": g(EMBED + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN), "Wb": g(EMBED + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN), "Wo": g(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        self.p["bf"][HIDDEN : 2 * HIDDEN] = self.p["bb"][HIDDEN : 2 * HIDDEN] = 1.0
        #: inside follows begin or inside of its kind only
        self.barred = np.zeros((TAGS, TAGS), dtype=bool)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = True
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False

    def _weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of inputs, of states, and offsets, of both directions."""
        w = np.stack([self.p["Wf"], self.p["Wb"]])
        return w[:, :EMBED], w[:, EMBED:], np.stack([self.p["bf"], self.p["bb"]])

    def _lstms(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (n, t, 2 HIDDEN) of both directions, which go side by side; what each class brings to the gates is a table."""
        n, t = x.shape
        wx, wh, bias = self._weights()
        brought = self.p["E"] @ wx + bias[:, None]
        h = np.zeros((2, n, HIDDEN), brought.dtype)
        c, out = np.zeros_like(h), np.empty((n, t, 2 * HIDDEN), brought.dtype)
        for k in range(t):
            z = h @ wh
            z[0] += brought[0][x[:, k]]
            z[1] += brought[1][x[:, t - 1 - k]]
            s = 1 / (1 + np.exp(-z[:, :, : 3 * HIDDEN]))
            i, f, o = s[:, :, :HIDDEN], s[:, :, HIDDEN : 2 * HIDDEN], s[:, :, 2 * HIDDEN :]
            g = np.tanh(z[:, :, 3 * HIDDEN :])
            was, c = (h, c), f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, k, :HIDDEN], out[:, t - 1 - k, HIDDEN:] = h[0], h[1]
            if tape is not None:
                tape.append((*was, i, f, o, g, tc))
        return out

    def _lstms_back(self, x: np.ndarray, grad: np.ndarray, tape: list) -> dict[str, np.ndarray]:
        n, t = x.shape
        wx, wh, _ = self._weights()
        gh = np.zeros((2, n, HIDDEN), grad.dtype)
        gc, zs = np.zeros_like(gh), np.empty((2, t, n, 4 * HIDDEN), grad.dtype)
        back = wh.transpose(0, 2, 1)
        for k in reversed(range(t)):
            _, before, i, f, o, g, tc = tape[k]
            h = np.stack([grad[:, k, :HIDDEN], grad[:, t - 1 - k, HIDDEN:]]) + gh
            c = gc + h * o * (1 - tc * tc)
            z = np.concatenate([c * g * i * (1 - i), c * before * f * (1 - f), h * tc * o * (1 - o), c * i * (1 - g * g)], axis=2)
            gh, gc = z @ back, c * f
            zs[:, k] = z
        zs = zs.reshape(2, t * n, 4 * HIDDEN)
        hs = np.stack([u[0] for u in tape], axis=1).reshape(2, t * n, HIDDEN)
        ways = np.stack([x.T, x.T[::-1]]).reshape(2, -1)
        held = (ways[:, None, :] == np.arange(CLASSES)[:, None]).astype(grad.dtype)
        by_class = held @ zs
        gwx, gwh, gb = self.p["E"].T @ by_class, hs.transpose(0, 2, 1) @ zs, zs.sum(1)
        w = np.concatenate([gwx, gwh], axis=1)
        return {"E": (by_class @ wx.transpose(0, 2, 1)).sum(0), "Wf": w[0], "bf": gb[0], "Wb": w[1], "bb": gb[1]}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores of windows of classes (n, WIDTH)."""
        return self._lstms(x) @ self.p["Wo"] + self.p["bo"]

    def transitions(self) -> np.ndarray:
        return np.where(self.barred, -1e4, self.p["T"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag paths, and its gradients."""
        n, t = x.shape
        tape: list = []
        h = self._lstms(x, tape)
        em = (h @ self.p["Wo"] + self.p["bo"]).astype(np.float64)
        # forward and backward shares, scaled at each place
        tr = self.transitions()
        most = em.max(2)
        e, m = np.exp(em - most[:, :, None]).transpose(1, 0, 2), np.exp(tr.astype(np.float64))
        a, b, scale = np.empty((t, n, TAGS)), np.ones((t, n, TAGS)), np.empty((t, n, 1))
        for k in range(t):
            a[k] = e[k] * (a[k - 1] @ m if k else ~self.barred[0])
            scale[k] = a[k].sum(1, keepdims=True)
            a[k] /= scale[k]
        for k in range(t - 2, -1, -1):
            b[k] = (e[k + 1] * b[k + 1]) @ m.T / scale[k + 1]
        gem = (a * b).transpose(1, 0, 2)
        gt = m * np.tensordot(a[:-1], e[1:] * b[1:] / scale[1:], axes=((0, 1), (0, 1)))
        rows = np.arange(n)
        score = em[rows[:, None], np.arange(t)[None], y].sum() + tr[y[:, :-1], y[:, 1:]].sum()
        gem[rows[:, None], np.arange(t)[None], y] -= 1
        np.subtract.at(gt, (y[:, :-1], y[:, 1:]), 1)
        gem = (gem / n).astype(h.dtype)
        flat = gem.reshape(-1, TAGS)
        out = self._lstms_back(x, gem @ self.p["Wo"].T, tape)
        return float((np.log(scale).sum() + most.sum() - score) / n), out | {"Wo": h.reshape(-1, 2 * HIDDEN).T @ flat, "bo": flat.sum(0), "T": np.where(self.barred, 0.0, gt / n)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 4) -> list[float]:
        """Adam over shuffled batches, in single precision, at steps that shrink; the mean loss of each epoch."""
        self.p = {k: w.astype(np.float32) for k, w in self.p.items()}
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, losses, last = 0, [], 1 + epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for k in range(0, len(x), batch):
                own = order[k : k + batch]
                loss, g = self.gradients(x[own], y[own])
                total += loss * len(own)
                step += 1
                for name in self.NAMES:
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
                    self.p[name] -= rate * (1 - step / last) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def decode(self, em: np.ndarray) -> list[int]:
        """The best tag path of scores (length, TAGS)."""
        return [t for _, _, path in Decoder(self).push(em, True) for t in path]

    def spans(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Spans of a whole text that the tagger finds."""
        run: list[int] = []
        for s in window_starts(text):
            if run and s != run[-1] + STRIDE:
                yield from self._run(text, run)
                run = []
            run.append(s)
        if run:
            yield from self._run(text, run)

    def _run(self, text: str, starts: list[int]) -> Iterator[tuple[str, int, int]]:
        """Spans in windows that follow each other by one stride: averaged scores and one decoding of the whole run.

        Scores are made BATCH windows at a time; places that later windows still reach are carried over.
        """
        middle = 1.0 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])
        total, weight = np.zeros((WIDTH - STRIDE, TAGS)), np.zeros(WIDTH - STRIDE)
        way = Decoder(self)
        for k in range(0, len(starts), BATCH):
            own = starts[k : k + BATCH]
            base, end = own[0], own[-1] + WIDTH
            code = np.zeros(end - base, np.int64)
            part = text[base:end]
            code[: len(part)] = classes(part)
            total = np.concatenate([total, np.zeros((end - base - len(total), TAGS))])
            weight = np.concatenate([weight, np.zeros(end - base - len(weight))])
            at = np.array(own) - base
            for s, e in zip(at.tolist(), self.emissions(code[at[:, None] + np.arange(WIDTH)[None]]), strict=True):
                total[s : s + WIDTH] += e * middle[:, None]
                weight[s : s + WIDTH] += middle
            last = k + BATCH >= len(starts)
            whole = len(part) if last else len(own) * STRIDE
            for begin, em, path in way.push(total[:whole] / weight[:whole, None], last):
                yield from self._accepted(text, starts[0] + begin, em, path)
            total, weight = total[whole:], weight[whole:]

    def _accepted(self, text: str, base: int, em: np.ndarray, path: list[int]) -> list[tuple[str, int, int]]:
        out, k = [], 0
        while k < len(path):
            if path[k] and path[k] % 2:
                kind, j = KINDS[(path[k] - 1) // 2], k + 1
                while j < len(path) and path[j] == path[k] + 1:
                    j += 1
                own = text[base + k : base + j]
                gain = (em[range(k, j), path[k:j]] - em[k:j, 0]).mean()
                if gain >= MARGIN and plausible(kind, own):
                    out.append((kind, base + k, base + j))
                k = j
            else:
                k += 1
        return out


class Decoder:
    """The best tag path of scores that come in pieces, equal to that of all scores at once.

    What is settled, as the ways to all tags of the newest place share it, is given out and forgotten, up to a place where
    a span begins or none is open; so memory follows the part that is still open, and no length cuts a decoding.
    """

    def __init__(self, tagger: Tagger):
        self.tr, self.first = tagger.transitions(), np.where(tagger.barred[0], -1e4, 0.0)
        self.score: np.ndarray | None = None
        self.begin = 0
        self.em = np.empty((0, TAGS))
        self.back = np.empty((0, TAGS), np.int8)

    def push(self, em: np.ndarray, last: bool) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(place of its first score, scores, path) of what these scores settle; the rest too if they are the last."""
        back = np.zeros((len(em), TAGS), np.int8)
        for k, row in enumerate(em):
            if self.score is None:
                self.score = self.first + row
                continue
            way = self.score[:, None] + self.tr
            back[k] = way.argmax(0)
            self.score = way.max(0) + row
            self.score -= self.score.max()
        self.em, self.back = np.concatenate([self.em, em]), np.concatenate([self.back, back])
        n = len(self.em)
        if self.score is None or not n:
            return
        if last:
            path = self._path(int(self.score.argmax()), n - 1)
            yield self.begin, self.em, path
            return
        tags, k = np.arange(TAGS), n - 1
        while k > 0 and (tags != tags[0]).any():
            tags = self.back[k][tags]
            k -= 1
        if k <= 0:
            return
        path = self._path(int(tags[0]), k)
        while k > 0 and path[k] and path[k] % 2 == 0:
            k -= 1
        if k:
            yield self.begin, self.em[:k], path[:k]
            self.begin, self.em, self.back = self.begin + k, self.em[k:], self.back[k:]

    def _path(self, tag: int, k: int) -> list[int]:
        path = [tag]
        for b in self.back[k:0:-1]:
            path.append(int(b[path[-1]]))
        return path[::-1]


_MARK = r"[^\w\s]|_"
_AT = rf"(?:\s?(?:{_MARK}){{1,2}}\s?(?:at|@)\s?(?:{_MARK}){{1,2}}\s?|\s?@\s?)"
_DOT = rf"(?:\s?(?:{_MARK}){{1,2}}\s?(?:dot|\.)\s?(?:{_MARK}){{1,2}}\s?|\sdot\s)"
_NAME = r"[A-Za-z0-9][A-Za-z0-9+%-]*(?:_[A-Za-z0-9+%-]+)*?"
_SPELLED = re.compile(rf"(?i){_NAME}(?:(?:{_DOT}|\.){_NAME})*(?:{_AT}{_NAME}(?:(?:{_DOT}|\s?\.\s?){_NAME})+|\sat\s{_NAME}(?:{_DOT}{_NAME})+)")
_READ_AS = str.maketrans("OolI", "0011")
_NONE_OF_THEM = re.compile(r"(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ][0-3]?[0-9](?![0-9])|[0-9]:[0-5][0-9](?::|\b)|^97[89][- ]?[0-9][- 0-9]{8,12}$")


def plausible(kind: str, own: str) -> bool:
    """Whether a decoded span has what its kind asks for; letters that look like digits count as such between digits."""
    if kind == "email":
        return len(own) <= 254 and bool(_SPELLED.fullmatch(own))
    own = re.sub(r"(?<=[0-9])[OolI]+(?=[0-9])", lambda m: m.group().translate(_READ_AS), own)
    own = re.sub(r"(?i)[\W_]{1,3}dot[\W_]{1,3}", ".", own)
    digits = re.sub("[^0-9]", "", own)
    if any(c.isalpha() for c in own) or not ("0" <= own[-1] <= "9"):
        return False
    between = [m.strip() for m in re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", own)]
    if any(len(m) > (5 if kind == "ip" else 3) for m in between):
        return False
    if kind == "ip":
        parts = re.findall("[0-9]+", own)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and len(set(between)) == 1 and between[0] != ""
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(set(between)) <= 1
    return 10 <= len(digits) <= 15 and not _NONE_OF_THEM.search(own)


#: Marks that disguises are drawn from; other marks read the same as some of these.
_PAIRS = ("()", "[]", "{}", "~~", "--", "__", "::", "!!")
_SEPARATORS = (".", "/", "_", "-", ":", ",", "~", ";")


#: What stands before and after disguised data.
_BEFORE = ("", "", "", ": ", "=", "\n", "- ", "\n- ", '"', "(", " to ", " at ", " under ", ", ", ". ")
_AFTER = ("", "", "", ".", ",", "\n", '"', ")", ";", " and", " -", ", or ")


def _between(word: str, rng: np.random.Generator) -> str:
    """A word or mark between two marks or spaces."""
    pair, inner, outer = _PAIRS[rng.integers(len(_PAIRS))], " " * int(rng.random() < 0.15), " " * int(rng.random() < 0.4)
    return f"{outer}{pair[0]}{inner}{word}{inner}{pair[1]}{outer}"


def _word(rng: np.random.Generator, least: int, most: int) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(least, most + 1)))


def another(kind: str, rng: np.random.Generator) -> str:
    """Data of a kind with other names and numbers, in the rules' own form: a corpus may hold few shapes of them."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        name = [_word(rng, 3, 9), f"{_word(rng, 1, 8)}.{_word(rng, 3, 9)}", f"{_word(rng, 1, 6)}_{_word(rng, 3, 7)}", _word(rng, 3, 8) + d(rng.integers(1, 4)), _word(rng, 3, 7).title()][rng.integers(5)]
        return f"{name}@{'.'.join(_word(rng, 3, 10) for _ in range(rng.integers(1, 3)))}.{_word(rng, 2, 3)}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, [10, 100, 256, 256][rng.integers(4)], 4))
    if kind == "card":
        digits = str(rng.integers(3, 7)) + d(rng.integers(13, 16))
        return next(digits + c for c in "0123456789" if luhn(digits + c))
    return f"+{rng.integers(1, 99)} {d(3)} {d(3)} {d(4)}"


def _email(own: str, rng: np.random.Generator) -> str:
    spelled = [str.lower, str.lower, str.upper, str.title][rng.integers(4)]
    way = rng.integers(6)
    if way < 2:  # words alone
        at, dot = f" {spelled('at')} ", f" {spelled('dot')} "
    elif way < 5:
        at = _between(spelled("at") if rng.random() < 0.8 else "@", rng)
        dot = [".", f" {spelled('dot')} ", _between(spelled("dot"), rng), _between(".", rng)][rng.integers(4)]
    else:
        at, dot = [" @ ", "@", "@ "][rng.integers(3)], [" . ", " dot ", _between("dot", rng)][rng.integers(3)]
    name, _, host = own.partition("@")
    if rng.random() < 0.3:
        name = re.sub(r"[^A-Za-z0-9]", "", name)
    elif dot.strip() != ".":
        name = name.replace(".", dot if rng.random() < 0.5 else ".")
    return name + at + host.replace(".", dot)


def _ip(own: str, rng: np.random.Generator) -> str:
    way = rng.integers(4)
    if way == 0:
        dot = [" dot ", " DOT ", " Dot "][rng.integers(3)]
    elif way == 1:
        dot = _between(["dot", "."][rng.integers(2)], rng)
    else:
        mark = _SEPARATORS[rng.integers(len(_SEPARATORS))]
        dot = [mark, f" {mark} ", f"{mark} ", f" {mark}"][rng.integers(1 if mark == "." else 0, 4)]
    return own.replace(".", dot)


def _card(own: str, rng: np.random.Generator) -> str:
    digits = re.sub("[^0-9]", "", own)
    mark = ("", "  ", *_SEPARATORS)[rng.integers(2 + len(_SEPARATORS))]
    mark = f" {mark} " if mark.strip() and rng.random() < 0.3 else mark
    size = [4, 4, 4, 3, 5, 2][rng.integers(6)]
    out = mark.join(digits[k : k + size] for k in range(0, len(digits), size))
    at = [k for k in range(1, len(out) - 1) if out[k] in "01" and out[k - 1].isdigit() and out[k + 1].isdigit()]
    if at and (not mark or rng.random() < 0.2):  # one 0 or 1 read as a letter
        k = at[rng.integers(len(at))]
        out = out[:k] + ("oO"[rng.integers(2)] if out[k] == "0" else "lI"[rng.integers(2)]) + out[k + 1 :]
    return out


def _phone(own: str, rng: np.random.Generator) -> str:
    digits = re.sub("[^0-9]", "", own)
    country, tail = digits[:-10], digits[-10:]
    marks = [m for m in _SEPARATORS if m != ":"]  # that would be times
    mark = (" ", " ", *marks)[rng.integers(2 + len(marks))]
    mark = f" {mark} " if mark.strip() and rng.random() < 0.3 else mark
    cuts = [(3, 6), (2, 6), (4, 7), (3, 7), (2, 4, 6, 8), (5,)][rng.integers(6)]
    tail = mark.join(tail[a:b] for a, b in zip((0, *cuts), (*cuts, len(tail)), strict=True))
    if rng.random() < 0.2:
        first, _, rest = tail.partition(mark)
        tail = f"({first}) {rest}"
    if not country or rng.random() < 0.3:
        return tail
    return [f"00{country}{mark}{tail}", f"(00{country}) {tail}", f"({country}) {tail}", f"{country}{mark}{tail}", f"+{country}{mark}{tail}"][rng.integers(5)]


def _number(rng: np.random.Generator) -> str:
    """A number that is none of the kinds: a date, a time, an amount, a book's number, a version, a measure."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    year, month, day, hour = int(rng.integers(1900, 2100)), int(rng.integers(1, 13)), int(rng.integers(1, 29)), int(rng.integers(0, 24))
    return [
        f"{year}-{month:02}-{day:02}", f"{year}-{month:02}-{day:02} {hour:02}:{d(2)}:{d(2)}", f"{day}/{month}/{year}", f"{day}.{month}.{year} at {hour}:30", f"{hour:02}:{d(2)}",
        f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(1)}.{d(4)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(7)}", f"{d(3)} - {d(3)}", f"{d(2)}, {d(2)}, {d(2)}, {d(2)} and {d(2)}", f"{year} {d(3)} {d(4)}", f"at {d(1)}.{d(1)}",
        f"{d(12)}", f"{d(8)}-{d(4)}", f"at {hour}.{d(2)} on {day}.{month}.", f"{d(4)}-{d(4)} {d(2)}%",
    ][rng.integers(18)]


#: How data of each kind is disguised for training.
DISGUISES = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def disguised(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its (non-overlapping) spans disguised, and where they are then; some give way to other numbers."""
    out, done, moved = [], 0, []
    size = 0
    for kind, a, b in spans:
        if a < done:
            continue
        other = rng.random() < OTHERS
        own = text[a:b] if rng.random() < 0.2 else another(kind, rng)
        own = _number(rng) if other else DISGUISES[kind](own, rng)
        before, after = _BEFORE[rng.integers(len(_BEFORE))], _AFTER[rng.integers(len(_AFTER))]
        if before and not before[0].isspace():
            before = " " * int(rng.random() < 0.5) + before
        out += [text[done:a].rstrip(" ") if before else text[done:a], before, own, after]
        size += len(out[-4]) + len(before)
        if not other:
            moved.append((kind, size, size + len(own)))
        size += len(own) + len(after)
        done = b
    return "".join([*out, text[done:]]), moved


def labelled_windows(texts: list[str], most: int = WINDOWS, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a trigger, and their tags: those of the rules, and then of texts with spans in COPIES disguises."""
    xs, ys = [], []
    rng = np.random.default_rng(seed)
    for copy in range(COPIES + 1):
        for text in texts:
            spans = base_spans(text)
            if copy:
                if not spans and copy % 8:
                    continue
                text, spans = disguised(text, spans, rng)
            tags = np.zeros(len(text) + WIDTH, np.int64)
            for kind, a, b in reversed(spans):
                k = 1 + 2 * KINDS.index(kind)
                tags[a:b] = k + 1
                tags[a] = k
            for s in window_starts(text):
                c = classes(text[s : s + WIDTH])
                y = tags[s : s + WIDTH].copy()
                if y[0] and y[0] % 2 == 0:
                    y[0] -= 1  # a span that comes in from before begins here
                xs.append(np.pad(c, (0, WIDTH - len(c))))
                ys.append(y)
                if len(xs) >= most:
                    return np.array(xs), np.array(ys)
    return np.array(xs, np.int64).reshape(-1, WIDTH), np.array(ys, np.int64).reshape(-1, WIDTH)


def fit(docs: DataFrame) -> Tagger | None:
    """Train on documents with digits or "@", in an order by hash; None without any.

    Surroundings of base spans (label 1) and of other triggers (label 0) are cut out of whole texts in Spark; the first WINDOWS / 16 of each label by hash come to the driver.
    """
    sample = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("o")).orderBy("o", "doc_id").limit(SAMPLE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, label = [], []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                # every span with its surroundings, and of what holds none every eighth window by its own hash
                for _, a, b in spans:
                    keep.append(t[max(0, a - WIDTH) : b + WIDTH])
                    label.append(1)
                for s in window_starts(t):
                    if not any(a < s + 2 * WIDTH and s - WIDTH < b for _, a, b in spans) and zlib.crc32(t[s : s + WIDTH].encode()) % 8 == 0:
                        keep.append(t[max(0, s - WIDTH) : s + 2 * WIDTH])
                        label.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(keep, pa.string())], names=["y", "t"])

    found = materialise(docs.join(F.broadcast(sample), "doc_id").select("text").mapInArrow(cut, "y int, t string").distinct())
    texts = [r.t for y in (1, 0) for r in found.where(F.col("y") == y).orderBy(F.xxhash64("t"), "t").limit(WINDOWS // 16).collect()]
    texts.sort(key=lambda t: zlib.crc32(t.encode()))
    x, y = labelled_windows(texts)
    if not len(x) or not y.any():
        return None
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger


def all_spans(text: str, tagger: Tagger | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those with the tagger's additions."""
    base = base_spans(text)
    if tagger is None or not _TRIGGER.search(text):
        return base, base
    ends = np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []
    starts = [a for _, a, _ in base]
    return base, ordered(base + [s for s in tagger.spans(text) if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[1]])


def find_personal_data(df: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans of every row."""
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    kind = df.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans = {k: [] for k in KINDS}, [], []
            for t in batch.column(1):
                base, every = all_spans(t.as_py() or "", shared.value)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit(docs))
