"""Toxicity by noisy-channel deobfuscation: restore the text under a character language model, then score it.

Restoring: a token with letters and stand-ins for letters (1d10t, @, $), with a letter three or more times in a row, or
a run of three or more lone characters (i d i o t) is a lattice of readings: each stand-in can be itself or its
letters, each run itself, two or one of its letter, each gap a space or nothing. Viterbi decoding takes the path of least
channel cost minus log probability under a character trigram model. A plain token has one path and stays as it is.

Scoring: words of the restored text speak by themselves and by their first 3 to 9 letters; those that documents
labelled toxic hold far more often than others (a log-likelihood ratio test, corrected for the number of tries) have a
weight. A logistic regression on a document's highest weights and their number gives the score.

Models are fitted on all labelled rows that aren't held out (copies share a weight), by sums of whole numbers that are
the same with every partitioning. Counts are gathered by Spark; what goes to the driver are trigrams, whose alphabet is
bounded as letters from U+2E80 up are one to the model, features that pass the test, and the regression's sums. Every text is scored whole, however long; time and memory are linear in a
stretch's length. Null texts count as empty and score as such, an empty table gives no rows; without labels of both
classes the score is the share of toxic labels. Repeated rows each get a row. Only doc_id and text are read; further
columns are kept by score_documents(), whatever their names, but for one named as the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import crc_class, materialise, slices, table
from weft.llm.labelled import ONE, fit_logistic, labelled_rows, sigmoid

MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Letters that a character can stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
EDGES = ".,;:?\"'()[]{}<>*%&#~^_=`-/\\…«»“”‘’¡¿"
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S[ .\-_*]){2,}\S(?=\s|$|[.,;:!?])")
#: Words, and trigrams, that a worker remembers before it starts anew.
MEMO = 50_000
#: Distinct words or features that a task counts before it passes them on.
FLUSH = 400_000
_WIDE = re.compile("[\u2e80-\U0010ffff]")


def folded(letters: str) -> str:
    """Letters from U+2E80 up, of which there are tens of thousands, are one to the character model."""
    return letters if letters.isascii() else _WIDE.sub("\u4e00", letters)


class CharacterModel:
    """Trigram model over characters with back-off by interpolation; words start and end with a space."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.one = dict(trigrams), Counter(), Counter()
        self.heads: Counter = Counter()
        for t, n in trigrams.items():
            self.two[t[1:]] += n
            self.one[t[2]] += n
            self.heads[t[:2]] += n
        self.heads1: Counter = Counter()
        for t, n in self.two.items():
            self.heads1[t[0]] += n
        self.total = sum(self.one.values())
        self._memo: dict[str, float] = {}

    def log_p(self, context: str, c: str) -> float:
        key = context + c
        out = self._memo.get(key)
        if out is None:
            if len(self._memo) > MEMO:
                self._memo.clear()
            name, key = key, folded(key)
            c = key[2]
            p1 = (self.one[c] + 0.1) / (self.total + 30)
            p2 = (self.two[key[1:]] + 4 * p1) / (self.heads1[key[1]] + 4)
            out = self._memo[name] = math.log((self.three.get(key, 0) + 4 * p2) / (self.heads[key[:2]] + 4))
        return out


def arcs(text: str, k: int) -> list[tuple[str, int, float]]:
    """Arcs (output, next position, cost) from position k of an obfuscated stretch."""
    c = text[k]
    out = [(c, k + 1, 0.0 if c.isalpha() or c == " " else 3.0)]
    out += [(x, k + 1, 1.0) for x in STANDS_FOR.get(c, "")]
    if c in " .-_*" and 0 < k < len(text) - 1:
        out.append(("", k + 1, 0.5))
    if (c.isalnum() or c in STANDS_FOR) and (not k or text[k - 1] != c):  # runs are walked once, from their start
        end = k + 1
        while end < len(text) and text[end] == c:
            end += 1
        if end - k >= 3:
            for x in [c, *STANDS_FOR.get(c, "")]:
                out += [(x, end, 1.0), (x + x, end, 1.5)]
    return out


def read_back(node: tuple | None) -> str:
    """The outputs along a chain of (chain before, output)."""
    out = []
    while node is not None:
        node, x = node
        out.append(x)
    return "".join(reversed(out))


def viterbi(text: str, model: CharacterModel) -> str:
    """The most likely reading of an obfuscated stretch, in time and memory linear in its length.

    A state points back along its path; what no live state points to is freed."""
    ahead: dict[int, dict[str, tuple[float, tuple | None]]] = {0: {" ": (0.0, None)}}
    for k in range(len(text)):
        here = arcs(text, k)
        for state, (cost, node) in ahead.pop(k).items():
            for out, to, price in here:
                s, total = state, cost + price
                for c in out:
                    total -= model.log_p(s[-2:].rjust(2), c)
                    s = (s + c)[-2:]
                states = ahead.setdefault(to, {})
                old = states.get(s)
                if old is None or total < old[0]:
                    states[s] = (total, (node, out) if out else node)
    ends = [(cost - model.log_p(s[-2:].rjust(2), " "), node) for s, (cost, node) in ahead[len(text)].items()]
    least = min(cost for cost, _ in ends)
    return min(read_back(node) for cost, node in ends if cost == least)


def is_obfuscated(word: str) -> bool:
    if word.isalpha():
        return bool(_RUN.search(word))
    return any(c.isalpha() for c in word) and (any(c in STANDS_FOR for c in word) or bool(_RUN.search(word)))


def restore_word(token: str, model: CharacterModel) -> str:
    """A lower-cased token's word, read through the channel if it is obfuscated."""
    word = token.strip(EDGES).rstrip("!")
    if word.isalpha() and not _RUN.search(word):
        return word
    if not is_obfuscated(word):
        return word
    return viterbi(word, model).strip(EDGES)


def spaced_stretches(text: str) -> list[str]:
    """Runs of lone characters of a lower-cased text."""
    return [m.group() for m in _SPACED.finditer(text)]


def restore(text: str, model: CharacterModel) -> str:
    """The whole text, lower-cased and restored: tokens by themselves, and runs of lone characters together."""
    low = _SPACED.sub(lambda m: viterbi(m.group(), model), text.lower())
    return re.sub(r"\S+", lambda m: restore_word(m.group(), model) if is_obfuscated(m.group().strip(EDGES).rstrip("!")) else m.group(), low)


def features(word: str) -> list[str]:
    return [word[:k] + "*" for k in range(3, min(len(word), 10))] + [word + "="]


class ToxicityModel:
    """weights by feature, the character model, and the logistic weights over (first, second, number)."""

    def __init__(self, characters: CharacterModel, weights: dict[str, float]):
        self.characters = characters
        self.weigh(weights)
        self.logistic: np.ndarray | None = None
        self.share = 0.0
        self._memo: dict[str, float] = {}

    def weigh(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.heads = {f[:3] for f in weights}

    def weight(self, token: str) -> float:
        get, plain = self.weights.get, token.strip(EDGES).rstrip("!")
        if (plain + "=")[:3] not in self.heads and plain.isalpha() and not _RUN.search(plain):
            return 0.0  # its features all start so
        out = max([get(f, 0.0) for w in restore_word(token, self.characters).split() for f in features(w)], default=0.0)
        if len(self._memo) > MEMO:
            self._memo.clear()
        if len(token) < 40:
            self._memo[token] = out
        return out

    def summary(self, text: str) -> tuple[float, float, float]:
        """The two highest weights of distinct words, and the logarithm of how many have one."""
        low = text.lower()
        tokens = set(low.split())
        if _SPACED.search(low):
            for x in spaced_stretches(low):
                tokens.update(viterbi(x, self.characters).split())
        memo, weight = self._memo, self.weight
        heavy = []
        for t in tokens:
            w = memo.get(t)
            if w is None:
                w = weight(t)
            if w:
                heavy.append(w)
        heavy.sort(reverse=True)
        return (heavy[0] if heavy else 0.0, heavy[1] if len(heavy) > 1 else 0.0, math.log1p(len(heavy)))

    def score(self, summaries: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(summaries), self.share)
        return sigmoid(summaries @ self.logistic[:-1] + self.logistic[-1])


def _weighed(tallies: dict[tuple[int, int], Counter]) -> pa.RecordBatch:
    """(feature, pos, neg) of the counters of each class and weight."""
    sums = (Counter(), Counter())
    for (y, weight), found in tallies.items():
        own = sums[y]
        for f, n in found.items():
            own[f] += n * weight
    names = list(sums[0] | sums[1])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([sums[y][n] for n in names], pa.int64()) for y in (1, 0))], names=["feature", "pos", "neg"])


def _counted(rows: DataFrame, characters: CharacterModel | None) -> DataFrame:
    """(feature, pos, neg), weights summed: without a model the trigrams of words, else features of restored words and "" for the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(characters)

    def grams(tallies: dict[tuple[int, int], Counter]) -> dict[tuple[int, int], Counter]:
        out: dict[tuple[int, int], Counter] = {}
        for key, words in tallies.items():
            own = out[key] = Counter()
            for w, n in words.items():
                w = w.strip(EDGES).rstrip("!")
                if w.isalpha():
                    w = folded(f"  {w} ")
                    for k in range(len(w) - 2):
                        own[w[k : k + 3]] += n
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, memo = shared.value, {}
        tallies: dict[tuple[int, int], Counter] = {}

        def told(token: str) -> list[str]:
            out = memo.get(token)
            if out is None:
                out = [f for w in restore_word(token, characters).split() for f in features(w)]
                if len(token) < 40:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[token] = out
            return out

        size = 0
        for batch in slices(batches):
            for text, y, weight in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                low = text.lower()
                found = tallies.setdefault((y, weight), Counter())
                size -= len(found)
                if characters is None:
                    found.update(low.split())
                else:
                    tokens = set(low.split())
                    for x in spaced_stretches(low):
                        tokens.update(viterbi(x, characters).split())
                    found.update({""}.union(*map(told, tokens)))
                size += len(found)
                if size > FLUSH:
                    yield _weighed(grams(tallies) if characters is None else tallies)
                    tallies, size = {}, 0
        yield _weighed(grams(tallies) if characters is None else tallies)

    return rows.select("text", "y", "weight").mapInArrow(work, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows, sizes = labelled_rows(docs, labels, "toxic", MODULUS, HELD_OUT)
    total = sum(sizes.values())
    grams = _counted(rows, None).select("feature", ((F.col("pos") + F.col("neg")) / F.lit(float(ONE))).alias("n"))
    characters = CharacterModel({r.feature: r.n for r in sorted(grams.collect())})
    model = ToxicityModel(characters, {})
    model.share = sizes.get(1, 0) / total if total else 0.0
    counted = materialise(_counted(rows, characters))
    of_all = counted.where("feature = ''").collect()
    pos, neg = (of_all[0].pos / ONE, of_all[0].neg / ONE) if of_all else (0, 0)
    if pos and neg:
        counted = counted.select("feature", *((F.col(c) / F.lit(float(ONE))).alias(c) for c in ("pos", "neg")))
        tries = counted.where(F.col("pos") + F.col("neg") >= 5).count()  # rarer ones can't pass the test
        a, b = F.col("pos"), F.col("neg")
        base = pos / (pos + neg)
        part = lambda n, share: F.when(n > 0, n * F.log(n / (share * (a + b)))).otherwise(0.0)
        ratio = 2 * (part(a, F.lit(base)) + part(b, F.lit(1 - base)))
        odds = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (neg + 1))
        best = counted.where((F.col("feature") != "") & (a >= 3) & (odds > 1.5) & (ratio > 2 * math.log(max(tries, 2)))).select("feature", odds.alias("odds"))
        model.weigh({r.feature: r.odds for r in sorted(best.collect())})
        # copies count less: classes have their own sizes again
        rate = np.array([sizes[0] / neg, sizes[1] / pos])
        rate = rate * (pos + neg) / (rate @ [neg, pos])
        model.logistic = fit_logistic(materialise(_summed(rows, model)), ["a", "b", "c"], {0: float(rate[0]), 1: float(rate[1])}, ridge=0.01)
    return model


def _summed(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.array([shared.value.summary(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(out[:, k].copy()) for k in range(3))], names=["y", "weight", "a", "b", "c"])

    return rows.select("text", "y", "weight").mapInArrow(work, "y int, weight long, a double, b double, c double")


def score_documents(df: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """df with the score of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(name)
    at = df.columns.index("text")
    schema = df.withColumn(name, F.lit(0.0)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            model = shared.value
            out = np.array([model.summary(t.as_py() or "") for t in batch.column(at)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(out))], names=schema.names)

    return df.mapInArrow(work, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs, model)
    return out.select("doc_id", (crc_class(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
