"""Byte-pair encoding and decoding by a tokenization automaton over the merges of a given vocabulary file.

The automaton reads tokens. It starts with one state that has an arc for every byte, and each merge (u, v) -> w adds
its gadget, in order of rank:

* the state after u is split from all that share it, and its copy has no arc v any more (u v is now written w);
* w gets an arc wherever u has one, to the state that v led to just then.

After the last gadget the automaton accepts, for every string, exactly one token sequence: the one that the merges
make. The state after a token depends on that token alone, so that states are named by tokens; a state keeps the
tokens that its own gadgets took away with their ranks, and shares those that came before it was split with the state
it was split from. An arc for w was made from the arc for its left part, so an arc is there if none of the gadgets up
to that time had taken the part away.

A pre-split word is encoded by running it through the table of transitions: at each byte position one state is live
(the prefix has one accepted reading), and every token that starts there and that the state has an arc for makes the
state at its end live. Decoding emits the bytes on the arcs.

Null texts are encoded as empty ones (no tokens, digests of the empty string); rows keep their doc_id, null or
repeated; further columns take no part.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import slices, table

#: How byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its words at so many.
MEMO_WORDS = 200_000
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class TokenAutomaton:
    """The automaton of a vocabulary: `ids` by bytes, `arcs` emitted by id, and the gadgets by state."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = dict(special or {})
        self.ids = dict(vocab)
        size = max([*self.ids.values(), *self.special.values()], default=-1) + 1
        self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size
        self.born = array("i", [-1]) * size
        self.cut: dict[int, int] = {}
        self._table: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, self.ids[u], self.ids[v], self.ids[u + v])
        self.arcs = [b""] * size
        for text, i in self.ids.items():
            self.arcs[i] = text
        for text, i in self.special.items():
            self.arcs[i] = text.encode()
        # tokens that no gadget gave an arc are never read
        self.live = {t: i for t, i in self.ids.items() if len(t) == 1 or self.born[i] >= 0}
        self.longest = max(map(len, self.live), default=1)
        #: token lengths that occur for a first pair of bytes, shortest first
        lengths: dict[bytes, set[int]] = {}
        for t in self.live:
            lengths.setdefault(t[:2], set()).add(len(t))
        self.lengths = {k: sorted(x for x in v if x > 1) for k, v in lengths.items() if len(k) == 2}
        self._split = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """u's state loses v at this rank; w is born with u's arcs, and shares v's state as it is now."""
        if (u << 32 | v) in self.cut or self.born[w] >= 0:
            return  # a merge that can't apply: an earlier one takes the pair, or makes the token
        if not self._arc(u, rank, v):
            self.cut[u << 32 | v] = rank
            return
        self.cut[u << 32 | v] = rank
        self.left[w], self.right[w], self.born[w] = u, v, rank

    def _arc(self, state: int, now: int, token: int) -> bool:
        """Had the state after `state`, as it was before rank `now`, an arc for token?

        Walks back both ways in time: the state was shared with its right part's before its own birth, and the
        token's arc was made from its left part's arc at its birth. Of the two the later gadget is undone first.
        """
        cut, born = self.cut, self.born
        limit = now
        while True:
            if cut.get(state << 32 | token, NEVER) < limit:
                return False
            bs, bt = born[state], born[token]
            if bs < 0 and bt < 0:
                return True
            if bs > bt:
                limit, state = min(limit, bs), self.right[state]
            else:  # a gadget takes the pair away before it gives arcs to w, which tells where u = v
                limit, token = min(limit, bt + 1), self.left[token]

    def step(self, state: int, token: int) -> bool:
        """The transition table: is there an arc from the state after `state`? Filled when first asked."""
        key = state << 32 | token
        out = self._table.get(key)
        if out is None:
            if len(self._table) > 2 * MEMO_WORDS:
                self._table.clear()
            out = self._table[key] = self._arc(state, NEVER, token)
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Run one pre-split word through the automaton, longest arcs first.

        A prefix has one accepted reading, so a position that was reached is never tried again.
        """
        live = self.live
        n = len(word)
        if n == 1:
            return [live[word]]
        lengths, step = self.lengths, self.step
        seen = bytearray(n + 1)
        path: list[int] = []
        todo = [(0, -1, 0)]  # from, token that leads here, depth
        while todo:
            at, token, depth = todo.pop()
            if at and (seen[at] or (depth > 1 and not step(path[depth - 2], token))):
                continue
            del path[max(0, depth - 1) :]
            if at:
                seen[at] = 1
                path.append(token)
                if at == n:
                    return path
            depth += 1
            todo.append((at + 1, live[word[at : at + 1]], depth))
            for k in lengths.get(word[at : at + 2], ()):
                end = at + k
                if end > n:
                    break
                t = live.get(word[at:end])
                if t is not None and not seen[end]:
                    todo.append((end, t, depth))
        raise ValueError("the vocabulary lacks a byte")

    def _word(self, word: str) -> bytes:
        out = array("I", self.encode_word(word.encode())).tobytes()
        if len(self._memo) > MEMO_WORDS:
            self._memo.clear()
        if len(word) < 40:
            self._memo[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self._special.split(text) if self._special and any(s in text for s in self.special) else [text]
        out, memo, word = [], self._memo, self._word
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                for x in self._split.findall(part):
                    y = memo.get(x)
                    out.append(word(x) if y is None else y)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.arcs.__getitem__, array("I", ids))).decode("utf-8", errors="replace")


def load_automaton(path: str) -> TokenAutomaton:
    """Compile a vocabulary file (JSON with model.vocab, model.merges and added_tokens)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    return TokenAutomaton(vocab, merges, special)


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, digests of the ids and of the decoded text; with_ids adds the ids (array of long).

    The automaton is compiled on the driver and broadcast; its size is that of the vocabulary.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_automaton(path))
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in slices(batches):
            count, a, b, lists = [], [], [], []
            for t in batch.column(1):
                ids = auto.encode(t.as_py() or "")
                count.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(auto.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(list(array("I", ids)))
            cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return df.select(F.col(key), F.col(text)).mapInArrow(work, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
