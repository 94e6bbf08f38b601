"""URL filtering by a bit-parallel wildcard automaton (multiword Shift-And).

A URL is made canonical as "." + host + path (host lower-cased; query and fragment left out). Rules become globs over
that: `*` stands for any bytes but "/", `**` for any bytes. All globs are packed into 64-bit words, one bit for each
glob position and one for its start. With D the live positions, a byte c makes D = ((D << 1) & B[c]) | (D & L[c]): B
has the positions whose byte is c, L those at which a wildcard may take c. A batch of URLs advances together, byte by
byte. Site rules decide by their longest glob that fits; where none fits, the pattern list decides; else the URL is allowed.

The rule tables are parameters of the call and are broadcast in the closure; their size is that of the lists given.
Null URLs, or URLs without "://", have an empty host and path, fit no site rule and are allowed. URLs are read whole,
however long: a batch takes as many steps as its longest URL has bytes, each over the URLs that are that long. Of equally
long rules the first decides. Every row of the table, repeated or not, gets its row; an empty table gives none; further
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table

#: (verdict, host, path prefix)
SITE_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: (verdict, glob over the canonical form): tried in order where no site rule fits
PATTERNS = [("block", "*.spam**"), ("block", "**/wp-login.php"), ("block", "*.casino.*")]


class WildcardAutomaton:
    """Globs packed into words; matches() tells which globs fit each of a batch of byte strings."""

    def __init__(self, globs: list[str]):
        self.n = len(globs)
        bits: list[tuple[int | None, np.ndarray | None]] = []
        starts, self.final = [], []
        anything, segment = np.ones(256, dtype=bool), np.ones(256, dtype=bool)
        segment[ord("/")] = False
        for g in globs:
            starts.append(len(bits))
            bits.append((None, None))
            raw, k = g.encode(), 0
            while k < len(raw):
                if raw[k : k + 1] == b"*":
                    wide = raw[k : k + 2] == b"**"
                    old = bits[-1][1]
                    loop = anything if wide else segment
                    bits[-1] = (bits[-1][0], loop if old is None else old | loop)
                    k += 2 if wide else 1
                else:
                    bits.append((raw[k], None))
                    k += 1
            self.final.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.byte = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        one = np.uint64(1)
        for at in starts:
            self.start[at // 64] |= one << np.uint64(at % 64)
        for at, (c, loop) in enumerate(bits):
            bit = one << np.uint64(at % 64)
            if c is not None:
                self.byte[c, at // 64] |= bit
            if loop is not None:
                self.loop[loop, at // 64] |= bit

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean array: texts by globs."""
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        offs = np.concatenate([[0], np.cumsum(lens)])[:-1][order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sorted_lens = lens[order]
        live = np.tile(self.start, (len(texts), 1))
        for k in range(int(lens.max(initial=0))):
            m = int(np.searchsorted(-sorted_lens, -k, side="left"))  # so many texts are longer than k
            c = data[offs[:m] + k]
            d = live[:m]
            up = d << np.uint64(1)
            up[:, 1:] |= d[:, :-1] >> np.uint64(63)
            live[:m] = (up & self.byte[c]) | (d & self.loop[c])
        out = np.zeros((len(texts), self.n), dtype=bool)
        for j, at in enumerate(self.final):
            out[order, j] = (live[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1) > 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + path


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", site_rules: list = SITE_RULES, patterns: list = PATTERNS) -> DataFrame:
    """key, host, path, rule (host and path of the site rule that decides, else null) and verdict of every row."""
    ranked = sorted(site_rules, key=lambda r: -len(r[1] + r[2]))  # stable: the first of equally long rules decides
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton([f"*.{h}{p}**" for _, h, p in ranked] + [g for _, g in patterns])
        said = [v for v, *_ in ranked] + [v for v, _ in patterns] + ["allow"]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = automaton.matches([f".{h}{p}".encode() for h, p in parts])
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(said) - 1) if len(parts) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([ranked[k][1] + ranked[k][2] if k < len(ranked) else None for k in first.tolist()], pa.string()), pa.array([said[k] for k in first.tolist()], pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    return df.select(F.col(key), F.col(url)).mapInArrow(work, f"{key} {kind}, host string, path string, rule string, verdict string")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
c AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM b),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
k AS (SELECT row_number() OVER () AS n, * FROM c),
m AS (
  SELECT n, arg_max(verdict, length(rhost || rpath)) AS verdict, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
  FROM k JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN m.verdict
            WHEN regexp_matches('.' || host || path, '^[^/]*\.spam') THEN 'block'
            WHEN regexp_matches('.' || host || path, '(?s)/wp-login\.php$') THEN 'block'
            WHEN regexp_matches('.' || host || path, '^[^/]*\.casino\.[^/]*$') THEN 'block'
            ELSE 'allow' END AS verdict
FROM k LEFT JOIN m USING (n)
"""
