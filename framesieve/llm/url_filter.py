"""URL filter: a trie over reversed host labels and then path segments, with longest-match precedence.

A rule is a host, optionally followed by "/" and a path: it fits that host and all its subdomains where
the URL's path starts with the rule's path, character by character; A-Z in hosts count as a-z, in rules too.  Of the rules that fit, the one with
the most host labels wins, then the one with the longest path; a rule that is both allowed and blocked is blocked.

Defined results: a null URL or one without "://" has an empty host and path, which only a rule with an
empty host fits; without a fitting rule the verdict is the default.  Rows are judged one by one: repeated
rows give repeated results, an empty table an empty one, and other columns are kept only on request.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize

#: Characters of rules (and 64 for each) that one broadcast trie is made of; it takes about eight times as much memory.
SHARD_CHARS = 8 << 20
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UPPER_CASE, LOWER_CASE)


class UrlTrie:
    """Nodes are numbers; edges, and the rules that end at a node or within one of its segments, are entries of a
    dictionary for all nodes.  The path of a host's node is reached by an edge named None."""

    def __init__(self, allow: Iterable[str] = (), block: Iterable[str] = ()):
        self.size = 1
        self.labels: dict[tuple[int, str | None], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        self.ends: dict[tuple[int, str], tuple[str, str]] = {}
        self.longest: dict[int, int] = {}
        self.host_rules: dict[int, tuple[str, str]] = {}
        for verdict, rules in (("allow", allow), ("block", block)):  # block comes last and wins ties
            for rule in rules:
                self._add(rule, verdict)

    def _next(self, edges: dict, key: tuple) -> int:
        node = edges.setdefault(key, self.size)
        self.size += node == self.size
        return node

    def _add(self, rule: str, verdict: str) -> None:
        host, slash, path = rule.partition("/")
        node = 0
        for label in reversed(host.translate(LOWER).split(".")) if host else ():
            node = self._next(self.labels, (node, label))
        if not slash:
            self.host_rules[node] = (rule, verdict)
            return
        node = self._next(self.labels, (node, None))
        *whole, last = path.split("/")
        for segment in whole:
            node = self._next(self.segments, (node, segment))
        self.ends[node, last] = (rule, verdict)
        self.longest[node] = max(len(last), self.longest.get(node, 0))

    def match(self, host: str, path: str) -> tuple[tuple[int, int, bool], str, str] | None:
        """The deciding rule: of the deepest host that has any fitting path the longest one.  How deep and how long it is, and
        whether it blocks, say which of several tries' rules decides; then the rule and its verdict."""
        chain, node = [0], 0
        for label in reversed(host.split(".")) if host else ():
            node = self.labels.get((node, label))
            if node is None:
                break
            chain.append(node)
        for depth in range(len(chain) - 1, -1, -1):
            inner = self.labels.get((chain[depth], None))
            found = self._path(inner, path) if inner is not None and path.startswith("/") else None
            if found:
                return (depth, found[0], found[1][1] == "block"), *found[1]
            if chain[depth] in self.host_rules:
                rule, verdict = self.host_rules[chain[depth]]
                return (depth, 0, verdict == "block"), rule, verdict
        return None

    def _path(self, node: int, path: str) -> tuple[int, tuple[str, str]] | None:
        """The longest rule that the path starts with, from a path's node on."""
        found, at = None, 1
        while node is not None:
            cut = path.find("/", at)
            segment = path[at:] if cut < 0 else path[at:cut]
            # the longest beginning of this segment at which a rule ends
            for k in range(min(len(segment), self.longest.get(node, -1)), -1, -1):
                if (node, segment[:k]) in self.ends:
                    found = at + k, self.ends[node, segment[:k]]
                    break
            if cut < 0:
                return found
            node, at = self.segments.get((node, segment)), cut + 1
        return found


def _shards(allow: list[str], block: list[str]) -> list[tuple[list[str], list[str]]]:
    """The rules in parts of at most SHARD_CHARS each (but for one rule's own length)."""
    out, size = [([], [])], 0
    for side, rules in enumerate((allow, block)):
        for rule in rules:
            size += len(rule) + 64
            if size > SHARD_CHARS and (out[-1][0] or out[-1][1]):
                out.append(([], []))
                size = len(rule) + 64
            out[-1][side].append(rule)
    return out


def filter_urls(pages: DataFrame, allow: list[str], block: list[str], keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """The kept columns, host, path, rule (null without one) and verdict of every row.  Rules beyond one trie's size come in
    further passes, each with a trie of its own; the deepest host and longest path of all decides."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    rows = pages.select(
        *keep,
        F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER_CASE, LOWER_CASE).alias("host"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    shards = _shards(allow, block)
    (best,) = fresh([*keep, "host", "path", "rule", "verdict"], "__best")
    extra = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField(best, T.ArrayType(T.IntegerType()))]
    kind = pa.list_(pa.int32())

    def judged(rows: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
        trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(*shards[k]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rules = trie.value
            for batch in batches:
                found = [rules.match(*pair) for pair in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                if k:
                    before = zip(batch.column(best).to_pylist(), batch.column("rule").to_pylist(), batch.column("verdict").to_pylist(), strict=True)
                    found = [max((x for x in (f, b[0] and (tuple(b[0]), *b[1:])) if x), key=lambda x: tuple(map(int, x[0])), default=None) for f, b in zip(found, before, strict=True)]
                columns = [pa.array([f and f[1] for f in found], pa.string()), pa.array([f[2] if f else default for f in found], pa.string()), pa.array([f and list(map(int, f[0])) for f in found], kind)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "rule", "verdict", best])

        kept = [c for c in rows.columns if c not in ("rule", "verdict", best)]
        return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *extra])), trie

    made, trie = judged(rows, 0)
    for k in range(1, len(shards)):  # what a pass found is written before the next trie is sent
        written = materialize(made)
        trie.unpersist()
        made, trie = judged(written, k)
    return made.drop(best)
