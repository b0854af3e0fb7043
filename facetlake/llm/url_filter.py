"""URL rules in a trie over reversed host labels and path segments.

A rule is ``host/path`` (or a bare ``host``) with a verdict. It fits its host and all subdomains if
the URL's path starts with the rule's path, character by character (hosts without regard to the case of A-Z): the last
segment of a rule may be the beginning of a segment. The longest fitting rule
wins: first the one with more host labels, then the one with the longer path.

The trie is broadcast, as block lists are lists of rules and not data; ``build``
checks its size against ``max_rules`` and refuses a larger one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


class Trie:
    """Nodes are dictionaries: by label below a host, by segment below a path."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, rule: str, verdict: str) -> None:
        host, slash, path = rule.partition("/")
        node = self.root
        for label in reversed(host.translate(LOWER).split(".")) if host else []:
            node = node.setdefault(("label", label), {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(("segment", segment), {})
        if not slash:
            self.size += "all" not in node
            node["all"] = (rule, verdict)
            return
        # The last segment is a beginning: kept by length, so that the longest is tried first.
        ends = node.setdefault("ends", {})
        self.size += last not in ends
        ends[last] = (rule, verdict)
        node["lengths"] = sorted({len(e) for e in ends}, reverse=True)

    def _path(self, node: dict, path: str) -> tuple[str, str] | None:
        """The rule with the longest path below one host node."""
        best = node.get("all")
        if not path.startswith("/"):
            return best
        rest = path[1:].split("/")
        for segment in rest:
            for n in node.get("lengths", ()):
                hit = node["ends"].get(segment[:n]) if n <= len(segment) else None
                if hit:
                    best = hit
                    break
            node = node.get(("segment", segment))
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, self._path(self.root, path)
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            best = self._path(node, path) or best
        return best


def build(rules: Iterable[tuple[str, str]], max_rules: int = 1_000_000) -> Trie:
    """A trie of (rule, verdict); a rule given twice has its last verdict."""
    trie = Trie()
    for rule, verdict in rules:
        trie.add(rule, verdict)
        if trie.size > max_rules:
            raise ValueError(f"more than {max_rules} rules: too many to broadcast")
    return trie


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, trie: Trie, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on every URL; one row for each row of ``pages``.

    Returns (id_col, host, path, rule, verdict). A null URL and one without ``://``
    have empty host and path. Without a fitting rule ``rule`` is null and the
    verdict is ``default``. A path without a leading ``/`` fits only rules that
    have no ``/``.
    Other columns are not read; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = sent.value.match
        for batch in batches:
            hits = [match(h, p) or (None, default) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rule, verdict = ([h[k] for h in hits] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    parts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    kind = pages.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
