"""URL filters by a Bloom filter cascade.

Level 0 encodes the listed keys; level 1 those keys of the corpus that level 0 lets through though they aren't listed; level 2 the
listed keys that level 1 lets through, and so on until no key is mistaken. For every key of the corpus the cascade then answers
membership exactly, without a join: the level at which a key drops out says which side it is on.

A key is a host suffix and a path prefix; those that a url can match are few (its labels times the rules' path lengths), and all keys
of all urls are the universe. Scale: two maps over the url column and one distinct of what level 0 lets through; level 0 is sized by
the universe's (approximate) count, so that what it lets through stays in the order of the list, which must fit the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Listed keys that a list may hold, as the list is built on the driver and broadcast as filters of a few bytes a key.
MOST_KEYS = 20_000_000
#: False positives of level 0 over the whole universe to expect for a list of few keys.
LET_THROUGH = 64


class Bloom:
    def __init__(self, n: int, rate: float, salt: int):
        rate = min(0.5, max(rate, 1e-12))
        self.size = max(64, math.ceil(max(n, 1) * -math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(-math.log2(rate)))
        self.salt = salt
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)

    def _places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=self.salt)
        a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def add(self, key: str) -> None:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1

    def complete(self, listed: set[str], passed: set[str]) -> Cascade:
        """Add levels below the first; ``passed``: the universe's keys that the first lets through."""
        mine, others = set(listed), passed - set(listed)
        while others:
            level = Bloom(len(others), 0.25, salt=len(self.levels))
            for key in others:
                level.add(key)
            self.levels.append(level)
            mine, others = others, {x for x in mine if x in level}
        return self


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), letters, letters.lower())


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """All keys that a url can match, the longest first: host and its parent domains, with the path's prefixes of the rules' lengths."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = [s + path[:n] for s in suffixes for n in lengths if n <= len(path)]
    return sorted(found, key=lambda x: -len(x))


def build(urls: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> dict[str, Cascade]:
    """A cascade for each verdict, exact for every key of ``urls`` (host, path)."""
    lengths = tuple(sorted({len(p) for _, _, p in rules}))
    lists: dict[str, set[str]] = {}
    for verdict, h, p in rules:
        lists.setdefault(verdict, set()).add(h + p)
    if sum(map(len, lists.values())) > MOST_KEYS:
        raise ValueError(f"lists of more than {MOST_KEYS} keys don't fit this operator")

    def universe(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = {k for h, p in set(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)) for k in keys_of(h, p, lengths)}
            yield {"key": sorted(keys)}

    keys = arrow_map(urls.select("host", "path"), universe, "key string")
    size = max(1, keys.agg(F.approx_count_distinct("key", 0.02)).first()[0])
    cascades = {}
    for verdict, own in lists.items():
        level = Bloom(len(own), max(len(own), LET_THROUGH) / size, salt=0)
        for key in own:
            level.add(key)
        cascades[verdict] = Cascade([level])
    first = urls.sparkSession.sparkContext.broadcast({v: c.levels[0] for v, c in cascades.items()})

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = sorted({(v, k) for k in batch.column("key").to_pylist() for v, level in first.value.items() if k in level})
            yield {"verdict": [v for v, _ in found], "key": [k for _, k in found]}

    passed: dict[str, set[str]] = {}
    for x in arrow_map(keys, passing, "verdict string, key string").distinct().toLocalIterator():
        passed.setdefault(x["verdict"], set()).add(x["key"])
    return {v: c.complete(lists[v], passed.get(v, set())) for v, c in cascades.items()}


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, the longest rule that fits (null: none) and its verdict.

    A rule fits its host and all subdomains, where the url's path starts with the rule's. Of rules that fit, the one with the longest host
    and path together wins; equally long ones can't fit the same url unless they are the same. What no list holds gets ``default``.
    Null and malformed urls have empty host and path and fit no rule but one with an empty host; very long ones are judged whole.
    Repeated rows each keep theirs, null ids too; an empty table gives no rows; other columns are ignored, whatever their names."""
    urls = pages.select("page_id", host().alias("host"), path().alias("path"))
    shared = urls.sparkSession.sparkContext.broadcast(build(urls, rules))
    lengths = tuple(sorted({len(p) for _, _, p in rules}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        cascades = shared.value
        for batch in batches:
            rule, verdict = [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                for key in keys_of(h, p, lengths):
                    on = next((v for v, c in cascades.items() if key in c), None)
                    if on is not None:
                        break
                else:
                    key, on = None, default
                rule.append(key)
                verdict.append(on)
            yield {x: batch.column(x) for x in ("page_id", "host", "path")} | {"rule": rule, "verdict": verdict}

    return arrow_map(urls, run, "page_id long, host string, path string, rule string, verdict string")
