"""URL rules by a sort-merge range join (op 10).

A host is keyed by its labels in reverse, each followed by a dot, so that a
host and its subdomains are one interval of the sorted keys: that of the
prefix. Rules become such intervals, one per host, with their path prefixes
inside. URLs are cut into ranges of (key, page_id); a rule goes to every range
that its interval meets. Within a range rules and URLs are merged in key order
while a stack holds the rules whose intervals are open; they are nested, so a
URL meets exactly the rules of its host and of the domains above it.

The ranges are cut at quantiles of a bounded sample of URLs (``CUT_SAMPLE`` per
range; only the balance depends on it). The page id is part of the order, so
even one URL that makes up a third of the table is spread over many ranges. A
range receives the rules that begin in it plus those open at its start, of
which there are at most as many as labels in a host, times the paths of a host.

Defined results: a null url or one without ``://`` has empty host and path and
meets no rule; of several fitting rules the longest (host plus path) wins, then
the one with the longer host; if equal rules differ in the verdict, block wins;
without a rule the verdict is ``DEFAULT``. Null page ids and repeated rows are
kept; null hosts, paths or verdicts in rules drop the rule; further columns are
ignored.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
CUT_SAMPLE = 16
RANGES_PER_PARTITION = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` becomes ``com.example.www.``; an empty host stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _after(key: str) -> str:
    """The first key beyond all that start with ``key``."""
    return key[:-1] + chr(ord(key[-1]) + 1)


class Stack:
    """Open host intervals, outermost first; each holds its path rules."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, {}, []))
        _, paths, lengths = self.frames[-1]
        if path not in paths or verdict == "block":
            paths[path] = (host + path, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def match(self, key: str, path: str) -> tuple[str | None, str]:
        self.close(key)
        best: tuple[str | None, str] = (None, DEFAULT)
        for _, paths, lengths in reversed(self.frames):
            found = next((paths[path[:n]] for n in lengths if n <= len(path) and path[:n] in paths), None)
            if found and (best[0] is None or len(found[0]) > len(best[0])):
                best = found
        return best


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id,
    url). ``rules``: (host, path, verdict)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
            .select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host"))))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce("page_id", F.lit(_NO_ID))
    sample = (urls.select("key", order.alias("id")).orderBy(F.xxhash64("id", "key"), "id", "key")
              .limit(CUT_SAMPLE * ranges).collect())
    sample = sorted((r["key"], r["id"]) for r in sample)
    cuts = sorted(set(sample[CUT_SAMPLE::CUT_SAMPLE]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["page_id"].astype("Int64").fillna(_NO_ID)
            yield pdf.assign(range=[bisect_right(cuts, (k, i)) for k, i in zip(pdf["key"], ids, strict=True)])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["range"] = [list(range(bisect_right(cuts, (k, _NO_ID)), bisect_left(cuts, (_after(k), _NO_ID)) + 1)) for k in pdf["key"]]
            yield pdf.explode("range").astype({"range": "int32"})

    dealt = urls.withColumn("kind", F.lit(1)).withColumn("verdict", F.lit(None).cast("string"))
    shape = "page_id long, host string, path string, key string, kind int, verdict string"
    dealt = dealt.select("page_id", "host", "path", "key", "kind", "verdict").mapInPandas(place, f"{shape}, range int")
    known = (rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
             .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").distinct()
             .select(F.lit(None).cast("long").alias("page_id"), "host", "path", host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "verdict"))
    known = known.mapInPandas(spread, f"{shape}, range int")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack = None, Stack()
        for pdf in batches:
            rows = []
            ids = pdf["page_id"].astype("Int64")
            for rng, key, kind, page, host, path, verdict in zip(pdf["range"], pdf["key"], pdf["kind"], ids, pdf["host"], pdf["path"], pdf["verdict"], strict=True):
                if rng != now:
                    now, stack = rng, Stack()
                if kind:
                    rows.append((None if page is pd.NA else page, host, path, *stack.match(key, path)))
                else:
                    stack.open(key, host, path, verdict)
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

    merged = (dealt.unionByName(known).repartition("range")
              .sortWithinPartitions("range", "key", "kind", "page_id"))
    return merged.mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")
