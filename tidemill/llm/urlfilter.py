"""URL verdicts: a blocked Bloom filter passes possible hits to an exact hash join; DataFrame operations only.

The list has two kinds of entries: rules (a host with its subdomains and a path prefix, written ``host/path``, allow or block)
and single listed URLs (block), which are canonical strings.  Rules are part of the query and few: for each shape that
occurs among them (labels of the host, characters of the path) a URL's host and path give one string, which is looked up in a
constant map, row by row.  Single URLs may be many.  A blocked Bloom filter holds them: 256-bit blocks of four words, eight bits a
key.  Up to ``MAX_BLOCKS`` blocks it is broadcast; a larger filter is dealt by ranges of blocks, and the URLs are shuffled to it.
URLs that it does not pass are done; those that it passes meet the list itself in a hash join, which removes
false positives.

The longest fitting rule decides (of equal ones the string that sorts first); without a rule, block if the URL is listed, else allow.
Null URLs and URLs without ``://`` have empty host and path, fit no rule and are allowed.  URLs are read whole, however long.  Rows that
repeat an id or a URL are judged one by one; an empty table or list is allowed, other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

WORDS, BITS = 4, 8
MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the module's rules read them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One string for the spellings of an address: no scheme, ``www.``/``m.`` prefix, query, fragment, ``.html`` or final slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def _place(key: Column, blocks: int) -> list[Column]:
    """The key's block, and its bits in each word of the block."""
    spots = F.xxhash64(key, F.lit(7))
    at = [F.shiftright(spots, 8 * i).bitwiseAND(255) for i in range(BITS)]
    words = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for p in at:
            word = word.bitwiseOR(F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"__w{w}"))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("__block"), *words]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows (block and four words), one for each block that holds a key."""
    placed = keys.select(*_place(F.col("key"), blocks))
    return placed.groupBy("__block").agg(*[F.expr(f"bit_or(__w{w})").alias(f"__f{w}") for w in range(WORDS)])


def flagged(probes: DataFrame, key: Column, keys: DataFrame, n_keys: int, most: int = MAX_BLOCKS, deal: bool = True) -> DataFrame:
    """``probes`` with the column ``__maybe``: false only if ``key`` is not among the ``key`` of ``keys``.

    Beyond ``most`` blocks the filter is not broadcast: with ``deal`` the probes are shuffled to it, without it every row may be a hit.
    """
    blocks = 1 << max(0, math.ceil(math.log2(max(n_keys, 1) / KEYS_PER_BLOCK)))
    if blocks > most and not deal:
        return probes.withColumn("__maybe", F.lit(True))
    held = bloom(keys, blocks)
    names = probes.columns
    placed = probes.select("*", *_place(key, blocks)).join(F.broadcast(held) if blocks <= most else held, "__block", "left")
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"__f{w}").bitwiseAND(F.col(f"__w{w}")) == F.col(f"__w{w}"))
    return placed.select(*[F.col(f"`{c}`") for c in names], F.coalesce(hit, F.lit(False)).alias("__maybe"))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule; null without one."""
    if not rules:
        return F.lit(None).cast("struct<n: int, rule: string, verdict: string>")
    table: dict[str, str] = {}
    for h, p, v in rules:
        table.setdefault(h + p, v)
    known = F.create_map(*[F.lit(x) for entry in sorted(table.items()) for x in entry])
    labels = F.split(host, r"\.")
    found = []
    for k, n in sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules}):
        own = F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n))
        fits = (F.size(labels) >= k) & (F.length(path) >= n) & (host != "") & F.map_contains_key(known, own)
        found.append(F.when(fits, F.struct((-F.length(own)).alias("n"), own.alias("rule"), F.element_at(known, own).alias("verdict"))))
    return F.array_min(F.array_compact(F.array(*found)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", most: int = MAX_BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row.

    ``rules``: (host, path prefix, allow or block), a host and a prefix given twice count as first given; ``listed``: canonical URL
    strings in the column ``key``.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("best", ruled(F.col("host"), F.col("path"), rules))
    result = ["page_id", "host", "path", F.col("best.rule").alias("rule")]
    if listed is None:
        return rows.select(*result, F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    keys = scratch.put(listed.select("key").filter("key is not null and key <> ''").distinct(), "listed")
    key = canonical(F.col("host"), F.col("path"))
    marked = flagged(rows.withColumn("url_key", key), F.col("url_key"), keys, keys.count(), most)
    marked = scratch.put(marked, "marked")
    asked = F.col("__maybe") & F.col("best").isNull()
    clear = marked.filter(~asked).select(*result, F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    exact = marked.filter(asked).join(keys.hint("shuffle_hash").withColumn("hit", F.lit(True)).withColumnRenamed("key", "url_key"), "url_key", "left")
    return clear.unionByName(exact.select(*result, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict")))
