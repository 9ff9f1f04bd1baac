"""URL rules by cascades of Bloom filters.

The first level of a cascade encodes the listed keys.  The second encodes the keys of the corpus that the first takes for
listed though they aren't, the third the listed keys that the second takes for those, and so on, until none is mistaken.
Every key that the corpus can ask for went through the building, so the answer of the cascade is exact for all of them,
and urls are judged by the filters alone, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, free_name, named

#: Share of keys that a level after the first mistakes.
RATE = 1 / 16
#: The first level mistakes about as many keys of the corpus as are listed, but this share at most.
MOST_RATE = 0.25
#: Bytes of filters that are broadcast at once; the keys of longer lists are dealt over several cascades by a hash.
MAX_BYTES = 1 << 26
#: Levels after which a cascade is not to be had: keys that share 128 bits of hash.
MAX_LEVELS = 64
#: Bits of a part of a filter, as Spark's bitmap functions cut them.
_PART = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


class Level(NamedTuple):
    seed: int
    bits: int
    hashes: int
    data: np.ndarray  # bytes


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 bits scattered anew for each seed."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _spots(h1: np.ndarray, h2: np.ndarray, seed: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """Bits of keys at a level, one hash after the other."""
    a, b = _mixed(h1, seed), _mixed(h2, seed) | np.uint64(1)
    for _ in range(hashes):
        yield (a % np.uint64(bits)).astype(np.int64)
        with np.errstate(over="ignore"):
            a = a + b


def _within(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether a level takes keys for its own."""
    held = np.ones(len(h1), bool)
    for at in _spots(h1, h2, level.seed, level.bits, level.hashes):
        held &= (level.data[at >> 3] >> (at & 7) & 1).astype(bool)
    return held


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys are listed: a key that first fails at level 2, 4, ... is, one that fails at 1, 3, ... is not."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    left = np.arange(len(h1))
    for i, level in enumerate(levels):
        held = _within(level, h1[left], h2[left])
        out[left[~held]] = i % 2 == 1
        left = left[held]
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit("a"), key), F.xxhash64(F.lit("b"), key)]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits, a multiple of 8, and hashes of a filter of `n` keys that mistakes the given share of others."""
    hashes = max(1, round(math.log2(1 / rate)))
    return max(64, -(-int(n * hashes * 1.4427 + 8) // 8) * 8), hashes


def _level(keys: DataFrame, n: int, seed: int, rate: float) -> Level:
    """The filter of `n` keys (h1, h2).  Tasks send bits, which Spark gathers into bitmaps before and after the shuffle."""
    bits, hashes = _shape(n, rate)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = _unsigned(batch.column(0)), _unsigned(batch.column(1))
            at = np.unique(np.concatenate(list(_spots(h1, h2, seed, bits, hashes))))
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["at"])

    parts = keys.select("h1", "h2").mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    data = np.zeros(-(-bits // _PART) * _PART // 8, np.uint8)
    for row in parts.collect():  # as many bytes as the filter has
        first = (row["part"] - 1) * _PART // 8
        data[first:first + _PART // 8] = np.frombuffer(row["bits"], np.uint8)
    return Level(seed, bits, hashes, data)


def _mistaken(keys: DataFrame, level: Level) -> DataFrame:
    """Keys that a level takes for its own."""
    sent = keys.sparkSession.sparkContext.broadcast(tuple(level))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, bits, hashes, data = sent.value
        for batch in batches:
            held = _within(Level(seed, bits, hashes, data), _unsigned(batch.column(1)), _unsigned(batch.column(2)))
            yield batch.filter(pa.array(held))

    return keys.select("key", "h1", "h2").mapInArrow(run, "key string, h1 long, h2 long")


def cascade(keys: DataFrame, universe: DataFrame, rate: float = RATE) -> list[Level]:
    """The levels that tell the listed `keys` (key, distinct) from all others of the `universe` (key, repeated at will).

    The universe is never shuffled: its keys pass the first filter where they are, and only those that it holds go on.
    Of them, those that are listed are told by their texts.  No listed key gives no level, and nothing is listed.
    """
    own = cut(keys.select("key", *[h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"))]))
    n = own.count()
    if not n:
        return []
    others = universe.select("key", *[h.alias(x) for h, x in zip(_hashes(F.col("key")), ("h1", "h2"))])
    asked = others.agg(F.approx_count_distinct("h1")).first()[0]
    levels = [_level(own, n, 0, min(MOST_RATE, max(n / max(asked, 1), 2.0**-30)))]
    wrong = cut(_mistaken(others, levels[0]).distinct().join(own.select("key"), "key", "left_anti"))
    held = own
    while (n := wrong.count()):
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError(f"{n} keys are mistaken at every level")
        levels.append(_level(wrong, n, len(levels), rate))
        # What the new level encodes is what the next one must not mistake.
        held, wrong = wrong, cut(_mistaken(held, levels[-1]))
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case, and then up to
    `?`, `#` or the end.  Both are empty for a null url and one without `://`."""
    host = F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """Keys that rules of the given shapes (labels of the host, characters of the path) would have for `host` and `path`.

    A host that has fewer labels gives itself, which is no key of such a rule.
    """
    found = [F.when(F.length("path") >= size, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, size)))
             for labels, size in shapes]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """All rows and columns of `urls` with `host, path, rule, verdict` (columns of these names are replaced).

    `rules` has `host, path, verdict`: a rule fits its host and all subdomains, if the url's path starts with the rule's.
    Hosts of rules are taken with A-Z in lower case.  The rule with the longest text wins, of equally long ones that with
    the longer host; the same rule with several verdicts has the one that comes first in the alphabet.  `rule` is host and
    path of the rule as one text, null where none fits, and then the verdict is `default`: a url that no list holds.
    Rules with a null in any column or without a host fit nothing.  No rule at all, null, empty and very long urls,
    repeated rows and empty frames are no special case.

    Every verdict has a cascade over the keys that the urls have for it.  Which keys a url has follows from the shapes of
    rules (how many labels, how long a path), of which lists have few, however long they are.  Filters of a list take at
    most about 8 bytes a rule and grow with the logarithm of the corpus; more than `max_bytes` of them are sent one part after
    the other, parts being dealt by a hash of the key, with the urls written in between.
    """
    spark = urls.sparkSession
    own = named(rules, host="host", path="path", verdict="verdict").dropna().where("host <> ''").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    keyed = cut(own.groupBy(F.concat("host", "path").alias("key"), (F.size(F.split("host", r"\.")).alias("labels")),
                            F.length("path").alias("size")).agg(F.min("verdict").alias("verdict")))
    shapes = sorted((r[0], r[1]) for r in keyed.select("labels", "size").distinct().collect())
    verdicts = sorted(r[0] for r in keyed.select("verdict").distinct().collect())
    names = [free_name(urls, c) for c in ("url_keys", "url_hits", "url_hash")]
    host, path = url_parts(F.col(f"`{url}`"))
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # Long before the first level is built, so that its size is known: n keys at up to log2(keys of the corpus) bits.
    parts = max(1, math.ceil(keyed.count() * 8 / max_bytes))
    part_of = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))
    ready = urls.withColumns({names[2]: host, names[1]: path}).select(
        *[F.col(f"`{c}`") for c in kept], F.col(names[2]).alias("host"), F.col(names[1]).alias("path"))
    candidates = _candidates(shapes)
    split = ready.withColumn(names[0], candidates)
    asked = split.select(F.explode(names[0]).alias("key"))
    hit = F.lit(None).cast("struct<size:int,host:int,rule:string,verdict:string>")
    out = ready.withColumn(names[1], hit)
    for part in range(parts):
        # A cascade answers for the keys of its universe only, so each key is asked of the cascades of its own part.
        chosen = (lambda c: c) if parts == 1 else (lambda c: c.where(part_of(F.col("key")) == part))
        found = {v: cascade(chosen(keyed.where(F.col("verdict") == v).select("key")), chosen(asked)) for v in verdicts}
        keys = candidates if parts == 1 else F.filter(candidates, lambda k: part_of(k) == part)
        out = _hit(out, keys, names, {v: [tuple(x) for x in c] for v, c in found.items()}, spark)
        if part + 1 < parts:
            out = cut(out)
    return out.withColumns({"rule": F.col(f"{names[1]}.rule"), "verdict": F.coalesce(F.col(f"{names[1]}.verdict"), F.lit(default))}).drop(names[1])


def _hit(out: DataFrame, asked: Column, names: list[str], found: dict[str, list[tuple]], spark) -> DataFrame:
    """Rows with the better of the rule found so far and the best that these cascades hold."""
    keys, hits, hashes = names
    sent = spark.sparkContext.broadcast([found[v] for v in sorted(found)])

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades = [[Level(*x) for x in c] for c in sent.value]
        for batch in batches:
            pairs = batch.column(batch.num_columns - 1)
            flat = pairs.flatten()
            h1, h2 = _unsigned(flat.field("h1")), _unsigned(flat.field("h2"))
            which = np.zeros(len(flat), np.int32)
            for i, levels in enumerate(cascades, 1):
                which[listed(levels, h1, h2) & (which == 0)] = i
            at = pairs.offsets.to_numpy()
            marks = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(which))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], marks], [*batch.schema.names[:-1], hashes])

    split = out.withColumn(keys, asked)
    pair = lambda k: F.struct(*[h.alias(n) for h, n in zip(_hashes(k), ("h1", "h2"))])
    hashed = split.withColumn(hashes, F.transform(keys, pair)).drop(keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema.fields[:-1])
    marked = hashed.mapInArrow(test, f"{kinds}, `{hashes}` array<int>").withColumn(keys, asked)
    verdict = F.array(*[F.lit(v) for v in sorted(found)]) if found else F.array().cast("array<string>")
    fits = F.filter(F.arrays_zip(F.col(keys).alias("k"), F.col(hashes).alias("w")), lambda z: z["w"] > 0)
    best = F.array_max(F.transform(fits, lambda z: F.struct(
        F.length(z["k"]).alias("size"), F.length(F.substring_index(z["k"], "/", 1)).alias("host"), z["k"].alias("rule"),
        F.get(verdict, z["w"] - 1).alias("verdict"))))
    return marked.withColumn(hits, F.greatest(F.col(hits), best)).drop(keys, hashes)
