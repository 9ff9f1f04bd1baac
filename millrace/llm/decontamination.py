"""Benchmark decontamination by winnowing: shared spans between training texts and benchmark items.

A shared span of `n` words holds `n - k + 1` hashed runs of `k` words.  Both sides keep the smallest hash of each such
window, so a shared span has a fingerprint in common for certain.  Fingerprints are joined; each hit is then extended
to the windows around it, which are compared word by word, so a chance hit of hashes changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, named

#: Everything below U+0080 that is neither a digit nor a letter.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A string of Spark has less than 2^31 bytes and a word with its break at least 2, so 30 bits hold any position.
_POS_BITS = 30
_POS_MASK = (1 << _POS_BITS) - 1


def words(text: Column) -> Column:
    """Words of a text as they stand; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def _exact_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; `lower` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _gram_size(n: int) -> int:
    return (n + 1) // 2


def _fingerprints(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows (keys, hash, pos) of the winnowed fingerprints of column `text`, for spans of `n` words.

    A fingerprint packs 34 bits of the hash above 30 bits of its position, so that the smallest value of a window is
    its smallest hash, the leftmost of equals.  Case folds as in the comparison; `lower` by itself would look at what stands around a letter.
    """
    k = _gram_size(n)
    window = n - k + 1
    cut_words = df.select(*keys, words(_exact_lower(F.col("text"))).alias("w")).where(F.size("w") >= n)
    grams = F.transform(
        F.sequence(F.lit(0), F.size("w") - k),
        lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)]).bitwiseAND(F.lit(~_POS_MASK)).bitwiseOR(i.cast("long")),
    )
    grammed = cut_words.select(*keys, grams.alias("g"))
    if window == 1:
        kept = F.col("g")
    else:
        kept = F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size("g") - window), lambda i: F.least(*[F.get("g", i + j) for j in range(window)])))
    rows = grammed.select(*keys, F.explode(kept).alias("p"))
    return rows.select(
        *keys, F.shiftright("p", _POS_BITS).alias("hash"), F.col("p").bitwiseAND(F.lit(_POS_MASK)).cast("int").alias("pos"))


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows of all items with their length in words and the sorted ids of the items that hold them."""
    cut_words = items.select("item_id", words(_exact_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    sized = cut_words.select("item_id", "w", F.least(F.size("w"), F.lit(n)).alias("span"))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("span")))
    windows = sized.select("item_id", "w", "span", starts.alias("s")).select(
        "item_id", "span", F.array_join(F.slice("w", F.col("s") + 1, F.col("span")), " ").alias("window"))
    return windows.groupBy("window", "span").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def contamination(
    docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Hit windows of every document: `doc_id, text_hash, n_words, windows array<struct<start,end>>, items array`.

    A window is `n` words of an item that follow each other; an item of fewer words, but at least one, is one window.
    Words are runs without ASCII punctuation and white space, with A-Z in lower case.  `windows` are the word ranges of
    a document (end exclusive, in order) that equal a window; `items` the ids of the items that hold them.

    Null texts have no words.  Rows that repeat both id and text are one document and give one row; other texts under
    the same id, or under a null id, are documents of their own.  An item without id marks words, but is not listed.
    No items, or no words in them, give every document without hits.  Other columns are not looked at.

    The only job that runs at once reads which window lengths the items have: at most `n` numbers.
    """
    texts = named(docs, doc_id=doc_id, text=text)
    base = texts.withColumn("text_hash", F.xxhash64("text"))
    known = named(items, item_id=item_id, text=item_text)
    item_windows = _item_windows(known, n)
    spans = sorted(r[0] for r in item_windows.select("span").distinct().collect())
    counted = base.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("long").alias("n_words")).distinct()
    if not spans:
        none = F.array().cast("array<struct<start:int,end:int>>")
        ids = F.array().cast(f"array<{known.schema['item_id'].dataType.simpleString()}>")
        return counted.select("doc_id", "text_hash", "n_words", none.alias("windows"), ids.alias("items"))

    hits = None
    for span in spans:
        k = _gram_size(span)
        of_items = known.where(F.least(F.size(words(F.col("text"))), F.lit(n)) == span)
        wanted = _fingerprints(of_items, span).select("hash").distinct()
        found = _fingerprints(base, span, "doc_id", "text_hash").join(wanted, "hash", "left_semi").select(
            "doc_id", "text_hash", F.lit(span).alias("span"), (F.col("pos") - (span - k)).alias("first"), F.col("pos").alias("last"))
        hits = found if hits is None else hits.unionByName(found)
    by_doc = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
        F.collect_set(F.struct("span", "first", "last")).alias("hits"))

    same_doc = F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_hash").eqNullSafe(F.col("hit_hash"))
    suspects = base.join(by_doc, same_doc).select("doc_id", "text_hash", "hits", words(_exact_lower(F.col("text"))).alias("w"))
    around = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(
        F.sequence(F.greatest(h["first"], F.lit(0)), F.least(h["last"], F.size("w") - h["span"])),
        lambda s: F.struct(h["span"].alias("span"), s.alias("start"))))))
    extended = suspects.select("doc_id", "text_hash", "w", F.explode(around).alias("x")).select(
        "doc_id", "text_hash", F.col("x.span").alias("span"), F.col("x.start").alias("start"),
        F.array_join(F.slice("w", F.col("x.start") + 1, F.col("x.span")), " ").alias("window"))
    matched = extended.join(item_windows, ["window", "span"]).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("span")).alias("end")))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    right = matched.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "windows", "items")
    return counted.join(right, same_doc, "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("windows", F.array().cast(right.schema["windows"].dataType)).alias("windows"),
        F.coalesce("items", F.array().cast(right.schema["items"].dataType)).alias("items"))


def covered(windows: Column) -> Column:
    """Words inside at least one of the sorted ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(windows, start, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["end"], x["start"].cast("long")))).alias("n"),
        F.greatest(acc["end"], x["end"].cast("long")).alias("end")))
    return total["n"]


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The documents that hold no window of a benchmark item, as they came: all columns, repeated rows and null ids too."""
    hit_id, hit_hash = free_name(docs, "hit_id"), free_name(docs, "hit_hash")
    found = contamination(docs, items, n).where(F.size("windows") > 0).select(
        F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash))
    same_doc = docs["doc_id"].eqNullSafe(F.col(hit_id)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(hit_hash))
    return docs.join(found, same_doc, "left_anti")
