"""Benchmark decontamination by SimHash windows (operator 4, native).

Texts are lower-cased and cut into words at anything that is not a letter or
digit; five-word shingles are hashed with XXH64 (shorter texts: one shingle of
all words).  A benchmark item of ``n`` shingles is compared with windows of
``n`` shingles of each document (a shorter document is one window).

1. *Window positions.*  A window can only reach the similarity if enough of its
   shingles belong to the benchmark: for equal sizes ``n`` a weighted Jaccard of
   at least ``s`` needs an overlap of ``2 n s / (1 + s)``.  Shingles are looked
   up in the benchmark's shingle vocabulary, and a window of size ``n`` is kept
   where that many hits fall inside it.  Sliding a window right to its next hit
   never lowers its overlap, so windows starting at hits (or ending at the end
   of the text) include the best one; this step loses no qualifying document.
2. *Candidates.*  Windows and items get 64-bit SimHash fingerprints.  The 64
   bits are cut into ``BLOCKS`` blocks; fingerprints at most ``RADIUS`` bits
   apart differ by at most ``RADIUS // BLOCKS`` bits in some block, so items
   index every block value within that distance and windows look up their own:
   all pairs within the radius meet.
3. *Check.*  Pairs within the radius are kept if the exact weighted Jaccard of
   their shingle multisets (weight: occurrences) is at least ``SIMILARITY``.

Everything is DataFrame expressions.  What grows with the documents is exploded
and joined against the benchmark's shingles; only matching rows travel.

Edge cases: NULL or empty texts on either side match nothing; repeated document
rows give the same findings once per (id, text); items with equal texts are
reported each; a document with a NULL ``doc_id`` is reported with NULL; an empty
benchmark or corpus gives no rows; other columns pass through or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.llm.common import fresh_names, let, small_side
from prospect.session import materialize, materialize_counted

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 10
_WIDTHS = [7, 7, 7, 7, 6, 6, 6, 6, 6, 6]
_SHIFTS = [sum(_WIDTHS[:i]) for i in range(BLOCKS)]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 hashes of the word shingles of ``text``, in order, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: _shingled(hashed, size))


def _shingled(hashed: Column, size: int) -> Column:
    n = F.size(hashed)
    many = F.transform(
        F.sequence(F.lit(1), n - (size - 1)),
        lambda i: F.xxhash64(*[F.element_at(hashed, i + k) for k in range(size)]))
    none = F.array().cast("array<long>")
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(hashed))).otherwise(none)


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array column: a bit is set when more than half of
    the hashes have it."""
    return F.expr(f"""
        aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(
            2 * aggregate({hashes}, 0, (c, h) -> c + cast(shiftrightunsigned(h, b) & 1L as int)) > size({hashes}),
            shiftleft(1L, b), 0L))""")


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger occurrence counts of two arrays."""
    shared = (f"aggregate(array_distinct({a}), 0, (acc, x) -> acc + least("
              f"size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")
    return F.expr(f"cast({shared} as double) / (size({a}) + size({b}) - {shared})")


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, _SHIFTS[k]).bitwiseAND(F.lit((1 << _WIDTHS[k]) - 1)).cast("int")


def _own_blocks(fp: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(fp, k).alias("value")) for k in range(BLOCKS)]))


def _near_blocks(fp: Column, reach: int) -> Column:
    """Every block value at most ``reach`` (0 or 1) bits from the item's."""
    out = []
    for k in range(BLOCKS):
        flips = [0] + ([1 << i for i in range(_WIDTHS[k])] if reach else [])
        out += [F.struct(F.lit(k).alias("block"), _block(fp, k).bitwiseXOR(F.lit(x)).alias("value")) for x in flips]
    return F.explode(F.array(*out))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, item_hashes, item_fp) of the items with words."""
    items = benchmark.select("item_id", shingle_hashes(F.col("text")).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    return items.select("item_id", F.size("item_hashes").alias("n"), "item_hashes", simhash("item_hashes").alias("item_fp"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n, distance, similarity): the best
    window of each document for each benchmark item it contains.  ``start`` is
    the window's first shingle, counted from 0."""
    if radius // BLOCKS > 1:
        raise ValueError(f"radius must stay below {2 * BLOCKS}")
    items, _ = materialize_counted(benchmark_items(benchmark), "leak-items")
    vocabulary, rows = materialize_counted(
        items.select(F.explode("item_hashes").alias("h"), "n").groupBy("h").agg(F.collect_set("n").alias("sizes")), "leak-vocabulary")
    ident = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    spread = docs.select(*ident, shingle_hashes(F.col("text")).alias("hashes")).select(
        "doc_id", "text_hash", F.size("hashes").alias("total"), F.posexplode("hashes").alias("pos", "h"))
    hits = spread.join(small_side(vocabulary, rows, 64), "h").select("doc_id", "text_hash", "total", "pos", F.explode("sizes").alias("n"))
    both = 2 * similarity / (1 + similarity)
    need = F.when(F.col("total") >= F.col("n"), F.ceil(F.col("n") * both - 1e-9)).otherwise(F.ceil(F.col("n") * similarity - 1e-9)).cast("int")
    # Hits of one text and size: at most the text's own shingles.  Repeated
    # rows give each position several times; the set folds them.
    runs = hits.groupBy("doc_id", "text_hash", "total", "n").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumn("need", need)
    starts = runs.filter(F.size("at") >= F.col("need")).select(
        "doc_id", "text_hash", "n",
        F.explode(F.expr("""array_distinct(transform(
            filter(sequence(1, size(at) - need + 1), i -> element_at(at, i + need - 1) < element_at(at, i) + n),
            i -> greatest(0, least(element_at(at, i), total - n))))""")).alias("start"))
    starts, rows = materialize_counted(starts, "leak-starts")
    places = starts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    found = docs.select(*ident, "text").join(
        small_side(places.withColumnsRenamed({"doc_id": "p_id", "text_hash": "p_hash"}), rows, 64),
        F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")))
    windows = found.select("doc_id", "text_hash", shingle_hashes(F.col("text")).alias("hashes"), "places").select(
        "doc_id", "text_hash", "hashes", F.explode("places").alias("p")).select(
        "doc_id", "text_hash", "p.start", "p.n", F.expr("slice(hashes, p.start + 1, p.n)").alias("window")).dropDuplicates(
        ["doc_id", "text_hash", "start", "n"])
    windows = materialize(windows.withColumn("fp", simhash("window")), "leak-windows")
    index = items.select("item_id", "n", "item_fp", _near_blocks(F.col("item_fp"), radius // BLOCKS).alias("b")).select(
        "item_id", "n", "item_fp", "b.block", "b.value")
    pairs = windows.select("doc_id", "text_hash", "start", "n", "fp", _own_blocks(F.col("fp")).alias("b")).select(
        "doc_id", "text_hash", "start", "n", "fp", "b.block", "b.value").join(index, ["n", "block", "value"])
    pairs = pairs.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("distance") <= radius).select(
        "doc_id", "text_hash", "start", "n", "item_id", "distance").distinct()
    checked = pairs.join(windows.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("start").alias("w_start"),
                                        F.col("n").alias("w_n"), "window"),
                         F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))
                         & (F.col("start") == F.col("w_start")) & (F.col("n") == F.col("w_n")))
    checked = checked.join(items.select("item_id", "n", "item_hashes"), ["item_id", "n"]).withColumn(
        "similarity", weighted_jaccard("item_hashes", "window")).filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", "n", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("b")
    return checked.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    own_id, own_hash = fresh_names(docs, "leak_id", "leak_hash")
    leaks, rows = materialize_counted(
        find_leaks(docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "leaked")
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_hash))
    return docs.join(small_side(leaks, rows, 32), same, "left_anti")
