"""N-gram Jaccard join by vertical partitioning.

All shingles (five words, hashed to 64 bits) stand in one global order, cut into FRAGMENTS by hash; within a fragment
the order goes from rare to frequent. Two sets that are similar enough share a shingle among the first few of either
(the prefix), so only shingles of the leading fragments are counted and compared. For pairs that share one, the
overlap is counted in each fragment by itself and summed per pair, which is exact.

Equal sets are one class from the start. Candidates are checked in three steps, and what links is contracted after each:
first the members of a prefix list against its head, which is the set with the fewest shingles of its own (in a group of
near copies the one nearest to their common text, and the same in most lists); then each set against the members of its
fullest lists that have another label, of each two labels the pair whose sketches are nearest; last all pairs that share
a list and whose labels still differ.
Parity sketches refute pairs before any is counted: each shingle in one set only flips one bit, so that the bits that
differ are no more than those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, spread, stage_table, text_of
from .components import components, contract
from .kernel import blocks, shingle_sets, tidied

FRAGMENTS, LEADING = 8, 3
#: Bits of the filter that is broadcast to fetch candidates' texts: 4 MB whatever the input; a full filter drops nothing.
FILTER_BITS = 1 << 25
#: 64-bit words of a parity sketch.
SKETCH = 16
#: Shingles whose sets are dealt over SALTS cells each: the commonest in one of SAMPLE sets. It moves rows, not results.
HOT, SALTS, SAMPLE = 10_000, 1024, 64
#: Lists in which a set looks for the nearest of other labels before all of its lists are compared.
FULLEST = 4
BLOCK = 1 << 20
_TOP = np.uint64(1 << 63)
#: Shingles are kept as signed numbers in the order of the unsigned hashes; leading ones lie below this.
_LEADING_BELOW = LEADING * (1 << 64) // FRAGMENTS - (1 << 63)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ _TOP).view(np.int64)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _set_id(ordered: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ordered.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n, percent: int):
    """Of two sets with 100 * overlap >= percent * union, the first so many shingles of each share one."""
    return n - (percent * n + 99) // 100 + 1


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def row_id(key: str, text: str) -> Column:
    """A hash of a row's key and text, either of which may be null."""
    return F.xxhash64(F.col(key), text_of(text))


def shingle_table(docs: DataFrame, percent: int, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, row, n, sid, leading, n_leading, sketch): row id, set size, id of the set, its shingles in the leading fragments.

    Where those are fewer than the prefix, leading holds the whole set. Of equal sets within a task only the first
    carries leading and sketch. Two different sets share an id with a chance of 2^-64 a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (s for b in batches for s in blocks(b, 2, BLOCK)):
            sizes, ids, heads, head_sizes, sketches = [], [], [], [], []
            for hashes in shingle_sets(batch.column(2), width):
                n, ordered = len(hashes), _signed(hashes)
                sid = _set_id(ordered) if n else None
                lead = int(np.searchsorted(ordered, _LEADING_BELOW))
                fresh = n and sid not in seen
                seen.add(sid)
                sizes.append(n)
                ids.append(sid)
                head_sizes.append(lead)
                sketches.append(_sketch(hashes) if fresh else ordered[:0])
                heads.append((ordered if lead < prefix_length(n, percent) else ordered[:lead]) if fresh else ordered[:0])
            yield pa.record_batch([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), _lists(heads), pa.array(head_sizes, pa.int64()), _lists(sketches)], names=["doc_id", "row", "n", "sid", "leading", "n_leading", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key), row_id(key, text).alias("__row"), text_of(text).alias("__text"))
    return read.mapInArrow(tidied(run), f"doc_id {kind}, row long, n long, sid long, leading array<long>, n_leading long, sketch array<long>")


def common_shingles(table: DataFrame) -> DataFrame:
    """(s, hot_df): the HOT commonest leading shingles of one set in SAMPLE, with the number of all sets that have each."""
    posted = table.select("sid", F.explode("leading").alias("s"))
    drawn = posted.filter(F.pmod(F.xxhash64("sid"), F.lit(SAMPLE)) == 0).groupBy("s").agg(F.count("*").alias("__n"))
    hot = drawn.filter("__n > 1").orderBy(F.desc("__n"), "s").limit(HOT).select("s")
    return posted.join(F.broadcast(hot), "s").groupBy("s").agg(F.count_distinct("sid").alias("hot_df"))


def prefix_lists(table: DataFrame, percent: int) -> DataFrame:
    """(s, sid, n, place, own): shingles that two sets or more have in the leading fragments and the set has in its prefix.

    A shingle that only one set has comes first in its fragment and is not sent on; its set's other places count it, and
    own is how many of them the set has. The sets of a common shingle are counted in cells.
    """
    posted = table.select("sid", F.explode("leading").alias("s"))
    hot = stage_table(common_shingles(table), "common")
    cells = posted.join(F.broadcast(hot), "s", "left").withColumn("cell", F.when(F.col("hot_df").isNotNull(), F.pmod(F.xxhash64("sid"), F.lit(SALTS))).otherwise(F.lit(0)))
    by_cell = Window.partitionBy("s", "cell")
    new = cells.withColumn("new", (F.coalesce(F.lag("sid").over(by_cell.orderBy("sid")) != F.col("sid"), F.lit(True))).cast("int"))
    shared = new.withColumn("df", F.coalesce("hot_df", F.sum("new").over(by_cell))).filter("new = 1 AND df > 1").select("s", "sid", "df")
    sizes = table.filter("sid IS NOT NULL").groupBy("sid").agg(F.max("n").alias("n"), F.max("n_leading").alias("n_leading"))
    leads = F.col("s") < F.lit(_LEADING_BELOW)
    part = Window.partitionBy("sid", "leads")
    placed = (
        shared.join(sizes, "sid")
        .withColumn("leads", leads)
        .withColumn("rank", F.row_number().over(part.orderBy("df", "s")))
        .withColumn("among", F.count("*").over(part))
        .withColumn("own", F.col("n_leading") - F.sum(F.col("leads").cast("int")).over(Window.partitionBy("sid")))
        .withColumn("place", F.when(F.col("leads"), F.col("n_leading")).otherwise(F.col("n")) - F.col("among") + F.col("rank"))
    )
    return placed.filter(F.col("place") <= F.expr(f"n - ({percent} * n + 99) div 100 + 1")).select("s", "sid", "n", "place", "own")


def _can_link(percent: int, n1: str, place1: str, n2: str, place2: str) -> Column:
    """Size and position bounds for the first shingle that two sets share in the global order."""
    return F.expr(
        f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})"
        f" AND {100 + percent} * (1 + least({n1} - {place1}, {n2} - {place2})) >= {percent} * ({n1} + {n2})"
    )


def sketches(table: DataFrame) -> DataFrame:
    return table.filter("size(sketch) > 0").select("sid", "n", "sketch").dropDuplicates(["sid"])


def _apart(sketch1: str, sketch2: str) -> Column:
    """Bits that differ in two sketches: no more than the shingles that one set only has."""
    return F.expr(" + ".join(f"bit_count({sketch1}[{i}] ^ {sketch2}[{i}])" for i in range(SKETCH)))


def _near(percent: int, n1: str, n2: str, apart: Column) -> Column:
    """Whether the sketches leave room for a link."""
    return (100 + percent) * apart <= (100 - percent) * (F.col(n1) + F.col(n2))


def star_pairs(lists: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each list's head with each other member that it may link with.

    The head is the member with the fewest shingles of its own, then of the least hash.
    """
    rank = F.struct(F.col("own"), F.xxhash64("sid").alias("hash"), F.col("sid"), F.col("n"), F.col("place"))
    heads = lists.groupBy("s").agg(F.min(rank).alias("head"))
    led = lists.join(heads, "s").filter("sid <> head.sid").filter(_can_link(percent, "n", "place", "head.n", "head.place"))
    pairs = led.select(F.least("head.sid", "sid").alias("a"), F.greatest("head.sid", "sid").alias("b")).distinct()
    of = lambda side: marks.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(_near(percent, "na", "nb", _apart("sa", "sb"))).select("a", "b")


def open_pairs(lists: DataFrame, labels: DataFrame, marks: DataFrame, percent: int, fullest: int | None = None) -> DataFrame:
    """Distinct (a, b, apart), a < b, that share a list, have different labels, and may link.

    Members of a list's commonest label are not compared with each other. With fullest, a set is only compared in that
    many of its lists, those in which the commonest label has most members.
    """
    named = lists.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    counts = named.groupBy("s", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("s").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    rows = named.select("s", "sid", "n", "place", "label").join(mixed.select("s", F.col("most.label").alias("most"), F.col("most.n").alias("full")), "s")
    if fullest:
        # In lists of a later place a partner of about the same size cannot link, if none was met before.
        early = F.expr(f"{100 + percent} * (place - 1) <= {100 - percent} * n")
        by_size = Window.partitionBy("sid").orderBy(early.desc(), F.desc("full"), "s")
        chosen = rows.filter("label <> most").withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= fullest)
        rows = rows.join(chosen.select("s", "sid", F.lit(True).alias("chosen")), ["s", "sid"], "left")
    rows = stage_table(rows, "mixed")
    second = lambda df: df.select(*(F.col(c).alias(f"{c}2") for c in df.columns))
    may = (F.col("s") == F.col("s2")) & (F.col("label") != F.col("label2")) & _can_link(percent, "n", "place", "n2", "place2")
    # Sketches go only to rows that have a partner by size and place.
    live = rows.join(second(rows.select("s", "n", "place", "label")), may, "left_semi").join(marks.select("sid", "sketch"), "sid")
    left = live.filter("label <> most AND chosen" if fullest else "label <> most")
    met = left.join(second(live.select("s", "sid", "n", "place", "label", "sketch")), may & F.expr("label2 = most OR sid < sid2"))
    met = met.filter(_near(percent, "n", "n2", _apart("sketch", "sketch2")))
    pairs = met.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
    of = lambda side: marks.select(F.col("sid").alias(side), F.col("sketch").alias(f"s{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", _apart("sa", "sb").alias("apart"))


def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with la and lb, the labels of their members, the lesser first."""
    of = lambda side: labels.select(F.col("sid").alias(side), F.col("label").alias(f"l{side}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    la, lb = F.coalesce("la", "a"), F.coalesce("lb", "b")
    return named.select("a", "b", "apart", F.least(la, lb).alias("la"), F.greatest(la, lb).alias("lb"))


def flag_maybe(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """docs with __maybe: false if the key is surely not among wanted's. A filter of FILTER_BITS bits, broadcast in pieces of 4 kB."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)) + 1
    pieces = wanted.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("__piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("__bits"))
    marked = docs.withColumn("__bit", bit).withColumn("__piece", F.expr("bitmap_bucket_number(__bit)"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__bit) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(bitmap_bit_position(__bit) % 8 as int))")
    found = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
    return marked.join(F.broadcast(pieces), "__piece", "left").select(*docs.columns, found.alias("__maybe"))


def segments(docs: DataFrame, table: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(sid, n, fragment, segment) for the sets in wanted, one row a fragment, computed from one text of each class."""
    holders = table.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("row").alias("row")).join(wanted, "sid")
    holders = stage_table(holders.select("sid", "row"), "holders")
    picked = docs.select(row_id(key, text).alias("row"), text_of(text).alias("__text"))
    near = flag_maybe(picked, "row", holders).filter("__maybe").drop("__maybe").join(holders.hint("shuffle_hash"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [i * (1 << 64) // FRAGMENTS - (1 << 63) for i in range(1, FRAGMENTS)]
        for batch in (s for b in batches for s in blocks(b, 1, BLOCK)):
            sids, sizes, parts = [], [], []
            for wanted_sid, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                ordered = _signed(hashes)
                if len(ordered) and _set_id(ordered) == wanted_sid:
                    sids.append(wanted_sid)
                    sizes.append(len(ordered))
                    parts += np.split(ordered, np.searchsorted(ordered, cuts))
            numbers = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sids))
            yield pa.record_batch([pa.array(np.repeat(np.array(sids, np.int64), FRAGMENTS)), pa.array(np.repeat(np.array(sizes, np.int64), FRAGMENTS)), pa.array(numbers), _lists(parts)], names=["sid", "n", "fragment", "segment"])

    made = near.select("sid", "__text").mapInArrow(tidied(run), "sid long, n long, fragment int, segment array<long>")
    return stage_table(made.dropDuplicates(["sid", "fragment"]), "segments")


def members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted per fragment, summed per pair."""
    left = parts.select(F.col("sid").alias("a"), F.col("n").alias("na"), "fragment", F.col("segment").alias("sa"))
    right = parts.select(F.col("sid").alias("b"), F.col("n").alias("nb"), "fragment", F.col("segment").alias("sb"))
    met = pairs.join(right, "b").join(left, ["a", "fragment"])
    counted = met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    whole = counted.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("common").alias("common"))
    return whole.filter(f"{100 + percent} * common >= {percent} * (na + nb)").select("a", "b")


def jaccard_classes(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, row, n_shingles, class) for every row of docs: a hash of key and text, set size, and the id of its component.

    class is null where there is no shingle. See jaccard_components.
    """
    table = stage_table(shingle_table(docs, percent, key, text, width), "shingles")
    lists = stage_table(prefix_lists(table, percent), "prefixes")
    marks = stage_table(sketches(table).join(lists.select("sid").distinct(), "sid", "left_semi"), "sketches")
    stars = stage_table(star_pairs(lists, marks, percent), "stars")
    parts = segments(docs, table, members(stars), key, text, width)
    labels = components(linked(stars, parts, percent))
    tried = stars
    for fullest in (FULLEST, None):
        rest = open_pairs(lists, labels, marks, percent, fullest).join(tried, ["a", "b"], "left_anti")
        if fullest:
            # Of each two labels the likeliest pair: where it links, all others of the two need no count.
            rest = with_labels(rest, labels).groupBy("la", "lb").agg(F.min(F.struct("apart", "a", "b")).alias("pair")).select("pair.a", "pair.b")
        rest = stage_table(rest.select("a", "b"), "pairs")
        more = members(rest).join(parts.select("sid").distinct(), "sid", "left_anti")
        parts = parts.unionByName(segments(docs, table, more, key, text, width))
        labels = contract(labels, linked(rest, parts, percent))
        tried = tried.unionByName(rest)
    done = table.select("doc_id", "row", F.col("n").alias("n_shingles"), "sid").join(labels, "sid", "left")
    return done.select("doc_id", "row", "n_shingles", F.coalesce("label", "sid").alias("class"))


def jaccard_components(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Sets link when 100 * overlap >= percent * union. component_id is the least key that links reach. Null and empty
    texts, and texts of white space, have no shingles and link with nothing; equal texts and repeated rows share a
    component. Rows of null key take part, and get the least key that is not null, or null. An empty table gives no rows;
    other columns are not read.
    """
    classes = stage_table(jaccard_classes(docs, percent, key, text, width), "classes")
    # Stored, so that Spark can split the rows of a large class in the join.
    least = stage_table(classes.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    named = classes.join(least, "class", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each class of jaccard_classes: that of the least key that is not null, then of the least hash.

    Rows equal in key and text are one; which of them stays is not defined where other columns differ. Rows that share
    a key and have different texts are judged each by itself. Rows without shingles stay. Only rows of classes with two
    rows or more are shuffled. An empty table gives no rows; no name of a column of docs is reserved.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    firsts = classes.filter("class IS NOT NULL").groupBy("class").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    firsts = stage_table(firsts, "firsts")
    suspects = classes.join(firsts, "class").groupBy("row").agg(F.max((F.col("row") == F.col("first.row")).cast("int")).alias("stays"))
    suspects = stage_table(suspects.select(F.col("row").alias("__row"), "stays"), "suspects")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), row_id(key, text).alias("__row"))
    flagged = flag_maybe(plain, "__row", suspects)
    clear = flagged.filter("NOT __maybe").select(names)
    doubtful = flagged.filter("__maybe").drop("__maybe").join(suspects, "__row", "left")
    single = doubtful.filter("stays = 1").dropDuplicates(["__row"]).select(names)
    return clear.unionByName(doubtful.filter("stays IS NULL").select(names)).unionByName(single).toDF(*docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(documents(spark, sf_dir)))
