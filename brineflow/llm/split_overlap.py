"""Same or near-same records across splits, found through compressed full-text indexes of the evaluation records.

Texts are first collapsed to classes of equal word sets, equal contents and equal entries. Each class is a sequence of
distinct symbols in one global order, rare words first, so what two sequences have in common is the sum of their
maximal matches: every common symbol lies in exactly one. Backward search of a training sequence in the index of the
evaluation sequences yields those matches with their spans; merged per pair of classes, the spans decide the pair.

If two word sets have a similarity of t, they share a symbol among the first n - ceil(t n) + 1 of either (prefix filter),
and from their first common one on they have all of what they share. So a sequence is sent, from that symbol on, to the
shard of each of its prefix symbols that the other side has as well; a shard indexes its evaluation sequences and
streams its training sequences through. A pair meets in the shard of each symbol its prefixes share; at the first of
them the sum is whole, at the others it is less, so no pair is lost and none is accepted wrongly. A symbol with
many classes is cut into cells of at most CELL x CELL, in shards of their own, so neither a task nor the driver holds
an unbounded group.

Defined results: null splits take no part; null and blank text has neither words nor content; a null or blank entry
matches nothing; repeated rows give their own pairs; any order of equals is by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.llm.backward_index import BackwardIndex
from brineflow.llm.related_splits import entry_key
from brineflow.operators.joins import HEAVY_SHARE, heavy_light_join
from brineflow.operators.packed import content_column
from brineflow.runtime.session import discard, parallelism, ship_code, spread, written

WORD = r"(?:[\p{L}\p{N}]|(?<=\p{Nd})[.,](?=\p{Nd}))++"
#: Counters of word frequencies, by hash: all words are counted, those that share a counter count together.
FREQUENCY_BUCKETS = 1 << 20
CELL = 1000
ROWS_PER_SHARD = 5_000
#: Places of the index that training sequences are matched with at a time: what a shard holds for its pairs doesn't grow with how many are alike.
HITS = 1_000_000
#: Records of a class that are joined as one block.
BLOCK = 50_000


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def _records(df: DataFrame, record: str, text: str, entry: str, split: str, source: str) -> DataFrame:
    rows = df.select(
        F.col(record).alias("record_id"), F.col(text).alias("text"), entry_key(F.col(entry)).alias("entry"), F.col(source).cast("string").alias("source"),
        (F.col(split) == "train").alias("train"),
    ).where(F.col(split).isin("train", "val", "test"))
    with_content = content_column(spread(rows), "text", "source")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))))
    whole = lambda c, kind: F.when(F.col(c).isNotNull(), F.unhex(F.md5(F.concat(F.lit(kind), F.col(c)))))
    return written(
        with_content.withColumn("words", words).select(
            "record_id", "train",
            F.when(F.size("words") > 0, F.unhex(F.md5(F.array_join("words", " ")))).alias("word_class"),
            F.when(F.size("words") > 0, F.transform("words", lambda w: F.xxhash64(w))).alias("symbols"),
            F.array_compact(F.array(whole("content", "content "), whole("entry", "entry "))).alias("other_classes"),
        ),
        "records",
    )


def _bucket(symbol: np.ndarray) -> np.ndarray:
    return symbol & (FREQUENCY_BUCKETS - 1)


def word_frequencies(records: DataFrame) -> np.ndarray:
    """Occurrences by counter, over all records; the driver gets at most FREQUENCY_BUCKETS numbers."""
    bucket = F.col("s").bitwiseAND(F.lit(FREQUENCY_BUCKETS - 1))
    counted = records.select(F.explode("symbols").alias("s")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(FREQUENCY_BUCKETS, dtype=np.int64)
    out[counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    return out


def _ordered(classes: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """`classes` with the symbols in the global order: rare words first, ties by hash."""
    shared = classes.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy()
            order = np.lexsort((flat, shared.value[_bucket(flat)], np.repeat(np.arange(len(lengths)), lengths)))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat[order])), *b.columns[2:]], schema=b.schema)

    return classes.mapInArrow(run, classes.schema)


def _search(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs of classes of one shard, decided by the merged spans of their maximal matches; training sequences go in parts of about HITS places."""
    names, types = ["eval_class", "train_class", "n_spans", "longest", "common"], [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))
    table = table.combine_chunks()
    train = table.column("train").to_numpy()
    if train.all() or not train.any():
        return schema.empty_table()
    tails = table.column("tail").combine_chunks()
    lengths = tails.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # symbols of different cells are different, so sequences meet within their cell only
    cell = np.unique(table.column("cell").to_numpy(), return_inverse=True)[1]
    known, symbol = np.unique(tails.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    key = cell[row] * len(known) + symbol
    of_eval = ~train[row]
    used, flat = np.unique(key[of_eval], return_inverse=True)
    # sequences are indexed from the last symbol to the first, so that a backward search goes on to the next symbols
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((-place[of_eval], row[of_eval]))
    evaluation, training = np.flatnonzero(~train), np.flatnonzero(train)
    index = BackwardIndex(flat[order] + 1, lengths[evaluation])
    at = np.minimum(np.searchsorted(used, key[~of_eval]), len(used) - 1)
    symbols = np.where(used[at] == key[~of_eval], at + 1, -1)
    low, high = index.single(np.maximum(symbols, 1))
    sizes = lengths[training]
    begin = np.cumsum(sizes) - sizes
    hits = np.add.reduceat(np.where(symbols > 0, high - low, 0), begin) + sizes
    n = table.column("n").to_numpy().astype(np.int64)
    ids = table.column("class_id").combine_chunks()
    out = []
    by_size = np.argsort(sizes, kind="stable")
    for part in np.split(by_size, np.flatnonzero(np.diff(np.cumsum(hits[by_size]) // HITS)) + 1):
        size = sizes[part]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        patterns = np.full((len(part), int(size.max())), -1, dtype=np.int64)
        patterns[np.repeat(np.arange(len(part)), size), inside] = symbols[np.repeat(begin[part], size) + inside]
        which, owner, span = index.maximal_matches(patterns, size, anywhere=True)
        pair, inverse = np.unique(which * len(evaluation) + owner, return_inverse=True)
        common = np.bincount(inverse, weights=span, minlength=len(pair)).astype(np.int64)
        longest = np.zeros(len(pair), dtype=np.int64)
        np.maximum.at(longest, inverse, span)
        t, e = training[part[pair // len(evaluation)]], evaluation[pair % len(evaluation)]
        near = common >= similarity * (n[t] + n[e] - common) - 1e-9
        columns = [ids.take(pa.array(e[near])), ids.take(pa.array(t[near])), np.bincount(inverse, minlength=len(pair))[near], longest[near], common[near]]
        out.append(pa.table([pa.array(c, k) if isinstance(c, np.ndarray) else c.cast(k) for c, k in zip(columns, types)], schema=schema))
    return pa.concat_tables(out)


def _placed_rows(shared: DataFrame) -> int:
    """Rows that all cells hold together: a class is in as many cells of a symbol as the other side has parts."""
    train, evaluation = F.ceil(F.col("n_train") / CELL), F.ceil(F.col("n_eval") / CELL)
    return shared.agg(F.sum(F.col("n_train") * evaluation + F.col("n_eval") * train)).first()[0] or 0


def class_matches(classes: DataFrame, similarity: float) -> DataFrame:
    """(eval_class, train_class, n_spans, longest, common): the pairs of classes (class_id, symbols, is_train, is_eval) that are near, symbols in one order."""
    spark = classes.sparkSession
    ship_code(spark)
    n = F.size("symbols")
    prefix = n - F.ceil(F.lit(similarity) * n - F.lit(1e-9)).cast("int") + 1
    seeds = classes.select("class_id", "is_train", "is_eval", F.posexplode(F.slice("symbols", 1, prefix)).alias("place", "symbol"))
    sides = seeds.groupBy("symbol").agg(F.count_if("is_train").alias("n_train"), F.count_if("is_eval").alias("n_eval"))
    shared = written(sides.where("n_train > 0 AND n_eval > 0"), "symbols")
    shards = max(parallelism(spark), math.ceil(_placed_rows(shared) / ROWS_PER_SHARD))
    side = F.explode(F.array_compact(F.array(F.when(F.col("is_train"), True), F.when(F.col("is_eval"), False)))).alias("train")
    met = heavy_light_join(seeds, shared, "symbol", "inner").select("class_id", "symbol", "place", "n_train", "n_eval", side)
    met = met.select("class_id", "symbol", "place", "train", F.ceil(F.col("n_train") / CELL).alias("cells_train"), F.ceil(F.col("n_eval") / CELL).alias("cells_eval"))
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("train"), F.col("cells_train")).otherwise(F.col("cells_eval")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("train"), F.col("cells_eval")).otherwise(F.col("cells_train")) - 1)
    e, t = F.when(F.col("train"), F.col("other")).otherwise(F.col("own")), F.when(F.col("train"), F.col("own")).otherwise(F.col("other"))
    placed = (
        met.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select("class_id", "place", "train", F.xxhash64("symbol", e, t).alias("cell"))
        .join(classes.select("class_id", "symbols"), "class_id")
        .select("class_id", "train", "cell", F.size("symbols").alias("n"), F.slice("symbols", F.col("place") + 1, F.size("symbols")).alias("tail"))
        .withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)))
    )
    # the search costs far more than its bytes, by which partitions would be merged
    found = placed.repartition(min(shards, 8 * parallelism(spark)), "shard").groupBy("shard").applyInArrow(lambda x: _search(x, similarity), "eval_class binary, train_class binary, n_spans bigint, longest bigint, common bigint")
    # in the shard of the first common symbol the spans are whole, and more than in any other
    best = F.max(F.struct("common", "n_spans", "longest")).alias("m")
    out = written(found.groupBy("eval_class", "train_class").agg(best).select("eval_class", "train_class", "m.n_spans", "m.longest", "m.common"), "matches")
    discard(shared)
    return out


def _in_blocks(pairs: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """`pairs` with the records of the class in column `side`; a class above BLOCK records is cut into blocks that are joined one by one."""
    large = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    blocks = written(large.select("class_id", F.ceil(F.col("_n") / BLOCK).alias("_blocks")), "blocks")
    heavy = [bytes(r["class_id"]) for r in blocks.orderBy(F.desc("_blocks"), "class_id").limit(int(1 / HEAVY_SHARE)).collect()]
    whole = F.coalesce("_blocks", F.lit(1).cast("bigint"))
    of_members = heavy_light_join(members, blocks, "class_id", heavy=heavy).withColumn("_block", F.pmod(F.xxhash64("record_id"), whole)).drop("_blocks")
    of_pairs = heavy_light_join(pairs.withColumnRenamed(side, "class_id"), blocks, "class_id", heavy=heavy).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1))).drop("_blocks")
    return of_pairs.join(of_members.withColumnRenamed("record_id", side.replace("class", "id")), ["class_id", "_block"]).drop("class_id", "_block")


def cross_split_pairs(df: DataFrame, record: str, text: str, entry: str, split: str, source: str, similarity: float = 0.8) -> DataFrame:
    """(eval_id, train_id, n_spans, longest, common) of every evaluation record and training record with equal content, near-equal words or the same entry.

    The last three are the merged spans of what they share: how many, the longest, and their sum, in symbols; of
    equal contents and entries the whole is one symbol, and the largest counts if a pair is tied in several ways.
    """
    records = _records(df, record, text, entry, split, source)
    sides = [F.max("train").alias("is_train"), F.max(~F.col("train")).alias("is_eval")]
    by_words = records.where("word_class IS NOT NULL").groupBy(F.col("word_class").alias("class_id")).agg(F.any_value("symbols").alias("symbols"), *sides)
    others = records.select(F.explode("other_classes").alias("class_id"), "train").groupBy("class_id").agg(*sides)
    others = others.select("class_id", F.array(F.xxhash64("class_id")).alias("symbols"), "is_train", "is_eval")
    classes = written(_ordered(by_words, word_frequencies(records)).unionByName(others), "classes")
    matches = class_matches(classes, similarity)
    discard(classes)
    members = records.select("record_id", "train", F.explode(F.array_compact(F.concat(F.array("word_class"), "other_classes"))).alias("class_id"))
    out = _in_blocks(matches, members.where(~F.col("train")).select("class_id", "record_id"), "eval_class")
    out = _in_blocks(out, members.where("train").select("class_id", "record_id"), "train_class")
    best = F.max(F.struct("common", "n_spans", "longest")).alias("m")
    return out.groupBy("eval_id", "train_id").agg(best).select("eval_id", "train_id", "m.n_spans", "m.longest", "m.common")


def overlap_report(df: DataFrame, record: str, text: str, entry: str, split: str, source: str, similarity: float = 0.8) -> DataFrame:
    """(split, source, n_pairs, n_records, n_spans, longest): overlaps with training per evaluation split and source, with the matches they rest on."""
    pairs = cross_split_pairs(df, record, text, entry, split, source, similarity)
    pairs = pairs.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_spans").alias("n_spans"), F.max("longest").alias("longest"))
    named = df.select(F.col(record).alias("eval_id"), F.col(split).alias("split"), F.col(source).alias("source"))
    total = [F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_records"), F.sum("n_spans").alias("n_spans"), F.max("longest").alias("longest")]
    return pairs.join(named, "eval_id").groupBy("split", "source").agg(*total)
