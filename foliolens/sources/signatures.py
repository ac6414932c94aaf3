"""The search index with a side table of trigram postings, and corpora narrowed by it.

``write_indexed`` numbers the documents in the order they are stored in and keeps, for each trigram of
their folded texts, the numbers of the documents that have it: lists of at most ``SEGMENT``
documents, sorted by trigram in hash ranges, so a look-up reads a few row groups. ``narrowed`` intersects
the lists of a few trigrams of each term and reads only the row groups of documents that may have
the terms; the search that follows decides. Its result is that of the same search over everything.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foliolens.functions.trigrams import SIZE, chunks, folded, required_literals, term_trigrams
from foliolens.plans.skipping import intervals, within
from foliolens.schema import CORPUS
from foliolens.sources.index import ordered

SEGMENT_BITS, RANGES, GRAMS_OF_TERM = 16, 64, 8
SEGMENT = 1 << SEGMENT_BITS
# Candidates are looked up in blocks of neighbours. Up to so many blocks (2 MB of numbers) are broadcast
# and their places pushed to the scan; beyond, a term is no rare one and everything is read.
BLOCK_BITS, MAX_BLOCKS = 6, 4096
# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Characters whose trigrams a task lists in one go.
AT_ONCE = 1 << 22

INDEXED = T.StructType([*CORPUS.fields, T.StructField("doc_no", T.LongType())])
POSTINGS = T.StructType([
    T.StructField("gram", T.StringType()), T.StructField("segment", T.LongType()),
    T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("range", T.IntegerType())])


def _range(gram):
    return F.pmod(F.xxhash64(gram), F.lit(RANGES)).cast("int")


def write_indexed(index: DataFrame, path: str, mode: str = "errorifexists", partitions: int | None = None) -> None:
    """``docs`` as ``write_index`` has them, numbered in ``doc_no``, and ``grams``."""
    numbered = ordered(index, partitions).withColumn("doc_no", F.monotonically_increasing_id())
    numbered.write.mode(mode).partitionBy("dataset").parquet(f"{path}/docs")
    write_postings(read_indexed(index.sparkSession, path), f"{path}/grams", mode)


def write_postings(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The postings of numbered documents. A trigram of very many documents is many short lists.

    Neighbouring documents go through a task together and give one list for each trigram, so that what is
    grouped are lists, not single numbers.
    """
    pieces = docs.select("doc_no", F.explode(chunks(folded(F.col("text")))).alias("piece"))
    lists = pieces.mapInArrow(_partial_lists, "gram string, segment long, docs array<int>").groupBy("gram", "segment").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))
    order = ["range", "gram", "segment"]
    (lists.withColumn("range", _range("gram")).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).partitionBy("range").parquet(path))


def _partial_lists(batches):
    """(gram, segment, docs) of pieces of text, as many at a time as have ``AT_ONCE`` characters."""
    numbers, held, size = [], [], 0
    for batch in batches:
        for number, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            numbers.append(number)
            held.append(piece)
            size += len(piece)
            if size >= AT_ONCE:
                yield _lists_of(numbers, held)
                numbers, held, size = [], [], 0
    if held:
        yield _lists_of(numbers, held)


def _lists_of(numbers: list[int], pieces: list[str]) -> pa.RecordBatch:
    sizes = np.array([len(p) for p in pieces])
    letters = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    docs, doc_of = np.unique(np.array(numbers, np.int64), return_inverse=True)
    owner = np.repeat(doc_of, sizes)
    # a trigram starts at every place of a piece but its last ones
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
    at = np.flatnonzero(left >= SIZE)
    codes = (letters[at] << 42) | (letters[at + 1] << 21) | letters[at + 2]
    grams, gram_of = np.unique(codes, return_inverse=True)
    pairs = np.unique(gram_of * len(docs) + owner[at])
    gram, doc = pairs // len(docs), docs[pairs % len(docs)]
    segment = doc >> SEGMENT_BITS
    first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (segment[1:] != segment[:-1])][:len(pairs)])
    text = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pairs)], pa.int32()), pa.array(doc & (SEGMENT - 1), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([text[SIZE * g:SIZE * g + SIZE] for g in gram[first].tolist()], pa.string()),
                                       pa.array(segment[first], pa.int64()), lists], ["gram", "segment", "docs"])


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEXED).parquet(f"{path}/docs")


def candidates(spark: SparkSession, path: str, terms: list[str]) -> DataFrame | None:
    """(doc_no) of the documents that have some trigrams of every term; None where no term has a trigram."""
    wanted = set()
    for grams in term_trigrams(spark, terms):
        step = max(1, -(-len(grams) // GRAMS_OF_TERM))
        wanted.update(grams[::step])
    if not wanted:
        return None
    wanted = sorted(wanted)
    ranges = spark.range(1).select(F.array(*[_range(F.lit(g)) for g in wanted])).first()[0]
    lists = spark.read.schema(POSTINGS).parquet(f"{path}/grams").filter(
        F.col("range").isin(sorted(set(ranges))) & F.col("gram").isin(wanted))
    # one list for each trigram of a segment, shortest first, so that the intersection stays short
    by_segment = lists.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct(F.size("docs").alias("n"), "docs"))).alias("lists"))
    every = by_segment.filter(F.size("lists") == len(wanted)).select("segment", F.aggregate(
        F.slice("lists", 2, len(wanted)), F.col("lists")[0]["docs"], lambda found, one: F.array_intersect(found, one["docs"])).alias("docs"))
    return every.select("segment", F.explode("docs").alias("doc")).select(
        (F.shiftleft("segment", SEGMENT_BITS) + F.col("doc")).alias("doc_no"))


def narrowed(spark: SparkSession, path: str, all: list[str] | None = None, any: list[str] | None = None) -> DataFrame:
    """The documents that may have all terms of ``all`` and one of ``any``: a corpus for the search that follows."""
    docs = read_indexed(spark, path)
    found = candidates(spark, path, list(all)) if all else None
    either = [candidates(spark, path, [t]) for t in any or []]
    if either and not [e for e in either if e is None]:
        one = either[0]
        for e in either[1:]:
            one = one.unionByName(e)
        found = one.distinct() if found is None else found.join(one, "doc_no", "left_semi")
    if found is None:
        return docs.drop("doc_no")
    blocks = [r[0] for r in found.select(F.shiftright("doc_no", BLOCK_BITS).alias("b")).distinct().limit(MAX_BLOCKS + 1).collect()]
    if len(blocks) > MAX_BLOCKS:
        return docs.drop("doc_no")
    at = F.shiftright("doc_no", BLOCK_BITS)
    known = spark.createDataFrame([(b,) for b in blocks], "_block long")
    places = [(low << BLOCK_BITS, ((high + 1) << BLOCK_BITS) - 1) for low, high in intervals(blocks)]
    near = docs.filter(within("doc_no", places))
    return near.join(F.broadcast(known), at == F.col("_block"), "left_semi").drop("doc_no")


def narrowed_by_pattern(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The documents that may match a regular expression: those with its required literals."""
    literals = required_literals(pattern)
    return narrowed(spark, path, all=literals) if literals else read_indexed(spark, path).drop("doc_no")
