"""A JSON array of objects, read by many tasks however few files hold it.

The text source cuts a file at closing braces, which lets it split the file by byte ranges. Whether a
range begins inside a string, and how deep, follows from the ranges before it: one scan counts quotes and
brackets per range for either case, the counts are added up over the ranges (one small row each), and a
second scan cuts the objects of the array. An object that goes on in the next range is put together from its pieces.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_ESCAPED = re.compile(r"\\.", re.S)
_COUNTS = "file string, block long, quotes long, outside long, inside long"
_PIECES = "file string, block long, place long, whole boolean, ends boolean, text string"


def _change(piece: str) -> int:
    return piece.count("{") + piece.count("[") - piece.count("]")


def _depths(segment: str) -> tuple[int, int, int]:
    """Quotes of a stretch up to a closing brace, and what it adds to the depth if it begins outside or
    inside a string. An escape is whole: no brace may follow a backslash in JSON."""
    pieces = (_ESCAPED.sub("", segment) if "\\" in segment else segment).split('"')
    quotes = len(pieces) - 1
    even, odd = (sum(map(_change, pieces[i::2])) for i in (0, 1))
    # the brace that ends the stretch counts unless it is part of a string
    return quotes, even - (quotes % 2 == 0), odd - (quotes % 2 == 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each byte range."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for file, block, segment in zip(*(c.to_pylist() for c in batch.columns)):
            total = found.setdefault((file, block), [0, 0, 0])
            quotes, outside, inside = _depths(segment)
            flipped = total[0] % 2
            total[0] += quotes
            total[1] += inside if flipped else outside
            total[2] += outside if flipped else inside
    rows = [(*at, *total) for at, total in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "quotes", "outside", "inside"])


def _cutter(starts: dict[tuple[str, int], tuple[bool, int]]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, in_string, depth, place, begun = None, [], False, 0, 0, True

        def rest():
            return [(*at, place, False, False, "".join(waiting))] if at and waiting else []

        for batch in batches:
            rows = []
            for file, block, segment in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    rows += rest()
                    at, waiting, place = (file, block), [], 0
                    in_string, depth = starts[at]
                    begun = depth <= 1 and not in_string  # the first object begins in this range
                quotes, outside, inside = _depths(segment)
                depth += inside if in_string else outside
                in_string ^= bool(quotes % 2)
                waiting.append(segment + "}")
                if depth == 1 and not in_string:
                    rows.append((*at, place, begun, True, "".join(waiting)))
                    waiting, begun, place = [], True, place + 1
            yield table(rows)
        yield table(rest())

    def table(rows):
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["file", "block", "place", "whole", "ends", "text"])
    return cut


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(text): the objects of the arrays in the files, as JSON. Other elements of an array are passed over."""
    segments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts, depths = {}, {}
    for r in sorted(segments.mapInArrow(_counted, _COUNTS).collect()):  # one row for each byte range
        in_string, depth = depths.get(r["file"], (False, 0))
        starts[r["file"], r["block"]] = in_string, depth
        depths[r["file"]] = in_string ^ bool(r["quotes"] % 2), depth + (r["inside"] if in_string else r["outside"])
    pieces = segments.mapInArrow(_cutter(starts), _PIECES)
    whole = pieces.filter("whole AND ends").select("text")
    # an object over a border: pieces up to the one that ends it; at most two for each range
    earlier = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.filter("NOT (whole AND ends)").withColumn("object", F.coalesce(F.sum(F.col("ends").cast("int")).over(earlier), F.lit(0)))
    joined = parts.groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("p"), F.max("ends").alias("ends"))
    joined = joined.filter("ends").select(F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
    # what stands before the object: the bracket, a comma, elements that are no objects
    return whole.unionByName(joined).select(F.regexp_extract("text", r"(?s)\{.*$", 0).alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return array_objects(spark, path).select(F.from_json("text", schema).alias("row")).select("row.*")
