"""A filter of fixed size that tells keys which are certainly not in a set."""

from pyspark.sql import DataFrame, functions as F

BITS = 1 << 27  # 16 MB, whatever the number of keys
# Fixed value: the bits of one bitmap of the session's bitmap functions.
BITMAP_BITS = 4096 * 8


def may_be_in(rows: DataFrame, keys: DataFrame, key: list[str], out: str) -> DataFrame:
    """Add ``out``: false where the row's key is not among ``keys``, true where it may be.

    Keys set a bit each by their hash. The bits are bitmaps, combined before their shuffle and broadcast: at most
    ``BITS`` of them, so the broadcast does not grow with the keys. The more keys, the more rows stay true.
    """
    def bit(df: DataFrame):
        return F.pmod(F.xxhash64(*[df[k] for k in key]), F.lit(BITS)) + 1

    maps = keys.select(bit(keys).alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    placed = rows.select("*", F.bitmap_bucket_number(bit(rows)).alias("_at"), F.bitmap_bit_position(bit(rows)).alias("_position"))
    joined = placed.join(F.broadcast(maps), F.col("_at") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_position") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("_position") % 8).cast("int")) == 1
    return joined.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias(out))
