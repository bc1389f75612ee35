"""Helpers that the operators of this subpackage share: words, key buckets, files."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_folder, partitions, running, salted_join, written  # noqa: F401  the operators' own helpers and the library's are found here

#: Words of every contract: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def md5_long(col: Column) -> Column:
    """A 60-bit hash that DuckDB can compute too."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")


def id_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most `buckets` ascending values of an integer key that part its rows about evenly, the smallest value first; [] without keys. Its size does not grow with the rows."""
    shares = [i / buckets for i in range(buckets)]
    row = df.select(F.percentile_approx(key, shares, max(10_000, 4 * buckets)).alias("p"), F.min(key).alias("m")).head()
    return sorted({row["m"], *row["p"]}) if row and row["m"] is not None else []


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """The number of the bounds at or below key, less one; keys that are null go first, to bucket 0."""
    if len(bounds) < 2:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], search(low, mid)).otherwise(search(mid, high))

    if len(bounds) <= 64:
        return F.when(key.isNull(), 0).otherwise(search(0, len(bounds)))
    # two levels: every step-th bound, then the bounds from there, so that a row looks at few of them
    step = math.isqrt(len(bounds))
    upto = lambda known: F.greatest(F.size(F.filter(known, lambda x: x <= key)) - 1, F.lit(0))
    longs = lambda values: F.array(*(F.lit(x).cast("bigint") for x in values))
    blocks = F.array(*(longs(bounds[i : i + step]) for i in range(0, len(bounds), step)))
    found = let(upto(longs(bounds[::step])), lambda i: i * step + upto(blocks[i]))
    return F.when(key.isNull(), 0).otherwise(found)


def filesystem(uri: str) -> tuple:
    """(file system, path) for workers that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Publisher:
    """Writes a file under another name and moves it into place, so that a repeated or lost attempt leaves whole files only."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        from pyarrow import fs

        if isinstance(self.fs, fs.LocalFileSystem):
            self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is not None:
            self.fs.delete_file(self.temp)
            return
        from pyarrow import fs

        if not isinstance(self.fs, fs.LocalFileSystem) and self.fs.get_file_info(self.path).type == fs.FileType.File:
            self.fs.delete_file(self.path)
        self.fs.move(self.temp, self.path)


def bytes_of(array) -> list:
    """The values of an Arrow string array as UTF-8 bytes; null as b""."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def slices(items: list, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of items of about `most` bytes together; an item is never cut."""
    start = total = 0
    for i, x in enumerate(items):
        total += len(x)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(items):
        yield start, len(items)
