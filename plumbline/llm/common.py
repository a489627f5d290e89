"""Shared pieces of the text operators: scratch tables, batching, hashed words and sorted hash tables.

Texts are handled in chunks of about CHUNK code points: one flat numpy array of
code points and an offset for each text, so that the work of a chunk is a fixed
number of array operations however many texts or words it has.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import stored as stored

CHUNK = 300_000
TABLE = 0x20000
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_cache: dict = {}


# == tables


def free_name(df: DataFrame, name: str) -> str:
    """name, or name_1, name_2 ... where df has that column already."""
    taken = {c.lower() for c in df.columns}
    k, out = 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each labelled document: the largest of its marks."""
    t = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return t.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


#: Rows of a side that is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def among(df: DataFrame, ids: DataFrame, by: str = "doc_id") -> DataFrame:
    """The rows of df whose id is in ids, without a shuffle of df where ids are few enough."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, by, "left_semi")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes, not by rows alone:
    some texts are a thousand times as long as others. A bound set by hand stays."""
    spark = df.sparkSession
    if spark.conf.get(BATCH, None) in (None, "256MB", "268435456", "268435456b", "9223372036854775807", "-1"):
        spark.conf.set(BATCH, "4m")
    return df


# == chunks


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about limit code points; null counts as ''."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, [x or "" for x in texts[start:k]]
            start, size = k, 0
        size += n
    if texts:
        yield start, [x or "" for x in texts[start:]]
    returned()


def returned() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and
    its arrays would stay with it beside those of others."""
    if "libc" not in _cache:
        _cache["libc"] = ctypes.CDLL(None)
    if hasattr(_cache["libc"], "malloc_trim"):
        _cache["libc"].malloc_trim(0)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with one blank before the first and after each, and
    the place where each text starts, with one more for the end."""
    flat = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.empty(len(texts) + 1, np.int64)
    at[0] = 1
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=at[1:])
    at[1:] += 1
    return flat, at


def tables() -> dict[str, np.ndarray]:
    """By code point under TABLE: lower case, word character, white space."""
    if "tables" not in _cache:
        every = [chr(c) for c in range(TABLE)]
        low = np.arange(TABLE, dtype=np.uint32)
        for c, x in enumerate(every):
            if (y := x.lower()) != x and len(y) == 1:
                low[c] = ord(y)
        word = np.fromiter((x.isalnum() for x in every), bool, TABLE)
        blank = np.fromiter((x.isspace() for x in every), bool, TABLE)
        _cache["tables"] = {"lower": low, "word": word, "blank": blank}
    return _cache["tables"]


def looked_up(table: np.ndarray, cp: np.ndarray, beyond) -> np.ndarray:
    """table[cp]; beyond for code points past the table."""
    out = table[np.minimum(cp, TABLE - 1)]
    if cp.size and int(cp.max()) >= TABLE:
        out = np.where(cp >= TABLE, cp if beyond is None else beyond, out)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _cache.get("powers")
    if have is None or len(have[0]) < n:
        n = max(n, 2 * CHUNK)
        inverse = pow(int(_BASE), -1, 1 << 64)
        both = []
        for b in (int(_BASE), inverse):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _cache["powers"] = tuple(both)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """The words of a chunk: text index, start, end and hash of each, in order."""

    def __init__(self, texts: list[str], raw: bool = False):
        """raw: runs of anything but white space, as they are. Otherwise runs of
        letters and digits in lower case."""
        t = tables()
        cp, at = code_points(texts)
        if raw:
            inside = ~looked_up(t["blank"], cp, False)
        else:
            cp = looked_up(t["lower"], cp, None)
            inside = looked_up(t["word"], cp, True)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        self.cp, self.at = cp, at
        up, down = powers(len(cp) + 1)
        total = np.empty(len(cp) + 1, np.uint64)
        total[0] = 0
        np.cumsum((cp.astype(np.uint64) + U64(1)) * up[: len(cp)], out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start])
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, at)

    @staticmethod
    def points(texts: list[str]) -> np.ndarray:
        """The code points that start and end count in, as they are."""
        return code_points(texts)[0]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words within a text, and the index of their first word."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(size, np.uint64)
        for k in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + self.hash[k : k + size]
        whole = np.flatnonzero(self.text[:size] == self.text[n - 1 :])
        return mixed(h[whole]), whole


class Table:
    """A sorted array of 64-bit hashes with an index over their leading bits, four
    entries of it to a key; at() gives places in the array, -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, min(28, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def at(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        b = (h >> self.shift).astype(np.int64)
        place, stop = self.first[b], self.first[b + 1]
        some = np.flatnonzero(place < stop)
        while len(some):
            p = place[some]
            hit = self.keys[p] == h[some]
            out[some[hit]] = p[hit]
            some = some[~hit]
            place[some] += 1
            some = some[place[some] < stop[some]]
        return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
