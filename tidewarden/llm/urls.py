"""URL filter: a blocked Bloom filter in front of an exact hash join.

Only DataFrame functions. Listed keys are ``host + path`` texts. A listed key fits a URL when its host is the URL's
host or a parent domain of it and its path is a prefix of the URL's path. So the keys that could fit a URL are the
pairs of a host suffix and a path prefix; of these, only pairs with a shape (number of labels, length of path) that
the list has are made. Each goes to one block of the Bloom filter; what the filter passes meets the list in an exact
join, so no false positive stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 8                    # 64-bit words of a block; a key sets one bit in each
BITS_PER_KEY = 16
BROADCAST_BLOCKS = 1 << 18   # up to so many blocks (19 MB) the filter is broadcast, beyond that it is joined by block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host with A-Z in lower case, and the path; empty where there is none."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return host, F.regexp_extract(url, PARTS, 2)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """For each word of a block, the word with the key's bit set."""
    turn = F.xxhash64(key, F.lit(WORDS))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(turn, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: one row per block in use, ``WORDS`` words of 64 bits."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(
        *[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])


def passed(rows: DataFrame, key: str, listed_keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows whose key the Bloom filter of ``listed_keys`` (one column of that name) does not rule out."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    table = bloom(listed_keys, key, blocks).alias("b")
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    fits = F.col("b.block") == _block(F.col(f"r.{key}"), blocks)
    for i, bit in enumerate(_bits(F.col(f"r.{key}"))):
        fits &= F.col(f"b.w{i}").bitwiseAND(bit) == bit
    return rows.alias("r").join(table, fits, "left_semi")


def judge(pages: DataFrame, listed: DataFrame, id_name: str = "page_id", url_name: str = "url",
          otherwise: str = "allow") -> DataFrame:
    """One row per page: (id, host, path, rule, verdict).

    ``listed`` has (host, path, verdict); a null host, path or verdict lists nothing. The longest fitting key wins, of
    equally long ones the first in text order; a key listed twice counts once, with the smaller verdict. A URL that no
    key fits has a null rule and the verdict ``otherwise``. A URL without ``://`` or a null one has an empty host and
    path. Pages that occur twice come out twice; other columns of ``pages`` are ignored. An empty list or table gives
    no rules or no rows.

    The list may be large; two numbers of it come to the driver: its size, and its distinct shapes, which are at most
    the labels of a host (127) times the longest listed path, whatever the number of keys.
    """
    listed = (listed.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
              .groupBy("host", "path").agg(F.min("verdict").alias("verdict")))
    listed = listed.select(_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"),
                           "verdict", F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars"))
    n_keys = listed.count()
    shapes = sorted(tuple(r) for r in listed.select("labels", "chars").distinct().collect())
    host, path = host_and_path(F.col(url_name))
    rows = pages.select(F.col(id_name), host.alias("host"), path.alias("path"))
    if not n_keys:
        return rows.select(id_name, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(otherwise).alias("verdict"))
    shape = F.filter(F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("chars")) for k, n in shapes]),
                     lambda s: s.chars <= F.length("path"))
    could = rows.select("host", "path", F.explode(shape).alias("s")).select(
        "host", "path", F.expr("concat(substring_index(host, '.', -s.labels), '\n', substring(path, 1, s.chars))")
        .alias("key"))
    hits = passed(could, "key", listed.select("key"), n_keys).distinct().join(
        listed.select("key", "rule", "verdict"), "key")
    best = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.min_by(
        F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"), F.col("verdict"))).alias("best"))
    return rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        id_name, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))
