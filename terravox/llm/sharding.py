"""Minimax contiguous partition of ordered atomic groups into shards.

Texts that are equal form one group; groups are ordered by the MD5 of their text. The smallest capacity with which
the ordered groups fit into so many shards is found by binary search, each capacity checked greedily, and the groups
are cut there.

The ordered group sizes are never gathered whole. Runs of neighbouring groups are summed up by a prefix of the hash; a
greedy check over the sums alone either settles a capacity or cuts inside some runs, and the runs that any check still
in question cuts are opened one level deeper, until no check is in question. What the driver holds is bounded by
the number of shards and the fan-out, not by the number of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravox.llm.words import free_name
from terravox.plans.storage import cut, discard

#: Hexadecimal digits of the hash that the first level of sums has, and that each further level adds.
DIGITS, MORE_DIGITS = 3, 2
#: Capacities that one round of the search tries.
PROBES = 7
#: Rows that one task numbers, about.
ROWS_PER_BUCKET = 100_000


class OrderedSums:
    """Prefix sums of group sizes over the ordered hashes, known down to the prefixes that were asked for."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.runs: dict[str, tuple[int, int, int]] = {}  # prefix: size, largest group, groups
        self.open(None)

    def open(self, prefixes: set[str] | None) -> None:
        """Read the sums of the first level, or of the given runs one level deeper."""
        runs = self.groups
        if prefixes is None:
            width = F.lit(DIGITS)
        else:
            runs = runs.where(" or ".join(f"(h >= '{k}' and h < '{k}g')" for k in sorted(prefixes)))  # ranges, so that the scan skips the rest
            width = F.coalesce(*[F.when(F.substring("h", 1, d).isin(sorted(k for k in prefixes if len(k) == d)), F.lit(d + MORE_DIGITS)) for d in sorted({len(k) for k in prefixes})])
        found = runs.withColumn("w", width).groupBy(F.expr("substring(h, 1, w)").alias("k"))
        for k in prefixes or ():
            del self.runs[k]
        self.runs |= {r.k: (int(r["size"]), int(r.largest), r.n) for r in found.agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()}
        self.keys = sorted(self.runs)
        self.ends = np.cumsum(np.array([self.runs[k][0] for k in self.keys], dtype=object))
        self.total = int(self.ends[-1]) if self.keys else 0

    def greedy(self, capacity: int, shards: int) -> tuple[list[str] | None, set[str]]:
        """First hashes (prefixes) of the shards after the first, or None if the groups don't fit; and the runs that must
        be opened before that is sure (then the first part is void). Behind a cut inside a run, which lies at most one
        group before the full capacity, the check goes on from there, to find the next runs to open as well."""
        cuts: list[str] = []
        doubtful: set[str] = set()
        at = 0  # size before the current shard
        while self.total - at > capacity and len(cuts) < shards - 1:
            i = int(np.searchsorted(self.ends, at + capacity, "right"))
            key = self.keys[i]
            start = self.ends[i] - self.runs[key][0]
            cuts.append(key)
            if self.runs[key][2] > 1:  # the cut lies inside this run
                doubtful.add(key)
                at += capacity
            elif start <= at:  # one group alone exceeds the capacity
                return None, doubtful
            else:
                at = start
        return (cuts if self.total - at <= capacity else None), doubtful


def smallest_capacity(sums: OrderedSums, shards: int) -> tuple[int, list[str]]:
    """The least capacity that suffices, and the first hashes of the shards after the first: binary search, of which one
    round of greedy checks takes three steps at once."""
    low, high = max([0, *(r[1] for r in sums.runs.values()), -(-sums.total // shards)]), sums.total
    while True:
        probes = sorted({low + (high - low) * k // (PROBES + 1) for k in range(PROBES + 1)})
        checks = {c: sums.greedy(c, shards) for c in probes}
        if doubtful := set().union(*(d for _, d in checks.values())):
            sums.open(doubtful)
            continue
        fits = [c for c in probes if checks[c][0] is not None]
        if fits and fits[0] == low:
            return low, checks[low][0] or []
        high = min([*fits, high])
        low = max(c for c in probes if checks[c][0] is None) + 1


def shard_documents(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law`` ("bytes"), ``shard`` (from 0),
    ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null under this law).

    Rows with equal texts share a shard; null texts have no bytes and form the group of the empty text; a text of any
    length is one group. Columns of the added names are replaced, all others stay, whatever their names; repeated rows
    get neighbouring slots in no particular order; ids are of any one type and may be null; an empty table gives no rows.
    Slots follow a hash of id and text, then the id (null first), so that many tasks number one shard, even where an id
    is frequent.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own_name = free_name([*docs.columns, *added], "_h")
    h, bucket, before = (f"{own_name}{x}" for x in ("", "_bucket", "_before"))
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    sized = docs.select(*own, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text.cast("binary")).alias(h))
    groups = cut(sized.groupBy(F.col(h).alias("h")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    unordered, groups = groups, cut(groups.repartitionByRange("h").sortWithinPartitions("h"))
    discard(unordered)
    rows = groups.agg(F.sum("rows")).first()[0] or 0
    _, cuts = smallest_capacity(OrderedSums(groups), shards)
    discard(groups)
    shard = F.lit(0)
    for k, first in enumerate(cuts, 1):
        shard = F.when(F.col(h) >= first, k).otherwise(shard)
    buckets = max(1, rows // (shards * ROWS_PER_BUCKET) + 1)
    placed = sized.withColumn("shard", shard.cast("int")).withColumn(bucket, F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.col(h)), F.lit(buckets)))
    counts = placed.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("shard", bucket).orderBy(F.col(f"`{id_column}`"), h)
    numbered = placed.join(offsets, ["shard", bucket]).withColumn("slot", F.col(before) + F.row_number().over(inside) - 1)
    return numbered.select(*own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
