"""N-gram Jaccard join with adaptive prefixes that must match several times.

A document is the set of its distinct word n-grams. Two documents are linked if
100 * intersection >= threshold * union. Documents with the same set are one class.
The n-grams of a class stand in one order for all, rare ones first, and its prefix
is long enough that linked classes share at least one n-gram of their prefixes. A
prefix longer by l - 1 asks for l shared n-grams; each class takes the l with the
least estimated cost: entries read, and candidates to verify, both from the n-grams'
frequencies.

Only prefix n-grams held by several classes travel on. Candidates are verified in
two rounds. First every class meets, per shared n-gram, the class in which that
n-gram stands most to the front, which ties groups of near copies together without
listing their pairs. Then classes of different components meet wherever they share
an n-gram; a pair is put out once, at the n-gram that completes the shared ones asked
for, and verified. So no link between components is missed, and pairs inside a
component, or that share too little, are not listed.

Frequencies are counted over all documents in a table of fixed size (2^22 counts);
it only decides the order. N-grams are 64-bit hashes of words.

Words are lower-cased (A-Z) runs of anything but white space. A text with fewer
words than n is one n-gram; null texts and texts without words have an empty set and
are linked with nothing: their component is their own id. Rows that repeat a
document get the same answer each. Rows without an id are linked with nothing and
have no component. Texts of any length are read whole, one at a time. Extra columns
play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import STAGED, discard_since, read_table, stage
from vitaframe.llm.components import components
from vitaframe.llm.shared_tokens import id_filter, is_shared, passes, shared_tokens, slot_of

COUNT_BITS = 22
COUNT_PARTS = 64
LONGEST_MATCH = 4
VERIFY_COST = 20
# So many of a class's shared prefix n-grams travel with each of its entries.
LEAD = 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The hashes of a text's distinct word n-grams, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total * _STEP + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(total)


def _packed_counts(total: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(total.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def count_ngrams(texts: DataFrame, n: int) -> np.ndarray:
    """Frequencies by the upper bits of the n-grams: 2^22 counts, whatever the input.

    Added up in two steps: with t tasks no task of either adds more than about twice
    the root of t tables.
    """
    width = (1 << COUNT_BITS) // COUNT_PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text, n) >> np.uint64(64 - COUNT_BITS)
                np.add.at(total, found.astype(np.int64), 1)
        if total.any():
            slot = math.isqrt(TaskContext.get().partitionId())
            yield pd.DataFrame(
                [(p, slot, _packed_counts(total[p * width : (p + 1) * width])) for p in range(COUNT_PARTS)],
                columns=["part", "slot", "counts"],
            )

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for blob in group["counts"]:
            total += _counts(blob)
        total = np.minimum(total, np.iinfo(np.uint32).max)
        return pd.DataFrame({"part": [key[0]], "counts": [_packed_counts(total)]})

    parts = texts.select("text").mapInPandas(count, "part int, slot int, counts binary")
    parts = parts.groupBy("part", "slot").applyInPandas(add, "part int, counts binary")
    out = np.zeros(1 << COUNT_BITS, np.uint32)
    for row in parts.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[row[0] * width : (row[0] + 1) * width] = _counts(row[1])
    return out


def prefix(found: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
    """The prefix of a set (rare n-grams first) and how many of it must be shared."""
    n = len(found)
    least = -(-threshold * n // 100)
    often = counts[(found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.float64)
    order = np.lexsort((found, often))
    longest = min(LONGEST_MATCH, least)
    reads = np.cumsum(often[order[: n - least + longest]] - 1)
    cost = [reads[n - least + l - 1] * (1 + VERIFY_COST / l**2) for l in range(1, longest + 1)]  # noqa: E741
    matches = 1 + int(np.argmin(cost))
    return found[order[: n - least + matches]], matches


def _sets(texts: DataFrame, n: int, threshold: int, counts) -> DataFrame:
    """id, n, set_id (equal for equal sets), matches, tokens (the prefix, in order)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, needed, prefixes = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), n)
                sizes.append(len(found))
                names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                tokens, matches = prefix(found, counts.value, threshold) if len(found) else (found, 0)
                needed.append(matches)
                prefixes.append(tokens.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(needed, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), values)],
                ["id", "n", "set_id", "matches", "tokens"],
            )

    return texts.mapInArrow(run, f"id {kind}, n long, set_id binary, matches int, tokens array<bigint>")


def _postings(nodes: DataFrame, total: int) -> DataFrame:
    """token, node, n, matches, at_most, place: prefix n-grams that several nodes hold.

    ``place`` counts the node's shared ones before it.
    ``at_most`` bounds how many n-grams the node can share with a node that it
    meets at this entry: what comes after, it, and the shared ones before it.
    """
    shared = shared_tokens(nodes.select(F.col("node").alias("id"), "tokens"), total)
    shared = shared.groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("shared"))
    rows = nodes.join(shared, F.col("node") == F.col("id")).select("node", "n", "matches", "tokens", "shared")
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                parts = []
                for node, n, matches, tokens, shared in batch.iloc[k : k + 500].itertuples(index=False):
                    tokens = np.asarray(tokens, np.int64)
                    at = np.flatnonzero(is_shared(tokens, np.asarray(shared, np.int64), total))
                    at_most = np.arange(len(at)) + n - at
                    parts.append(pd.DataFrame({"token": tokens[at], "node": node, "n": n, "matches": matches, "at_most": at_most, "place": np.arange(len(at))}))
                yield pd.concat(parts)

    return rows.mapInPandas(run, f"token long, node {kind}, n long, matches int, at_most long, place int")


def _across(rest: DataFrame, leads: DataFrame, may_link: Column) -> DataFrame:
    """The pairs (a, b) of different components that share enough prefix n-grams.

    ``leads``: node and its first LEAD shared n-grams, in order. The order is the same
    for all, so the shared ones before an entry tell which match it is. Where both
    places lie within LEAD only the match that completes a pair is put out; further on
    each match is, and counted, for pairs not complete within LEAD.
    """
    rows = rest.join(leads, F.col("node") == F.col("l_node")).drop("l_node")
    rows = stage(rows.withColumn("before", F.slice("lead", F.lit(1), F.least("place", F.lit(LEAD)))).drop("lead"), "join-leads")
    x = rows.select([F.col(c).alias(f"x_{c}") for c in rows.columns])
    y = rows.select([F.col(c).alias(f"y_{c}") for c in rows.columns])
    needed = F.least("x_matches", "y_matches")
    earlier = F.size(F.array_intersect("x_before", "y_before"))
    near = (F.col("x_place") < LEAD) & (F.col("y_place") < LEAD)
    wanted = F.when(near, earlier == needed - 1).otherwise(earlier < needed)
    met = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_comp") < F.col("y_comp")) & may_link & wanted)
    pairs = met.groupBy(F.col("x_node").alias("a"), F.col("y_node").alias("b")).agg(
        F.max(near).alias("complete"), F.count_if(~near).alias("further"), F.max(earlier).alias("earlier"), F.first(needed).alias("needed")
    )
    return pairs.filter("complete OR earlier + further >= needed").select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    one = sets.select(F.col("node").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("nb"), F.col("tokens").alias("tb"))
    met = pairs.join(two, F.col("b") == F.col("nb")).join(one, F.col("a") == F.col("na"))
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return met.select("a", "b", common.alias("c"), (F.size("ta") + F.size("tb")).alias("s")).filter(
        100 * F.col("c") >= threshold * (F.col("s") - F.col("c"))
    ).select("a", "b")


def join_components(
    docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's id, n_shingles and component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(count_ngrams(texts, n))
    rows = stage(_sets(texts, n, threshold, counts), "join-sets")
    counts.destroy()  # what was made from it is staged
    usable = rows.filter("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("set_id", "n", "matches").agg(F.min("id").alias("node"), F.first("tokens").alias("tokens"))
    nodes = stage(classes, "join-classes")
    total = nodes.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    entries = stage(_postings(nodes, total), "join-entries")
    # Classes that could share enough with any other at all.
    able = entries.filter(100 * F.col("at_most") >= threshold * F.col("n"))
    heads = able.groupBy("token").agg(
        F.min(F.struct((F.col("n") - F.col("at_most")).alias("front"), "node", "n", "matches", "at_most")).alias("head"),
        F.count(F.lit(1)).alias("held"),
    )
    heads = heads.filter("held > 1").select(F.col("token").alias("x_token"), *[F.col(f"head.{c}").alias(f"x_{c}") for c in ("node", "n", "matches", "at_most")])
    able = stage(able.join(heads, F.col("token") == F.col("x_token")).drop("x_token"), "join-able")

    def may_link(x: str, y: str) -> Column:
        """Whether sizes, and what can be shared at most, allow a link."""
        n1, n2 = F.col(f"{x}n"), F.col(f"{y}n")
        bound = F.least(F.col(f"{x}at_most"), F.col(f"{y}at_most"))
        return (100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2)) & (100 * bound >= threshold * (n1 + n2 - bound))

    def counted(met: DataFrame, x: str, y: str) -> DataFrame:
        """The pairs that share as many prefix n-grams as asked for."""
        pairs = met.groupBy(F.col(f"{x}node").alias("a"), F.col(f"{y}node").alias("b")).agg(
            F.count(F.lit(1)).alias("shared"), F.first(F.least(F.col(f"{x}matches"), F.col(f"{y}matches"))).alias("needed")
        )
        return pairs.filter("shared >= needed").select("a", "b")

    kind = texts.schema["id"].dataType.simpleString()

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The whole sets of the nodes in pairs. Texts stay where they are."""
        wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w")))
        bits = spark.sparkContext.broadcast(id_filter(wanted, "w"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen = [k for k, slot in enumerate(batch.column(2).to_pylist()) if passes(bits.value, slot)]
                for k in range(0, len(chosen), 500):
                    part = chosen[k : k + 500]
                    found = [shingles(batch.column(1)[i].as_py(), n).view(np.int64) for i in part]
                    ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), lists], ["node", "tokens"])

        slots = texts.filter(F.col("id").isNotNull()).select("id", "text", slot_of(F.col("id")).alias("slot"))
        sets = stage(slots.mapInArrow(run, f"node {kind}, tokens array<bigint>"), "join-full-sets")
        bits.destroy()
        return sets

    star = able.filter((F.col("x_node") != F.col("node")) & may_link("x_", ""))
    pairs = stage(counted(star, "x_", ""), "join-pairs")
    links = stage(_verify(pairs, sets_of(pairs), threshold), "join-links")
    found = components(links)

    named = able.select("token", "node", "n", "matches", "at_most", "place").join(
        found.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left"
    )
    named = stage(named.withColumn("comp", F.coalesce("component", "node")).drop("c_node", "component"), "join-named")
    torn = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    rest = stage(named.join(torn.select(F.col("token").alias("t")), F.col("token") == F.col("t")).drop("t"), "join-rest")
    torn_nodes = rest.select(F.col("node").alias("t_node")).distinct()
    first = entries.filter(F.col("place") < LEAD).join(torn_nodes, F.col("node") == F.col("t_node"), "left_semi")
    leads = first.groupBy(F.col("node").alias("l_node")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda e: e["token"]).alias("lead")
    )
    more = stage(_across(rest, leads, may_link("x_", "y_")), "join-more")
    if not more.isEmpty():
        links = stage(links.unionByName(_verify(more, sets_of(more), threshold)), "join-all-links")
        found = components(links)
    answer = nodes.join(found.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select(
        F.col("set_id").alias("s"), F.coalesce("component", "node").alias("component_id")
    )
    out = rows.select("id", "n", "set_id").join(answer, F.col("set_id") == F.col("s"), "left")
    own = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    mark = len(STAGED)
    found = join_components(docs, n, threshold, id_col, text_col)
    gone = stage(
        found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct(), "join-gone"
    )
    discard_since(mark, gone)
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents"), n=3, threshold=90)
