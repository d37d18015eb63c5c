"""SimHash near-dedup: fingerprints meet at the variants halfway between them.

A document's fingerprint has a bit set where more than half of the hashes of its word
n-grams have it set. Equal fingerprints are one node. Two fingerprints that differ in
at most three bits have a point between them, one or two flipped bits from either, so
each emits the variants within half the radius and those that emit the same one meet:

* Fingerprints that differ in an odd number of bits have different parity. The odd one
  goes two steps, the even one a single step; two of the same parity go one step each.
* Of any three bits two lie in the same half of the word, so the second step flips two
  bits of one half only: 992 variants in place of 2,016.

An odd fingerprint has 1 + 64 + 992 variants, an even one 64. Variants are spread over
ranges by a multiplication that can be undone; only the key's lower bytes and the number
of the flipped bits travel (8 to 10 bytes a variant), as the fingerprint follows from them.

In a range the members of a variant that are one step away are linked with all others
there (1 + 2 steps at most). One of them, the hub, is paired with each other member, which
connects all that meet; a variant has at most 1 + 64 + 992 members, however many rows
there are. Pairs are deduplicated, their distance is counted, and of what a range has
found only a forest is put out: a row per fingerprint, not one per pair.

Very large inputs take several passes over the fingerprints, each with the variants of
one class (a linear function of the bits, so a pass makes no others): disk and the
memory of a task are bounded by ``pass_variants`` and ``range_variants``.

Null texts and texts without words have fingerprint zero, which is linked like any
other; fewer words than n are one n-gram. Texts are read whole, in steps. Rows that
repeat a document get the same answer each. Rows without an id have a fingerprint and
tie others together, but never name a component (null if nothing else does). Extra
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import read_table, stage
from vitaframe.llm.components import components

SEED = 42
BITS = 64
RADIUS = 3
# n-grams of a text whose bits are counted at a time.
STEP = 1 << 16
# Variants that one task makes before it sends them, and that one range should hold.
BLOCK_VARIANTS = 1 << 21
RANGE_VARIANTS = 1 << 21
# Variants of one pass.
PASS_VARIANTS = 1 << 37
LEAST_RANGE_BITS, MOST_RANGE_BITS = 6, 16
# An odd factor and its inverse modulo 2^64.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """The fingerprint of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(n, len(words))
    count = len(words) - size + 1
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    ends = ends[size - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, count, STEP):
        spans = zip(starts[k : k + STEP], ends[k : k + STEP], strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """The bits to flip, and how many they are: none, each one, each two of one half."""
    half = BITS // 2
    chosen: list[tuple[int, ...]] = [(), *((b,) for b in range(BITS))]
    chosen += [pair for lo in (0, half) for pair in combinations(range(lo, lo + half), 2)]
    masks = np.array([sum(1 << b for b in bits) for bits in chosen], np.uint64)
    return masks, np.array([len(bits) for bits in chosen], np.uint8)


MASKS, STEPS = _flips()


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) & 1


def _class_of(x: np.ndarray, bits: int) -> np.ndarray:
    """A linear function of the bits: the class of a ^ b is that of a ^ that of b."""
    out = np.zeros(len(x), np.int64)
    for k in range(bits):
        taken = np.uint64(sum(1 << b for b in range(BITS) if (b * 0x9E3779B1 >> (7 + k)) & 1))
        out |= _parity(x & taken).astype(np.int64) << k
    return out


def _variants(fps: np.ndarray, wanted: int, class_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants of the fingerprints that fall into one class, and their flips."""
    mask_class, fp_class = _class_of(MASKS, class_bits), _class_of(fps, class_bits)
    odd = _parity(fps).astype(bool)
    keys, flips = [], []
    for c in np.unique(fp_class):
        of_class = np.flatnonzero(mask_class == c ^ wanted)
        here = fp_class == c
        for group, used in ((fps[here & odd], of_class), (fps[here & ~odd], of_class[STEPS[of_class] == 1])):
            if len(group) and len(used):
                keys.append((group[:, None] ^ MASKS[used]).ravel())
                flips.append(np.tile(used.astype(np.uint16), len(group)))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    return np.concatenate(keys), np.concatenate(flips)


def _met(keys: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hub and member wherever several fingerprints emit one variant."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    order = order[again]
    keys, flips = keys[order], flips[order]
    fps, steps = (keys * _BACK) ^ MASKS[flips], STEPS[flips]
    order = np.lexsort((fps, steps > 1, keys))
    keys, fps, steps = keys[order], fps[order], steps[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    hub = np.flatnonzero(first)[np.cumsum(first) - 1] if len(keys) else np.empty(0, np.int64)
    linked = ~first & (steps[hub] <= 1)
    a, b = fps[hub[linked]], fps[linked]
    close = np.bitwise_count(a ^ b) <= RADIUS
    pairs = np.unique(np.stack([np.minimum(a, b)[close], np.maximum(a, b)[close]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the smallest one that it is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[child]], nodes[child]


def _pass(nodes: DataFrame, wanted: int, class_bits: int, total: int, range_variants: int, block_variants: int) -> DataFrame:
    """a, b: fingerprints that the variants of one class connect."""
    # A range is named by the upper bits of its keys; bytes that all its keys share stay at home.
    range_bits = min(max(LEAST_RANGE_BITS, (-(-(total >> class_bits) // range_variants) - 1).bit_length()), MOST_RANGE_BITS)
    cut = 8 - range_bits // 8
    shift = np.uint64(64 - range_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, block_variants * (1 << class_bits) // len(MASKS))
        for fps in _in_steps(batches, step):
            variants, flips = _variants(fps, wanted, class_bits)
            keys = variants * _SPREAD
            part = (keys >> shift).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            part, keys, flips = part[order], keys[order], flips[order]
            heads = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, np.int64)
            low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :cut])
            bounds = np.append(heads, len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[heads].astype(np.int32)), _blobs(low.ravel(), bounds * cut), _blobs(flips.astype("<u2").view(np.uint8), bounds * 2)],
                ["part", "keys", "flips"],
            )

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(group["keys"]), np.uint8).reshape(-1, cut)
        whole = np.zeros((len(low), 8), np.uint8)
        whole[:, :cut] = low
        whole[:, cut:] = np.array([int(key[0]) << (64 - range_bits)], "<u8").view(np.uint8)[cut:]
        keys = whole.view("<u8").ravel()
        a, b = _forest(*_met(keys, np.frombuffer(b"".join(group["flips"]), "<u2")))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = nodes.select("fp").mapInArrow(send, "part int, keys binary, flips binary")
    if 1 << range_bits > 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # As many tasks as there are ranges ask for, whatever the setting.
        sent = sent.repartition(1 << (range_bits - 1), "part")
    return sent.groupBy("part").applyInPandas(meet, "a long, b long")


def _in_steps(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[np.ndarray]:
    """The fingerprints of the batches, so many at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, held)) >= step:
            fps = np.concatenate(held)
            whole = len(fps) // step * step
            for k in range(0, whole, step):
                yield fps[k : k + step]
            held = [fps[whole:]]
    if held and len(rest := np.concatenate(held)):
        yield rest


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The slices between bounds as a binary column."""
    offsets = pa.py_buffer(np.ascontiguousarray(bounds.astype(np.int32)))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def links(
    nodes: DataFrame,
    pass_variants: int = PASS_VARIANTS,
    range_variants: int = RANGE_VARIANTS,
    block_variants: int = BLOCK_VARIANTS,
) -> DataFrame:
    """``nodes``: distinct fp. Returns a, b: edges that connect all that links of three bits or fewer connect."""
    odd = (F.bit_count("fp") % 2) == 1
    n_odd, n_even = nodes.agg(F.count_if(odd), F.count_if(~odd)).first()
    total = n_odd * len(MASKS) + n_even * BITS
    class_bits = max(0, (max(total, 1) - 1) // pass_variants).bit_length()
    found = None
    for wanted in range(1 << class_bits):
        part = _pass(nodes, wanted, class_bits, total, range_variants, block_variants)
        part = stage(part.distinct(), f"simhash-links-{wanted}")
        found = part if found is None else found.unionByName(part)
    return found


def near_copies(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and component_id (smallest id reachable)."""
    rows = stage(fingerprints(docs, n, id_col, text_col), "simhash-rows")
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    found = components(links(nodes, **sizes)).select(F.col("node"), F.col("component"))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = stage(named, "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stage(named.join(least, "component").select(F.col("fp").alias("a_fp"), "component_id"), "simhash-answer")
    out = rows.join(answer, F.col("fp") == F.col("a_fp"))
    return out.select(F.col("id").alias(id_col), _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    found = near_copies(docs, n, id_col, text_col)
    gone = stage(
        found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct(), "simhash-gone"
    )
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read_table(spark, sf_dir, "documents"))
