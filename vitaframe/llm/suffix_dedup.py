"""Suffix-array dedup: repeated strings of 50 bytes, by a distributed merge sort.

Every string of ``LENGTH`` bytes holds an anchor: the 24-byte gram of the smallest
hash in it. Equal strings have their anchors at the same place, so only suffixes
that start at anchors are sorted. Of these, only suffixes whose gram occurs in two
documents at all take part (``shared_tokens``).

Each task sorts its suffixes (50 bytes each) into a run. Entries alike in suffix and
in the bytes before it are settled within the run: the smallest document stands for
them. Runs are cut by splitters taken from a sample of documents that follows the number of
ranges, and sent front-coded: the length of the prefix shared with the entry before, and the
rest. With more than ``LEVEL_RANGES`` ranges runs are cut coarsely first; tasks that take
a bounded part of a coarse range make longer runs of its pieces, settle what is alike
in them, and cut these by splitters of their own. A range's runs are
combined by a loser tree that knows how long a prefix each entry shares with the
last one put out; it compares bytes only where these are equal, and only from there
on. The merged order comes with the common prefix of neighbours, so strings that
start at the anchor or up to 26 bytes before it are grouped by runs of long enough
common prefixes and by the rank of the bytes before the anchor, all exact. In each
group the smallest document keeps the string.

Null texts are empty. Texts shorter than 50 bytes lose nothing. Rows that repeat a
document are alike and do not remove from each other. Rows without an id take no part
and lose nothing. Ids are whole numbers. Extra columns play no part. Entries at the
border of a passage differ from document to document, so a passage in very many
documents brings as many entries of about 100 bytes to one range.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import collect_garbage, discard, read_table, stage
from vitaframe.llm.jaccard_join import mixed
from vitaframe.llm.shared_tokens import id_filter, is_shared, pack, passes, shared_tokens, slot_of, unpack

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM  # an anchor starts at most so far into its string
RUN_ENTRIES = 1 << 18
RANGE_BYTES = 16 << 20
SETTLED = 1 << 12  # groups for what is settled within a run
LEVEL_RANGES = 1024
SAMPLE_DOCS = 2_000  # at least
SAMPLE_GRAMS = 20  # of a document
SAMPLES = 32  # for each range
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchors of a text start, and the hashes of their grams."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    grams = n - GRAM + 1
    hashes = words[:grams] * _FACTORS[0]
    for k in (1, 2):
        hashes = mixed(hashes + words[8 * k : 8 * k + grams] * _FACTORS[k])

    def slide(x: np.ndarray, best) -> np.ndarray:
        """Best of every REACH + 1 neighbours."""
        width, out = 1, x
        while 2 * width <= REACH + 1:
            out = best(out[:-width], out[width:])
            width *= 2
        rest = REACH + 1 - width
        return best(out[: len(out) - rest], out[rest:]) if rest else out

    least = slide(hashes, np.minimum)
    none = np.zeros(REACH, np.uint64)
    chosen = slide(np.concatenate([none, least, none]), np.maximum) == hashes
    at = np.flatnonzero(chosen)
    return at, hashes[at]


def anchor_tokens(text: str) -> np.ndarray:
    return np.unique(anchors(text.encode("utf-8", "surrogatepass"))[1])


def sampled_grams(docs: DataFrame, n_docs: int, wanted: int) -> DataFrame:
    """About so many grams of anchors (column gram), from documents chosen by a hash."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                data = text.encode("utf-8", "surrogatepass")
                at = anchors(data)[0]
                step = max(1, len(at) // SAMPLE_GRAMS)
                out += [data[a : a + GRAM] for a in at[::step].tolist()]
            yield pd.DataFrame({"gram": pd.Series(out, dtype=object)})

    share = min(1.0, wanted / SAMPLE_GRAMS / max(1, n_docs))
    some = docs.filter(F.pmod(F.xxhash64("id", F.lit("split")), F.lit(1_000_000_000)) < int(share * 1_000_000_000) + 1)
    return some.select("text").mapInPandas(sample, "gram binary")


def _cuts(grams: list[bytes], ranges: int) -> list[bytes]:
    grams = sorted(grams)
    return sorted({grams[len(grams) * k // ranges] for k in range(1, ranges)}) if grams else []


def splitters(docs: DataFrame, n_docs: int, ranges: int, level_ranges: int) -> tuple[list[bytes], int, DataFrame | None]:
    """Grams that cut the suffixes into ranges of about equal size: those of the first level, how
    many ranges each of its ranges has, and a table of these ranges' splitters (part, edges)."""
    fine = -(-ranges // level_ranges)
    coarse = -(-ranges // fine)
    first = sampled_grams(docs, n_docs, max(SAMPLE_DOCS * SAMPLE_GRAMS, SAMPLES * coarse))
    cuts = _cuts([bytes(r[0]) for r in first.collect()], coarse)
    if fine == 1:
        return cuts, 1, None

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": [bisect_right(cuts, g) for g in batch["gram"]], "gram": batch["gram"]})

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "edges": [b"".join(_cuts(group["gram"].tolist(), fine))]})

    grams = sampled_grams(docs, n_docs, SAMPLES * ranges).mapInPandas(place, "part int, gram binary")
    return cuts, fine, stage(grams.groupBy("part").applyInPandas(choose, "part int, edges binary"), "suffix-edges")


class Entries:
    """Suffixes with the bytes before them, as matrices padded with zeros."""

    def __init__(self, right, left, sizes, doc, at):
        self.right, self.left, self.sizes, self.doc, self.at = right, left, sizes, doc, at

    def take(self, order: np.ndarray) -> Entries:
        return Entries(self.right[order], self.left[order], self.sizes[order], self.doc[order], self.at[order])


def cut_entries(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The LENGTH bytes from each anchor, the REACH bytes before it, and how many are real."""
    padded = np.frombuffer(bytes(REACH) + data + bytes(LENGTH), np.uint8)
    around = padded[at[:, None] + np.arange(REACH + LENGTH)]
    sizes = np.stack([np.minimum(LENGTH, len(data) - at), np.minimum(REACH, at)], axis=1).astype(np.uint8)
    return around[:, REACH:], around[:, :REACH], sizes


def _keys(matrix: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, the first word last (for lexsort)."""
    width = -(-matrix.shape[1] // 8) * 8
    wide = np.zeros((len(matrix), width), np.uint8)
    wide[:, : matrix.shape[1]] = matrix
    words = wide.view(">u8").astype(np.uint64)
    return [words[:, k] for k in range(words.shape[1] - 1, -1, -1)]


def common_prefix(matrix: np.ndarray) -> np.ndarray:
    """Of each row with the row before it (0 for the first)."""
    out = np.zeros(len(matrix), np.int64)
    if len(matrix) > 1:
        differ = matrix[1:] != matrix[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return out


def all_strings(sizes: np.ndarray) -> np.ndarray:
    """Bit o is set if the string that starts o bytes before the anchor lies in the text."""
    o = np.arange(REACH + 1)
    fits = (sizes[:, 1:2] >= o) & (sizes[:, :1].astype(np.int64) + o >= LENGTH)
    return (fits << o).sum(axis=1)


def sort_run(entries: Entries) -> tuple[Entries, Entries]:
    """The sorted run without repeated entries, and the repeated ones of larger documents."""
    keys = [entries.at, entries.doc, entries.sizes[:, 1], entries.sizes[:, 0], *_keys(entries.left), *_keys(entries.right)]
    e = entries.take(np.lexsort(keys))
    same = np.zeros(len(e.doc), bool)
    if len(e.doc) > 1:
        same[1:] = (
            (e.right[1:] == e.right[:-1]).all(axis=1) & (e.left[1:] == e.left[:-1]).all(axis=1) & (e.sizes[1:] == e.sizes[:-1]).all(axis=1)
        )
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    later = same & (e.doc > e.doc[first])
    return e.take(np.flatnonzero(~later)), e.take(np.flatnonzero(later))


def front_code(e: Entries) -> bytes:
    """A sorted run: lengths of common prefixes, what follows them, and the rest."""
    shared = common_prefix(e.right)
    rest = e.right[np.arange(LENGTH) >= shared[:, None]]
    parts = [shared.astype(np.uint8).tobytes(), rest.tobytes(), e.left.tobytes(), e.sizes.tobytes(), pack(e.doc), pack(e.at)]
    blob = struct.pack("<7q", len(e.doc), *map(len, parts)) + b"".join(parts)
    return zstandard.ZstdCompressor(level=1).compress(blob)


def front_decode(blob: bytes) -> Entries:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n, *sizes = struct.unpack_from("<7q", blob)
    at, parts = 56, []
    for size in sizes:
        parts.append(blob[at : at + size])
        at += size
    shared = np.frombuffer(parts[0], np.uint8).astype(np.int64)
    rest = np.frombuffer(parts[1], np.uint8)
    start = np.cumsum(LENGTH - shared) - (LENGTH - shared)
    right = np.empty((n, LENGTH), np.uint8)
    for c in range(LENGTH):
        # The last entry at or above that spells this column out.
        owner = np.maximum.accumulate(np.where(shared <= c, np.arange(n), 0))
        right[:, c] = rest[start[owner] + c - shared[owner]]
    left = np.frombuffer(parts[2], np.uint8).reshape(n, REACH)
    size = np.frombuffer(parts[3], np.uint8).reshape(n, 2)
    return Entries(right, left, size, unpack(parts[4]).view(np.int64), unpack(parts[5]).view(np.int64))


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs: run and place of each entry in order, and its
    common prefix with the entry before.

    ``prefixes`` holds each entry's common prefix with its predecessor in the run.
    Each candidate carries its common prefix with the last entry put out. The longer
    one wins; only for equal ones are bytes compared, from that place on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r) for r in runs] + [0] * (k - len(runs))
    place = [0] * k
    text = [runs[i][0] if ends[i] else None for i in range(k)]
    known = [0] * k
    tree = [0] * k
    out_run, out_place, out_prefix = [], [], []

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one with the winner."""
        ta, tb = text[a], text[b]
        if tb is None:
            return a, b
        if ta is None:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        while ka < LENGTH:
            if ta[ka : ka + 8] != tb[ka : ka + 8]:
                while ta[ka] == tb[ka]:
                    ka += 1
                if ta[ka] < tb[ka]:
                    known[b] = ka
                    return a, b
                known[a] = ka
                return b, a
            ka += 8
        known[b] = LENGTH
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if k > 1 else 0
    while text[top] is not None:
        out_run.append(top)
        at = place[top]
        out_place.append(at)
        out_prefix.append(known[top])
        at += 1
        place[top] = at
        if at < ends[top]:
            text[top], known[top] = runs[top][at], prefixes[top][at]
        else:
            text[top] = None
        node = (top + k) >> 1
        while node:
            other = tree[node]
            to = text[other]
            if to is not None:
                if text[top] is None:
                    tree[node], top = top, other
                elif known[other] > known[top]:
                    tree[node], top = top, other
                elif known[other] == known[top]:
                    top, tree[node] = play(top, other)
            node >>= 1
    return out_run, out_place, out_prefix


def repeated_strings(e: Entries, prefix: np.ndarray) -> np.ndarray:
    """Per entry of the merged order, the strings (as bits) that a smaller document has."""
    n = len(e.doc)
    mask = np.zeros(n, np.int64)
    backward = np.ascontiguousarray(e.left[:, ::-1])
    order = np.lexsort(_keys(backward))
    before = common_prefix(backward[order])
    ranked = np.empty(n, np.int64)
    for o in range(REACH + 1):
        ranked[order] = np.cumsum(before < o) if o else 0
        group = np.cumsum(prefix < LENGTH - o) * np.int64(n + 1) + ranked
        fits = np.flatnonzero((e.sizes[:, 1] >= o) & (e.sizes[:, 0].astype(np.int64) + o >= LENGTH))
        if len(fits) < 2:
            continue
        fits = fits[np.argsort(group[fits], kind="stable")]
        starts = np.flatnonzero(np.diff(group[fits], prepend=-1))
        least = np.minimum.reduceat(e.doc[fits], starts)
        least = np.repeat(least, np.diff(np.append(starts, len(fits))))
        mask[fits] |= (e.doc[fits] > least).astype(np.int64) << o
    return mask


def _by_document(doc: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[list, list, list]:
    used = mask != 0
    doc, at, mask = doc[used], at[used], mask[used]
    order = np.argsort(doc, kind="stable")
    starts = np.flatnonzero(np.diff(doc[order], prepend=doc[order][0] - 1)) if len(order) else np.empty(0, np.int64)
    return doc[order][starts].tolist(), np.split(at[order], starts[1:]) if len(order) else [], np.split(mask[order], starts[1:]) if len(order) else []


def cut_run(entries: Entries, edges: list[bytes], first: int) -> list[tuple]:
    """A run's pieces by range (part, run), parts counted from ``first``, and what is settled within
    it (a part below zero; id, at, mask)."""
    kept, later = sort_run(entries)
    out = [(-1 - i % SETTLED, None, i, at, mask) for i, at, mask in zip(*_by_document(later.doc, later.at, all_strings(later.sizes)), strict=True)]
    grams = kept.right[:, :GRAM]
    starts = [0, *(_first_at(grams, x) for x in edges), len(grams)]
    for part, (a, b) in enumerate(zip(starts, starts[1:], strict=False), first):
        if a < b:
            out.append((part, front_code(kept.take(np.arange(a, b))), None, None, None))
    return out


def _joined(parts: list[Entries]) -> Entries:
    return Entries(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("right", "left", "sizes", "doc", "at")))


def find_repeats(docs: DataFrame, range_bytes: int = RANGE_BYTES, level_ranges: int = LEVEL_RANGES) -> DataFrame:
    """``docs``: id (long), text. Per id (``f_id``): anchors ``at`` and ``mask``.

    Bit o of a mask: the string that starts o bytes before the anchor is in a smaller document.
    """
    size, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    total = max(1, 2 * size // (REACH + 2))
    shared = shared_tokens(docs, total, anchor_tokens).groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("shared"))
    shared = stage(shared.withColumnRenamed("id", "s_id"), "suffix-shared")
    cuts, fine, finer = splitters(docs, n_docs, max(64, -(-size // range_bytes)), level_ranges)
    rows = docs.join(shared, F.col("id") == F.col("s_id")).select("id", "text", "shared")
    schema = "part int, run binary, id long, at array<bigint>, mask array<bigint>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def run() -> pa.RecordBatch:
            columns = list(zip(*cut_run(Entries(*(np.concatenate(x) for x in zip(*held, strict=True))), cuts, 0), strict=True))
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "run", "id", "at", "mask"]
            )

        for batch in batches:
            for doc, text, tokens in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                at, hashes = anchors(data)
                at = at[is_shared(hashes, tokens.values.to_numpy(zero_copy_only=False), total)]
                for k in range(0, len(at), RUN_ENTRIES):
                    some = at[k : k + RUN_ENTRIES]
                    held.append((*cut_entries(data, some), np.full(len(some), doc.as_py()), some))
                    count += len(some)
                    if count >= RUN_ENTRIES:
                        yield run()
                        held, count = [], 0
        if count:
            yield run()

    def cut_again(key: tuple, pieces: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Longer runs of the pieces of a coarse range, cut by its own splitters."""
        if key[0] < 0 or not len(pieces):
            return pieces[["part", "run", "id", "at", "mask"]]
        edges = own["edges"].iloc[0] if len(own) else b""
        edges = [edges[k : k + GRAM] for k in range(0, len(edges), GRAM)]
        out = cut_run(_joined([front_decode(b) for b in pieces["run"]]), edges, key[0] * fine)
        return pd.DataFrame({name: pd.Series(c, dtype=object) for name, c in zip(("part", "run", "id", "at", "mask"), zip(*out, strict=True), strict=True)})

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # settled within a run
            return group[["id", "at", "mask"]]
        parts = [front_decode(b) for b in group["run"]]
        texts = [p.right.tobytes() for p in parts]
        strings = [[t[i : i + LENGTH] for i in range(0, len(t), LENGTH)] for t in texts]
        order_run, order_place, prefix = merge_runs(strings, [common_prefix(p.right).tolist() for p in parts])
        first = np.cumsum([0, *(len(p.doc) for p in parts)])
        order = first[np.array(order_run, np.int64)] + np.array(order_place, np.int64)
        whole = _joined(parts).take(order)
        ids, ats, masks = _by_document(whole.doc, whole.at, repeated_strings(whole, np.array(prefix, np.int64)))
        return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "at": pd.Series(ats, dtype=object), "mask": pd.Series(masks, dtype=object)})

    sent = rows.mapInArrow(send, schema)
    if finer is not None:
        # Tasks that put a coarse range together: each takes a few runs' worth of entries.
        slots = max(1, total * fine // max(64, -(-size // range_bytes)) // (4 * RUN_ENTRIES))
        slot = F.when(F.col("part") < 0, 0).otherwise(F.pmod(F.xxhash64("run"), F.lit(slots))).cast("int").alias("slot")
        spread = finer.select("part", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "edges")
        sent = sent.select("*", slot).groupBy("part", "slot").cogroup(spread.groupBy("part", "slot")).applyInPandas(cut_again, schema)
    whole = (
        sent.groupBy("part")
        .applyInPandas(meet, "id long, at array<bigint>, mask array<bigint>")
        .groupBy(F.col("id").alias("f_id"))
        .agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("mask")).alias("mask"))
    )
    del rows, sent
    found = stage(whole, "suffix-found")
    discard(shared)
    return found


def _first_at(grams: np.ndarray, edge: bytes) -> int:
    """The first of the sorted grams that is not before the edge."""
    lo, hi = 0, len(grams)
    while lo < hi:
        mid = (lo + hi) // 2
        if grams[mid].tobytes() < edge:
            lo = mid + 1
        else:
            hi = mid
    return lo


def covered(n: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a marked string."""
    steps = np.zeros(n + 1, np.int64)
    for o in range(REACH + 1):
        start = at[(mask >> o) & 1 == 1] - o
        np.add.at(steps, start, 1)
        np.add.at(steps, start + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False,
    range_bytes: int = RANGE_BYTES, level_ranges: int = LEVEL_RANGES,
) -> DataFrame:
    """Every row's id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes ``kept`` if asked for."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = find_repeats(slim.filter(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH)), range_bytes, level_ranges)
    collect_garbage(docs.sparkSession)  # the texts and runs that were sent
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(found, "f_id"))

    def result(doc, text, at, mask) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        n_removed = n_spans = 0
        kept = data
        if at is not None:
            gone = covered(len(data), at, mask)
            n_removed = int(gone.sum())
            n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        row = (doc, len(data), n_removed, n_spans, hashlib.sha256(kept).hexdigest())
        return (*row, kept) if with_bytes else row

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_bytes
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, slots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield batch_of([result(i, batch.column(1)[k].as_py(), None, None) for k, (i, s) in enumerate(zip(ids, slots, strict=True)) if s is None or not passes(bits.value, s)])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(2).to_pylist()
            yield batch.filter(pa.array([s is not None and passes(bits.value, s) for s in slots], pa.bool_()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, at, mask in zip(*batch.columns, strict=True):
                lists = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in (at, mask)]
                out.append(result(doc.as_py(), text.as_py(), *lists))
            yield batch_of(out)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    slots = slim.select("id", "text", F.when(F.col("id").isNotNull(), slot_of(F.col("id"))).alias("slot"))
    some = slots.mapInArrow(touched, "id long, text string, slot long")
    some = some.join(found, F.col("id") == F.col("f_id"), "left").select("id", "text", "at", "mask").mapInArrow(cut, schema)
    return slots.mapInArrow(untouched, schema).unionByName(some).withColumnRenamed("id", id_col)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
