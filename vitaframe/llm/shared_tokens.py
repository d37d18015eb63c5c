"""Which 64-bit tokens occur in more than one document.

Only what is needed to tell travels: each task packs its documents into blocks,
cuts the sorted tokens of a block into ranges and sends, per range, the steps from
token to token (to as many bits as the number of tokens asks for) and the place of
the document in the block. A range meets in one task; how many ranges there are
follows the number of tokens, and tokens are hashes, so ranges are alike in size. A
token held by very many documents adds one step per document and block.

A block is cut into ``LEVEL_RANGES`` pieces at most, so that pieces stay long: with
more ranges blocks are cut coarsely first, pieces of one coarse range are put together
to new blocks by tasks that take a bounded number of tokens each, and these are cut
into the final ranges. That is enough for LEVEL_RANGES squared.

Cutting tokens to fewer bits can only name too many tokens, never too few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 19
LEAST_RANGES = 64
LEVEL_RANGES = 4096


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _token_lists(batches: Iterator[pa.RecordBatch], tokens_of: Callable | None) -> Iterator[tuple]:
    """id and tokens of every row."""
    for batch in batches:
        for i, value in zip(batch.column(0), batch.column(1), strict=True):
            if tokens_of is None:
                yield i.as_py(), value.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            else:
                yield i.as_py(), tokens_of(value.as_py())


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """ids, tokens and the place of each token's document, up to a size."""
    ids, parts, size = [], [], 0
    for i, tokens in rows:
        if len(tokens):
            ids.append(i)
            parts.append(tokens)
            size += len(tokens)
        if size >= BLOCK_TOKENS:
            yield ids, np.concatenate(parts), np.repeat(np.arange(len(ids)), [len(p) for p in parts])
            ids, parts, size = [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.repeat(np.arange(len(ids)), [len(p) for p in parts])


def _pieces(ids: list, cut: np.ndarray, owner: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
    """Sorted tokens of a block by range: range, steps, places of their documents, ids of these."""
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        used, place = np.unique(owner[a:b], return_inverse=True)
        yield int(part[a]), pack(np.diff(cut[a:b], prepend=np.uint64(0))), pack(place), [ids[u] for u in used]


def _together(group: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Pieces as one block: ids, sorted tokens, and the place of each token's document."""
    owners, ids, first = [], [], 0
    for places, names in zip(group["places"], group["ids"], strict=True):
        owners.append(unpack(places).astype(np.int64) + first)
        ids.extend(names)
        first += len(names)
    token, owner = np.concatenate([np.cumsum(unpack(s)) for s in group["steps"]]), np.concatenate(owners)
    order = np.argsort(token, kind="stable")
    return ids, token[order], owner[order]


def shared_tokens(
    rows: DataFrame, total: int, tokens_of: Callable | None = None, range_tokens: int = RANGE_TOKENS, level_ranges: int = LEVEL_RANGES,
    mark_bits: int = 0,
) -> DataFrame:
    """``rows``: id, tokens (array<bigint>, distinct within a row); about ``total`` of them.

    With ``tokens_of`` the second column is a text, and this gives its tokens.

    Returns id and the upper bits of the tokens that another row holds, too, in one or
    more rows per id; ``is_shared`` compares them. Tokens may be reported in vain at the rate of chance hits of cut hashes.

    The ``mark_bits`` lowest bits of a token are no part of it but a mark. The lowest bits of
    what is returned are the greatest mark of any holder; ``shared_marks`` reads them.
    """
    ranges = max(LEAST_RANGES, -(-total // range_tokens))
    # Ranges of a coarse range, and tasks that put its pieces together.
    fine = -(-ranges // level_ranges)
    slots = max(1, -(-total * fine // ranges // (8 * range_tokens)))
    kind = rows.schema["id"].dataType.simpleString()
    pa_kind = to_arrow_type(rows.schema["id"].dataType)
    bits, mark = cut_bits(total), np.uint64((1 << mark_bits) - 1)
    names, schema = ["part", "steps", "places", "ids"], f"part int, steps binary, places binary, ids array<{kind}>"

    def range_of(cut: np.ndarray) -> np.ndarray:
        """The range of a cut token: its upper 32 bits, scaled."""
        return (((cut >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, owner in _blocks(_token_lists(batches, tokens_of)):
            cut = tokens >> np.uint64(64 - bits)
            if mark_bits:
                cut = cut & ~mark | tokens & mark
            order = np.argsort(cut, kind="stable")
            cut, owner = cut[order], owner[order]
            columns = list(zip(*_pieces(ids, cut, owner, range_of(cut) // fine), strict=True))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa_kind))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def cut_again(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, cut, owner = _together(group)
        return pd.DataFrame(list(_pieces(ids, cut, owner, range_of(cut))), columns=names)

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, token, owner = _together(group)
        if mark_bits:
            # All holders' marks, as one.
            name = token & ~mark
            starts = np.flatnonzero(np.diff(name, prepend=~name[:1]))
            marks = np.maximum.reduceat(token & mark, starts) if len(starts) else token
            token = name | np.repeat(marks, np.diff(starts, append=len(name)))
        same = token[1:] == token[:-1]
        again = np.zeros(len(token), bool)
        again[1:] |= same
        again[:-1] |= same
        token, owner = token[again], owner[again]
        order = np.argsort(owner, kind="stable")
        token, owner = token[order].view(np.int64), owner[order]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        lists = np.split(token, starts[1:]) if len(starts) else []
        return pd.DataFrame({"id": pd.Series([ids[o] for o in owner[starts]], dtype=object), "tokens": pd.Series(lists, dtype=object)})

    sent = rows.mapInArrow(send, schema)
    if fine > 1:
        slot = F.pmod(F.xxhash64("steps", "ids"), F.lit(slots)).alias("slot")
        sent = sent.groupBy("part", slot).applyInPandas(cut_again, schema)
    return sent.groupBy("part").applyInPandas(meet, f"id {kind}, tokens array<bigint>")


def cut_bits(total: int) -> int:
    """To how many bits ``shared_tokens`` cuts the tokens it returns."""
    return min(64, max(32, math.ceil(math.log2(max(total, 2))) + 12))


def is_shared(tokens: np.ndarray, shared: np.ndarray, total: int) -> np.ndarray:
    """Which of a row's tokens are among those returned for it."""
    return np.isin(tokens.view(np.uint64) >> np.uint64(64 - cut_bits(total)), shared.view(np.uint64))


def shared_marks(tokens: np.ndarray, shared: np.ndarray, total: int, mark_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a row's tokens are among those returned for it, and with which marks (0 for others)."""
    mark = np.uint64((1 << mark_bits) - 1)
    cut = tokens.view(np.uint64) >> np.uint64(64 - cut_bits(total)) & ~mark
    held = np.sort(shared.view(np.uint64))
    if not len(held):
        return np.zeros(len(cut), bool), np.zeros(len(cut), np.int64)
    place = np.minimum(np.searchsorted(held, cut), len(held) - 1)
    found = held[place] & ~mark == cut
    return found, np.where(found, held[place] & mark, 0).astype(np.int64)


SLOT_BITS = 26
BUCKET_BITS = 1 << 15  # of Spark's bitmap functions


def slot_of(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << SLOT_BITS)) + 1


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit per slot that tells whether an id of the table falls into it.

    8 MB, whatever the table. With very many ids it lets others pass as well, so
    what it lets through is joined with the ids afterwards.
    """
    slots = ids.select(slot_of(F.col(column)).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    out = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    size = BUCKET_BITS // 8
    for bucket, bits in parts.collect():
        out[(bucket - 1) * size : bucket * size] = np.frombuffer(bits, np.uint8)
    return out


def passes(bits: np.ndarray, slot: int) -> bool:
    """``slot`` as given by ``slot_of``."""
    return bool(bits[(slot - 1) >> 3] >> ((slot - 1) & 7) & 1)
