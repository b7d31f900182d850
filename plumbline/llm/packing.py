"""Hierarchical multi-length packing of token ids into training sequences.

Every document is its ids and one end id.  Runs of a full window become
sequences of their own; the rest of a document (its tail) is routed to the
smallest tier (64, 128, ... window) that holds it.  A pool of tails is packed
tier by tier from the longest: a bin takes a tail of its tier, and its gap is
filled with whole tails of shorter tiers, the longest that fits first.  What
still gapes is filled by cutting one tail, so each bin is exactly a tier long
and needs no padding.  The last ids of a partition are cut into tiers as well;
fewer ids than the shortest tier are the only ones that get padding.

Sequences of a pool are dealt to step groups of even token counts, longest
first to the lightest group.

Packing needs no shuffle: each input partition packs its own rows in pools of
bounded size, and sequence ids carry the partition number.  A lost executor
repeats a partition and makes the same rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.llm.bpe import text_slices

COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Ids:
    """Ids of texts as the ``tokenizers`` library gives them.

    A text that holds one of the tokenizer's added strings (an end mark, say) goes to
    that library, which alone knows what they mean.  Any other text is encoded by the
    same ranks in the faster library; a test holds both equal.
    """

    def __init__(self, tokenizer_path: str, rank_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        from plumbline.llm.bpe import read_ranks

        self.library = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_path), special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if any(x in text for x in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def loaded(tokenizer_path: str, rank_path: str, pattern: str) -> Ids:
    return vec.worker_slot(("ids", tokenizer_path, rank_path, pattern), lambda: Ids(tokenizer_path, rank_path, pattern))


@dataclass
class Pools:
    """Packs one partition; ``rows`` gets a tuple for each piece."""

    window: int
    shortest: int
    first_id: int
    pool_tokens: int
    group_tokens: int

    def __post_init__(self):
        self.tails: list[tuple[int, int, tuple, int]] = []  # length, order, document, start
        self.held, self.order, self.sequences, self.groups = 0, 0, 0, 0
        self.rows: list[tuple] = []
        self.made: list[tuple[int, list[tuple[int, tuple, int]]]] = []  # tier, pieces

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // 4
        doc = (key, ids, total)
        full = total - total % self.window
        for start in range(0, full, self.window):
            self.made.append((self.window, [(self.window, doc, start)]))
        if total > full:
            self._keep(total - full, doc, full)
        if self.held >= self.pool_tokens or len(self.made) * self.window >= self.pool_tokens:
            self.pack(False)

    def _keep(self, length: int, doc: tuple, start: int) -> None:
        self.tails.append((length, self.order, doc, start))
        self.order += 1
        self.held += length

    def pack(self, last: bool) -> None:
        tails = sorted(self.tails, key=lambda x: x[:2])
        self.tails, self.held = [], 0
        left = sum(x[0] for x in tails)
        while tails:
            length, _, doc, start = tails.pop()
            tier = max(self.shortest, 1 << (length - 1).bit_length())
            if left < tier:
                if not last:
                    self._keep(length, doc, start)
                    for x in tails:
                        self._keep(x[0], x[2], x[3])
                    break
                tier = max(self.shortest, 1 << (left.bit_length() - 1))
            bin_, gap = [], tier
            while True:
                take = min(length, gap)
                bin_.append((take, doc, start))
                gap -= take
                left -= take
                if take < length:
                    insort(tails, (length - take, self.order, doc, start + take), key=lambda x: x[:2])
                    self.order += 1
                if not gap or not tails:
                    break
                at = bisect_right(tails, gap, key=lambda x: x[0])
                length, _, doc, start = tails.pop(at - 1 if at else 0)
            self.made.append((tier, bin_))
        self._deal()

    def _deal(self) -> None:
        total = sum(sum(p[0] for p in pieces) for _, pieces in self.made)
        n = max(1, round(total / self.group_tokens))
        load = [(0, g) for g in range(n)]
        for tier, pieces in sorted(self.made, key=lambda x: -x[0]):
            weight, g = heapq.heappop(load)
            heapq.heappush(load, (weight + tier, g))
            offset = 0
            for length, (key, ids, total), start in pieces:
                self.rows.append((key, start, length, ids[4 * start : 4 * (start + length)], total, self.first_id + self.sequences, offset, tier, self.first_id + self.groups + g))
                offset += length
            self.sequences += 1
        self.groups += n
        self.made = []


def pack(df: DataFrame, tokenizer_path: str, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, shortest: int = 64, end_id: int = 1, pool_tokens: int = 1 << 20, group_tokens: int = 1 << 17) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Ids are those of the tokenizer file with add_special_tokens=False; the rank file
    holds the same vocabulary.  A null or empty text is one end id.  Rows with equal
    ids or texts are packed one by one; a text longer than the window fills sequences
    of its own and has one tail.  Other columns of the input are ignored, whatever
    their names.  An empty table has no pieces.  Columns: the id, start, length, ids
    (four little-endian bytes each), ids_crc32 of them, doc_tokens, sequence_id,
    offset, tier (the sequence's length) and step_group.  ``pool_tokens`` and ``group_tokens`` bound what a
    task holds and a step's tokens; they drop nothing.
    """
    kind = df.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = loaded(tokenizer_path, rank_path, pattern)
        pools, id_type = Pools(window, shortest, TaskContext.get().partitionId() << 36, pool_tokens, group_tokens), None

        def flush() -> Iterator[pa.RecordBatch]:
            if pools.rows:
                rows, pools.rows = pools.rows, []
                key, start, length, ids, *rest, tier, group = zip(*rows)
                long = [pa.array(x, pa.int64()) for x in (start, length, *rest, group)]
                yield pa.RecordBatch.from_arrays([pa.array(key, id_type), *long[:2], pa.array(ids, pa.binary()), *long[2:-1], pa.array(tier, pa.int32()), long[-1]], [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in batches:
            id_type = batch.column(0).type
            for first, texts in text_slices(batch, text_col):
                keys = batch.column(0).slice(first, len(texts)).to_pylist()
                for key, text in zip(keys, texts):
                    pools.add(key, ids_of.encode(text) + end)
                yield from flush()
        if id_type is not None:
            pools.pack(True)
            yield from flush()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}").withColumn("ids_crc32", F.crc32("ids"))
