"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces of documents are first packed by best fit inside hashed groups of bounded size. Nearly full bins leave; an underfull bin
becomes one item, carrying its pieces, of the next level, where FAN_IN groups meet and their bins are merged by best fit again. The
levels form a tree. Every group passes at most CARRY bins on, the emptiest ones, which still have room for others; the
rest leave as they are. So no task holds more than FAN_IN * CARRY bins, however large the corpus, and no piece is lost.

Null and empty texts give one piece with only the closing id. Documents with equal or null ids and repeated rows stay separate pieces, dealt
to groups by row and not by id; pieces of one size go in the order of their ids, null last. A long text is tokenized whole and cut into pieces of the
capacity. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.shared import saved
from textloom.llm.tokens import piece_tokenizer

CAPACITY = 2048
END_ID = (0).to_bytes(4, "little")
GROUP_ITEMS = 2_000
FAN_IN = 16
CARRY = 2_000
NEARLY_FULL = 0.995

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BINS = f"bin_group long, fill long, pieces array<{PIECE}>, offsets array<bigint>, done boolean"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token sequence of each document with END_ID, cut every capacity tokens."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(tokenizer_path)
        for b in ts.slices(batches, "text"):
            rows: list[tuple] = []
            for doc, value in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = (tokenizer.packed_ids(value) if value else b"") + END_ID
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: items from large to small, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    rooms: dict[int, list[int]] = {}  # room -> bins with that room
    order: list[int] = []  # the rooms in use, sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(order, sizes[i])
        if at < len(order):
            room = order[at]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append(b)
    return bins


def _pack_group(capacity: int, last: bool):
    least = int(NEARLY_FULL * capacity)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [(p[0]["doc_id"] is None, p[0]["doc_id"] or 0, p[0]["piece"], p[0]["start"]) for p in rows["pieces"]]  # null ids last
        order = sorted(range(len(rows)), key=lambda i: keys[i])
        sizes = [int(rows["fill"].iat[i]) for i in order]
        pieces = [rows["pieces"].iat[i] for i in order]
        made = [(sum(sizes[i] for i in b), [p for i in b for p in pieces[i]]) for b in best_fit(sizes, capacity)]
        made.sort(key=lambda x: x[0])
        carried = 0
        done = []
        for fill, _ in made:
            stays = not last and fill < least and carried < CARRY
            carried += stays
            done.append(not stays)
        offsets = [[0, *itertools.accumulate(x["length"] for x in p[:-1])] if d else [] for (_, p), d in zip(made, done)]
        return pd.DataFrame({"bin_group": rows["bin_group"].iat[0], "fill": [f for f, _ in made], "pieces": [p for _, p in made], "offsets": offsets, "done": done})

    return run


def pack_bins(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """fill, pieces, offsets: one row per sequence. pieces must be computed already, as it is read twice."""
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    whole = pieces.where(F.col("length") >= capacity).select(F.col("length").alias("fill"), F.array(item).alias("pieces"), F.array(F.lit(0).cast("long")).alias("offsets"))
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP_ITEMS))
    state = rest.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("bin_group"), F.col("length").alias("fill"), F.array(item).alias("pieces"))
    out = whole
    while True:
        last = groups == 1
        packed = saved(state.groupBy("bin_group").applyInPandas(_pack_group(capacity, last), BINS))
        out = out.unionByName(packed.where("done").select("fill", "pieces", "offsets"))
        if last:
            return out
        state = packed.where(~F.col("done")).select(F.floor(F.col("bin_group") / FAN_IN).alias("bin_group"), "fill", "pieces")
        groups = -(-groups // FAN_IN)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenized once, beside the scan; only piece descriptions are shuffled.
    """
    pieces = saved(token_pieces(docs, tokenizer_path, capacity, text, key))
    bins = saved(pack_bins(pieces, capacity).withColumn("sequence_id", F.monotonically_increasing_id()))
    placed = F.arrays_zip(F.col("pieces").alias("p"), F.col("offsets").alias("offset"))
    return bins.select("sequence_id", F.explode(placed).alias("x")).select("x.p.doc_id", "x.p.piece", "x.p.start", "x.p.length", "x.p.ids_crc32", "sequence_id", F.col("x.offset").alias("offset"))
