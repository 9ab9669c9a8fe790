"""Cropped and edited copies of images by local descriptors.

An image is a row (media_id, image, width, height), image holding width * height grey bytes. Corners are found at several scales, in proportion
to the image's area; each gets an orientation from its intensity centroid and 256 binary tests turned by it. Images with equal bytes form one
class first. The four 64-bit words of a descriptor are Hamming tables: two descriptors that agree in one word meet in a join. A pair of images is
a copy if MIN_VOTES matches agree on one turn, scale and shift.

All rows of a word meet, those of a crowded word in blocks of some BLOCK_ROWS, so no link is lost. A corner meets a block as one row with arrays of the
block's corners; a task holds the rows of one image and one block at a time, and places are compared only for pairs in which MIN_VOTES corners have met.
n_links counts every other class that shows the same picture. Hence m different copies of a picture still have some m * m / 2 matches, in those arrays,
as there are that many links between them to count.

Images that are null, empty or of the wrong length have no corners, as have those of at most 2 * RADIUS + 4 pixels on a side; they match only equal bytes
(null: nothing). Places beyond 2^20 pixels count as there. Rows that share an id are one image with the corners of all; equal rows are one class. An
empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.shared import saved

SCALES = {1.0: 40, 0.7: 20, 0.5: 10}  # corners of each scale for SIDE * SIDE pixels or fewer; larger images have more in proportion
RADIUS = 10
TESTS = 256
WORDS = TESTS // 64
MIN_VOTES = 3
SHIFT_BIN = 8
TURN_BINS = 16
SIDE = 96
COPY_EVERY = 10
BROADCAST_IDS = 200_000
BLOCK_ROWS = 1_000
SLICE_MATCHES = 1 << 20
CROWD = 1_000  # rows of a word that meet undealt
TASK_PICTURES = 1_000

_RNG = np.random.default_rng(31)
_PAIRS = np.clip(_RNG.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS + 1, RADIUS - 1)
_WAVES = np.stack([_RNG.uniform(0.02, 0.16, 64) * _RNG.choice([-1, 1], 64), _RNG.uniform(0.02, 0.16, 64), _RNG.uniform(0, 1, 64)], axis=1)


def smooth(image: np.ndarray, times: int = 2) -> np.ndarray:
    """Binomial blur, edges repeated."""
    for _ in range(times):
        p = np.pad(image, 1, mode="edge")
        image = (p[:-2, 1:-1] + 2 * p[1:-1, 1:-1] + p[2:, 1:-1]) / 4
        p = np.pad(image, 1, mode="edge")
        image = (p[1:-1, :-2] + 2 * p[1:-1, 1:-1] + p[1:-1, 2:]) / 4
    return image


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling."""
    h, w = (max(2, round(s * scale)) for s in image.shape)
    y, x = np.linspace(0, image.shape[0] - 1, h), np.linspace(0, image.shape[1] - 1, w)
    y0, x0 = np.minimum(y.astype(int), image.shape[0] - 2), np.minimum(x.astype(int), image.shape[1] - 2)
    dy, dx = (y - y0)[:, None], (x - x0)[None, :]
    a, b, c, d = image[y0][:, x0], image[y0][:, x0 + 1], image[y0 + 1][:, x0], image[y0 + 1][:, x0 + 1]
    return a * (1 - dy) * (1 - dx) + b * (1 - dy) * dx + c * dy * (1 - dx) + d * dy * dx


def corners(image: np.ndarray, most: int) -> np.ndarray:
    """Rows (y, x) of the strongest corner responses that are local peaks, away from the border."""
    gy, gx = np.gradient(image)
    a, b, c = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
    response = a * b - c * c - 0.05 * (a + b) ** 2
    edge = RADIUS + 1
    inner = response[edge:-edge, edge:-edge]
    if inner.size == 0:
        return np.zeros((0, 2), dtype=int)
    around = np.lib.stride_tricks.sliding_window_view(response[edge - 2 : response.shape[0] - edge + 2, edge - 2 : response.shape[1] - edge + 2], (5, 5)).max(axis=(2, 3))
    y, x = np.nonzero((inner == around) & (inner > 1e-3))
    order = np.argsort(-inner[y, x], kind="stable")[:most]
    return np.stack([y[order], x[order]], axis=1) + edge


_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID**2).sum(axis=0) <= RADIUS**2


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corner rows (x, y, angle, scale) in pixels of the whole image, and their descriptors as WORDS 64-bit words."""
    points, words = [], []
    for scale, most in SCALES.items():
        small = smooth(resized(image, scale) if scale != 1 else image, 2)
        at = corners(small, max(most, -(-most * image.size // (SIDE * SIDE))))
        if not len(at):
            continue
        patches = np.stack([small[y - RADIUS : y + RADIUS + 1, x - RADIUS : x + RADIUS + 1] for y, x in at])
        patches = (patches - patches.mean(axis=(1, 2), keepdims=True)) * _DISC
        angle = np.arctan2((patches * _GRID[0]).sum(axis=(1, 2)), (patches * _GRID[1]).sum(axis=(1, 2)))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
        tx = np.clip(np.rint(cos * px - sin * py).astype(int), -RADIUS, RADIUS) + RADIUS
        ty = np.clip(np.rint(sin * px + cos * py).astype(int), -RADIUS, RADIUS) + RADIUS
        values = patches[np.arange(len(at))[:, None, None], ty, tx]
        bits = np.packbits(values[:, :, 0] > values[:, :, 1], axis=1)
        words.append(bits.view(np.uint64))
        points.append(np.stack([at[:, 1] / scale, at[:, 0] / scale, angle, np.full(len(at), scale)], axis=1))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, WORDS), np.uint64)
    return np.concatenate(points), np.concatenate(words)


SCALE_CODES = np.array(list(SCALES))
ANGLES = 4_096


def packed_points(points: np.ndarray) -> np.ndarray:
    """Corner rows as single numbers: 20 bits each of x and y, 12 of the angle, 4 of the scale."""
    x, y = (np.clip(np.rint(points[:, i]), 0, (1 << 20) - 1).astype(np.int64) for i in (0, 1))
    angle = np.rint(points[:, 2] * ANGLES / (2 * np.pi)).astype(np.int64) % ANGLES
    scale = np.abs(points[:, 3, None] - SCALE_CODES).argmin(axis=1)
    return ((x << 20 | y) << 12 | angle) << 4 | scale


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        points, words = [], []
        for image, w, h in zip(b.column("image").to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist()):
            own, code = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if image and w and h and w * h == len(image) and min(w, h) > 2 * RADIUS + 4:
                found, bits = describe(np.frombuffer(image, dtype=np.uint8).reshape(h, w).astype(np.float64))
                if len(found):
                    own, code = packed_points(found), bits.view(np.int64).ravel()
            points.append(own)
            words.append(code)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("digest"), pa.array(points, kind), pa.array(words, kind)], names=["media_id", "digest", "points", "words"])


def _met_rows(shared: DataFrame) -> DataFrame:
    """(a, block, ka, ids, places): a corner of image a, and in two arrays the corners of one block of images, of larger ids, that share a word with it.

    All rows of a pair lie in one block of a: images are dealt to as many blocks as a's most crowded word has, which is a power of two, so that
    the blocks of its other words are split, never mixed.
    """
    deal = lambda id_, n: F.pmod(F.xxhash64(id_), n)
    lists = shared.groupBy("table", "word", deal("m.media_id", F.col("cuts")).alias("part")).agg(F.collect_list("m").alias("others"))
    rows = shared.withColumn("blocks", F.max("cuts").over(Window.partitionBy("m.media_id")))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).join(lists, ["table", "word", "part"])
    rows = rows.withColumn("block", F.explode(F.sequence("part", F.col("blocks") - 1, F.col("cuts"))))
    later = F.filter("others", lambda o: o["media_id"] > F.col("m.media_id"))
    dealt = F.filter(later, lambda o: deal(o["media_id"], F.col("blocks")) == F.col("block"))
    met = rows.select(F.col("m.media_id").alias("a"), "block", F.col("m.at").alias("ka"), F.when(F.col("blocks") > F.col("cuts"), dealt).otherwise(later).alias("others")).where(F.size("others") > 0)
    return met.select("a", "block", "ka", F.col("others.media_id").alias("ids"), F.col("others.at").alias("places"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows cut into slices of whole groups (a, block), each of SLICE_MATCHES matches at most or of one group."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_tables([*rest, pa.Table.from_batches([batch])]).combine_chunks()
        a, block = (rows[c].to_numpy() for c in ("a", "block"))
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (block[1:] != block[:-1])]))
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["ids"]).to_numpy())])[starts]
        first, last = 0, len(starts) - 1
        for i in range(1, last + 1):
            if i == last or upto[i + 1] - upto[first] > SLICE_MATCHES:
                yield rows.slice(starts[first], starts[i] - starts[first])
                first = i
        rest = [rows.slice(starts[last])]
    yield from rest


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _agreed(rows: pa.Table, min_votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, votes of the pairs that agree on one turn, scale and shift often enough; places are compared only where enough corners have met."""
    times = pc.list_value_length(rows["ids"]).to_numpy()
    a, ka = (np.repeat(rows[c].to_numpy(), times) for c in ("a", "ka"))
    b, kb = (pc.list_flatten(rows[c]).to_numpy() for c in ("ids", "places"))
    order = np.lexsort((ka, b, a))
    a, b, ka, kb = a[order], b[order], ka[order], kb[order]
    first = _changes(a, b)
    pair = np.cumsum(first) - 1
    enough = np.bincount(pair, weights=_changes(a, b, ka)) >= min_votes
    ids, kept = (a[first], b[first]), enough[pair]
    pair, ka, kb = pair[kept], ka[kept], kb[kept]
    votes = np.zeros(len(enough), dtype=np.int64)
    if len(pair):
        (ax, ay, a_angle, a_scale), (bx, by, b_angle, b_scale) = (
            ((at >> 36 & 0xFFFFF).astype(float), (at >> 16 & 0xFFFFF).astype(float), (at >> 4 & 0xFFF) * (2 * np.pi / ANGLES), SCALE_CODES[at & 15]) for at in (ka, kb)
        )
        turn, ratio = (b_angle - a_angle) % (2 * np.pi), a_scale / b_scale
        turn_bin = np.floor(turn * TURN_BINS / (2 * np.pi) + 0.5).astype(int) % TURN_BINS
        scale_bin = np.rint(4 * np.log2(ratio)).astype(int)
        tx = bx - ratio * (ax * np.cos(turn) - ay * np.sin(turn))
        ty = by - ratio * (ax * np.sin(turn) + ay * np.cos(turn))
        # Two grids, half a bin apart, so that no agreement is lost on a border.
        for grid in (0.0, 0.5):
            cell = (np.floor(ty / SHIFT_BIN + grid), np.floor(tx / SHIFT_BIN + grid), scale_bin, turn_bin, pair)
            order = np.lexsort((ka, *cell))
            cell = [c[order] for c in cell]
            start = _changes(*cell)
            count = np.bincount(np.cumsum(start) - 1, weights=_changes(ka[order], *cell)).astype(int)
            np.maximum.at(votes, cell[-1][start], count)
    found = votes >= min_votes
    return ids[0][found], ids[1][found], votes[found]


def _votes(met: DataFrame, min_votes: int) -> DataFrame:
    """a, b, votes of the pairs in rows of _met_rows that agree on one turn, scale and shift often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _agreed(rows, min_votes)], names=["a", "b", "votes"])

    return met.repartition("a", "block").sortWithinPartitions("a", "block").mapInArrow(run, "a long, b long, votes long")


def copy_links(media: DataFrame, min_votes: int = MIN_VOTES) -> tuple[DataFrame, DataFrame]:
    """(media_id, class_id: smallest id with the same bytes) and (a, b, votes) between classes that show the same picture."""
    digest = F.when(F.col("image").isNotNull(), F.concat_ws("x", F.sha2("image", 256), F.col("width"), F.col("height")))
    source = media.select(F.col("media_id").cast("long").alias("media_id"), "image", "width", "height", digest.alias("digest"))
    described = saved(source.mapInArrow(_describe, "media_id long, digest string, points array<long>, words array<long>"))
    least = described.where("digest IS NOT NULL").groupBy("digest").agg(F.min("media_id").alias("class_id"))
    classes = saved(described.select("media_id", "digest").join(least, "digest", "left").select("media_id", F.coalesce("class_id", "media_id").alias("class_id")))
    same = saved(classes.where("media_id <> class_id").select("media_id").distinct())
    few = same.count() <= BROADCAST_IDS
    single = described.join(F.broadcast(same) if few else same, "media_id", "left_anti")
    table = F.transform("words", lambda w, i: F.struct(w.alias("word"), (i % WORDS).cast("tinyint").alias("table"), F.get("points", F.floor(i / WORDS).cast("int")).alias("at")))
    rows = single.where("media_id IS NOT NULL").select("media_id", F.explode(table).alias("r")).select("r.table", "r.word", F.struct("media_id", F.col("r.at").alias("at")).alias("m"))
    # Only words that several images share are written.
    words = rows.groupBy("table", "word").agg(F.count("*").alias("n"), F.min("m.media_id").alias("low"), F.max("m.media_id").alias("high"))
    words = words.where("low <> high").drop("low", "high")
    cuts = F.when(F.col("n") > CROWD, F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / BLOCK_ROWS, F.lit(1.0)))))).otherwise(F.lit(1)).cast("long")
    shared = saved(rows.join(words, ["table", "word"]).select("table", "word", "m", cuts.alias("cuts")))
    return classes, saved(_votes(_met_rows(shared), min_votes))


def media_copies(media: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """Per image: media_id, class_id, component_id (smallest media_id of its copies, itself included), n_links of its class, all counted."""
    classes, links = copy_links(media, min_votes)
    roots = connected_components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("end_id")).unionByName(links.select(F.col("b").alias("end_id"))).groupBy("end_id").agg(F.count("*").alias("n_links"))
    return (
        classes.join(roots, classes["class_id"] == roots["node"], "left").join(ends, F.col("class_id") == F.col("end_id"), "left")
        .select("media_id", "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A crop of the image, a quarter turn for every other seed, with other brightness and some noise."""
    rng = np.random.default_rng(seed)
    size = int(image.shape[0] * rng.uniform(0.7, 0.9))
    y, x = rng.integers(0, image.shape[0] - size + 1, 2)
    part = image[y : y + size, x : x + size].astype(np.float64)
    part = np.rot90(part, seed % 2)
    return np.clip(part * rng.uniform(0.85, 1.1) + rng.uniform(-10, 10) + rng.normal(0, 1.0, part.shape), 0, 255).astype(np.uint8)


@lru_cache(maxsize=4)
def _basis(n: int, side: int) -> np.ndarray:
    y, x = np.mgrid[0:side, 0:side]
    waves = _WAVES[:n, :, None, None]
    return np.cos(2 * np.pi * (waves[:, 0] * x + waves[:, 1] * y + waves[:, 2]))


def picture(vector: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey picture whose waves have the vector's values as their strengths."""
    n = min(len(vector), len(_WAVES))
    field = np.tensordot(vector[:n], _basis(n, side), axes=1)
    spread = np.abs(field).max() or 1.0
    return (127.5 + 120 * field / spread).astype(np.uint8)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for key, vector in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
            if key is None or not vector:
                continue
            image = picture(np.nan_to_num(np.array([v or 0.0 for v in vector], dtype=np.float64)))
            rows.append((2 * key, image.tobytes(), SIDE, SIDE))
            if key % COPY_EVERY == 3:
                copy = edited(image, key)
                rows.append((2 * key + 1, np.ascontiguousarray(copy).tobytes(), copy.shape[1], copy.shape[0]))
        columns = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["media_id", "image", "width", "height"])


def rendered(embeddings: DataFrame) -> DataFrame:
    """Pictures of all vectors, ids doubled, and an edited copy, id + 1, of one in COPY_EVERY: known answers for the operator."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = vectors.repartition(max(1, -(-vectors.count() // TASK_PICTURES)))  # drawing and describing take far longer than reading
    return vectors.mapInArrow(_render, "media_id long, image binary, width int, height int")
