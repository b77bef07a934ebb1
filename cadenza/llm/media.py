"""Local image descriptors: cropped or edited copies of an image are found by their matching corners.

Corners of several scales get an orientation from the centroid of their patch and 128 binary tests turned
by it. Each of several tables holds a fixed choice of the bits as key; descriptors of one key that differ
in few bits are matches, and two images are linked when enough matches agree on one similarity transform.
Images of equal pixels are described once each and matched once. Pictures are dealt to pairs of bounded blocks; the
tables are made anew for each pair, so that all matches of two pictures meet in one task and no match leaves it.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import components, forest

#: Radius of the patch that is described, bits of a descriptor, levels and the step from each to the next.
RADIUS, BITS, LEVELS, STEP = 14, 128, 4, 2**0.25
#: Least response of a corner against the strongest of its image, and radius in which it is the largest.
FLOOR, APART = 0.12, 5
TABLES, KEY_BITS, FARTHEST = 6, 28, 22
#: Holders up to which a key is matched together with others; pictures and points up to which a block is filled, blocks at least and tasks at most.
LIGHT, BLOCK, MOST_POINTS, LEAST_BLOCKS, MOST_TASKS = 32, 8192, 1 << 19, 8, 4096
#: Matches that agree on one transform, within so many pixels at scale 1.
AGREEING, NEAR_PX = 4, 2.0
#: Different pictures up to which their classes are broadcast.
MOST_BROADCAST = 10_000
#: Pairs of matches whose transforms are tried at a time.
TRIES = 4096
_HEAD = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+255\s")


def read_image(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM image of 8 bits; None for anything else."""
    if raw is None or not (m := _HEAD.match(raw)):
        return None
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    if not w * h or len(raw) < m.end() + w * h * depth:
        return None
    x = np.frombuffer(raw, np.uint8, w * h * depth, m.end())
    return x.reshape(h, w) if depth == 1 else (x.reshape(h, w, 3).astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).round().astype(np.uint8)


def write_image(x: np.ndarray) -> bytes:
    """A binary PGM image."""
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def _tests() -> np.ndarray:
    """Ends of the binary tests, (BITS, 2) as complex offsets inside the patch."""
    rng = np.random.default_rng(20)
    out: list[tuple[complex, complex]] = []
    while len(out) < BITS:
        a, b = (complex(*rng.normal(0, RADIUS / 2, 2)) for _ in range(2))
        if abs(a) <= RADIUS and abs(b) <= RADIUS and abs(a - b) > 2:
            out.append((a, b))
    return np.array(out)


_TESTS = _tests()
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_CHOICE = np.stack([np.random.default_rng(70 + t).permutation(BITS)[:KEY_BITS] for t in range(TABLES)])


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        p, n = np.pad(x, pad, mode="edge"), x.shape[axis]
        at = [np.take(p, range(k, k + n), axis) if axis == 2 else p[:, k : k + n] for k in range(5)]
        x = (at[0] + at[4]) * np.float32(1 / 16) + (at[1] + at[3]) * np.float32(4 / 16) + at[2] * np.float32(6 / 16)
    return x


def _largest(x: np.ndarray) -> np.ndarray:
    """The largest value of each square of radius APART."""
    for axis in (1, 2):
        out = x.copy()
        n = x.shape[axis]
        for k in range(1, min(APART, n - 1) + 1):
            lo, hi = [slice(None)] * 3, [slice(None)] * 3
            lo[axis], hi[axis] = slice(0, n - k), slice(k, n)
            np.maximum(out[tuple(lo)], x[tuple(hi)], out=out[tuple(lo)])
            np.maximum(out[tuple(hi)], x[tuple(lo)], out=out[tuple(hi)])
        x = out
    return x


def _resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    for axis, n in ((1, h), (2, w)):
        old = x.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        i = np.minimum(at.astype(int), max(old - 2, 0))
        f = (at - i).astype(np.float32).reshape((1, -1, 1) if axis == 1 else (1, 1, -1))
        x = np.take(x, i, axis) * (1 - f) + np.take(x, np.minimum(i + 1, old - 1), axis) * f
    return x


def corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of images (n, h, w): the image, place (complex), angle and packed bits of each corner."""
    found = []
    n, h, w = images.shape
    x = _blur(images.astype(np.float32))
    edge = RADIUS + 2
    for level in range(LEVELS):
        s = STEP**level
        lh, lw = round(h / s), round(w / s)
        if min(lh, lw) <= 2 * edge:
            break
        y = _blur(_resized(x, lh, lw)) if level else x
        gx, gy = np.zeros_like(y), np.zeros_like(y)
        gx[:, :, 1:-1], gy[:, 1:-1] = y[:, :, 2:] - y[:, :, :-2], y[:, 2:] - y[:, :-2]
        xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        top = r.max((1, 2), keepdims=True)
        good = (r >= _largest(r)) & (r > FLOOR * top) & (r > 1)
        good[:, :edge] = good[:, -edge:] = good[:, :, :edge] = good[:, :, -edge:] = False
        k, i, j = np.nonzero(good)
        patch = y[k[:, None], i[:, None] + _DISC[:, 0], j[:, None] + _DISC[:, 1]]
        # float64 sums of one row each do not depend on how rows are stacked
        patch = patch.astype(np.float64)
        turn = (patch * _DISC[:, 1]).sum(1) + 1j * (patch * _DISC[:, 0]).sum(1)
        angle = np.angle(turn)
        ends = np.exp(1j * angle)[:, None, None] * _TESTS
        v = y[k[:, None, None], i[:, None, None] + np.rint(ends.imag).astype(int), j[:, None, None] + np.rint(ends.real).astype(int)]
        bits = np.packbits(v[:, :, 0] > v[:, :, 1], axis=1)
        found.append((k, ((j + 0.5) * w / lw - 0.5) + 1j * ((i + 0.5) * h / lh - 0.5), angle, bits))
    if not found:
        return np.zeros(0, int), np.zeros(0, complex), np.zeros(0), np.zeros((0, BITS // 8), np.uint8)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def packed(z: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Places to 1/16 pixel and angles to 1/256 turn in one long each; images have up to 2 ** 23 / 16 pixels a side."""
    return (np.rint(z.real * 16).astype(np.int64) << 32) | (np.rint(z.imag * 16).astype(np.int64) << 8) | (np.rint(angle / (2 * np.pi) * 256).astype(np.int64) & 255)


def unpacked(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (g >> 32) / 16 + 1j * (((g >> 8) & 0xFFFFFF) / 16), (g & 255) / 256 * 2 * np.pi


#: Pixels that are worked on at a time; a larger image is worked on alone.
_PIXELS = 400_000


def _described(batches):
    """(image_id, image) to (image_id, digest, points)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, raws = part.column(0), [read_image(x) for x in part.column(1).to_pylist()]
            shapes: dict[tuple, list[int]] = {}
            for n, x in enumerate(raws):
                if x is not None:
                    shapes.setdefault(x.shape, []).append(n)
            points: list[bytes | None] = [None] * len(raws)
            for (h, w), members in shapes.items():
                step = max(1, _PIXELS // (h * w))
                for lo in range(0, len(members), step):
                    own = members[lo : lo + step]
                    k, z, angle, bits = corners(np.stack([raws[n] for n in own]))
                    whole = np.concatenate([packed(z, angle).astype("<i8").view(np.uint8).reshape(-1, 8), bits], 1)
                    for m, n in enumerate(own):
                        points[n] = whole[k == m].tobytes()
            digests = [None if x is None else hashlib.sha256(b"%d %d " % x.shape + x.tobytes()).digest() for x in raws]
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(points, pa.binary())], ["image_id", "digest", "points"])


_POINT = 8 + BITS // 8


def runs(batches, cols: int, same: int):
    """Whole runs of rows that agree in the first ``same`` columns, from sorted batches: columns, starts and ends, over many runs at a time."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:cols]]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in now[:same]], axis=0)) + 1
        if not len(cut):
            rest = now
            continue
        yield [c[: cut[-1]] for c in now], np.concatenate([[0], cut[:-1]]), cut
        rest = [c[cut[-1] :] for c in now]
    if rest is not None and len(rest[0]):
        yield rest, np.array([0]), np.array([len(rest[0])])


#: Pairs of descriptors that are compared at a time, and of those that share a key how many a pair of blocks may hold before it is halved.
_COMPARED, _MOST_COMPARED = 1 << 20, 1 << 22


def _keys(bits: np.ndarray) -> np.ndarray:
    """The key of each packed descriptor in each table, (TABLES, n)."""
    out = np.empty((TABLES, len(bits)), np.uint32)
    for lo in range(0, len(bits), 1 << 16):
        own = np.unpackbits(bits[lo : lo + (1 << 16)], axis=1)
        for t, c in enumerate(_CHOICE):
            out[t, lo : lo + (1 << 16)] = np.ascontiguousarray(np.packbits(own[:, c], axis=1)).view("<u4")[:, 0]
    return out


class _Blocks:
    """The points of the pictures of two blocks; pictures are numbered by their ids."""

    def __init__(self, rep: np.ndarray, points: np.ndarray):
        order = np.argsort(rep, kind="stable")
        self.rep, raws = rep[order], [points[k] for k in order]
        rows = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, _POINT)
        self.picture = np.repeat(np.arange(len(raws)), [len(x) // _POINT for x in raws])
        self.at, self.bits = rows[:, :8].copy().view("<i8")[:, 0], rows[:, 8:].copy().view("<u8")
        self.keys, self.order = _keys(rows[:, 8:]), order

    def linked(self, first: np.ndarray, second: np.ndarray):
        """Arrays (u, v) of the linked pairs of a picture of ``first`` and one of ``second``, masks that are equal or have none in common."""
        own = np.flatnonzero((first | second)[self.picture])
        tables, met = [], 0
        for key in self.keys:
            by_key = own[np.argsort(key[own], kind="stable")]
            lo = np.flatnonzero(np.diff(key[by_key], prepend=key[by_key[:1]] ^ 1))
            size = np.diff(lo, append=len(by_key))
            lo, size = lo[size > 1], size[size > 1]
            tables.append((by_key, lo, size))
            met += int((size * (size - 1) // 2).sum())
        if met > _MOST_COMPARED and max(first.sum(), second.sum()) > 1:
            if first is second:
                one, two = _halves(first)
                parts = (one, one), (one, two), (two, two)
            elif first.sum() >= second.sum():
                parts = tuple((x, second) for x in _halves(first))
            else:
                parts = tuple((first, x) for x in _halves(second))
            for x, y in parts:
                yield from self.linked(x, y)
            return
        found = [x for t, table in enumerate(tables) for x in self.matches(t, *table, None if first is second else first)]
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = self.picture[a] * len(self.rep) + self.picture[b]
        order = np.argsort(pair, kind="stable")
        a, b, pair = a[order], b[order], pair[order]
        lo = np.flatnonzero(np.diff(pair, prepend=-1))
        hi = np.append(lo[1:], len(pair))
        enough = hi - lo >= AGREEING
        good = []
        for s, e in zip(lo[enough].tolist(), hi[enough].tolist(), strict=True):
            both = np.unique(np.stack([self.at[a[s:e]], self.at[b[s:e]]]), axis=1)
            if both.shape[1] >= AGREEING and agreeing(*both, AGREEING) >= AGREEING:
                good.append(s)
        if good:
            yield self.rep[self.picture[a[good]]], self.rep[self.picture[b[good]]]

    def matches(self, table: int, by_key: np.ndarray, lo: np.ndarray, size: np.ndarray, first: np.ndarray | None):
        """Points (a, b) that match and that no earlier table has, a in the picture of the smaller id; where ``first`` is given, one of its pictures and one of another."""
        light = size <= LIGHT
        # each point of a light key with all behind it
        n = size[light]
        at = np.repeat(lo[light], n) + (within := _counted(n))
        after = np.repeat(n, n) - within - 1
        ends = np.cumsum(after)
        cut = np.searchsorted(ends, np.arange(_COMPARED, ends[-1] + _COMPARED, _COMPARED)) if len(ends) else []
        for s, e in zip([0, *cut], [*cut, len(at)], strict=True):
            i = np.repeat(at[s:e], after[s:e])
            yield self.near(table, by_key[i], by_key[i + 1 + _counted(after[s:e])], first)
        for s, n in zip(lo[~light].tolist(), size[~light].tolist(), strict=True):
            own, step = by_key[s : s + n], max(1, _COMPARED // n)
            for k in range(0, n, step):
                i = np.arange(k, min(n, k + step))
                yield self.near(table, own[np.repeat(i, n - 1 - i)], own[np.repeat(i, n - 1 - i) + 1 + _counted(n - 1 - i)], first)

    def near(self, table: int, a: np.ndarray, b: np.ndarray, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        p, q = self.picture[a], self.picture[b]
        good = p != q if first is None else first[p] != first[q]
        a, b = a[good], b[good]
        good = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(1) <= FARTHEST
        for key in self.keys[:table]:
            good &= key[a] != key[b]
        a, b = a[good], b[good]
        turned = self.picture[a] > self.picture[b]
        return np.where(turned, b, a), np.where(turned, a, b)


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one behind the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = x & (np.cumsum(x) <= x.sum() // 2)
    return one, x & ~one


def agreeing(ga: np.ndarray, gb: np.ndarray, enough: int | None = None) -> int:
    """Most matches, of different points in both images, that one similarity transform explains; the first count that is ``enough`` ends the search."""
    (za, ta), (zb, tb) = unpacked(ga), unpacked(gb)
    m = len(za)
    if m < 2:
        return m
    turn = np.exp(1j * (tb - ta))
    best, step = 0, max(1, TRIES // m)
    for first in range(1, m // 2 + 1, step):  # all pairs, by how far they lie apart in the order of matches
        strides = np.arange(first, min(first + step, m // 2 + 1))
        i = np.tile(np.arange(m), len(strides))
        j = (i + np.repeat(strides, m)) % m
        away = np.abs(za[i] - za[j]) > 4
        i, j = i[away], j[away]
        alpha = (zb[i] - zb[j]) / (za[i] - za[j])
        fits = (np.abs(alpha) > 0.3) & (np.abs(alpha) < 3.3)
        unit = alpha / np.maximum(np.abs(alpha), 1e-9)
        fits &= ((unit.conj() * turn[i]).real > 0.9) & ((unit.conj() * turn[j]).real > 0.9)
        i, alpha, unit = i[fits], alpha[fits], unit[fits]
        for lo in range(0, len(i), 512):
            x, u = alpha[lo : lo + 512, None], unit[lo : lo + 512, None]
            ok = (np.abs(x * (za - za[i[lo : lo + 512], None]) + zb[i[lo : lo + 512], None] - zb) <= NEAR_PX * np.maximum(1, np.abs(x))) & ((u.conj() * turn).real > 0.9)
            n = ok.sum(1)
            for k in np.argsort(-n, kind="stable"):
                if n[k] <= best:
                    break
                own = ok[k]
                best = max(best, min(len(np.unique(np.rint(za[own] / 2))), len(np.unique(np.rint(zb[own] / 2)))))
                if enough is not None and best >= enough:
                    return best
    return best


def _found(batches):
    """Rows (pair, second, rep, points), sorted by pair, to the linked pairs u, v of pictures, many at a time."""
    for (_, second, rep, points), lo, hi in runs(batches, 4, 1):
        for s, e in zip(lo, hi, strict=True):
            blocks = _Blocks(rep[s:e], points[s:e])
            behind = second[s:e].astype(bool)[blocks.order]
            first = ~behind
            for u, v in blocks.linked(first, behind if behind.any() else first):
                yield np.stack([u, v])


def _verified(batches):
    """Rows of pairs of blocks to links (u, v)."""
    for u, v in _found(batches):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _summed(batches):
    """Rows of pairs of blocks to (u, v, n_links): a forest that connects what the links connect, with null n_links, and how many links each picture u has, with null v."""
    held: list[np.ndarray] = []

    def batch():
        u, v = np.concatenate(held, axis=1)
        ends, n = np.unique(np.concatenate([u, v]), return_counts=True)
        a, b = forest(u, v)
        no, none = pa.nulls(len(ends), pa.int64()), pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ends])), pa.concat_arrays([pa.array(b), no]), pa.concat_arrays([none, pa.array(n)])], ["u", "v", "n_links"])

    for found in _found(batches):
        held.append(found)
        if sum(x.shape[1] for x in held) > _COMPARED:
            yield batch()
            held.clear()
    if held:
        yield batch()


def links(points: DataFrame) -> DataFrame:
    """(u, v) of linked images from (rep, points), one row for each different image."""
    return dealt(points).mapInArrow(_verified, "u long, v long")


def dealt(points: DataFrame) -> DataFrame:
    """(pair, second, rep, points) from (rep, points): each picture once for each block that its own block meets, itself included."""
    n, size = points.agg(F.count("*"), F.coalesce(F.sum(F.length("points") / _POINT), F.lit(0.0))).first()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK), int(-(-size // MOST_POINTS)))
    rows = points.select("rep", "points", F.pmod(F.xxhash64("rep"), F.lit(blocks).cast("long")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    pair = F.shiftleft(F.least("block", "other"), 32).bitwiseOR(F.greatest("block", "other"))
    rows = rows.select(pair.alias("pair"), (F.col("block") > F.col("other")).alias("second"), "rep", "points")
    return rows.repartition(min(blocks * (blocks + 1) // 2, MOST_TASKS), "pair").sortWithinPartitions("pair")


def copies(images: DataFrame, id_column: str = "image_id", image_column: str = "image") -> DataFrame:
    """(image_id, n_points, n_links, class_id) of every row: its corners, its links to other pictures, the smallest id among its copies.

    n_links counts all verified links, however many pictures share a key; pairs of pictures are compared where their blocks meet, and only sums and a forest leave there. Images of equal pixels are one picture and share all three results. Nulls, empty values and what is no
    8-bit PGM or PPM have null n_points and n_links and are their own class; a picture with too few corners
    has no links. A null id has the class of its picture, null where no row of it has an id, and then stays
    unlinked. Repeated rows have equal results, no rows give no rows, other columns are not read.
    """
    own = written(images.select(F.col(id_column).cast("long").alias("image_id"), F.col(image_column).alias("image")).mapInArrow(_described, "image_id long, digest binary, points binary"), "points")
    reps = own.where("digest is not null").groupBy("digest").agg(F.min("image_id").alias("rep"), F.first("points").alias("points"))
    reps = written(reps, "pictures")
    found = written(dealt(reps.where("rep is not null").select("rep", "points")).mapInArrow(_summed, "u long, v long, n_links long"), "image-links")
    roots_ = components(found.where("v is not null").select("u", "v"))
    each = found.where("v is null").groupBy(F.col("u").alias("linked")).agg(F.sum("n_links").alias("n_links"))
    pictures = reps.select("digest", "rep").join(roots_, F.col("rep") == F.col("node"), "left").join(each, F.col("rep") == F.col("linked"), "left")
    pictures = pictures.select(F.col("digest").alias("picture"), F.coalesce("root", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if reps.count() <= MOST_BROADCAST:
        pictures = F.broadcast(pictures)
    out = own.select("image_id", "digest", (F.length("points") / _POINT).cast("long").alias("n_points")).join(pictures, F.col("digest") == F.col("picture"), "left")
    return out.select("image_id", "n_points", "n_links", F.when(F.col("digest").isNull(), F.col("image_id")).otherwise(F.col("class")).alias("class_id"))


SIDE = 112
#: One of so many vectors, by a hash of its id, also gets an edited copy.
COPIED = 8
EDITS = ("crop", "tone", "turn", "scale", "caption")


def basis(dim: int, side: int = SIDE) -> np.ndarray:
    """``dim`` smooth patterns of whole numbers, (dim, side * side)."""
    x = np.random.default_rng(5).normal(0, 1, (dim, side + 16, side + 16)).astype(np.float32)
    for _ in range(3):
        x = _blur(x)
    x = x[:, 8:-8, 8:-8].reshape(dim, -1).astype(np.float64)
    return np.rint(x / x.std() * 500)


def edited(x: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """A copy: three quarters of the picture, other tones, turned and cut, made smaller, or with a caption over a part."""
    rng = np.random.default_rng(seed)
    h, w = x.shape
    if kind == "crop":
        i, j = int(rng.integers(0, h // 4 + 1)), int(rng.integers(0, w // 4 + 1))
        return x[i : i + h - h // 4, j : j + w - w // 4]
    if kind == "tone":
        return np.clip(np.rint(x * rng.uniform(0.6, 0.9) + rng.uniform(5, 40) + rng.normal(0, 1.5, x.shape)), 0, 255).astype(np.uint8)
    if kind == "turn":
        return _sampled(x, np.exp(1j * rng.uniform(0.1, 6.2)), int(h * 0.8), int(w * 0.8))
    if kind == "scale":
        return _sampled(x, h / int(h * 0.85), int(h * 0.85), int(w * 0.85))
    out = x.copy()
    out[h - h // 4 : h - h // 12, w // 8 : w - w // 8] = 250
    return out


def _sampled(x: np.ndarray, step: complex, h: int, w: int) -> np.ndarray:
    """A picture of h times w around the same centre, whose pixels lie ``step`` apart; places outside have the nearest pixel."""
    i, j = np.mgrid[:h, :w]
    z = (j - (w - 1) / 2 + 1j * (i - (h - 1) / 2)) * step
    b, a = np.clip(z.imag + (x.shape[0] - 1) / 2, 0, x.shape[0] - 1.001), np.clip(z.real + (x.shape[1] - 1) / 2, 0, x.shape[1] - 1.001)
    i, j = b.astype(int), a.astype(int)
    b, a = b - i, a - j
    return np.rint((x[i, j] * (1 - a) + x[i, j + 1] * a) * (1 - b) + (x[i + 1, j] * (1 - a) + x[i + 1, j + 1] * a) * b).astype(np.uint8)


def _rendered(dim: int):
    def run(batches):
        patterns = basis(dim)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for vec_id, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    v = None if v is None else np.array([0.0 if x is None else x for x in v][:dim] + [0.0] * (dim - len(v)))
                    image = None
                    if v is not None and np.isfinite(v).all():
                        # sums of whole numbers are the same in every order
                        grey = np.rint(np.clip(v, -64, 64) * 1000) @ patterns / 500_000
                        image = np.clip(np.rint(grey * 45 + 128), 0, 255).astype(np.uint8).reshape(SIDE, SIDE)
                    key = zlib.crc32(str(vec_id).encode())
                    rows.append((None if vec_id is None else 2 * vec_id, None if image is None else write_image(image)))
                    if image is not None and vec_id is not None and key % COPIED == 0:
                        rows.append((2 * vec_id + 1, write_image(edited(image, EDITS[key // COPIED % len(EDITS)], key))))
                ids, raw = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["image_id", "image"])

    return run


def rendered(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(image_id, image): a picture of each vector, of id 2 * vec_id, and for one in COPIED an edited copy of the next id.

    The tables hold no pictures, so these stand for a media column. A vector is a mix of ``dim`` smooth patterns;
    null elements and missing ones count as 0, those beyond ``dim`` are not drawn, a null or unbounded vector has a null image.
    """
    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(_rendered(dim), "image_id long, image binary")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all vectors and their edited copies, with the class of each."""
    return copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
