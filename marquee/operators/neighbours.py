"""Cross-kind neighbours: exact top candidates per medium, then assignment under a capacity.

Scoring is blocked and pruned. Targets are cut into small blocks of alike items, which pass
by the items of a task. The blocks that promise an item most give it a score that eight
targets reach; only blocks whose bound reaches that too are scored: as products of small
matrices in single precision, and exactly where that comes near the item's eighth best. The
rare-word bonus only ever raises a score, so pairs that share rare words are scored
apart, and the better of the two scores per pair is ranked (exact, see tests).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import fixed
from ..session import fresh_path, materialise
from .similarity import AXES, Features, rare_words
from .sorting import top_per_group

VEC = [f"v_{a}" for a in AXES]
CHUNK = 128  # most targets in a block of alike ones
FIRST = 4  # blocks that give an item its first floor
ITEM_BLOCK = 131072  # most items in a task, about 0.8 kB each
TARGET_BLOCK = 4194304  # most targets that pass by in a task, about 0.2 kB each
HELD = 524288  # targets that a task holds at once, about 0.4 kB each
PACK_ROWS = 131072  # targets that are cut into blocks together
LISTED = 16384  # items whose blocks are listed together
BOUNDS = 1 << 17  # bounds of items and blocks taken at once
LEAST_ITEMS = 2048  # items that are worth a task
TASK_PAIRS = 1 << 20  # most pairs by rare words in a task, if no item has many more than the others
STRIP = 512  # items scored at once
MOST_FOUND = 1 << 18  # pairs scored exactly at once
BROADCAST_CUTOFFS = 1 << 22  # full targets of 16 bytes each
SLACK = 1e-9  # more than rounding can move a bound
ROUGH = 2e-5  # more than single precision can move a score

KEYS = ["rel1", "rel2", "pre8", "maker1", "maker2"]
ITEM_FLOATS = [*VEC, "tone", "scale"]
TARGET_FLOATS = [*ITEM_FLOATS, "score"]
ITEM_LONGS = ["gid", "kind_rank", "turn", *KEYS]
TARGET_LONGS = ["gid", *KEYS]
SCORED = ["turn", "score", "tone", "scale", *VEC]
CANDIDATE = (
    "gid long, kind_rank int, turn long, target_rank int, neighbour long, sim double, axis int"
)


# ------------------------------------------------------------------ inputs


def pair_keys(vectors: DataFrame, side: str) -> DataFrame:
    """Keys two items must not share: 128-bit hashes of franchise and maker, and the eight
    bytes of the title prefix as they are. An absent key gets a value of its own per side."""
    absent = F.lit(0 if side == "item" else 1).cast("long")
    empty = F.col("base_key") == ""
    rel = F.when(empty, F.concat(F.lit("title:"), "title_key")).otherwise(F.concat(F.lit("base:"), "base_key"))
    pre = F.substring("title_key", 1, 8)
    packed = F.conv(F.hex(pre), 16, -10).cast("long")
    no_maker = F.col("maker") == ""
    return vectors.select(
        "gid", "kind_rank", "turn", "score", "eligible", "tone", "scale", *VEC,
        F.xxhash64(rel).alias("rel1"),
        F.xxhash64(F.lit("second"), rel).alias("rel2"),
        F.when(F.length(pre) == 8, packed).otherwise(absent).alias("pre8"),
        F.when(no_maker, absent).otherwise(F.xxhash64("maker")).alias("maker1"),
        F.when(no_maker, absent).otherwise(F.xxhash64(F.lit("second"), "maker")).alias("maker2"),
    )


def cell_of(n_targets: int) -> Column:
    """Cell of a target: kind, tone, then scale, quality and strongest axis as the catalogue
    grows. At most 4 * 8 * 8 * 4 * 13 = 13,312 cells, so their bounds always fit a broadcast."""
    tones, scales, qualities, by_axis = (
        (4, 1, 1, False) if n_targets <= 20_000 else (4, 4, 4, False) if n_targets <= 1_000_000 else (8, 8, 4, True)
    )
    part = lambda c, n: F.least(F.lit(n - 1), F.floor((F.col(c) + 1) * n / 2)).cast("int")
    cell = (F.col("kind_rank") * tones + part("tone", tones)) * scales + part("scale", scales)
    quality = F.least(F.lit(qualities - 1), F.floor((F.col("score") - 60) * qualities / 40)).cast("int")
    cell = cell * qualities + quality
    if by_axis:
        top = F.greatest(*[F.col(v) for v in VEC])
        axis = F.lit(0)
        for i in reversed(range(len(VEC))):
            axis = F.when(F.col(VEC[i]) == top, F.lit(i)).otherwise(axis)
        cell = cell * len(VEC) + axis
    return cell


# ------------------------------------------------------------------ block scoring


def pair_scores(left: dict, right: dict) -> np.ndarray:
    """Scores of pairs without the rare-word bonus, term by term in the fixed order."""
    sim = 0.0
    for v in VEC:
        sim = sim + left[v] * right[v]
    sim = sim - fixed.SCALE_W * np.abs(left["scale"] - right["scale"])
    sim = sim + fixed.QUAL_W * ((right["score"] - 60) / 40)
    gap = np.abs(left["tone"] - right["tone"])
    return sim * np.maximum(0.0, 1 - fixed.TONE_VETO * gap * gap)


def score_block(left: dict, right: dict) -> np.ndarray:
    """Scores of all (left, right) pairs without the rare-word bonus; pairs that must not meet
    get minus infinity. The plain form, which tests hold blocks and bounds against."""
    used = [*VEC, "tone", "scale"]
    sim = pair_scores({c: left[c][:, None] for c in used}, {c: right[c][None, :] for c in [*used, "score"]})
    same = lambda k: left[k][:, None] == right[k][None, :]
    sim[(same("rel1") & same("rel2")) | same("pre8") | (same("maker1") & same("maker2"))] = -np.inf
    return sim


def cell_bounds(left: dict, cells: pd.DataFrame, near: float | np.ndarray = 1.0) -> np.ndarray:
    """Upper bound of the score of any pair (item, member of the cell); `near` bounds the cosine too."""
    cos = np.zeros((len(left["gid"]), len(cells)))
    for v in VEC:
        cos += left[v][:, None] * cells[v].to_numpy()[None, :]
    cos = np.minimum(cos, np.minimum(near, 1.0) + SLACK)
    off = lambda c: np.maximum(
        0.0,
        np.maximum(
            cells[f"{c}_lo"].to_numpy()[None, :] - left[c][:, None],
            left[c][:, None] - cells[f"{c}_hi"].to_numpy()[None, :],
        ),
    )
    inner = cos - fixed.SCALE_W * off("scale") + (fixed.QUAL_W * ((cells["top"].to_numpy() - 60) / 40))[None, :]
    gap = off("tone")
    return np.maximum(inner, 0.0) * np.maximum(0.0, 1 - fixed.TONE_VETO * gap * gap)


def _arrays(pdf: pd.DataFrame) -> dict:
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def _pack(pdf: pd.DataFrame, floats: list[str], longs: list[str]) -> dict:
    """Columns of a few rows as two strings of bytes, column after column."""
    return {
        "floats": np.concatenate([pdf[c].to_numpy("f8") for c in floats]).tobytes(),
        "longs": np.concatenate([pdf[c].to_numpy("i8") for c in longs]).tobytes(),
    }


def _unpack(floats: bytes, longs: bytes, f_names: list[str], l_names: list[str]) -> dict:
    f = np.frombuffer(floats, "f8").reshape(len(f_names), -1)
    i = np.frombuffer(longs, "i8").reshape(len(l_names), -1)
    return dict(zip(f_names, f)) | dict(zip(l_names, i))


def _pack_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items -> packed rows, one per group in each batch: mapInPandas body."""
    for pdf in batches:
        out = [{"grp": int(g)} | _pack(part, ITEM_FLOATS, ITEM_LONGS) for g, part in pdf.groupby("grp", sort=False)]
        if out:
            yield pd.DataFrame(out)


def _leaves(points: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Halves rows at the median of their widest direction until at most `most` are together."""
    if len(rows) <= most:
        yield rows
        return
    part = points[rows]
    axis = int(part.var(axis=0).argmax())
    order = rows[np.argsort(part[:, axis], kind="stable")]
    half = len(order) // 2
    yield from _leaves(points, order[:half], most)
    yield from _leaves(points, order[half:], most)


def _pack_targets(chunk: int):
    """Sorted targets -> packed blocks of alike targets of one kind: mapInPandas body. Of targets
    that are equal in all that counts, the first 8 items are the best for everyone, so the rest go,
    and so do targets without a number in what scores read: they reach no score."""
    same = TARGET_FLOATS + KEYS

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid", kind="stable")
        pdf = pdf[pdf.groupby(same, sort=False).cumcount() < fixed.WIDE]
        points = pdf[TARGET_FLOATS].to_numpy("f8")
        points[:, -1] = fixed.QUAL_W * (points[:, -1] - 60) / 40
        points[:, -3:-1] *= 1.5  # tone and scale; by trial, so that fewest blocks reach the floors
        found = [np.sort(r) for r in _leaves(points, np.arange(len(pdf)), chunk)]
        return pd.DataFrame(
            [{"kind_rank": int(pdf["kind_rank"].iloc[0]), "block": zlib.crc32(p["longs"])} | p
             for p in (_pack(pdf.iloc[r], TARGET_FLOATS, TARGET_LONGS) for r in found)]
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = {}, {}
        for pdf in batches:
            for rank, part in pdf.dropna(subset=TARGET_FLOATS).groupby("kind_rank", sort=False):
                held.setdefault(rank, []).append(part)
                n[rank] = n.get(rank, 0) + len(part)
                if n[rank] >= PACK_ROWS:
                    yield blocks(pd.concat(held.pop(rank)))
                    del n[rank]
        for parts in held.values():
            yield blocks(pd.concat(parts))

    return run


class _Blocks:
    """Blocks of targets of one medium as padded arrays in single precision, and what bounds their scores."""

    def __init__(self, blocks: list[dict]):
        self.right = {c: np.concatenate([b[c] for b in blocks]) for c in blocks[0]}
        self.exact = np.stack([self.right[c] for c in TARGET_FLOATS], axis=1)
        self.keys = np.stack([self.right[c] for c in KEYS], axis=1)
        size = np.array([len(b["gid"]) for b in blocks])
        start = np.cumsum(size) - size
        wide = -(-int(size.max()) // 8) * 8
        place = np.arange(wide)
        real = place < size[:, None]
        self.at = np.where(real, start[:, None] + place, 0)  # places behind the last target of a block hold no target
        of = lambda c: np.where(real, self.right[c][self.at], 0.0)
        vec = np.stack([of(v) for v in VEC], axis=1)
        quality = np.where(real, fixed.QUAL_W * ((of("score") - 60) / 40), -1e30)  # which reaches no floor
        tone, one = of("tone"), np.ones(real.shape)
        self.inner = np.concatenate([vec, quality[:, None], fixed.SCALE_W * of("scale")[:, None]], axis=1).astype("f4")
        self.columns = np.ascontiguousarray(self.inner.transpose(0, 2, 1))
        self.factor = np.stack([one, tone, -fixed.TONE_VETO * tone * tone], axis=1).astype("f4")
        self.tone, self.scale = tone.astype("f4"), (fixed.SCALE_W * of("scale")).astype("f4")
        # Bounds: the largest of each axis, a ball around the middle, and spans of tone, scale and quality.
        middle = vec.sum(axis=2) / size[:, None]
        off = np.where(real, ((vec - middle[:, :, None]) ** 2).sum(axis=1), 0.0)
        self.box, self.middle = vec.max(axis=2).T.astype("f4"), (2 * middle).T.astype("f4")
        self.middle_length = (middle**2).sum(axis=1).astype("f4")
        self.radius = np.sqrt(off.max(axis=1)).astype("f4")
        self.length = (vec**2).sum(axis=1).max(axis=1).astype("f4")
        self.top = quality.max(axis=1).astype("f4")
        span = lambda x: (np.where(real, x, np.inf).min(axis=1), np.where(real, x, -np.inf).max(axis=1))
        self.spans = {}
        for c, x in (("tone", tone), ("scale", of("scale"))):
            low, high = span(x)
            self.spans[c] = ((low + high) / 2).astype("f4"), ((high - low) / 2).astype("f4")

    def bounds(self, vec: np.ndarray, length: np.ndarray, tone: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the scores of items with the targets of each block, up to rounding, and about the
        score of its middle. From |a - b| >= |a - middle| - radius follows a bound on a * b, which for small
        blocks is closer than that of the box."""
        far = vec @ self.middle
        middle = far * np.float32(0.5)
        np.subtract(self.middle_length, far, out=far)
        far += length[:, None]
        np.maximum(far, 0.0, out=far)
        np.sqrt(far, out=far)
        far -= self.radius
        np.maximum(far, 0.0, out=far)
        np.multiply(far, far, out=far)
        np.subtract(self.length, far, out=far)
        far += length[:, None]
        far *= np.float32(0.5)
        out = vec @ self.box
        np.minimum(out, far, out=out)
        for c, x in (("scale", scale), ("tone", tone)):
            at, half = self.spans[c]
            np.subtract(x[:, None], at, out=far)
            np.abs(far, out=far)
            if c == "scale":
                middle -= np.float32(fixed.SCALE_W) * far
            far -= half
            np.maximum(far, 0.0, out=far)
            if c == "scale":
                far *= np.float32(fixed.SCALE_W)
                out -= far
        out += self.top
        middle += self.top
        np.multiply(far, far, out=far)
        far *= np.float32(-fixed.TONE_VETO)
        far += np.float32(1)
        np.maximum(far, 0.0, out=far)
        np.maximum(out, 0.0, out=out)
        out *= far
        middle *= far
        return out, middle


class _Group:
    """Items of a task with the best targets they have met so far, at most 8 per medium."""

    def __init__(self, items: dict, k: int):
        known = ~np.isnan(sum(items[c] for c in ITEM_FLOATS))  # no score without a number
        self.items, self.k = {c: v[known] for c, v in items.items()}, k
        items = self.items
        self.m = m = len(items["gid"])
        self.floor, self.sim, self.gid, self.axis = {}, {}, {}, {}
        # In single precision, as products of matrices: the score before the tone factor, and the factor.
        self.exact = np.stack([items[c] for c in ITEM_FLOATS], axis=1)
        self.keys = np.stack([items[c] for c in KEYS], axis=1)
        one, vec = np.ones(m), self.exact[:, : len(VEC)]
        self.inner = np.concatenate([vec, one[:, None], one[:, None]], axis=1).astype("f4")
        t = items["tone"]
        self.factor = np.stack([1 - fixed.TONE_VETO * t * t, 2 * fixed.TONE_VETO * t, one], axis=1).astype("f4")
        self.scale = (fixed.SCALE_W * items["scale"]).astype("f4")
        self.length = (vec**2).sum(axis=1).astype("f4")
        self.bare = {"tone": t.astype("f4"), "scale": items["scale"].astype("f4")}

    def meet(self, rank: int, blocks: list[dict]) -> None:
        """Scores blocks of targets of one medium with the items they may still matter to."""
        m, k = self.m, self.k
        if rank not in self.floor:
            self.floor[rank] = np.full(m, fixed.MIN_SIM)
            self.sim[rank] = np.full((m, k), -np.inf)
            self.gid[rank] = np.full((m, k), np.iinfo("i8").max)
            self.axis[rank] = np.full((m, k), -1, "i1")
        held = _Blocks(blocks)
        others = np.flatnonzero(self.items["kind_rank"] != rank)
        for a in range(0, len(others), LISTED):
            rows, block, bound = self.listed(rank, held, others[a : a + LISTED])
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(len(blocks) + 1))
            found, n = [], 0
            for j in np.flatnonzero(np.diff(ends)):
                at = order[ends[j] : ends[j + 1]]
                r = rows[at]
                r = r[bound[at] >= self.floor[rank][r] - ROUGH]
                for b in range(0, len(r), STRIP):
                    hits = self.near(rank, held, j, r[b : b + STRIP])
                    if len(hits[0]):
                        found.append(hits)
                        n += len(hits[0])
                if n >= MOST_FOUND:
                    self.take(rank, held, found)
                    found, n = [], 0
            if found:
                self.take(rank, held, found)

    def listed(self, rank: int, held: _Blocks, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, block, bound) of the blocks that reach the floors, after the nearest blocks have set them."""
        out, n = [], len(held.at)
        step = max(1, BOUNDS // n)
        narrow = "i2" if n < 32768 else "i8"
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            bound, middle = held.bounds(self.inner[r, :-2], self.length[r], *(self.bare[c][r] for c in ("tone", "scale")))
            middle += bound
            each, first = np.arange(len(r)), []
            for _ in range(min(FIRST, n)):
                first.append(middle.argmax(axis=1))
                middle[each, first[-1]] = -np.inf
            self.lift(rank, held, r, np.stack(first, axis=1))
            i, j = np.nonzero(bound >= (self.floor[rank][r] - ROUGH).astype("f4")[:, None])
            out.append((r[i].astype("i4"), j.astype(narrow), bound[i, j]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def lift(self, rank: int, held: _Blocks, r: np.ndarray, first: np.ndarray) -> None:
        """Raises floors to the eighth best score in some blocks, a few each; pairs that must not meet do not count."""
        k, most = self.k, 3 * self.k
        sim = np.matmul(self.inner[r][:, None, None, :-1], held.inner[first][:, :, :-1])[:, :, 0]
        sim -= np.abs(self.scale[r][:, None, None] - held.scale[first])
        factor = np.matmul(self.factor[r][:, None, None, :], held.factor[first])[:, :, 0]
        sim = (np.maximum(sim, 0.0) * np.maximum(factor, 0.0)).reshape(len(r), -1)
        if sim.shape[1] < most:
            return
        top = np.argpartition(sim, sim.shape[1] - most, axis=1)[:, -most:]
        score = np.take_along_axis(sim, top, axis=1)
        c = np.take_along_axis(held.at[first].reshape(len(r), -1), top, axis=1)
        same = lambda key: self.items[key][r][:, None] == held.right[key][c]
        score[(same("rel1") & same("rel2")) | same("pre8") | (same("maker1") & same("maker2"))] = -np.inf
        eighth = np.partition(score, most - k, axis=1)[:, most - k] - ROUGH
        self.floor[rank][r] = np.maximum(self.floor[rank][r], eighth)

    def near(self, rank: int, held: _Blocks, j: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, target) of a block whose scores in single precision come near the floors. All pairs are bounded
        by one product: the scale on the item's side of the block, the tone factor at its best in the block."""
        low = (self.floor[rank][r] - ROUGH).astype("f4")
        (at, half), (middle, _) = ((x[j] for x in held.spans[c]) for c in ("tone", "scale"))
        gap = np.maximum(np.abs(self.bare["tone"][r] - at) - half, 0.0)
        best = np.maximum(1 - np.float32(fixed.TONE_VETO) * gap * gap, np.float32(1e-6))
        side = np.where(self.bare["scale"][r] >= middle, np.float32(1), np.float32(-1))
        inner = self.inner[r]
        inner[:, -1] = side
        hit = inner @ held.inner[j] >= (low / best + side * self.scale[r] - np.float32(ROUGH))[:, None]
        wide = hit.shape[1]
        eights = np.flatnonzero(hit.reshape(-1).view("u8"))
        which, place = np.nonzero(hit.reshape(-1, 8)[eights])
        at = eights[which] * 8 + place
        i, c = at // wide, at % wide
        sim = np.einsum("ij,ij->i", self.inner[r[i], :-1], held.columns[j, c, :-1])
        gap = self.bare["tone"][r[i]] - held.tone[j, c]
        sim -= np.abs(self.scale[r[i]] - held.scale[j, c])
        sim *= 1 - np.float32(fixed.TONE_VETO) * gap * gap
        keep = sim >= low[i]
        return r[i[keep]], held.at[j, c[keep]]

    def take(self, rank: int, held: _Blocks, found: list) -> None:
        """Exact scores of what single precision lets through, merged into the lists: higher
        scores first, ties to the lower item."""
        k = self.k
        r, c = (np.concatenate(x) for x in zip(*found))
        same = dict(zip(KEYS, (self.keys[r] == held.keys[c]).T))
        apart = ~((same["rel1"] & same["rel2"]) | same["pre8"] | (same["maker1"] & same["maker2"]))
        r, c = r[apart], c[apart]
        left, other = dict(zip(ITEM_FLOATS, self.exact[r].T)), dict(zip(TARGET_FLOATS, held.exact[c].T))
        sim = pair_scores(left, other)
        keep = sim >= self.floor[rank][r]
        if not keep.any():
            return
        r, c, sim = r[keep], c[keep], sim[keep]
        low = np.minimum([left[v][keep] for v in VEC], [other[v][keep] for v in VEC])
        axis = np.where(low.max(axis=0) > 0, low.argmax(axis=0), -1).astype("i1")
        mine = np.unique(r)
        row = np.concatenate([np.repeat(mine, k), r])
        sim = np.concatenate([self.sim[rank][mine].ravel(), sim])
        gid = np.concatenate([self.gid[rank][mine].ravel(), held.right["gid"][c]])
        axis = np.concatenate([self.axis[rank][mine].ravel(), axis])
        order = np.lexsort((gid, -sim, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = order[place < k]
        self.sim[rank][mine] = sim[best].reshape(-1, k)
        self.gid[rank][mine] = gid[best].reshape(-1, k)
        self.axis[rank][mine] = axis[best].reshape(-1, k)
        self.floor[rank][mine] = np.maximum(self.floor[rank][mine], self.sim[rank][mine, k - 1])

    def rows(self) -> Iterator[pd.DataFrame]:
        for rank in self.floor:
            for a in range(0, self.m, 16384):
                r, place = np.nonzero(self.sim[rank][a : a + 16384] > -np.inf)
                r += a
                yield pd.DataFrame(
                    {
                        "gid": self.items["gid"][r], "kind_rank": self.items["kind_rank"][r], "turn": self.items["turn"][r],
                        "target_rank": rank, "neighbour": self.gid[rank][r, place],
                        "sim": self.sim[rank][r, place], "axis": self.axis[rank][r, place],
                    }
                )


def _best(held: int, k: int):
    """Per task: its items first, then blocks of targets, up to `held` targets at once: mapInPandas body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, group, task, blocks, n = [], None, None, {}, 0

        def met() -> None:
            nonlocal group, parts, blocks, n
            if group is None:
                group = _Group({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, k)
                parts = parts[:1]
            for rank in sorted(blocks):
                group.meet(rank, blocks.pop(rank))
            n = 0

        with np.errstate(all="ignore"):
            for pdf in batches:
                for t, rank, floats, longs in zip(pdf["task"], pdf["kind_rank"], pdf["floats"], pdf["longs"]):
                    if t != task:
                        if blocks:
                            met()
                            yield from group.rows()
                        elif group is not None:
                            yield from group.rows()
                        parts, group, task, blocks, n = [], None, t, {}, 0
                    if rank < 0:
                        parts.append(_unpack(floats, longs, ITEM_FLOATS, ITEM_LONGS))
                    elif parts:
                        blocks.setdefault(rank, []).append(_unpack(floats, longs, TARGET_FLOATS, TARGET_LONGS))
                        n += len(blocks[rank][-1]["gid"])
                        if n >= held:
                            met()
            if blocks:
                met()
            if group is not None:
                yield from group.rows()

    return run


def alike_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first item of each group that is equal in all that scores read, and (of, gid, turn) of every item.

    Groups are told by 128-bit hashes; a null counts as no number, as it does in scores."""
    alike = [*ITEM_FLOATS, "kind_rank", *KEYS]
    known = [F.coalesce(F.col(c), F.lit(float("nan"))) if c in ITEM_FLOATS else F.col(c) for c in alike]
    marked = items.withColumns({"_h1": F.xxhash64(*known), "_h2": F.xxhash64(F.lit("second"), *known)})
    first = materialise(
        marked.groupBy("_h1", "_h2").agg(*[F.min(c).alias(c) for c in ["gid", "turn", *alike]]), "alike"
    )
    of = first.select("_h1", "_h2", F.col("gid").alias("of"))
    return first.drop("_h1", "_h2"), marked.select("_h1", "_h2", "gid", "turn").join(of, ["_h1", "_h2"]).select("of", "gid", "turn")


def plain_candidates(
    vectors: DataFrame, grain: int | None = None, chunk: int = CHUNK, item_block: int = ITEM_BLOCK, target_block: int = TARGET_BLOCK
) -> DataFrame:
    """Best 8 per item and medium by the score without the rare-word bonus, for each part of
    the targets; the best 8 of an item are among its parts' best.

    A task holds up to `item_block` items and lets up to `target_block` targets pass by, packed
    in blocks of up to `chunk` alike ones. Items and targets are dealt to a number of groups
    that follows the cores, until that bound makes more of them: till then what is shuffled
    grows as the input does, and pairs never leave a task. Items that are equal in all that
    scores read have the same lists: where they are at least half of all, one of each kind is
    scored and the others take its lists. `grain` sets how fine the cells are by which targets
    are sorted (the number of targets by default)."""
    items = pair_keys(vectors, "item").drop("score", "eligible")
    different = F.approx_count_distinct(F.xxhash64(*ITEM_FLOATS, "kind_rank", *KEYS)).alias("n")
    n = items.agg(F.count("*").alias("items"), different).first()
    if n["items"] >= 2 * n["n"]:
        first, members = alike_items(items)
        lists = _plain_candidates(first, vectors, grain, chunk, item_block, target_block).drop("turn").withColumnRenamed("gid", "of")
        return lists.join(members, "of").select("gid", "kind_rank", "turn", "target_rank", "neighbour", "sim", "axis")
    return _plain_candidates(items, vectors, grain, chunk, item_block, target_block)


def _plain_candidates(
    items: DataFrame, vectors: DataFrame, grain: int | None, chunk: int, item_block: int, target_block: int
) -> DataFrame:
    spark = vectors.sparkSession
    targets = pair_keys(vectors.filter("eligible"), "target").drop("turn", "eligible")
    n, t = items.count(), vectors.filter("eligible").count()
    if not t:
        return spark.createDataFrame([], CANDIDATE)
    targets = targets.withColumn("cell", cell_of(t if grain is None else grain))
    wanted = min(3 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ITEMS))
    groups, parts = max(1, wanted, -(-n // item_block)), max(1, -(-t // target_block))
    alike = F.xxhash64(*TARGET_FLOATS, *KEYS)
    blocks = (
        targets.withColumn("_like", alike)
        .repartitionByRange(max(1, -(-t // PACK_ROWS)), "kind_rank", "cell", "_like", "gid")
        .select("kind_rank", *TARGET_FLOATS, *TARGET_LONGS)
        .mapInPandas(_pack_targets(chunk), "kind_rank int, block long, floats binary, longs binary")
        .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        .select((F.col("grp") * parts + F.col("block") % parts).cast("int").alias("task"), "kind_rank", "block", "floats", "longs")
    )
    grp = F.pmod(F.xxhash64("gid", F.lit("item")), F.lit(groups)).cast("int").alias("grp")
    rows = (
        items.select(grp, *ITEM_FLOATS, *ITEM_LONGS)
        .mapInPandas(_pack_items, "grp int, floats binary, longs binary")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .select((F.col("grp") * parts + F.col("part")).cast("int").alias("task"), F.lit(-1).alias("kind_rank"), F.lit(0).cast("long").alias("block"), "floats", "longs")
    )
    dealt = rows.unionByName(blocks).repartitionById(groups * parts, F.col("task"))
    # Blocks come in an order that says nothing of what they hold, so the first ones lift all floors.
    return dealt.sortWithinPartitions("task", (F.col("kind_rank") >= 0), "block").mapInPandas(_best(HELD, fixed.WIDE), CANDIDATE)


# ------------------------------------------------------------------ rare-word pairs


def related(a: str = "i", b: str = "j") -> Column:
    """Same franchise: equal titles, equal non-empty base titles, or equal eight-letter starts."""
    c = lambda side, name: F.col(f"{side}.{name}")
    pre = [F.substring(c(s, "title_key"), 1, 8) for s in (a, b)]
    return (
        (c(a, "title_key") == c(b, "title_key"))
        | ((c(a, "base_key") != "") & (c(a, "base_key") == c(b, "base_key")))
        | ((F.length(pre[0]) == 8) & (pre[0] == pre[1]))
    )


def same_maker(a: str = "i", b: str = "j") -> Column:
    return (F.col(f"{a}.maker") != "") & (F.col(f"{a}.maker") == F.col(f"{b}.maker"))


def score_parts(a: str = "i", b: str = "j") -> dict[str, Column]:
    """What the score of a pair is made of: `cos`, `off`, `quality` and the tone factor `veto`."""
    c = lambda side, name: F.col(f"{side}.{name}")
    cos = F.lit(0.0)
    for v in VEC:
        cos = cos + c(a, v) * c(b, v)
    gap = F.abs(c(a, "tone") - c(b, "tone"))
    return {
        "cos": cos,
        "off": F.lit(fixed.SCALE_W) * F.abs(c(a, "scale") - c(b, "scale")),
        "quality": F.coalesce(F.lit(fixed.QUAL_W) * ((c(b, "score") - 60) / 40), F.lit(0.0)),
        "veto": F.greatest(F.lit(0.0), 1 - F.lit(fixed.TONE_VETO) * gap * gap),
    }


def whole_score(shared: Column, cos: Column, off: Column, quality: Column, veto: Column) -> Column:
    bonus = F.lit(fixed.RARE_W) * F.least(shared, F.lit(3)) / 3
    return (cos + F.when(shared > 0, bonus).otherwise(F.lit(0.0)) - off + quality) * veto


def pair_score(shared: Column, a: str = "i", b: str = "j") -> Column:
    return whole_score(shared, **score_parts(a, b))


def shared_axis(a: str = "i", b: str = "j") -> Column:
    """Axis both items share most; the first of equals, -1 if they share none."""
    low = [F.least(F.col(f"{a}.{v}"), F.col(f"{b}.{v}")) for v in VEC]
    top = F.greatest(*low)
    out = F.lit(-1)
    for i in reversed(range(len(VEC))):
        out = F.when((low[i] == top) & (top > 0), F.lit(i)).otherwise(out)
    return out


def pair() -> list[Column]:
    return [F.col("i.gid").alias("gid"), F.col("j.gid").alias("neighbour")]


def rare_meetings(features: Features, columns: list[str] = ()) -> DataFrame:
    """(i, j): two items of different kinds for each rare word they share, j eligible; each with gid,
    kind_rank, eligible and `columns` of its vector.

    A rare word is in at most 40 items by definition, so its list is bounded, a word gives a
    bounded number of pairs, and the whole is linear in the text. Items bring their columns
    to the list, so a pair is judged where it is made and needs no join."""
    shown = ["gid", "kind_rank", "eligible", *columns]
    counts = features.counts if features.scarce is None else features.scarce
    rare = rare_words(counts, features.profiles, features.vectors.select("kind", "pos", *shown))
    lists = rare.groupBy("word").agg(F.collect_list(F.struct(*shown)).alias("l"))
    pairs = lists.select(F.explode("l").alias("i"), "l").select("i", F.explode("l").alias("j"))
    return pairs.filter(F.col("j.eligible") & (F.col("i.kind_rank") != F.col("j.kind_rank")))


def by_item(features: Features, pairs: DataFrame) -> DataFrame:
    """Pairs spread by item, into tasks that the number of pairs keeps small."""
    df = F.col("df")
    most = features.profiles.filter(df.between(*fixed.RARE_DF)).agg(F.sum(df * (df - 1)).alias("n")).first()["n"] or 0
    return pairs.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_PAIRS)), "gid")


def rare_pairs(features: Features) -> DataFrame:
    """(gid, neighbour, shared): cross-kind pairs that share rare words, targets eligible."""
    pairs = by_item(features, rare_meetings(features).select(*pair()))
    return pairs.groupBy("gid", "neighbour").agg(F.count("*").alias("shared"))


def rare_scores(features: Features, met: DataFrame, least: float | None = None) -> DataFrame:
    """(gid, kind_rank, turn, target_rank, neighbour, sim, axis) of pairs that met, full score; of those that
    score `least`, if given. A pair that would not with the whole bonus is dropped where it is made."""
    parts = score_parts()
    rows = met.select(
        *pair(), F.col("i.kind_rank").alias("kind_rank"), F.col("i.turn").alias("turn"),
        F.col("j.kind_rank").alias("target_rank"), *[c.alias(n) for n, c in parts.items()], shared_axis().alias("axis"),
    )
    key = ["gid", "kind_rank", "turn", "target_rank", "neighbour"]
    if least is not None:
        rows = rows.filter(whole_score(F.lit(3), *map(F.col, parts)) >= least)
    once = by_item(features, rows).groupBy(*key).agg(
        F.count("*").alias("shared"), *[F.max(n).alias(n) for n in [*parts, "axis"]]
    )
    scored = once.select(*key, whole_score(F.col("shared"), *map(F.col, parts)).alias("sim"), "axis")
    return scored if least is None else scored.filter(F.col("sim") >= least)


def rare_candidates(features: Features) -> DataFrame:
    """Best 8 per item and medium among the pairs that share rare words, full score."""
    met = rare_meetings(features, [*SCORED, "title_key", "base_key", "maker"]).filter(~related() & ~same_maker())
    scored = rare_scores(features, met, fixed.MIN_SIM)
    return top_per_group(scored, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], fixed.WIDE, "_r").drop("_r")


def best_of_both(both: DataFrame, n_items: int) -> DataFrame:
    """Best 8 per item and medium with rank `place`, a pair at its better score. Spread by list once, into
    tasks that the number of items keeps small; the merge and the ranking both keep to that."""
    spark = both.sparkSession
    most = n_items * 3 * fixed.WIDE * (1 + max(1, -(-n_items // TARGET_BLOCK)))
    lists = both.repartition(max(spark.sparkContext.defaultParallelism, -(-most // TASK_PAIRS)), "gid", "target_rank")
    key = ["gid", "kind_rank", "turn", "target_rank", "neighbour"]
    merged = lists.groupBy(*key).agg(F.max("sim").alias("sim"), F.max("axis").alias("axis"))
    return top_per_group(merged, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], fixed.WIDE, "place")


def candidates(features: Features) -> DataFrame:
    """Best 8 per item and medium with rank `place`; the bonus counts where there is one."""
    both = plain_candidates(features.vectors).unionByName(rare_candidates(features))
    return best_of_both(both, features.ids.count())


# ------------------------------------------------------------------ assignment


def assign(cands: DataFrame, cap: int = fixed.CAP, quota: int = fixed.K_PER_MEDIUM) -> DataFrame:
    """Each item takes, per medium, its best `quota` candidates that have room; earlier turns
    go first. Serial by definition, but since every target prefers earlier turns, the outcome
    is the one stable assignment, which deferred acceptance reaches in parallel rounds.

    The state is one cutoff turn per full target. Cutoffs only fall, so a round is: drop
    candidates behind a cutoff, take the best `quota`, recompute the cutoffs. They are
    written to the shared folder each round, which also ends the lineage. Rounds read one
    row per list, so that a list finds its best `quota` without a sort or an exchange.
    `cands` is read several times: give a written table."""
    spark = cands.sparkSession
    wide = cands.agg(F.max("place").alias("n")).first()["n"] or 0
    lists = materialise(_lists(cands, wide), "lists") if wide <= fixed.WIDE else None
    schema = "neighbour long, cutoff long"
    cutoffs = spark.createDataFrame([], schema)
    listed, before = lists is not None, None
    while True:
        if listed:
            proposed = _list_proposals(lists, cutoffs if before else None, quota, wide)
        else:
            proposed = _proposals(cands, cutoffs, quota).select("neighbour", "turn")
        held = top_per_group(proposed, ["neighbour"], [F.asc("turn")], cap, "_r")
        full = held.filter(F.col("_r") == cap).select("neighbour", F.col("turn").alias("cutoff"))
        seen = Observation()
        path = fresh_path(spark, "cutoffs")
        full.observe(seen, F.count("*").alias("n"), F.sum("cutoff").alias("s")).write.parquet(path)
        # Targets only get full and cutoffs only fall, so equal figures mean equal tables.
        state = (seen.get["n"], seen.get["s"])
        if state == before or not state[0]:
            return _proposals(cands, cutoffs, quota)
        before = state
        cutoffs = spark.read.schema(schema).parquet(path)
        listed = lists is not None and state[0] * wide <= BROADCAST_CUTOFFS  # every place has them
        if state[0] <= BROADCAST_CUTOFFS:
            cutoffs = F.broadcast(cutoffs)  # else every round would bring all candidates to their cutoffs


def _proposals(cands: DataFrame, cutoffs: DataFrame, quota: int) -> DataFrame:
    open_ = cands.join(cutoffs, "neighbour", "left").filter(
        F.col("cutoff").isNull() | (F.col("turn") <= F.col("cutoff"))
    )
    return top_per_group(open_.drop("cutoff"), ["gid", "target_rank"], [F.asc("place")], quota, "pick")


def _lists(cands: DataFrame, wide: int) -> DataFrame:
    """One row per item and medium: its turn, and the candidate of each place as n1, n2, ..."""
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("neighbour"))).alias(f"n{k}")
    return cands.groupBy("gid", "target_rank").agg(F.max("turn").alias("turn"), *map(at, range(1, wide + 1))).drop("gid", "target_rank")


def _list_proposals(lists: DataFrame, cutoffs: DataFrame | None, quota: int, wide: int) -> DataFrame:
    """(neighbour, turn) of the best `quota` of each list that no cutoff shuts out."""
    rows, taken, picks = lists, F.lit(0), []
    for k in range(1, wide + 1):
        free = F.col(f"n{k}").isNotNull()
        if cutoffs is not None:
            cut = cutoffs.select(F.col("neighbour").alias(f"n{k}"), F.col("cutoff").alias(f"c{k}"))
            rows = rows.join(F.broadcast(cut), f"n{k}", "left")
            free &= F.col(f"c{k}").isNull() | (F.col("turn") <= F.col(f"c{k}"))
        picks.append(F.when(free & (taken < quota), F.col(f"n{k}")))
        taken = taken + F.when(free, 1).otherwise(0)
    return rows.select("turn", F.explode(F.array(*picks)).alias("neighbour")).dropna(subset=["neighbour"])


def neighbour_slots(picks: DataFrame) -> DataFrame:
    """Numbers an item's picks through its media in order: slots 0 to 8."""
    order = [F.asc("target_rank"), F.asc("pick")]
    return top_per_group(picks, ["gid"], order, 3 * fixed.K_PER_MEDIUM, "_s").withColumn("slot", F.col("_s") - 1).drop("_s")
