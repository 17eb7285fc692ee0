"""The identity bank's walk over frames: a verdict for every correspondence.

A frame is judged by what the bank holds from earlier frames; only what is accepted
(kept or probationary) enters it. So frames of a clip follow one another, clips are
independent: a task takes a frame of all its clips at once and holds the identities of
those clips, some thousand numbers each, and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.operators.reliable import spread

IDENTITY = ["clip", "kind", "slot"]
#: Observations for trust, empty frames an identity survives, pixel radii, probation and bootstrap frames.
TRUST, MAX_IDLE, SELF_PX, CROSS_PX, PROBATION, BOOTSTRAP = 3, 8, 50.0, 20.0, 3, 5
VERDICTS = np.array(["kept", "probationary", "self", "cross"])
KEPT, PROBATIONARY, SELF, CROSS = range(4)


class IdentityBanks:
    """Identities of many clips by (clip number, identity number): observations, first and
    last frame, last pixel. Calls take one frame's rows of any of the clips, clip by clip."""

    def __init__(self):
        self.n, self.first, self.last = (np.zeros((0, 0), np.int64) for _ in range(3))
        self.at = np.zeros((0, 0, 2))

    def grow(self, clips: int, size: int) -> None:
        have = self.n.shape
        if clips <= have[0] and size <= have[1]:
            return
        # clips arrive one by one, so their room doubles
        room = have[0] if clips <= have[0] else max(clips, 2 * have[0])
        more = ((0, room - have[0]), (0, max(size - have[1], 0)))
        self.n, self.first, self.last = (np.pad(x, more) for x in (self.n, self.first, self.last))
        self.at = np.pad(self.at, (*more, (0, 0)))

    def judge(self, frame: int, clips: np.ndarray, ids: np.ndarray, pixels: np.ndarray) -> np.ndarray:
        """Verdict codes: cross, another trusted identity owns the pixel; self, a trusted
        identity jumped; probationary, too young; else kept."""
        n = self.n[clips, ids]
        out = np.full(len(ids), KEPT)
        exempt = (frame < BOOTSTRAP) | ((n > 0) & (self.first[clips, ids] < BOOTSTRAP))
        out[(n < PROBATION) & ~exempt] = PROBATIONARY
        step = pixels - self.at[clips, ids]
        out[(n >= TRUST) & (np.sqrt((step * step).sum(axis=1)) > SELF_PX)] = SELF
        starts = _changes(clips)
        present, row = clips[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(clips))))
        owned = self.n[present] >= TRUST
        if owned.any():
            u, v = (np.where(owned, self.at[present, :, axis], np.inf)[row] for axis in (0, 1))
            u -= pixels[:, :1]
            v -= pixels[:, 1:]
            gap = np.multiply(u, u, out=u) + np.multiply(v, v, out=v)
            gap[np.arange(len(ids)), ids] = np.inf
            near, other = np.nonzero(gap < CROSS_PX * CROSS_PX)
            out[near[np.sqrt(gap[near, other]) < CROSS_PX]] = CROSS
        return out

    def observe(self, frame: int, clips: np.ndarray, ids: np.ndarray, pixels: np.ndarray, present: np.ndarray) -> None:
        """Record accepted correspondences in order, then forget the idle of the clips
        ``present``, which are those with a row in the frame."""
        new = self.n[clips, ids] == 0
        self.first[clips[new], ids[new]] = frame
        np.add.at(self.n, (clips, ids), 1)
        self.last[clips, ids], self.at[clips, ids] = frame, pixels
        self.n[present] = np.where(frame - self.last[present] > MAX_IDLE, 0, self.n[present])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Firsts of the runs of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


BEFORE = ["prev_obs", "prev_frame", "prev_u", "prev_v"]
CORR = ["clip", "frame_idx", "corr_id", "kind", "slot", "u", "v"]
STATE = "verdict string, seen boolean, first_seen int, n_obs int, prev_obs int, prev_frame int, prev_u double, prev_v double"


def _known(b: pa.RecordBatch) -> pa.RecordBatch:
    """The rows without a null or a pixel that is no number."""
    good = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns])
    for name in ("u", "v"):
        good &= ~np.isnan(b.column(name).to_numpy(zero_copy_only=False))
    return b if good.all() else b.filter(pa.array(good))


def judged_corrs(corrs: DataFrame) -> DataFrame:
    """(clip, frame_idx, corr_id, kind, slot, u, v) with the verdict, the state of the
    identity before the frame (prev_*, null if unknown) and after it (first_seen, n_obs), and
    ``seen`` for the last accepted one of its identity and frame, whose pixel is kept.

    Rows with a null pixel, kind, slot or corr_id are no correspondences and are left out,
    inside the task, so that other readers of the rows by clip may share their shuffle; those
    of one frame are taken in corr_id order.
    """
    names = CORR
    rows = corrs.select(*names)
    rows = rows.withColumns({"u": F.col("u").cast("double"), "v": F.col("v").cast("double"), "frame_idx": F.col("frame_idx").cast("int")})

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        numbers: dict[tuple, int] = {}
        bank, rest = IdentityBanks(), None

        def run(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            clip, kind = (t.column(c).combine_chunks().dictionary_encode() for c in ("clip", "kind"))
            kinds, frame = kind.dictionary.to_pylist(), t.column("frame_idx").to_numpy()
            clip = np.array([places.setdefault(c, len(places)) for c in clip.dictionary.to_pylist()])[clip.indices.to_numpy()]
            slots, slot = np.unique(t.column("slot").to_numpy(), return_inverse=True)
            pairs, ids = np.unique(kind.indices.to_numpy().astype(np.int64) * len(slots) + slot, return_inverse=True)
            ids = np.array([numbers.setdefault((kinds[k], int(slots[s])), len(numbers)) for k, s in zip(*np.divmod(pairs, len(slots)))])[ids]
            bank.grow(len(places), len(numbers))
            pixels = np.stack([t.column("u").to_numpy(), t.column("v").to_numpy()], axis=1)
            verdict, first, n = (np.zeros(len(ids), np.int64) for _ in range(3))
            prev, seen = np.zeros((len(ids), 4)), np.zeros(len(ids), bool)
            starts = _changes(frame)
            for s, e in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                c, i, f = clip[s:e], ids[s:e], int(frame[s])
                prev[s:e, 0], prev[s:e, 1], prev[s:e, 2:] = bank.n[c, i], bank.last[c, i], bank.at[c, i]
                verdict[s:e] = code = bank.judge(f, c, i, pixels[s:e])
                ok = code <= PROBATIONARY
                bank.observe(f, c[ok], i[ok], pixels[s:e][ok], c[_changes(c)])
                first[s:e], n[s:e] = bank.first[c, i], bank.n[c, i]
                back = np.flatnonzero(ok)[::-1]
                seen[s + back[np.unique(c[back] * len(numbers) + i[back], return_index=True)[1]]] = True
            unknown, none = prev[:, 0] == 0, n == 0
            ints = lambda x, mask: pa.array(x.astype(np.int32), mask=mask)
            return pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks() for c in names), pa.array(VERDICTS[verdict]), pa.array(seen), ints(first, none), ints(n, none), ints(prev[:, 0], unknown), ints(prev[:, 1], unknown),
                 pa.array(prev[:, 2], mask=unknown), pa.array(prev[:, 3], mask=unknown)],
                names=[*names, "verdict", "seen", "first_seen", "n_obs", "prev_obs", "prev_frame", "prev_u", "prev_v"])

        for b in map(_known, batches):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            clip, frame = t.column("clip").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("frame_idx").to_numpy()
            cut = int(_changes(clip, frame)[-1])  # the last frame may go on in the next batch
            if cut:
                yield run(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield run(rest)

    ordered = spread(rows, "clip").sortWithinPartitions("frame_idx", "clip", "corr_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInArrow(walk, f"{schema}, {STATE}")


def accepted_history(judged: DataFrame) -> DataFrame:
    """Per identity and frame with an accepted correspondence: first_seen, n_obs, trusted,
    last pixel, the state before the frame (prev_*, where the rows have it) and the next such
    frame. The history lies by clip."""
    before = [c for c in BEFORE if c in judged.columns]
    # by clip, as the walk had them: what follows needs no other shuffle
    seen = spread(judged.where("seen").select(*IDENTITY, "frame_idx", "first_seen", "n_obs", F.col("u").alias("last_u"), F.col("v").alias("last_v"), *before), "clip")
    after = F.lead("frame_idx").over(Window.partitionBy(*IDENTITY).orderBy("frame_idx"))
    return seen.select(*IDENTITY, "frame_idx", "first_seen", "n_obs", (F.col("n_obs") >= TRUST).alias("trusted"), "last_u", "last_v", *before, after.alias("next_frame"))
