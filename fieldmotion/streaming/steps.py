"""Per-frame steps: identity bank, homography chain, player tracker and loss streak."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd

from fieldmotion.functions.constants import KIND_Y
from fieldmotion.operators.assign import MISSING, cheapest_matching
from fieldmotion.operators.planar import consensus_fit, mapped, robust_similarity

# --- identity bank -----------------------------------------------------------

BANK_SCHEMA = "clip string, frame_idx int, n_input int, n_kept int, n_probationary int, n_self int, n_cross int, n_tracks int, n_trusted int, n_checked int, n_bad int, median_residual double, valid boolean"

# Trust, pruning, pixel tolerances, probation and bootstrap.
TRUST, MAX_IDLE, SELF_PX, CROSS_PX, PROBATION, BOOTSTRAP = 3, 8, 50.0, 20.0, 3, 5


def _key(kind, slot):
    return f"{kind}|{int(slot)}"


def judge(bank: dict, frame: int, rows: Mapping[str, np.ndarray]) -> np.ndarray:
    """Verdict per row against the bank: kept, probationary, self or cross."""
    pix = rows["at"]
    trusted = {k: i for i, k in enumerate(k for k, t in bank.items() if t["n"] >= TRUST)}
    near = None
    if trusted:
        gap = pix[:, None, :] - np.array([bank[k]["at"] for k in trusted])[None]
        near = (gap * gap).sum(axis=2)
        owner = np.array([trusted.get(k, -1) for k in rows["key"]], dtype=int)
        mine = np.flatnonzero(owner >= 0)
        far = np.zeros(len(pix), bool)
        far[mine] = np.sqrt(near[mine, owner[mine]]) > SELF_PX
        near[mine, owner[mine]] = np.inf
        cross = (np.sqrt(near) < CROSS_PX).any(axis=1)
    out = []
    for i, k in enumerate(rows["key"]):
        t = bank.get(k)
        young = (t is None or t["n"] < PROBATION) and not (frame < BOOTSTRAP or (t is not None and t["first"] < BOOTSTRAP))
        out.append("cross" if near is not None and cross[i] else "self" if near is not None and far[i] else "probationary" if young else "kept")
    return np.array(out, dtype=object)


def observe(bank: dict, frame: int, rows: Mapping[str, np.ndarray]) -> None:
    """Record rows and forget identities idle for more than the limit."""
    for key, at in zip(rows["key"], rows["at"].tolist()):
        t = bank.setdefault(key, {"first": frame, "n": 0})
        t["n"] += 1
        t["last"], t["at"] = frame, at
    for name in [k for k, t in bank.items() if frame - t["last"] > MAX_IDLE]:
        del bank[name]


def residuals(bank: dict, h: np.ndarray, rows: Mapping[str, np.ndarray]) -> np.ndarray:
    """Where a homography puts trusted identities, in yards from where they belong: the
    rows of trusted ones, and the last pixels of those without a row."""
    trusted = {k: t for k, t in bank.items() if t["n"] >= TRUST}
    present = set(rows["key"])
    seen = [(k, p) for k, p in zip(rows["key"], rows["at"].tolist()) if k in trusted]
    seen += [(k, t["at"]) for k, t in trusted.items() if k not in present]
    if not seen:
        return np.zeros(0)
    gap = mapped(h, np.array([p for _, p in seen])) - np.array([_home(k) for k, _ in seen])
    return np.sqrt((gap * gap).sum(axis=1))


def agrees(bank: dict, h: np.ndarray, rows: Mapping[str, np.ndarray], tol: float = 0.7, bad_share: float = 0.20) -> bool:
    """Does a homography put trusted identities where they belong?"""
    r = residuals(bank, h, rows)
    return not len(r) or _passes(r, tol, bad_share)


def _passes(r: np.ndarray, tol: float, bad_share: float) -> bool:
    return bool((r > tol).mean() <= bad_share and np.median(r) <= tol)


def validated(bank: dict, h, rows: Mapping[str, np.ndarray], tol: float = 1.0, bad_share: float = 0.34) -> dict:
    """The check of a frame's homography as columns; nothing without a homography."""
    if h is None or not len(h):
        return {"n_checked": None, "n_bad": None, "median_residual": None, "valid": None}
    r = residuals(bank, np.array(h, dtype=float).reshape(3, 3), rows)
    return {"n_checked": len(r), "n_bad": int((r > tol).sum()), "median_residual": float(np.median(r)) if len(r) else None,
            "valid": not len(r) or _passes(r, tol, bad_share)}


@lru_cache(maxsize=10_000)
def _home(key: str) -> tuple[float, float]:
    """Where an identity belongs, in yards."""
    kind, slot = key.split("|")
    return 10.0 + 5 * int(slot), KIND_Y[kind]


def _picked(rows: Mapping[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in rows.items()}


def _present(rows: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The correspondences of a frame by corr_id: their identities, pixels and places."""
    ids = rows["corr_id"]
    order = np.array(sorted((i for i, x in enumerate(ids) if x is not None and x == x), key=ids.__getitem__), dtype=int)
    key = [_key(k, s) for k, s in zip(rows["kind"][order], rows["slot"][order])]
    pair = lambda a, b: np.column_stack([np.asarray(rows[a])[order], np.asarray(rows[b])[order]]).astype(float)
    return {"key": np.array(key, dtype=object), "at": pair("u", "v"), "place": pair("fx", "fy")}


def bank_step(state: dict, frame: int, rows: Mapping[str, np.ndarray]) -> list[dict]:
    h = next((x for x in rows["h"] if x is not None and not np.isscalar(x)), None) if "h" in rows else None
    bank, rows = state.setdefault("bank", {}), _present(rows)
    verdict = judge(bank, frame, rows)
    check = validated(bank, h, _picked(rows, verdict == "kept"))
    observe(bank, frame, _picked(rows, (verdict == "kept") | (verdict == "probationary")))
    count = lambda v: int((verdict == v).sum())
    return [{"n_input": len(verdict), "n_kept": count("kept"), "n_probationary": count("probationary"), "n_self": count("self"),
             "n_cross": count("cross"), "n_tracks": len(bank), "n_trusted": sum(t["n"] >= TRUST for t in bank.values()), **check}]


# --- homography chain --------------------------------------------------------

CHAIN_SCHEMA = "clip string, frame_idx int, h array<double>, method string, rmse double, n_corrs int, n_inliers int"

# Largest jump of a full solution, and the accept gates of a delta.
JUMP_YD, MAX_SCALE, MAX_ROT_DEG, MAX_SHIFT_PX = 2.0, 1.8, 3.0, 400.0
KEPT, PROBATIONARY, SELF, CROSS = range(4)


def _degenerate(dst: np.ndarray) -> bool:
    if len(dst) < 4:
        return True
    fullest = [np.unique(np.rint(dst[:, i] / 0.5), return_counts=True)[1].max() for i in (0, 1)]
    return len(dst) - max(fullest) < 2


def _delta(prev: np.ndarray, now: np.ndarray, places: np.ndarray) -> np.ndarray | None:
    """Previous homography moved by the similarity that carries its pixels to the new ones."""
    if len(now) < 2:
        return None
    try:
        was = mapped(np.linalg.inv(prev), places)
    except np.linalg.LinAlgError:
        return None
    fit = robust_similarity(was, now)
    if fit is None:
        return None
    c, s, *shift, _ = fit
    turn = np.array([[c, -s], [s, c]])
    scale, rot = math.hypot(c, s), math.degrees(math.atan2(s, c))
    if not (1 / MAX_SCALE <= scale <= MAX_SCALE) or abs(rot) > MAX_ROT_DEG or np.hypot(*shift) > MAX_SHIFT_PX:
        return None
    move = np.eye(3)
    move[:2, :2], move[:2, 2] = turn, shift
    return prev @ np.linalg.inv(move)


#: Frames judged at once by an unchanged bank, and their rows beyond the first frame, at most.
AHEAD, AHEAD_ROWS = 256, 4096


def chain_walk(state: dict, frames: list[int], starts: list[int], rows: Mapping[str, np.ndarray]) -> Iterator[dict]:
    """Homographies of a clip's next frames; frame i has the rows from starts[i] up to starts[i + 1].

    Only full and delta frames change the bank and the homography. Frames are therefore
    judged together, twice as many after each stretch without a change and one by one after
    a change; those with too few kept correspondences for any fit need nothing more."""
    there = _numbered_identities(rows)
    bank, edges = state.setdefault("bank", {}), np.searchsorted(there["row"], starts)
    prev = np.array(state["h"]).reshape(3, 3) if state.get("h") else None
    i, ahead = 0, 1
    while i < len(frames):
        lo, changed = edges[i], False
        stop = max(i + 1, min(i + ahead, len(frames), int(np.searchsorted(edges, lo + AHEAD_ROWS, side="right")) - 1))
        hi = edges[stop]
        counts = np.diff(edges[i:stop + 1])
        verdict = _judge_numbered(bank, np.repeat(frames[i:stop], counts), there["number"][lo:hi], there["at"][lo:hi], there["keys"])
        n_kept = np.add.reduceat(np.append(verdict == KEPT, False), edges[i:stop] - lo) * (counts > 0)
        for f, n, s, e in zip(frames[i:stop], n_kept.tolist(), edges[i:stop].tolist(), edges[i + 1:stop + 1].tolist(), strict=True):
            i += 1
            if n < (4 if prev is None else 2):
                yield {"h": state.get("h") or None, "method": "none" if prev is None else "carry", "rmse": None, "n_corrs": n, "n_inliers": 0 if prev is None else None}
                continue
            row, said = _by_id(there, s, e, verdict[s - lo:e - lo])
            h, out = _solve(bank, prev, f, row, said)
            yield out
            if out["method"] in ("full", "delta"):
                observe(bank, f, _picked(row, np.concatenate([np.flatnonzero(said == v) for v in (KEPT, PROBATIONARY)])))
                state["h"], prev, changed = out["h"], h, True
                break
        ahead = 1 if changed else min(2 * ahead, AHEAD)


def _solve(bank: dict, prev: np.ndarray | None, frame: int, rows: Mapping[str, np.ndarray], verdict: np.ndarray) -> tuple[np.ndarray | None, dict]:
    """The homography of one frame and its output row."""
    kept = _picked(rows, verdict == KEPT)
    src, dst = kept["at"], kept["place"]
    h, inlier, rmse, method = None, None, None, "none"
    if not _degenerate(dst):
        h, inlier = consensus_fit(src, dst, frame)
    if h is not None and prev is not None:
        jump = np.linalg.norm(mapped(h, src) - mapped(prev, src), axis=1).mean()
        if jump > JUMP_YD or not agrees(bank, h, kept):
            h = None
    if h is not None:
        method = "full"
        rmse = float(np.sqrt((np.linalg.norm(mapped(h, src) - dst, axis=1)[inlier] ** 2).mean()))
    elif prev is not None:
        h = _delta(prev, src, dst)
        method = "carry" if h is None else "delta"
        h = prev if h is None else h
    return h, {"h": None if h is None else h.ravel().tolist(), "method": method, "rmse": rmse, "n_corrs": len(src),
               "n_inliers": int(inlier.sum()) if method == "full" else (0 if method == "none" else None)}


def _numbered_identities(rows: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows with a corr_id, as arrays: row number, corr_id, identity number, pixel and
    place; ``names`` are the identities by number, ``keys`` their numbers by name."""
    row = np.flatnonzero(pd.notna(rows["corr_id"]))
    kind, kinds = pd.factorize(np.asarray(rows["kind"])[row], use_na_sentinel=False)
    slot, slots = pd.factorize(np.asarray(rows["slot"])[row], use_na_sentinel=False)
    pair = lambda a, b: np.column_stack([np.asarray(rows[a])[row], np.asarray(rows[b])[row]]).astype(float)
    names = [_key(k, s) for k in kinds for s in slots]
    return {"row": row, "corr_id": np.asarray(rows["corr_id"])[row], "number": kind * len(slots) + slot, "at": pair("u", "v"), "place": pair("fx", "fy"),
            "keys": {k: i for i, k in enumerate(names)}, "names": np.array(names, dtype=object)}


def _by_id(there: Mapping[str, np.ndarray], start: int, end: int, verdict: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One frame's rows and their verdicts in order of corr_id."""
    ids = there["corr_id"][start:end].tolist()
    order = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=int)
    at = start + order
    return {"key": there["names"][there["number"][at]], "at": there["at"][at], "place": there["place"][at]}, verdict[order]


def _judge_numbered(bank: dict, frames: np.ndarray, ids: np.ndarray, pixels: np.ndarray, keys: dict[str, int]) -> np.ndarray:
    """Verdict codes of rows of several frames against one bank, as ``judge`` finds them."""
    young, early, own = np.ones(len(keys), bool), np.zeros(len(keys), bool), np.full(len(keys), -1)
    trusted = []
    for k, t in bank.items():
        i = keys.get(k)
        if i is not None:
            young[i], early[i] = t["n"] < PROBATION, t["first"] < BOOTSTRAP
        if t["n"] >= TRUST:
            if i is not None:
                own[i] = len(trusted)
            trusted.append(t["at"])
    out = np.where(young[ids] & (frames >= BOOTSTRAP) & ~early[ids], PROBATIONARY, KEPT)
    if not trusted:
        return out
    owner, at = own[ids], np.array(trusted)
    u, v = (pixels[:, axis, None] - at[None, :, axis] for axis in (0, 1))
    near = np.sqrt(u * u + v * v)
    mine = np.flatnonzero(owner >= 0)
    out[mine[near[mine, owner[mine]] > SELF_PX]] = SELF
    near[mine, owner[mine]] = np.inf
    out[(near < CROSS_PX).any(axis=1)] = CROSS
    return out


# --- loss streak -------------------------------------------------------------

STREAK_SCHEMA = "clip string, frame_idx int, streak int, lost_from int"


def streak_step(state: dict, frame: int, rows: Mapping[str, np.ndarray], limit: int = 3) -> list[dict]:
    """Running count of carried frames; lost_from is set once the limit was reached."""
    state["streak"] = state.get("streak", 0) + 1 if rows["method"][0] == "carry" else 0
    if state.get("lost_from") is None and state["streak"] >= limit:
        state["lost_from"] = frame - limit + 1
    return [{"streak": state["streak"], "lost_from": state.get("lost_from")}]
