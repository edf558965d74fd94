"""Detectors that advance by the rows a watermark has passed; each holds bounded, typed state of one capture.

``advance(state, rows)`` takes time-ordered rows as arrays, returns the output frame and leaves ``state`` ready for the
next call. The batch forms of the same operators are windows (``operators.rest``, ``operators.frames``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from rushlight.functions import pixels
from rushlight.operators.frames import SELECT_BLURRY_BELOW, SELECT_CORRELATION, SELECT_MAX_DIFF
from rushlight.operators.motion import CONE_SAFETY, GRAVITY_ALPHA, MAX_STEP_NS, ORBIT_M_S2, RATE_WINDOW, REST_WINDOW, SWEEP_RAD_S
from rushlight.operators.rest import ACCEL_REST_M_S2, BIAS_ALPHA, GYRO_REST_RAD_S, MAX_TILT_DEG
from rushlight.operators.telemetry import ROLLING_WARMUP, ROLLING_WINDOW

STRIDE = 256  # rows smoothed by one product; old weights stay far from underflow over so many


def smoothed(start: np.ndarray, rows: np.ndarray, alpha: float) -> np.ndarray:
    """g = g + alpha * (x - g) along ``rows`` from ``start``, after every row."""
    out, keep = np.empty_like(rows), 1.0 - alpha
    for low in range(0, len(rows), STRIDE):
        part = rows[low : low + STRIDE]
        fade = keep ** np.arange(1, len(part) + 1)[:, None]
        out[low : low + STRIDE] = fade * (start + np.cumsum(alpha * part / fade, 0))
        start = out[low + len(part) - 1]
    return out


def gated(start: np.ndarray, rows: np.ndarray, alpha: float, within: float) -> np.ndarray:
    """As ``smoothed``, moved only by rows closer than ``within`` to the mean so far: guessed rows, until they are right."""
    moving = np.linalg.norm(rows - start, axis=1) < within
    while True:
        means = np.concatenate([start[None], smoothed(start, rows[moving], alpha)])[np.cumsum(moving)]
        before = np.concatenate([start[None], means[:-1]])
        right = np.linalg.norm(rows - before, axis=1) < within
        if (right == moving).all():
            return means
        moving = right


def last_known(first, values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The latest value up to each row; ``first`` before any."""
    at = np.cumsum(there)
    return np.concatenate([np.asarray([first], values.dtype), values[there]])[at]


def rolling_root(tail: list[float], values: np.ndarray, window: int) -> np.ndarray:
    """Root of the mean square of the last ``window`` values, ``tail`` being those before."""
    if not len(values):
        return np.zeros(0)
    squares = np.concatenate([np.asarray(tail, float), values]) ** 2
    size = np.minimum(np.arange(1, len(squares) + 1), window)
    padded = np.concatenate([np.zeros(window - 1), squares])
    return np.sqrt(np.lib.stride_tricks.sliding_window_view(padded, window).sum(1) / size)[len(tail) :]


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return rows[["x", "y", "z"]].to_numpy(float)


def _degrees_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = (a * b).sum(-1) / size
    return np.where(size > 0, np.degrees(np.arccos(np.clip(np.nan_to_num(cosine), -1, 1))), 0.0)


class Stillness:
    """Rest, tilt against the marked pose and disturbance, one row per gyro or accel sample."""

    time = "t_ns"
    out = (
        "t_ns long, gyro_rms double, accel_rms double, tilt_deg double, max_tilt_deg double, at_rest boolean, "
        "rest_for_ms long, disturbed boolean, residual_deg double"
    )
    state = (
        "bias array<double>, gravity array<double>, reference array<double>, gyro array<double>, accel array<double>, "
        "tilt double, max_tilt double, since long, disturbed boolean, residual double, last long"
    )

    def start(self) -> dict:
        return {"bias": [0.0] * 3, "gravity": None, "reference": None, "gyro": [], "accel": [], "tilt": 0.0,
                "max_tilt": 0.0, "since": None, "disturbed": False, "residual": 0.0, "last": None}

    def advance(self, s: dict, rows: pd.DataFrame) -> pd.DataFrame:
        sensor, t, v = rows["sensor"].to_numpy(str), rows["t_ns"].to_numpy(np.int64), _vectors(rows)
        accel = sensor == "accel"
        gravity = np.full((len(rows), 3), np.nan)  # known after each row
        if accel.any():
            seed = v[accel][0] if s["gravity"] is None else np.array(s["gravity"])
            after = smoothed(seed, v[accel], GRAVITY_ALPHA)
            gravity[accel] = after
        known = np.concatenate([[s["gravity"] or [np.nan] * 3], gravity[accel]])[np.cumsum(accel)]
        frozen = (sensor == "mark") & ~np.isnan(known[:, 0])
        span = np.cumsum(frozen)
        references = np.concatenate([[s["reference"] or [np.nan] * 3], known[frozen]])
        moved = sensor != "mark"
        made = self._judge(s, sensor[moved], t[moved], v[moved], gravity[moved], span[moved], references)
        if accel.any():
            s["gravity"] = gravity[accel][-1].tolist()
        return made

    def _judge(self, s: dict, sensor: np.ndarray, t: np.ndarray, v: np.ndarray, gravity: np.ndarray, span: np.ndarray, references: np.ndarray) -> pd.DataFrame:
        """One row per sample; only what begins anew with each pose goes pose by pose."""
        gyro, accel = sensor == "gyro", sensor == "accel"
        turn, free = v[gyro], 0 if s["reference"] is not None else int((span[gyro] == 0).sum())
        if free:
            moving = gated(np.array(s["bias"]), turn[:free], BIAS_ALPHA, 2 * GYRO_REST_RAD_S)
            s["bias"] = moving[-1].tolist()
        bias = np.concatenate([moving, np.broadcast_to(s["bias"], turn[free:].shape)]) if free else np.broadcast_to(s["bias"], turn.shape)
        speed = np.linalg.norm(turn - bias, axis=1)
        shake = np.abs(np.linalg.norm(v[accel], axis=1) - np.linalg.norm(gravity[accel], axis=1))
        spread = {}
        for name, one, values in (("gyro", gyro, speed), ("accel", accel, shake)):
            roots = rolling_root(s[name], values, REST_WINDOW)
            first = rolling_root([], np.array(s[name]), REST_WINDOW)[-1] if s[name] else np.nan
            spread[name] = np.concatenate([[first], roots])[np.cumsum(one)]
            s[name] = [*s[name], *values.tolist()][-REST_WINDOW:]
        quiet = (spread["gyro"] < GYRO_REST_RAD_S) & (spread["accel"] < ACCEL_REST_M_S2)
        tilt, most = np.zeros(len(t)), np.zeros(len(t))
        upset, residual = np.zeros(len(t), bool), np.zeros(len(t))
        against, of = np.zeros(len(t)), np.zeros(len(t))
        against[accel] = _degrees_between(gravity[accel], references[span[accel]])
        of[gyro] = speed
        bounds = np.searchsorted(span, np.arange(len(references) + 1)).tolist()
        for at, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if at:
                s.update(reference=references[at].tolist(), tilt=0.0, max_tilt=0.0, disturbed=False, residual=0.0, last=None)
            if s["reference"] is None or low == high:
                continue
            own, turns = accel[low:high], gyro[low:high]
            part = tilt[low:high] = np.concatenate([[s["tilt"]], against[low:high][own]])[np.cumsum(own)]
            most[low:high] = np.maximum(np.maximum.accumulate(part), s["max_tilt"])
            upset[low:high] = np.logical_or.accumulate(~quiet[low:high] | (own & (part > MAX_TILT_DEG))) | s["disturbed"]
            times = t[low:high][turns]
            if len(times):
                before = np.concatenate([[times[0] if s["last"] is None else s["last"]], times[:-1]])
                step = times - before
                grown = np.where((step > 0) & (step <= MAX_STEP_NS), of[low:high][turns] * step / 1e9, 0.0)
                residual[low:high] = s["residual"] + np.concatenate([[0.0], np.cumsum(grown)])[np.cumsum(turns)]
                s["last"] = int(times[-1])
            else:
                residual[low:high] = s["residual"]
            s.update(tilt=float(part[-1]), max_tilt=float(most[high - 1]), disturbed=bool(upset[high - 1]), residual=float(residual[high - 1]))
        if not len(t):
            return pd.DataFrame()
        opened = quiet & ~np.concatenate([[s["since"] is not None], quiet[:-1]])
        since = last_known(s["since"] or 0, t, opened)
        s["since"] = int(since[-1]) if quiet[-1] else None
        rest = np.where(quiet, (t - since) // 1_000_000, 0)
        return pd.DataFrame(
            {"t_ns": t, "gyro_rms": np.nan_to_num(spread["gyro"]), "accel_rms": np.nan_to_num(spread["accel"]), "tilt_deg": tilt,
             "max_tilt_deg": most, "at_rest": quiet, "rest_for_ms": rest, "disturbed": upset, "residual_deg": np.degrees(residual)}
        )


class Sweep:
    """Heading and sides swept so far, one row per gyro sample. Rotation rows hold a rotation vector."""

    time = "t_ns"
    out = (
        "t_ns long, heading_deg double, left_deg double, right_deg double, swept_deg double, implied_cone_deg double, "
        "orbit_samples long, pan_samples long, orbit_likely boolean"
    )
    state = "low array<double>, pointed array<double>, last long, heading double, least double, most double, orbit long, pan long"

    def __init__(self, max_step: int = MAX_STEP_NS):
        self.max_step = max_step

    def start(self) -> dict:
        return {"low": None, "pointed": None, "last": None, "heading": 0.0, "least": 0.0, "most": 0.0, "orbit": 0, "pan": 0}

    def advance(self, s: dict, rows: pd.DataFrame) -> pd.DataFrame:
        sensor, t, v = rows["sensor"].to_numpy(str), rows["t_ns"].to_numpy(np.int64), _vectors(rows)
        turned, accel, gyro = sensor == "rotation", sensor == "accel", sensor == "gyro"
        none = [np.nan] * 3
        low = smoothed(np.array(s["low"] or (v[accel][0] if accel.any() else none)), v[accel], GRAVITY_ALPHA)
        lows = np.concatenate([[s["low"] or none], low])[np.cumsum(accel)]
        x, y, z = v[turned].T
        w = np.sqrt(np.maximum(1 - (x * x + y * y + z * z), 0.0))
        down = -np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3)
        length = np.linalg.norm(down, axis=1)
        sound = turned.copy()
        sound[turned] = length > 0
        points = np.concatenate([[s["pointed"] or none], (down / np.where(length > 0, length, 1)[:, None])[length > 0]])[np.cumsum(sound)]
        measured = ~np.isnan(points[:, 0])
        size = np.linalg.norm(lows, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            gravity = np.where(measured[:, None], points, np.where((size > 0)[:, None], -lows / size[:, None], np.nan))
        along = (v * gravity).sum(1)
        across = np.linalg.norm(v - along[:, None] * gravity, axis=1)
        orbit = s["orbit"] + np.cumsum(accel & measured & (across > ORBIT_M_S2))
        pan = s["pan"] + np.cumsum(accel & measured & (across <= ORBIT_M_S2))
        times = t[gyro]
        before = np.concatenate([[s["last"] if s["last"] is not None else times[0] if len(times) else 0], times[:-1]])[: len(times)]
        step = times - before
        with np.errstate(invalid="ignore"):
            sweeping = (step > 0) & (step <= self.max_step) & (np.abs(along[gyro]) >= SWEEP_RAD_S)
        heading = s["heading"] + np.cumsum(np.where(sweeping, along[gyro] * step / 1e9, 0.0))
        least = np.minimum(np.minimum.accumulate(heading), s["least"]) if len(heading) else heading
        most = np.maximum(np.maximum.accumulate(heading), s["most"]) if len(heading) else heading
        s.update(low=lows[-1].tolist() if size[-1] == size[-1] else None, pointed=points[-1].tolist() if measured[-1] else None,
                 orbit=int(orbit[-1]), pan=int(pan[-1]))
        if len(times):
            s.update(last=int(times[-1]), heading=float(heading[-1]), least=float(least[-1]), most=float(most[-1]))
        left, right = np.degrees(most), np.degrees(-least)
        return pd.DataFrame(
            {"t_ns": times, "heading_deg": -np.degrees(heading), "left_deg": left, "right_deg": right, "swept_deg": left + right,
             "implied_cone_deg": np.minimum(left, right) * CONE_SAFETY, "orbit_samples": orbit[gyro], "pan_samples": pan[gyro],
             "orbit_likely": ~measured[gyro] | (orbit > pan)[gyro]}
        )


class Locks:
    """The first deviation of each kind, with the exposures checked and matched by then."""

    time = "t_ns"
    out = "t_ns long, kind string, detail string, checked long, matched long"
    state = "physical_id string, crop string, seen array<string>, checked long, matched long"

    def start(self) -> dict:
        return {"physical_id": None, "crop": None, "seen": [], "checked": 0, "matched": 0}

    def advance(self, s: dict, rows: pd.DataFrame) -> pd.DataFrame:
        exposure, wanted = rows["exposure_ns"], rows["requested_ns"]
        checked = (exposure.notna() & wanted.notna()).to_numpy(bool)
        got, asked = (c.fillna(0).to_numpy(np.int64) for c in (exposure, wanted))
        drift = checked & (np.abs(got - asked) > asked // 50)
        n, m = s["checked"] + np.cumsum(checked), s["matched"] + np.cumsum(checked & ~drift)
        tests, details = {}, {}
        for kind, column in (("lens_switch", "physical_id"), ("crop_changed", "crop")):
            values, there = rows[column].to_numpy(object), rows[column].notna().to_numpy()
            if s[column] is None and there.any():
                s[column] = str(values[there.argmax()])
            tests[kind] = there & (values != s[column])
            details[kind] = lambda i, column=column, values=values: f"{s[column]} -> {values[i]}"
        manual = rows["awb_manual"].to_numpy(object)
        tests |= {"exposure_drift": drift, "awb_not_manual": np.equal(manual, False).astype(bool)}
        details |= {"exposure_drift": lambda i: f"requested {asked[i]} ns, got {got[i]}", "awb_not_manual": lambda i: "requested OFF"}
        found = []
        for kind in sorted(set(tests) - set(s["seen"])):
            if tests[kind].any():
                i = int(tests[kind].argmax())
                own = (checked[i], checked[i] and not drift[i]) if kind == "lens_switch" else (0, 0)
                found.append((int(rows["t_ns"].iloc[i]), kind, details[kind](i), int(n[i] - own[0]), int(m[i] - own[1])))
                s["seen"] = [*s["seen"], kind]
        s.update(checked=int(n[-1]), matched=int(m[-1]))
        return pd.DataFrame(found, columns=["t_ns", "kind", "detail", "checked", "matched"])


class Rate:
    """Mean of the last angular speeds and the smear it predicts."""

    time = "t_ns"
    out = "t_ns long, angular_rate double, blur_px double"
    state = "speeds array<double>"

    def start(self) -> dict:
        return {"speeds": []}

    def advance(self, s: dict, rows: pd.DataFrame) -> pd.DataFrame:
        speeds = np.concatenate([s["speeds"], rows["speed"].to_numpy(float)])
        size = np.minimum(np.arange(1, len(speeds) + 1), RATE_WINDOW)
        padded = np.concatenate([np.zeros(RATE_WINDOW - 1), speeds])
        rate = (np.lib.stride_tricks.sliding_window_view(padded, RATE_WINDOW).sum(1) / size)[len(s["speeds"]) :]
        s["speeds"] = speeds[-(RATE_WINDOW - 1) :].tolist()
        exposure, focal = rows["exposure_s"].to_numpy(float), rows["focal_px"].to_numpy(float)
        smear = np.where((exposure > 0) & (focal > 0), np.abs(rate) * exposure * focal, 0.0)
        return pd.DataFrame({"t_ns": rows["t_ns"].to_numpy(), "angular_rate": rate, "blur_px": smear})


class Select:
    """Online frame selection on grey planes: blurred, duplicate of the last kept frame, or kept."""

    time = "frame"
    out = (
        "frame long, blur_vol double, blur_relative double, motion_diff double, hist_correlation double, blurred boolean, "
        "duplicate boolean, kept boolean"
    )
    state = "vols array<double>, gray binary, height int, width int"

    def __init__(self, blur: float = SELECT_BLURRY_BELOW, correlation: float = SELECT_CORRELATION, max_diff: float = SELECT_MAX_DIFF):
        self.blur, self.correlation, self.max_diff = blur, correlation, max_diff

    def start(self) -> dict:
        return {"vols": [], "gray": None, "height": None, "width": None}

    def advance(self, s: dict, rows: pd.DataFrame) -> pd.DataFrame:
        images = [pixels.as_image(*one) for one in zip(rows["gray"], rows["height"], rows["width"])]
        vols = np.array([pixels.laplacian_variance(i) for i in images])
        every = pd.Series([*s["vols"], *vols])
        median = every.rolling(ROLLING_WINDOW, min_periods=1).median().to_numpy()[len(s["vols"]) :]
        ready = np.minimum(len(s["vols"]) + np.arange(1, len(vols) + 1), ROLLING_WINDOW) >= ROLLING_WARMUP
        relative = np.where(ready & (median > 0), vols / np.where(median > 0, median, 1), 1.0)
        blurred = ready & (relative < self.blur)
        s["vols"] = every.tolist()[-(ROLLING_WINDOW - 1) :]
        last = None if s["gray"] is None else pixels.as_image(s["gray"], s["height"], s["width"])
        motion, alike, kept = np.full(len(images), np.nan), np.full(len(images), np.nan), np.zeros(len(images), bool)
        for i, image in enumerate(images):
            if last is not None:
                alike[i] = pixels.correlation(pixels.histogram(image), pixels.histogram(last))
                motion[i] = pixels.mean_difference(image, last) if image.shape == last.shape else np.nan
            kept[i] = not blurred[i] and not (alike[i] > self.correlation and motion[i] < self.max_diff)
            last = image if kept[i] else last
        if last is not None:
            s.update(gray=last.tobytes(), height=last.shape[0], width=last.shape[1])
        return pd.DataFrame(
            {"frame": rows["frame"], "blur_vol": vols, "blur_relative": relative, "motion_diff": motion, "hist_correlation": alike,
             "blurred": blurred, "duplicate": ~blurred & ~kept, "kept": kept}
        )


DETECTORS = {"stillness": Stillness, "sweep": Sweep, "locks": Locks, "rate": Rate, "select": Select}
