"""Training on the driver's small parameters, with data and gradients as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.camera import Camera
from voxloom.functions import spherical
from voxloom.lineage import cut
from voxloom.operators import raster, splats

Arrays = dict[str, np.ndarray]


@dataclass
class Optimizer:
    """Gradient descent: ``sgd`` (with momentum), ``adam`` or ``adamw`` (decay apart from the gradient)."""

    parameters: Arrays
    kind: str = "adam"
    rate: float = 1e-3
    momentum: float = 0.0
    decay: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    steps: int = 0
    first: Arrays = field(default_factory=dict)
    second: Arrays = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("sgd", "adam", "adamw"):
            raise ValueError(f"no optimiser {self.kind!r}")

    def step(self, gradients: Arrays) -> None:
        self.steps += 1
        for name, g in gradients.items():
            p = self.parameters[name]
            if self.decay and self.kind == "adamw":
                p -= self.rate * self.decay * p
            elif self.decay:
                g = g + self.decay * p
            m = self.first.setdefault(name, np.zeros_like(p))
            if self.kind == "sgd":
                m[...] = self.momentum * m + g
                p -= self.rate * m
                continue
            s = self.second.setdefault(name, np.zeros_like(p))
            a, b = self.betas
            m[...] = a * m + (1 - a) * g
            s[...] = b * s + (1 - b) * g * g
            p -= self.rate * (m / (1 - a**self.steps)) / (np.sqrt(s / (1 - b**self.steps)) + self.eps)


@dataclass
class Accumulator:
    """Steps once for every ``n`` gradients, with their mean."""

    optimizer: Optimizer
    n: int
    held: Arrays = field(default_factory=dict)
    count: int = 0

    def add(self, gradients: Arrays) -> bool:
        for name, g in gradients.items():
            self.held[name] = self.held.get(name, 0) + g / self.n
        self.count += 1
        return self.flush() if self.count >= self.n else False

    def flush(self) -> bool:
        """Steps with what is held, if anything."""
        if not self.count:
            return False
        self.optimizer.step(self.held)
        self.reset()
        return True

    def reset(self) -> None:
        self.held, self.count = {}, 0


@dataclass
class StepDecay:
    """Multiplies the rate by ``gamma`` every ``every`` epochs."""

    optimizer: Optimizer
    every: int
    gamma: float = 0.1
    epoch: int = 0

    def step(self) -> float:
        self.epoch += 1
        if self.epoch % self.every == 0:
            self.optimizer.rate *= self.gamma
        return self.optimizer.rate


def batches(samples: DataFrame, size: int, sample: str = "sample", seed: int | None = None) -> Iterator[DataFrame]:
    """Whole samples in lots of ``size``, in order or shuffled by ``seed``; the driver holds sample ids only."""
    ids = sorted(r[0] for r in samples.select(sample).distinct().collect())
    if seed is not None:
        np.random.default_rng(seed).shuffle(ids)
    for at in range(0, len(ids), size):
        yield samples.filter(F.col(sample).isin(ids[at : at + size]))


def train_epoch(step: Callable[[DataFrame], tuple[float, Arrays]], data: Iterable[DataFrame], optimizer: Optimizer | Accumulator) -> float:
    """Mean loss over an epoch; ``step`` gives the loss and the gradients of a batch."""
    losses = []
    for batch in data:
        loss, gradients = step(batch)
        (optimizer.add if isinstance(optimizer, Accumulator) else optimizer.step)(gradients)
        losses.append(loss)
    if isinstance(optimizer, Accumulator):
        optimizer.flush()
    return float(np.mean(losses)) if losses else 0.0


def evaluate(loss: Callable[[DataFrame], float], data: Iterable[DataFrame]) -> float:
    values = [loss(b) for b in data]
    return float(np.mean(values)) if values else 0.0


# -- Gaussians

_RAW = ("px", "py", "pz", "dc0", "dc1", "dc2", "opacity_raw", "sx", "sy", "sz", "qw", "qx", "qy", "qz")


def _screen(x: np.ndarray, camera: Camera) -> np.ndarray:
    """[rows, 6]: u, v, ka, kb, kc, depth of raw columns px..pz, sx..sz, qw..qz."""
    p, s, q = x[:, :3], np.exp(x[:, 3:6]), x[:, 6:]
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    w, a, b, c = q.T
    r = np.stack([1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b), 2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a), 2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)], 1).reshape(-1, 3, 3)
    cam = p @ camera.rotation.T + camera.translation
    z = np.maximum(cam[:, 2], camera.near)
    t = cam[:, :2] / z[:, None]
    bound = np.array([0.65 * camera.width / camera.fx, 0.65 * camera.height / camera.fy])
    clipped = np.clip(t, -bound, bound)
    j = np.zeros((len(x), 2, 3))
    j[:, 0, 0], j[:, 1, 1] = camera.fx / z, camera.fy / z
    j[:, 0, 2], j[:, 1, 2] = -camera.fx * clipped[:, 0] / z, -camera.fy * clipped[:, 1] / z
    m = j @ camera.rotation @ (r * s[:, None, :])
    cov = m @ m.transpose(0, 2, 1) + raster.LOW_PASS * np.eye(2)
    det = np.maximum(cov[:, 0, 0] * cov[:, 1, 1] - cov[:, 0, 1] ** 2, 1e-12)
    return np.stack([camera.fx * t[:, 0] + camera.cx, camera.fy * t[:, 1] + camera.cy, cov[:, 1, 1] / det, -cov[:, 0, 1] / det, cov[:, 0, 0] / det, cam[:, 2]], 1)


def _basis(p: np.ndarray, eye: np.ndarray, degree: int) -> np.ndarray:
    """[rows, coefficients]: the harmonics in the direction from ``eye`` to each place."""
    d = p - eye
    x, y, z = (d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)).T
    return np.stack([np.full(len(p), spherical.C0), *spherical.directed(x, y, z, degree)], 1)


def project_backward(raw: DataFrame, screen_grads: DataFrame, camera: Camera, step: float = 1e-5, degree: int = 0) -> DataFrame:
    """Gradients g_<column> of a raw table from those of its screen attributes, and ``g_screen``, the norm on the screen.

    The projection maps each row by itself, so its Jacobian is taken by central differences on ten parameters, for
    batches of rows at once; so is that of the colour's direction. Coefficients and opacities have closed forms. A
    channel below 0, which is shown as 0, passes nothing on. ``g_rest`` has the shape of ``rest``, 0 above ``degree``.
    """
    names = ("gu", "gv", "gka", "gkb", "gkc", "gdepth", "gopacity", "gr", "gg", "gb")
    geometry = ("px", "py", "pz", "sx", "sy", "sz", "qw", "qx", "qy", "qz")
    most = spherical.coefficients(degree) - 1
    joined = raw.select("gid", *_RAW, "rest").join(screen_grads.select("gid", *names), "gid")

    def run(parts):
        import pandas as pd

        for pdf in parts:
            x, g = pdf[list(geometry)].to_numpy(float), pdf[list(names[:6])].to_numpy(float)
            out = {"gid": pdf["gid"]}
            for k, name in enumerate(geometry):
                move = np.zeros(x.shape[1])
                move[k] = step
                out[f"g_{name}"] = ((_screen(x + move, camera) - _screen(x - move, camera)) / (2 * step) * g).sum(1)
            p = 1 / (1 + np.exp(-pdf["opacity_raw"].to_numpy(float)))
            out["g_opacity_raw"] = pdf["gopacity"] * p * (1 - p)
            eye, place = np.asarray(camera.position, float), x[:, :3]
            held = [np.array([list(k) for k in r], float).reshape(-1, 3) if r is not None else np.zeros((0, 3)) for r in pdf["rest"]]
            sh = np.zeros((len(pdf), most + 1, 3))
            sh[:, 0] = pdf[["dc0", "dc1", "dc2"]].to_numpy(float)
            for row, r in zip(sh, held, strict=True):
                row[1 : 1 + len(r)] = r[:most]
            shown = lambda at: np.einsum("nk,nkc->nc", _basis(at, eye, degree), sh) + 0.5
            colour = pdf[["gr", "gg", "gb"]].to_numpy(float) * (shown(place) >= 0)
            for k, name in enumerate(geometry[:3]):
                move = np.zeros(3)
                move[k] = step
                out[f"g_{name}"] += ((shown(place + move) - shown(place - move)) / (2 * step) * colour).sum(1)
            by = _basis(place, eye, degree)[:, :, None] * colour[:, None, :]
            out |= {f"g_dc{i}": by[:, 0, i] for i in range(3)}
            out["g_rest"] = [[(by[i, k + 1] if k < most else np.zeros(3)).tolist() for k in range(len(r))] for i, r in enumerate(held)]
            out["g_screen"] = np.hypot(g[:, 0] * camera.width / 2, g[:, 1] * camera.height / 2)
            yield pd.DataFrame(out)

    schema = "gid long, " + ", ".join(f"g_{n} double" for n in (*geometry, "opacity_raw", "dc0", "dc1", "dc2", "screen")) + ", g_rest array<array<double>>"
    return joined.mapInPandas(run, schema)


_BETAS = (0.9, 0.999)


def _first_moment(m: Column, g: Column) -> Column:
    return _BETAS[0] * m + (1 - _BETAS[0]) * g


def _second_moment(m: Column, g: Column) -> Column:
    return _BETAS[1] * m + (1 - _BETAS[1]) * g * g


def _adam_change(m1: Column, m2: Column, rate: float, t: int, eps: float = 1e-15) -> Column:
    return rate * (m1 / (1 - _BETAS[0] ** t)) / (F.sqrt(m2 / (1 - _BETAS[1] ** t)) + eps)


def _adam(c: str, g: Column, rate: float, t: int, eps: float = 1e-15) -> dict[str, Column]:
    """Column ``c`` and its moments after a step by ``g``."""
    m1, m2 = _first_moment(F.col(f"m1_{c}"), g), _second_moment(F.col(f"m2_{c}"), g)
    return {f"m1_{c}": m1, f"m2_{c}": m2, c: F.col(c) - _adam_change(m1, m2, rate, t, eps)}


#: Rates by the first letter of a column: places, colours, further harmonics, opacities, scales, rotations.
_RATES = {"p": 1.6e-4, "d": 2.5e-3, "r": 1.25e-4, "o": 0.05, "s": 5e-3, "q": 1e-3}


@dataclass
class SplatTrainer:
    """Fits a raw table to images. Moments of Adam and statistics are columns beside the parameters.

    The rate of places is that of ``rates`` times the extent and falls exponentially to ``last_rate`` over
    ``decay_steps``. With ``densify``, every ``densify_every`` steps between ``densify_after`` and ``densify_until`` rows are
    added and dropped, and every ``reset_every`` steps until then opacities are reset.
    """

    raw: DataFrame
    rates: dict[str, float] = field(default_factory=dict)
    extent: float = 1.0
    ssim_weight: float = 0.2
    densify: bool = True
    densify_after: int = 500
    densify_every: int = 100
    densify_until: int = 15000
    reset_every: int = 3000
    densify_from: float = 2e-4
    percent_dense: float = 0.01
    least_opacity: float = 0.005
    most_scale: float = 0.1
    most: int = 0
    last_rate: float = 1.6e-6
    decay_steps: int = 30000
    degree_every: int = 1000
    most_degree: int = 0
    steps: int = 0

    def __post_init__(self) -> None:
        if not self.extent > 0:
            raise ValueError("the extent of the scene must be positive")
        zeros = {f"{m}_{c}": F.lit(0.0) for m in ("m1", "m2") for c in _RAW} | {"seen_sum": F.lit(0.0), "seen": F.lit(0.0)}
        self.rates = _RATES | self.rates
        rest = F.coalesce("rest", F.array().cast("array<array<double>>"))
        none = F.transform(rest, lambda k: F.transform(k, lambda c: c * 0))
        self.raw = self.raw.select("gid", *_RAW, rest.alias("rest")).withColumns(zeros | {"m1_rest": none, "m2_rest": none})

    @property
    def degree(self) -> int:
        """Harmonics come in one degree after the other, or all at once."""
        return min(self.steps // self.degree_every, self.most_degree) if self.degree_every > 0 else self.most_degree

    def rate(self, column: str) -> float:
        """The rate of a column in the step that comes next."""
        first = self.rates[column[0]]
        if column[0] != "p":
            return first
        t = min(1.0, self.steps / self.decay_steps) if self.decay_steps > 0 else 1.0
        return self.extent * first ** (1 - t) * self.last_rate**t

    def render_image(self, camera: Camera, background=(0.0, 0.0, 0.0)) -> DataFrame:
        return raster.render_raw(self.raw, camera, self.degree, background)

    def step(self, camera: Camera, target: DataFrame, background=(0.0, 0.0, 0.0)) -> float:
        """One step on the weighted sum of mean absolute difference and lack of similarity to ``target`` (x, y, r, g, b).

        Returns that sum; then rows are added, dropped and reset where the schedule says so.
        """
        degree, weight = self.degree, self.ssim_weight
        seen = splats.view_colour(self.raw, camera.position.tolist(), degree)
        frags = raster.fragments(raster.project(seen, camera), camera).persist()
        image = raster.composite(frags, camera, background).persist()
        both = image.join(target.select("x", "y", *(F.col(c).alias(f"t_{c}") for c in "rgb")), ["x", "y"]).persist()
        n = camera.width * camera.height * 3
        loss = both.agg(sum((F.sum(F.abs(F.col(c) - F.col(f"t_{c}"))) for c in "rgb"), F.lit(0.0)) / n).first()[0]
        slopes = {c: F.signum(F.col(c) - F.col(f"t_{c}")) / n for c in "rgb"}
        grad = both
        if weight:
            loss = (1 - weight) * loss + weight * (1 - raster.ssim(image, target).first()[0])
            similar = raster.ssim_backward(image, target, camera.width * camera.height)
            grad = both.join(similar, ["x", "y"])
            slopes = {c: (1 - weight) * s - weight * F.col(f"g{c}") for c, s in slopes.items()}
        grad = grad.select("x", "y", *(s.alias(f"g{c}") for c, s in slopes.items()), F.lit(0.0).alias("gdepth"), F.lit(0.0).alias("galpha"))
        self._adam(project_backward(self.raw, raster.composite_backward(frags, grad, background), camera, degree=degree))
        for df in (both, image, frags):
            df.unpersist()
        self._follow_schedule()
        return float(loss)

    def _follow_schedule(self) -> None:
        due = lambda every: self.densify and every > 0 and self.steps < self.densify_until and self.steps % every == 0
        if due(self.densify_every) and self.steps > self.densify_after:
            self.densify_and_prune(self.steps)
        if due(self.reset_every):
            self.reset_opacity()

    def _adam(self, grads: DataFrame) -> None:
        """One step of Adam for all rows; those without a gradient have 0."""
        rates = {c: self.rate(c) for c in (*_RAW, "rest")}
        self.steps += 1
        j = self.raw.join(grads, "gid", "left")
        each = lambda f, x, y: F.zip_with(x, y, lambda u, v: F.zip_with(u, v, f))
        cols = {}
        for c in _RAW:
            g = F.coalesce(f"g_{c}", F.lit(0.0))
            cols |= _adam(c, g, rates[c], self.steps)
        g = F.coalesce("g_rest", F.transform("rest", lambda k: F.transform(k, lambda c: c * 0)))
        m1, m2 = each(_first_moment, F.col("m1_rest"), g), each(_second_moment, F.col("m2_rest"), g)
        change = each(lambda u, v: _adam_change(u, v, rates["rest"], self.steps), m1, m2)
        cols |= {"m1_rest": m1, "m2_rest": m2, "rest": each(lambda p, d: p - d, F.col("rest"), change)}
        hit = F.col("g_screen").isNotNull()
        cols |= {"seen_sum": F.col("seen_sum") + F.coalesce("g_screen", F.lit(0.0)), "seen": F.col("seen") + hit.cast("double")}
        self._set(j.withColumns(cols).select(*self.raw.columns))

    def _set(self, df: DataFrame) -> None:
        """Cuts the lineage, which would grow with every step, by a table in the checkpoint folder."""
        self.raw = cut(df)

    def densify_and_prune(self, seed: int = 0) -> tuple[int, int]:
        """Clones small and splits large Gaussians whose mean screen gradient is high; drops faint and huge ones.

        A split makes two from samples of the parent, 1.6 times smaller. Nothing is added beyond ``most`` and nothing
        dropped if all would go. Returns the numbers of added and removed rows.
        """
        size = F.exp(F.greatest("sx", "sy", "sz"))
        chosen = F.col("seen_sum") / F.greatest(F.col("seen"), F.lit(1.0)) >= self.densify_from
        large = size > self.percent_dense * self.extent
        drop = (1 / (1 + F.exp(-F.col("opacity_raw"))) < self.least_opacity) | (size > self.most_scale * self.extent)
        c = self.raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen & ~large).alias("clones"), F.count_if(chosen & large).alias("splits"), F.max("gid").alias("top")).first()
        grow = not (self.most and c.n + c.clones + 2 * c.splits > self.most)
        split = (chosen & large) if grow else F.lit(False)
        fresh = {x: F.lit(0.0) if kind == "double" else F.transform(x, lambda k: F.transform(k, lambda c: c * 0)) for x, kind in self.raw.dtypes if x.startswith(("m1_", "m2_", "seen"))}
        kept = self.raw.filter(~(drop | split)).withColumns({"seen_sum": F.lit(0.0), "seen": F.lit(0.0)})
        added = None
        if grow:
            clones = self.raw.filter(chosen & ~large).withColumns(fresh)
            active = splats.activate(self.raw.filter(split))
            spots = splats.sample(active, 2, seed)
            twins = self.raw.filter(split).join(spots, "gid").withColumns({"px": F.col("x"), "py": F.col("y"), "pz": F.col("z")} | {s: F.col(s) - float(np.log(1.6)) for s in ("sx", "sy", "sz")} | fresh).select(*self.raw.columns)
            added = clones.unionByName(twins).withColumn("gid", F.lit((c.top or 0) + 1) + F.monotonically_increasing_id())
        after = kept if added is None else kept.unionByName(added)
        if not after.limit(1).count():
            return 0, 0
        more = (c.clones + 2 * c.splits) if grow else 0
        self._set(after)
        return more, c.n + more - self.raw.count()

    def reset_opacity(self) -> None:
        """Opacities over 0.01 go down to it."""
        self._set(self.raw.withColumns({"opacity_raw": F.least(F.col("opacity_raw"), F.lit(float(np.log(0.01 / 0.99)))), "m1_opacity_raw": F.lit(0.0), "m2_opacity_raw": F.lit(0.0)}))


@dataclass
class SplatOptimizer:
    """Adam on all numeric columns of an activated table; scales and opacities keep their bounds."""

    gaussians: DataFrame
    learning_rate: float = 1e-3
    steps: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.learning_rate < float("inf"):
            raise ValueError("the learning rate must be finite and positive")
        if not self.gaussians.limit(1).count():
            raise ValueError("there are no Gaussians to optimise")
        self.columns = [c for c, kind in self.gaussians.dtypes if kind == "double"]
        self.state = self.gaussians.withColumns({f"{m}_{c}": F.lit(0.0) for m in ("m1", "m2") for c in self.columns})

    def step(self, gradients: DataFrame) -> None:
        """One step by a table (gid, g_<column>, ...); columns and rows without a gradient have 0."""
        self.steps += 1
        have = [c for c in self.columns if f"g_{c}" in gradients.columns]
        j = self.state.join(gradients.select("gid", *(f"g_{c}" for c in have)), "gid", "left")
        cols = {}
        for c in have:
            cols |= _adam(c, F.coalesce(f"g_{c}", F.lit(0.0)), self.learning_rate, self.steps, 1e-8)
        self.state = cut(splats.project_constraints(j.withColumns(cols)).select(*self.state.columns))
        self.gaussians = self.state.select(*self.gaussians.columns)


def objective(gaussians: DataFrame, predicted: DataFrame, target: DataFrame, opacity_weight: float = 0.0, scale_weight: float = 0.0) -> float:
    """Mean squared colour difference plus weighted regularisers of an activated table."""
    if not (0 <= opacity_weight < float("inf") and 0 <= scale_weight < float("inf")):
        raise ValueError("weights must be finite and not negative")
    both = predicted.join(target.select("x", "y", *(F.col(c).alias(f"t_{c}") for c in "rgb")), ["x", "y"])
    loss = both.agg(F.avg(sum(((F.col(c) - F.col(f"t_{c}")) * (F.col(c) - F.col(f"t_{c}")) for c in "rgb"), F.lit(0.0)) / 3)).first()[0]
    logs = sum((F.pow(F.log(F.greatest(F.col(s), F.lit(1e-8))), F.lit(2)) for s in splats.S), F.lit(0.0)) / 3
    r = gaussians.agg(F.avg(F.col("opacity") * F.col("opacity")), F.avg(logs)).first()
    if r[0] is None:
        raise ValueError("the regularisers need at least one Gaussian")
    return float(loss + opacity_weight * r[0] + scale_weight * r[1])
