"""Singular spectrum analysis of many series at once.

A model names the columns of a long DataFrame and the options of the fit; it is immutable and holds
no result. Each operation is one shuffle by key and one kernel call per series, system or field, so
the unit that must fit a worker is a series. Columns other than those named are pruned before.
"""

from __future__ import annotations

import json
import warnings
import zlib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from lagweave.kernels import decompose as D
from lagweave.kernels import forecast as P
from lagweave.kernels import gaps as G
from lagweave.kernels import nested as N
from lagweave.kernels.trajectory import Block, Trajectory
from lagweave.operators import relational
from lagweave.plans.capabilities import ALLOWED, NotCapable, capable, require

Groups = Mapping[str, Iterable[int]] | Iterable[Iterable[int]] | None


def named(groups: Groups, count: int) -> dict[str, list[int]]:
    """Groups by name; unnamed ones are F1, F2 and so on; by default one for each triple."""
    if groups is None:
        groups = [[i] for i in range(1, count + 1)]
    if isinstance(groups, Mapping):
        return {str(k): [int(i) for i in v] for k, v in groups.items()}
    return {f"F{n}": [int(i) for i in g] for n, g in enumerate(groups, 1)}


def plain_json(x):
    if isinstance(x, np.ndarray):
        return {"__array__": x.tolist(), "kind": str(x.dtype)}
    if isinstance(x, np.generic):
        return x.item()
    raise TypeError(f"a model with {type(x).__name__} in its options cannot be saved")


def from_json(x: dict):
    return np.array(x["__array__"], x["kind"]) if "__array__" in x else x


def highest(groups: Groups) -> int:
    """The largest triple that groups name, 0 for none."""
    return 0 if groups is None else max((i for g in named(groups, 0).values() for i in g), default=0)


@dataclass(frozen=True)
class SSA:
    """Options of a decomposition over (key, [channel,] coordinates, value) rows.

    kind: 1d, toeplitz, mssa (with channel), cssa (value a struct of re and im) or nd (several
    coordinates); by default what the columns tell: cssa, mssa, nd or 1d. Absent rows and null values are gaps. window: a length, one for each coordinate,
    or a boolean array as a shape; by default half of the (shortest) series. mask: a boolean column.
    Projectors, weights and circular are as in kernels.decompose. nested: steps applied to the fit.
    """

    df: DataFrame
    kind: str | None = None
    key: str = "series_id"
    coords: tuple[str, ...] = ("t",)
    value: str = "value"
    channel: str | None = None
    window: Any = None
    count: int | None = None
    method: str = "auto"
    circular: bool | tuple[bool, ...] = False
    column_projector: Any = "none"
    row_projector: Any = "none"
    column_weight: Any = None
    row_weight: Any = None
    mask: str | None = None
    nested: tuple[tuple[str, dict], ...] = field(default=())
    stored: DataFrame | None = None  # the triples of a fit, which operations read instead of fitting

    def __post_init__(self) -> None:
        if self.kind is None:
            told = "cssa" if isinstance(dict((f.name, f.dataType) for f in self.df.schema).get(self.value), StructType) else "mssa" if self.channel else "nd" if len(self.coords) > 1 else "1d"
            object.__setattr__(self, "kind", told)
        require(self.kind, "decompose")
        if self.kind == "mssa" and not self.channel:
            object.__setattr__(self, "channel", "channel")
        if self._projected:
            require(self.kind, "projection")
        if self.column_weight is not None or self.row_weight is not None:
            require(self.kind, "weights")
        if np.any(self.circular):
            require(self.kind, "circular")
        if self.method not in D.METHODS:
            raise ValueError(f"svd method {self.method!r} is not one of {D.METHODS}")

    def _check_columns(self) -> None:
        """Refuses a table whose columns cannot be what the kind takes, before any job."""
        columns = [self.key, *self.coords, self.value, *([self.channel or "channel"] if self.kind == "mssa" else []), *([self.mask] if self.mask else [])]
        missing = [c for c in columns if c not in self.df.columns]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        value = self.df.schema[self.value].dataType
        if self.kind == "cssa" and (not isinstance(value, StructType) or {*value.names} < {"re", "im"}):
            raise ValueError(f"{self.value} is no struct of re and im")
        if self.kind != "cssa" and not isinstance(value, NumericType) and value.typeName() != "void":
            raise ValueError(f"{self.value} is no number")
        if self.kind == "toeplitz" and isinstance(self.window, np.ndarray) and not self.window.all():
            raise NotCapable("a Toeplitz decomposition takes no shapes")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"df": None, "stored": None}  # workers need the options alone

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @property
    def _projected(self) -> bool:
        return any(not (isinstance(p, (str, int)) and D.BASES.get(p, p) == 0) for p in (self.column_projector, self.row_projector))

    def capable(self, operation: str) -> bool:
        return capable(self.kind, operation)

    # --- from rows to a fit, inside a worker ---

    def read(self, pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[tuple[int, ...]], list[str]]:
        """Arrays (NaN in gaps), the coordinates of their first cells, and channel names."""
        pdf = pdf.copy()
        if self.kind == "cssa":
            pdf["__x"] = [complex(v["re"], v["im"]) if v is not None and v["re"] is not None and v["im"] is not None else complex(np.nan) for v in pdf[self.value]]
        else:
            pdf["__x"] = pd.to_numeric(pdf[self.value], errors="coerce").astype(float)
        if self.mask:
            pdf.loc[~pdf[self.mask].fillna(False).astype(bool), "__x"] = np.nan
        arrays, origins, names = [], [], []
        for name, part in pdf.groupby(self.channel, sort=True) if self.channel else [("", pdf)]:
            if self.channel:  # channels lose the gaps at their ends
                known = part.loc[part["__x"].notna(), self.coords[0]]
                if known.empty:
                    raise ValueError(f"channel {name} has no value")
                part = part[part[self.coords[0]].between(known.min(), known.max())]
            at = part[list(self.coords)].to_numpy(np.int64)
            low, high = at.min(0), at.max(0)
            x = np.full(tuple(high - low + 1), np.nan, complex if self.kind == "cssa" else float)
            x[tuple((at - low).T)] = part["__x"].to_numpy()
            if not np.isfinite(x).any():
                raise ValueError("a series has no value")
            arrays.append(x)
            origins.append(tuple(int(v) for v in low))
            names.append(str(name))
        return arrays, origins, names

    def shape(self, arrays: list[np.ndarray]) -> tuple[np.ndarray, tuple[bool, ...]]:
        rank = arrays[0].ndim
        w = self.window
        if w is None:
            w = tuple((n + 1) // 2 for n in np.min([a.shape for a in arrays], axis=0))
        w = np.ones((w,) * rank if np.isscalar(w) else tuple(w), bool) if not (isinstance(w, np.ndarray) and w.dtype == bool) else w
        wrap = (self.circular,) * rank if isinstance(self.circular, bool) else tuple(self.circular)
        return w, wrap

    def trajectory(self, arrays: list[np.ndarray]) -> Trajectory:
        window, wrap = self.shape(arrays)
        return Trajectory([Block(a, window, wrap) for a in arrays])

    def fit_arrays(self, arrays: list[np.ndarray], plain: bool = False, count: int | None = None, need: int = 0) -> D.Triples:
        """need: triples that must be there; more are found than by default where groups name them."""
        x, count = self.trajectory(arrays), count or self.count
        if need > (count or D.default_count(x)):
            count = min(need, D.rank_limit(x))
        if self.kind == "toeplitz":
            t = D.toeplitz(x, count, self.method)
        elif self._projected:
            t = D.projected(x, count, self.column_projector, self.row_projector, self.method, self.kind)
        elif self.column_weight is not None or self.row_weight is not None:
            t = D.weighted(x, count, self.column_weight, self.row_weight, self.method, self.kind)
        else:
            t = D.basic(x, count, self.method, self.kind)
        for step, options in () if plain else self.nested:
            t = {"iossa": N.iterative_oblique, "fossa": N.filtered, "eossa": lambda *a, **k: N.esprit_oblique(*a, **k)[0]}[step](t, **options)
        return t

    def read_triples(self, arrays: list[np.ndarray], rows: pd.DataFrame) -> D.Triples:
        """The fit that stored rows (see triples) hold."""
        rows = rows.sort_values("k")
        turn = (lambda x: np.asarray(x).view(complex)) if self.kind == "cssa" else np.asarray
        u, v = (np.stack([turn(np.asarray(x, float)) for x in rows[c]], 1) for c in ("u", "v"))
        special = rows["special"].tolist()
        x, nested = self.trajectory(arrays), json.loads(rows["nested"].iloc[0])
        weights = [None if w is None else np.asarray(w, float) for w in (self.column_weight, self.row_weight)]
        if any(w is not None for w in weights):
            weights = [np.ones(n) if w is None else w for w, n in zip(weights, (x.rows, x.columns), strict=True)]
        return D.Triples(x, rows["sigma"].to_numpy(float), u, v, special.count("right"), special.count("left"), self.kind, bool(self.nested), *weights, tuple(map(tuple, nested)))

    def _run(self, make: Callable[..., Iterable], schema: str, extra: tuple[str, ...] = (), df: DataFrame | None = None, fit: bool = True, groups: Groups = None) -> DataFrame:
        """One kernel call per key. make(fit, origins, names, key, pdf) gives the rows after the key,
        as tuples or as frames with the columns' names. groups: what the fit must have triples for."""
        whole = df is None
        self._check_columns()
        df = self.df if df is None else df
        columns = list(dict.fromkeys([self.key, *([self.channel] if self.channel else []), *self.coords, self.value, *([self.mask] if self.mask else []), *extra]))
        kind = df.schema[self.key].dataType.simpleString()
        names, need = [self.key, *StructType.fromDDL(schema).names], highest(groups)

        def kernel(pdf: pd.DataFrame, kept: pd.DataFrame | None = None) -> pd.DataFrame:
            if pdf.empty:
                return pd.DataFrame(columns=names)
            key = pdf[self.key].iloc[0]
            arrays, origins, channels = self.read(pdf)
            what = arrays
            if fit and kept is not None and len(kept) >= max(need, 1):
                what = self.read_triples(arrays, kept)
            elif fit:
                what = self.fit_arrays(arrays, need=need)
            rows = list(make(what, origins, channels, key, pdf))
            if rows and isinstance(rows[0], pd.DataFrame):
                out = pd.concat(rows, ignore_index=True)
                out.insert(0, self.key, key)
                return out[names]
            return pd.DataFrame([(key, *r) for r in rows], columns=names)

        out, rows = f"`{self.key}` {kind}, {schema}", df.select(*columns).groupBy(self.key, *extra)
        if self.stored is not None and fit and whole:
            return rows.cogroup(self.stored.groupBy(self.key)).applyInPandas(lambda a, b: kernel(a, b), out)
        return rows.applyInPandas(lambda a: kernel(a), out)

    @property
    def _cell(self) -> str:
        """Schema of a cell: channel, coordinates, value."""
        number = "value struct<re: double, im: double>" if self.kind == "cssa" else "value double"
        return ", ".join([*(["channel string"] if self.channel else []), *(f"{c} long" for c in self.coords), number])

    def _cells(self, arrays: list[np.ndarray], origins: list[tuple[int, ...]], channels: list[str], start: list[int] | None = None, **constant) -> Iterable[pd.DataFrame]:
        """Frames of the cells of arrays, with constant columns; not finite values become null."""
        for i, (x, origin, name) in enumerate(zip(arrays, origins, channels, strict=True)):
            at = np.indices(x.shape).reshape(x.ndim, -1) + np.asarray(origin)[:, None] + (start[i] if start else 0)
            flat = x.ravel()
            known = np.isfinite(flat)
            if self.kind == "cssa":
                value = [{"re": float(v.real), "im": float(v.imag)} if k else None for v, k in zip(flat.tolist(), known.tolist(), strict=True)]
            else:
                value = np.where(known, flat, np.nan)
            yield pd.DataFrame(constant | ({"channel": name} if self.channel else {}) | dict(zip(self.coords, at, strict=True)) | {"value": value}, index=np.arange(x.size))

    # --- decomposition ---

    def decompose(self, vectors: bool = True) -> DataFrame:
        """(key, k, sigma, u, v, special). vectors=False leaves u and v out of the shuffle back.

        Nested models cannot be decomposed further: triples() reads theirs.
        """
        if self.nested:
            raise NotCapable("a nested model cannot be decomposed; triples() gives what it has")
        return self.triples(vectors).drop("nested")

    def triples(self, vectors: bool = True) -> DataFrame:
        """(key, k, sigma, u, v, special, nested) of any model; nested: the groups of a nested one, as JSON."""
        plain = lambda x: [float(a) for a in x] if not np.iscomplexobj(x) else [float(b) for a in x for b in (a.real, a.imag)]

        def make(t, *_):
            for i, s in enumerate(t.sigma):
                special = "right" if i < t.right else "left" if i < t.special else None
                yield (i + 1, float(s), plain(t.u[:, i]) if vectors else None, plain(t.v[:, i]) if vectors else None, special, json.dumps(t.nested))

        return self._run(make, "k int, sigma double, u array<double>, v array<double>, special string, nested string")

    def counts(self) -> DataFrame:
        """(key, nu, nv, nsigma, nspecial)."""
        return self._run(lambda t, *_: [(t.u.shape[1], t.v.shape[1], len(t.sigma), t.special)], "nu int, nv int, nsigma int, nspecial int")

    def __getitem__(self, name: str):
        """Parts by name or by a beginning that only one has: sigma, U, V, F as tables, options as they are."""
        parts = {"sigma": lambda: self.triples(False).select(self.key, "k", "sigma"), "U": lambda: self.triples().select(self.key, "k", "u"), "V": lambda: self.triples().select(self.key, "k", "v"),
                 "F": lambda: self.df, "window": lambda: self.window, "kind": lambda: self.kind, "circular": lambda: self.circular, "method": lambda: self.method, "channel": lambda: self.channel}
        if name == "lambda":
            warnings.warn("lambda is deprecated; take sigma", DeprecationWarning, stacklevel=2)
            name = "sigma"
        found = [name] if name in parts else [x for x in parts if x.startswith(name)]
        if len(found) != 1:
            raise KeyError(name)
        return parts[found[0]]()

    def capabilities(self) -> dict[str, bool]:
        """Which operations this model takes."""
        return {x: self.capable(x) and not (x == "owcor" and not self.nested) and not (x == "decompose" and bool(self.nested)) for x in sorted(ALLOWED)}

    def summary(self) -> DataFrame:
        """(key, n, rows, columns, nsigma, nspecial, wnorm)."""
        def make(t, *_):
            yield (sum(b.values.size for b in t.x.blocks), t.x.rows, t.x.columns, len(t.sigma), t.special, float(np.sqrt(t.x.norm2)))

        return self._run(make, "n long, rows long, columns long, nsigma int, nspecial int, wnorm double")

    def contributions(self) -> DataFrame:
        return self._run(lambda t, *_: ((i + 1, float(c)) for i, c in enumerate(t.contributions())), "k int, contribution double")

    def wnorm(self) -> DataFrame:
        return self.summary().select(self.key, "wnorm")

    def reconstruct(self, groups: Groups = None, residual: bool = False) -> DataFrame:
        """(key, grp, cells): the groups' series; with residual also what their union leaves."""
        def make(t, origins, channels, *_):
            all_ = named(groups, len(t.sigma))
            for name, g in all_.items():
                yield from self._cells(t.series(g), origins, channels, grp=name)
            if residual:
                union = t.series(sorted({i for g in all_.values() for i in g}))
                yield from self._cells([b.values - u for b, u in zip(t.x.blocks, union, strict=True)], origins, channels, grp="__residual__")

        return self._run(make, f"grp string, {self._cell}", groups=groups)

    def elementary(self) -> DataFrame:
        return self.reconstruct()

    def residuals(self, groups: Groups = None) -> DataFrame:
        return self.reconstruct(groups, residual=True).where("grp = '__residual__'").drop("grp")

    # --- correlations ---

    def _matrix(self, make: Callable[[D.Triples, dict[str, list[int]]], np.ndarray], groups: Groups, name: str) -> DataFrame:
        def rows(t, *_):
            g = named(groups, len(t.sigma))
            m, names = make(t, g), list(g)
            return ((a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names))

        return self._run(rows, f"g1 string, g2 string, {name} double", groups=groups)

    def frobenius_orthogonal(self, groups: Groups = None) -> DataFrame:
        """(key, orthogonal, worst): whether the groups' matrices are orthogonal, and the largest correlation if not."""
        def make(t, *_):
            told = D.frobenius_orthogonal(t, list(named(groups, len(t.sigma)).values()))
            yield (told is True, 0.0 if told is True else float(told))

        return self._run(make, "orthogonal boolean, worst double", groups=groups)

    def wcor(self, groups: Groups = None) -> DataFrame:
        if self.nested:
            warnings.warn("matrices of a nested model's components need not be F-orthogonal, and their w-correlations mislead where they are not: see frobenius_orthogonal()", stacklevel=2)
        return self._matrix(lambda t, g: D.wcor([t.series(x) for x in g.values()], t.x), groups, "wcor")

    def frobenius_cor(self, groups: Groups = None) -> DataFrame:
        return self._matrix(lambda t, g: D.frobenius(t, list(g.values())), groups, "cor")

    def owcor(self, groups: Groups = None) -> DataFrame:
        if not self.nested:
            raise NotCapable("only nested models have oblique correlations")
        return self._matrix(lambda t, g: D.oblique_correlations(t, list(g.values())), groups, "owcor")

    def high_rank_rate(self, rank: int) -> DataFrame:
        return self._run(lambda t, *_: [(G.high_rank_rate(t, rank),)], "rate double")

    # --- forecasts ---

    def _forecast(self, call: Callable[[D.Triples, list[int]], list[np.ndarray]], groups: Groups, only_new: bool, length: int, reverse: bool) -> DataFrame:
        def make(t, origins, channels, *_):
            start = [-length if reverse else len(b.values) if only_new else 0 for b in t.x.blocks]
            for name, g in named(groups, len(t.sigma)).items():
                yield from self._cells(call(t, g), origins, channels, start, grp=name)

        return self._run(make, f"grp string, {self._cell}", groups=groups)

    def rforecast(self, groups: Groups = None, length: int = 1, base: str = "reconstructed", only_new: bool = True, reverse: bool = False, direction: str = "row") -> DataFrame:
        require(self.kind, "rforecast")
        return self._forecast(lambda t, g: P.recurrent(t, g, length, base, only_new, reverse, direction), groups, only_new, length, reverse)

    def vforecast(self, groups: Groups = None, length: int = 1, only_new: bool = True, direction: str = "row") -> DataFrame:
        require(self.kind, "vforecast")
        return self._forecast(lambda t, g: P.vector(t, g, length, only_new, direction), groups, only_new, length, False)

    def bforecast(self, groups: Groups = None, length: int = 1, replicates: int = 100, level: float = 0.95, kind: str = "recurrent", interval: str = "confidence", only_intervals: bool = False, chunk: int = 10, only_new: bool = True) -> DataFrame:
        """(key, grp, t, mean, lower, upper, level): each replicate is fitted again; `chunk` of them
        share a task. Seeds follow from key, group and replicate. A prediction interval is the
        replicates' one, its ends moved by the residuals' quantiles. With only_new=False the fitted
        part comes before the new values."""
        require(self.kind, "bforecast")
        if interval not in ("confidence", "prediction"):
            raise ValueError("interval is confidence or prediction")
        many = self.df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // chunk) - 1))))
        tails = ((1 - level) / 2, (1 + level) / 2)

        def make(t, origins, _channels, key, pdf):
            first = int(pdf["__chunk"].iloc[0]) * chunk
            forecast = (P.recurrent if kind == "recurrent" else P.vector)
            for name, g in (named(groups, len(t.sigma)) if groups is not None else {"F1": list(range(1, len(t.sigma) + 1))}).items():
                plain = forecast(t, g, length, only_new=only_new)[0]
                residual = t.x.blocks[0].values - t.series(g)[0]
                low, high = np.quantile(residual, tails) if interval == "prediction" else (0.0, 0.0)
                at = origins[0][0] + np.arange(len(plain)) + (len(residual) if only_new else 0)
                for rep in range(first, min(first + chunk, replicates)):
                    x = P.bootstrap(t, g, length, zlib.crc32(f"{key}/{name}/{rep}".encode()), kind, only_new=only_new)
                    yield pd.DataFrame({"grp": name, "t": at, "x": x, "plain": plain, "low": low, "high": high})

        runs = self._run(make, "grp string, t long, x double, plain double, low double, high double", ("__chunk",), many, groups=groups)
        end = lambda tail, by: F.percentile("x", F.lit(tail)) + F.first(by)
        mean = F.first("plain") if only_intervals else F.avg("x")
        return runs.groupBy(self.key, "grp", "t").agg(mean.alias("mean"), end(tails[0], "low").alias("lower"), end(tails[1], "high").alias("upper")).withColumn("level", F.lit(level))

    def predict(self, groups: Groups = None, length: int = 1, method: str = "recurrent", interval: str = "none", direction: str = "column", **options) -> DataFrame:
        require(self.kind, "predict")
        if interval != "none":
            return self.bforecast(groups, length, kind=method, interval=interval, **({"only_intervals": True} | options))
        return (self.rforecast if method == "recurrent" else self.vforecast)(groups, length, direction=direction, **options)

    def forecast(self, groups: Groups = None, length: int = 1, method: str = "recurrent", interval: str = "none", **options) -> DataFrame:
        """(key, grp, t, part, mean, lower, upper, level): part is fitted or forecast."""
        require(self.kind, "forecast")
        null = F.lit(None).cast("double")
        new = self.predict(groups, length, method, interval, **options)
        if interval == "none":
            new = new.select(self.key, "grp", *self.coords, F.col("value").alias("mean"), null.alias("lower"), null.alias("upper"), null.alias("level"))
        old = self.reconstruct(groups).select(self.key, "grp", *self.coords, F.col("value").alias("mean"), null.alias("lower"), null.alias("upper"), null.alias("level"))
        return old.withColumn("part", F.lit("fitted")).unionByName(new.withColumn("part", F.lit("forecast")))

    # --- recurrences and roots ---

    def lrr(self, groups: Groups = None, reverse: bool = False) -> DataFrame:
        require(self.kind, "lrr")

        def make(t, *_):
            for name, g in named(groups, len(t.sigma)).items():
                c = P.lrr(t.column_space(t.pick(g)), reverse=reverse, orthonormalize=False)
                yield (name, [float(x.real) for x in c], [float(x.imag) for x in c.astype(complex)])

        return self._run(make, "grp string, coef array<double>, coef_im array<double>", groups=groups)

    def _roots(self, call: Callable[[D.Triples, list[int]], np.ndarray], groups: Groups) -> DataFrame:
        def make(t, *_):
            for name, g in named(groups, len(t.sigma)).items():
                z = call(t, g)
                for d in range(z.shape[1]):
                    p = P.parameters(z[:, d])
                    for i, r in enumerate(z[:, d]):
                        yield (name, i + 1, str(d + 1), {"re": float(r.real), "im": float(r.imag)}, *(float(p[k][i]) for k in ("period", "frequency", "modulus", "rate")))

        return self._run(make, "grp string, number int, dim string, root struct<re: double, im: double>, period double, frequency double, modulus double, rate double", groups=groups)

    def roots(self, groups: Groups = None, method: str = "companion") -> DataFrame:
        """All characteristic roots of the groups' recurrences, the largest modulus first.

        method: companion (eigenvalues of that matrix) or polyroot (Newton's steps on them)."""
        require(self.kind, "roots")
        return self._roots(lambda t, g: P.roots(P.lrr(t.column_space(t.pick(g)), orthonormalize=False), method)[:, None], groups)

    def parestimate(self, groups: Groups = None, method: str = "esprit", **options) -> DataFrame:
        require(self.kind, "parestimate")
        return self._roots((lambda t, g: P.esprit(t, g, **options)) if method == "esprit" else P.pairs, groups)

    # --- gaps and low rank ---

    def gapfill(self, groups: Groups = None, method: str = "sequential", **options) -> DataFrame:
        require(self.kind, "gapfill")
        fill = G.sequential if method == "sequential" else G.simultaneous

        def make(t, origins, channels, *_):
            for name, g in named(groups, len(t.sigma)).items():
                yield from self._cells(fill(t, g, **options), origins, channels, grp=name)

        return self._run(make, f"grp string, {self._cell}", groups=groups)

    def igapfill(self, groups: Groups, **options) -> DataFrame:
        """(key, grp, cells, rounds, converged): each channel starts from its own mean."""
        require(self.kind, "igapfill")
        wanted = named(groups, 0)

        def make(arrays, origins, channels, *_):
            out, rounds, settled = G.iterative(lambda a: self.fit_arrays(a, plain=True), arrays, list(wanted.values()), **options)
            for name, filled in zip(wanted, out, strict=True):
                yield from self._cells(filled, origins, channels, grp=name, rounds=rounds, converged=settled)

        return self._run(make, f"grp string, {self._cell}, rounds int, converged boolean", fit=False)

    def summarize_gaps(self, windows: list[int]) -> DataFrame:
        require(self.kind, "summarize_gaps")
        rows = self.df.select(F.col(self.key).alias("series_id"), F.col(self.coords[0]).alias("t"), F.col(self.value).alias("value"))
        return relational.gaps(rows, windows)

    def cadzow(self, rank: int, **options) -> DataFrame:
        def make(t, origins, channels, *_):
            arrays, rounds, settled = G.cadzow(t, rank, **options)
            return self._cells(arrays, origins, channels, rounds=rounds, converged=settled)

        return self._run(make, f"{self._cell}, rounds int, converged boolean")

    # --- nested models and grouping ---

    def _with(self, step: str, **options) -> SSA:
        require(self.kind, step)
        return replace(self, nested=(*self.nested, (step, options)))

    def iossa(self, groups: list[list[int]], **options) -> SSA:
        return self._with("iossa", groups=groups, **options)

    def fossa(self, groups: list[list[int]], **options) -> SSA:
        return self._with("fossa", groups=groups, **options)

    def eossa(self, groups: list[list[int]], **options) -> SSA:
        """Triples of a cluster follow each other; nested_groups() names them."""
        return self._with("eossa", groups=groups, **options)

    def nested_groups(self) -> DataFrame:
        return self._run(lambda t, *_: ((f"F{n}", list(g)) for n, g in enumerate(t.nested, 1)), "grp string, triples array<int>")

    def report(self) -> DataFrame:
        """(key, name, value) of the last iterative step."""
        return self._run(lambda t, *_: ((k, None if v is None else float(v)) for k, v in t.report.items()), "name string, value double")

    def grouping_pgram(self, groups: Groups = None, base: str = "series", bins=2, threshold: float = 0, method: str = "constant", drop: bool = True) -> DataFrame:
        """(key, bin, triples, shares): groups of triples by where their energy lies."""
        require(self.kind, "grouping_pgram")

        def make(t, *_):
            if t.x.shaped:
                raise NotCapable("gapped data has no periodogram")
            g = list(named(groups, len(t.sigma)).values())
            rows = {"series": lambda x: t.series(x)[0], "eigen": lambda x: t.u[:, x[0] - 1], "factor": lambda x: t.v[:, x[0] - 1]}[base]
            share, found = N.by_frequency([rows(x) for x in g], bins, threshold, method)
            for j, members in enumerate(found):
                if members or not drop:
                    yield (f"F{j + 1}", sorted({i for m in members for i in g[m]}), [float(share[m, j]) for m in members])

        return self._run(make, "bin string, triples array<int>, shares array<double>", groups=groups)

    def grouping_auto(self, method: str = "pgram", **options) -> DataFrame:
        """Groups of triples by frequency (pgram) or by w-correlation (wcor)."""
        if method not in ("pgram", "wcor"):
            raise ValueError("method is pgram or wcor")
        return (self.grouping_pgram if method == "pgram" else self.grouping_wcor)(**options)

    def grouping_wcor(self, groups: Groups = None, clusters: int | None = None) -> DataFrame:
        require(self.kind, "grouping_wcor")

        def make(t, *_):
            g = list(named(groups, len(t.sigma)).values())
            k = clusters or max(1, len({i for x in g for i in x}) // 2)
            for n, members in enumerate(N.by_correlation(D.wcor([t.series(x) for x in g], t.x), k), 1):
                yield (f"F{n}", sorted({i for m in members for i in g[m]}))

        return self._run(make, "grp string, triples array<int>", groups=groups)

    def hmatr(self, base: int | None = None, test: int | None = None, window: int | None = None, count: int = 10, chunk: int = 32) -> DataFrame:
        """(key, base_start, test_start, h), starts from 1; `chunk` base segments share a task."""
        require(self.kind, "hmatr")
        sizes = self.df.groupBy(self.key).agg((F.max(self.coords[0]) - F.min(self.coords[0]) + 1).alias("__n"))
        b = F.lit(base) if base else F.floor(F.col("__n") / 4)
        many = self.df.join(sizes, self.key).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - b - 1) / chunk))))

        def make(arrays, _o, _c, _k, pdf):
            f = arrays[0]
            n = len(f)
            bb, tt = base or n // 4, test or n // 4
            w = window or bb // 2
            first = int(pdf["__chunk"].iloc[0]) * chunk
            for s in range(first, min(first + chunk, n - bb)):
                for j, h in enumerate(G.heterogeneity(f, s, bb, tt, w, count)):
                    yield (s + 1, j + 1, float(h))

        return self._run(make, "base_start int, test_start int, h double", ("__chunk",), many, fit=False)

    # --- plot data, storage ---

    def plot_data(self, what: str, groups: Groups = None, cumulative: bool = False) -> DataFrame:
        """Tidy rows of a plot: values, vectors, paired, series, wcor, roots; reconstruction (the
        original, each group and the residuals), hmatr, gaps (windows without a gap, by length),
        pgram (each triple's share by bin) and tree (merges of the w-correlation clusters)."""
        if what == "values":
            return self.triples(vectors=False).select(self.key, "k", "sigma")
        if what == "vectors":
            return self.triples().select(self.key, "k", F.posexplode("u").alias("i", "value"))
        if what == "paired":
            u = self.triples().select(self.key, "k", F.posexplode("u").alias("i", "x"))
            return u.join(u.select(self.key, (F.col("k") - 1).alias("k"), "i", F.col("x").alias("y")), [self.key, "k", "i"])
        if what == "series":
            rows = self.reconstruct(groups)
            if not cumulative:
                return rows
            from pyspark.sql import Window

            place = [self.key, *(["channel"] if self.channel else []), *self.coords]
            return rows.withColumn("value", F.sum("value").over(Window.partitionBy(*place).orderBy(F.length("grp"), "grp")))
        if what == "wcor":
            return self.wcor(groups)
        if what == "roots":
            return self.roots(groups)
        if what == "reconstruction":
            place = [*(["channel"] if self.channel else []), *self.coords]
            known = self.df.select(self.key, F.lit("Original").alias("grp"), *[F.col(c).alias("channel") for c in (self.channel,) if c], *[F.col(c).cast("long").alias(c) for c in self.coords], F.col(self.value).alias("value"))
            rows = self.reconstruct(groups, residual=True).withColumn("grp", F.when(F.col("grp") == "__residual__", "Residuals").otherwise(F.col("grp")))
            return known.select(self.key, "grp", *place, "value").unionByName(rows)
        if what == "hmatr":
            return self.hmatr()
        if what == "gaps":
            rows = self.df.select(F.col(self.key).alias("series_id"), F.col(self.coords[0]).alias("t"), F.col(self.value).alias("value"))
            return relational.complete_share(rows, list(range(1, (self.window if isinstance(self.window, int) else 10) + 1)))
        if what == "pgram":
            return self.grouping_pgram([[i] for i in range(1, (self.count or 10) + 1)], bins=10, drop=False).select(self.key, "bin", F.posexplode("triples").alias("place", "k"), "shares").select(self.key, "bin", "k", F.get("shares", F.col("place")).alias("share"))
        if what == "tree":
            def make(t, *_):
                g = list(named(groups, len(t.sigma)).values())
                w = D.wcor([t.series(x) for x in g], t.x)
                for n, (left, right, height) in enumerate(N.merges((1 - np.abs(w)) / 2 if np.iscomplexobj(w) else (1 - w) / 2), 1):
                    yield (n, sorted({i for m in left for i in g[m]}), sorted({i for m in right for i in g[m]}), float(height))

            return self._run(make, "step int, first array<int>, second array<int>, height double", groups=groups)
        raise ValueError(f"no plot {what!r}")

    # --- fits that are kept ---

    def precache(self) -> SSA:
        """The model with its triples in Spark's cache: operations read them and do not fit again.

        A group beyond them is fitted anew; a lost block is computed again.
        """
        return replace(self, stored=self.triples().persist())

    def cleanup(self) -> SSA:
        """The model without kept triples; those in Spark's cache are released."""
        if self.stored is not None:
            self.stored.unpersist()
        return replace(self, stored=None)

    def save(self, path: str) -> None:
        """Writes the triples to path, and the options below it."""
        options = {f: getattr(self, f) for f in self.__dataclass_fields__ if f not in ("df", "stored")}
        spark = self.df.sparkSession
        self.triples().write.parquet(path)
        spark.createDataFrame([(json.dumps(options, default=plain_json),)], "options string").coalesce(1).write.parquet(f"{path}/_options")

    @classmethod
    def load(cls, spark: SparkSession, path: str, df: DataFrame) -> SSA:
        """The model that save() wrote, over df, whose triples it does not fit again."""
        options = json.loads(spark.read.parquet(f"{path}/_options").first()["options"], object_hook=from_json)
        options["nested"] = tuple((step, more) for step, more in options["nested"])
        options |= {k: tuple(options[k]) for k in ("coords", "window", "circular") if isinstance(options[k], list)}
        return cls(df, **options, stored=spark.read.parquet(path))

    def clone(self, **changes) -> SSA:
        return replace(self, **changes)
