"""The engine from Spark SQL: table functions over a table argument partitioned by series.

    SELECT * FROM ssa_reconstruct(TABLE(s) PARTITION BY (series_id) ORDER BY (t), 36, 'trend=1;season=2,3')

The table argument has the columns series_id, t and value; options follow it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from lagweave.kernels import decompose as D
from lagweave.kernels import forecast as P
from lagweave.kernels import gaps as G
from lagweave.kernels.trajectory import Block, Trajectory


def parsed(groups: str) -> dict[str, list[int]]:
    """Groups from text such as trend=1;season=2,3."""
    out = {}
    for n, part in enumerate(filter(None, groups.split(";")), 1):
        name, _, ids = part.rpartition("=")
        out[name.strip() or f"F{n}"] = [int(i) for i in ids.split(",")]
    return out


class _Series:
    """Collects a partition's rows; a series must fit a worker."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, float | None]] = []
        self.key, self.options = None, ()

    def eval(self, row: Row, *options) -> None:
        self.key, self.options = row["series_id"], options
        self.rows.append((int(row["t"]), None if row["value"] is None else float(row["value"])))

    def fitted(self, window: int) -> tuple[D.Triples, int]:
        at = np.array([t for t, _ in self.rows])
        x = np.full(at.max() - at.min() + 1, np.nan)
        x[at - at.min()] = [np.nan if v is None else v for _, v in self.rows]
        return D.basic(Trajectory([Block(x, np.ones(int(window), bool), (False,))])), int(at.min())

    def cells(self, name: str, x: np.ndarray, first: int):
        for i, v in enumerate(x):
            yield self.key, name, first + i, float(v) if np.isfinite(v) else None


CELLS = "series_id string, grp string, t bigint, value double"


@udtf(returnType="series_id string, k int, sigma double, u array<double>, v array<double>")
class SsaDecompose(_Series):
    def terminate(self):
        if self.rows:
            t, _ = self.fitted(self.options[0])
            for i, s in enumerate(t.sigma):
                yield self.key, i + 1, float(s), [float(x) for x in t.u[:, i]], [float(x) for x in t.v[:, i]]


@udtf(returnType=CELLS)
class SsaReconstruct(_Series):
    def terminate(self):
        if self.rows:
            t, first = self.fitted(self.options[0])
            for name, g in parsed(self.options[1]).items():
                yield from self.cells(name, t.series(g)[0], first)


@udtf(returnType=CELLS)
class SsaForecast(_Series):
    """Options: window, groups, length, method (recurrent or vector)."""

    def terminate(self):
        if self.rows:
            t, first = self.fitted(self.options[0])
            call = P.vector if len(self.options) > 3 and self.options[3] == "vector" else P.recurrent
            for name, g in parsed(self.options[1]).items():
                yield from self.cells(name, call(t, g, int(self.options[2]))[0], first + len(t.x.blocks[0].values))


@udtf(returnType=CELLS)
class SsaGapfill(_Series):
    """Options: window, groups, method (sequential or simultaneous)."""

    def terminate(self):
        if self.rows:
            t, first = self.fitted(self.options[0])
            call = G.simultaneous if len(self.options) > 2 and self.options[2] == "simultaneous" else G.sequential
            for name, g in parsed(self.options[1]).items():
                yield from self.cells(name, call(t, g)[0], first)


@udtf(returnType="series_id string, grp string, re double, im double, period double, modulus double")
class SsaRoots(_Series):
    """Options: window, groups, ls or tls."""

    def terminate(self):
        if self.rows:
            t, _ = self.fitted(self.options[0])
            for name, g in parsed(self.options[1]).items():
                z = P.esprit(t, g, solve=self.options[2] if len(self.options) > 2 else "ls")[:, 0]
                p = P.parameters(z)
                for i, r in enumerate(z):
                    yield self.key, name, float(r.real), float(r.imag), float(p["period"][i]), float(p["modulus"][i])


def register(spark: SparkSession) -> None:
    """Registers ssa_decompose, ssa_reconstruct, ssa_forecast, ssa_gapfill and ssa_roots."""
    for name, f in {"ssa_decompose": SsaDecompose, "ssa_reconstruct": SsaReconstruct, "ssa_forecast": SsaForecast, "ssa_gapfill": SsaGapfill, "ssa_roots": SsaRoots}.items():
        spark.udtf.register(name, f)
