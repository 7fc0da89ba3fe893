"""Which operations apply to which kind of model; checked before any job starts."""

from __future__ import annotations

KINDS = ("1d", "toeplitz", "mssa", "cssa", "nd")
ALL = frozenset(KINDS)
SERIES = frozenset(("1d", "toeplitz", "mssa", "cssa"))
#: Kinds an operation is defined for; gaps, shapes and circular data are checked by the kernels.
ALLOWED = {
    "decompose": ALL, "reconstruct": ALL, "residuals": ALL, "wcor": ALL, "wnorm": ALL, "cadzow": ALL, "contributions": ALL, "frobenius_cor": ALL, "owcor": ALL,
    "lrr": SERIES, "roots": SERIES, "rforecast": SERIES, "vforecast": SERIES,
    "bforecast": frozenset(("1d", "toeplitz")), "forecast": frozenset(("1d", "toeplitz")), "predict": frozenset(("1d", "toeplitz", "mssa")),
    "parestimate": ALL, "gapfill": SERIES, "igapfill": frozenset(("1d", "mssa", "nd")), "summarize_gaps": frozenset(("1d", "toeplitz", "cssa")),
    "iossa": frozenset(("1d", "toeplitz", "mssa", "nd")), "fossa": ALL, "eossa": ALL,
    "grouping_wcor": ALL, "grouping_pgram": frozenset(("1d", "toeplitz")), "projection": frozenset(("1d", "nd")), "weights": frozenset(("1d", "nd")), "circular": frozenset(("1d", "toeplitz", "nd")), "hmatr": frozenset(("1d",)),
}


class NotCapable(ValueError):
    """The operation is not defined for this kind of model."""


def capable(kind: str, operation: str) -> bool:
    return kind in ALLOWED.get(operation, frozenset())


def require(kind: str, operation: str) -> None:
    if not capable(kind, operation):
        raise NotCapable(f"{operation} is not defined for kind {kind}")
