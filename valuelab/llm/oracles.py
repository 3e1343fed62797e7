"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from . import leaks, licenses, quality


def oracles() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle(),
        "op5_quality_rules": quality.oracle(),
        "op13_benchmark_windows": leaks.oracle(),
    }
