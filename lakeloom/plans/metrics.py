"""Counters and gauges of one command, and their text for Prometheus."""

from __future__ import annotations

import os
import threading
from pathlib import Path

SERIES = {
    "lakeloom_intervals_done_total": ("counter", "intervals computed and marked done"),
    "lakeloom_intervals_failed_total": ("counter", "intervals that failed and wait for another try"),
    "lakeloom_audit_failures_total": ("counter", "blocking audits with violations"),
    "lakeloom_audits_passed_total": ("counter", "audits without violations"),
    "lakeloom_snapshots_built_total": ("counter", "versions built or filled"),
    "lakeloom_model_build_duration_seconds": ("gauge", "seconds that a model's last build took"),
    "lakeloom_command_duration_seconds": ("gauge", "seconds that the last apply or run took"),
    "lakeloom_last_run_timestamp_seconds": ("gauge", "when the last apply or run ended, by outcome"),
    "lakeloom_planned_models_total": ("counter", "models of the last plan, by category"),
}


class Metrics:
    def __init__(self) -> None:
        self._values: dict[tuple[str, tuple], float] = {}
        self._guard = threading.Lock()

    def add(self, name: str, by: float = 1, **labels: str) -> None:
        key = name, tuple(sorted(labels.items()))
        with self._guard:
            self._values[key] = self._values.get(key, 0) + by

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._guard:
            self._values[name, tuple(sorted(labels.items()))] = value

    def value(self, name: str, **labels: str) -> float:
        return self._values.get((name, tuple(sorted(labels.items()))), 0)

    def text(self) -> str:
        """The exposition format: each series with its help and type, samples sorted, ``# EOF`` last."""
        out = []
        for name, (kind, about) in SERIES.items():
            samples = sorted((labels, v) for (n, labels), v in self._values.items() if n == name)
            if not samples:
                continue
            family = name.removesuffix("_total") if kind == "counter" else name
            out += [f"# HELP {family} {about}", f"# TYPE {family} {kind}"]
            for labels, v in samples:
                shown = ",".join('{}="{}"'.format(k, x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")) for k, x in labels)
                out.append(f"{name}{{{shown}}} {v:g}" if shown else f"{name} {v:g}")
        return "\n".join([*out, "# EOF", ""])

    def write(self, path: str | Path) -> None:
        """Beside and renamed, as a collector may read at any time."""
        part = Path(f"{path}.part")
        part.write_text(self.text())
        os.replace(part, path)
