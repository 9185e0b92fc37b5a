"""Ticks from outside: entries for cron and units for systemd."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

from ..errors import LoomError, UnavailableError

NICKNAMES = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAYS = "sun mon tue wed thu fri sat".split()


def fields(cron: str) -> list[set[int]]:
    """The minutes, hours, days, months and weekdays of an expression."""
    parts = NICKNAMES.get(cron.strip().lower(), cron).split()
    if len(parts) != 5:
        raise LoomError(f"{cron!r} isn't a cron expression of five fields")
    out = []
    for k, (part, (lo, hi)) in enumerate(zip(parts, _RANGES)):
        values: set[int] = set()
        for piece in part.lower().split(","):
            m = re.fullmatch(r"(\*|[a-z]{3}|\d+)(?:-([a-z]{3}|\d+))?(?:/(\d+))?", piece)
            if not m:
                raise LoomError(f"{cron!r}: {piece!r} can't be read")
            names = _MONTHS if k == 3 else _DAYS if k == 4 else []
            number = lambda x: int(x) if x.isdigit() else names.index(x) + (k == 3) if x in names else -1  # noqa: B023, E731
            a, b = (lo, hi) if m[1] == "*" else (number(m[1]), number(m[2]) if m[2] else hi if m[3] else number(m[1]))
            step = int(m[3] or 1)
            if not (lo <= a <= b <= hi and step):
                raise LoomError(f"{cron!r}: {piece!r} is out of range")
            values |= set(range(a, b + 1, step))
        out.append({v % 7 for v in values} if k == 4 else values)
    if not any(d <= {2: 29, 4: 30, 6: 30, 9: 30, 11: 30}.get(m, 31) for d in out[2] for m in out[3]):
        raise LoomError(f"{cron!r} never comes")
    return out


def calendar(cron: str) -> str:
    """The same as systemd's OnCalendar. Where cron fires on either of a day and a weekday, systemd needs both, so that is refused."""
    minute, hour, day, month, weekday = fields(cron)
    show = lambda v, n, lo: "*" if len(v) == n else ",".join(f"{x:02d}" for x in sorted(v))
    if len(day) < 31 and len(weekday) < 7:
        raise LoomError(f"{cron!r} names days of the month and of the week; a timer can't have either of them")
    days = "" if len(weekday) == 7 else ",".join(_DAYS[d].title() for d in sorted(weekday)) + " "
    return f"{days}*-{show(month, 12, 1)}-{show(day, 31, 1)} {show(hour, 24, 0)}:{show(minute, 60, 0)}:00"


def title(env: str, config: Path) -> str:
    return f"lakeloom-{re.sub(r'[^A-Za-z0-9]+', '-', config.resolve().parent.name)}-{env}"


def command(env: str, config: Path) -> str:
    return f"{sys.executable} -m lakeloom run {env} --config {config.resolve()}"


def units(env: str, cron: str, config: Path) -> dict[str, str]:
    """Texts of a service and its timer; a tick that the machine slept through is made up for."""
    name = title(env, config)
    service = f"[Unit]\nDescription=tick of {env}\n\n[Service]\nType=oneshot\nWorkingDirectory={config.resolve().parent}\nExecStart={command(env, config)}\n"
    timer = f"[Unit]\nDescription=when {env} ticks\n\n[Timer]\nOnCalendar={calendar(cron)}\nPersistent=true\n\n[Install]\nWantedBy=timers.target\n"
    return {f"{name}.service": service, f"{name}.timer": timer}


def _crontab(text: str | None = None) -> str:
    if not shutil.which("crontab"):
        raise UnavailableError("this machine has no crontab; print the systemd units instead")
    if text is None:
        return subprocess.run(["crontab", "-l"], capture_output=True, text=True).stdout
    subprocess.run(["crontab", "-"], input=text, text=True, check=True)
    return text


def with_entry(crontab: str, env: str, cron: str | None, config: Path) -> str:
    """A crontab with this project's entry for ``env`` set, or without it for None."""
    mark = f"# {title(env, config)}"
    lines = [x for x in crontab.splitlines() if not x.endswith(mark)]
    if cron is not None:
        fields(cron)
        lines.append(f"{cron} {command(env, config)} {mark}")
    return "\n".join(lines) + "\n" if lines else ""


def register(env: str, cron: str, config: Path) -> None:
    _crontab(with_entry(_crontab(), env, cron, config))


def remove(env: str, config: Path) -> None:
    _crontab(with_entry(_crontab(), env, None, config))


def entries() -> list[str]:
    return [x for x in _crontab().splitlines() if " # lakeloom-" in x]
