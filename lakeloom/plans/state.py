"""The state store: versions, pointers, intervals, journals and locks, in one SQLite file.

It is the driver's and small. Every change is one transaction that takes the write lock first.
"""

from __future__ import annotations

import json
import shutil
import sqlite3
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from ..errors import StateError
from .interval import Interval, iso, millis

VERSION = 2
_TABLES = """
create table if not exists meta (key text primary key, value text not null);
create table if not exists snapshots (name text, fingerprint text, sql text, ast text, physical text, kind text, version integer, columns text, location text, generation integer not null default 0, created integer, orphaned integer, claimed integer, primary key (name, fingerprint));
create table if not exists intervals (name text, fingerprint text, start integer, end integer, status text, primary key (name, fingerprint, start));
create table if not exists pointers (env text, name text, fingerprint text, primary key (env, name));
create table if not exists environments (env text primary key, promoted integer);
create table if not exists plans (id integer primary key, env text, applied integer, who text, summary text);
create table if not exists runs (id integer primary key, env text, started integer, finished integer, outcome text, detail text);
create table if not exists locks (key text primary key, owner text, expires real);
create table if not exists canon (key text primary key, ast text);
create table if not exists places (name text, physical text, key text, place text, primary key (name, physical, key));
"""


@dataclass(frozen=True)
class Snapshot:
    name: str
    fingerprint: str
    sql: str
    ast: str | None
    physical: str
    kind: str
    version: int
    columns: str
    location: str
    generation: int = 0
    created: int = 0
    orphaned: int | None = None


class StateStore:
    def __init__(self, path: str | Path = ":memory:") -> None:
        self.path = str(path)
        self._guard = threading.RLock()
        if self.path != ":memory:":
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        self._db = sqlite3.connect(self.path, timeout=30, isolation_level=None, check_same_thread=False)
        self._db.row_factory = sqlite3.Row
        self._db.execute("pragma journal_mode = wal")
        there = self._db.execute("select 1 from sqlite_master where name = 'meta'").fetchone()
        found = int(self._db.execute("select value from meta where key = 'version'").fetchone()[0]) if there else None
        if found is not None and found != VERSION:
            self._db.close()
            raise StateError(f"{path} has layout {found} and this library {VERSION}" + ("; run migrate" if found < VERSION else "; use a newer library"))
        self._db.executescript(_TABLES)
        self._db.execute("insert or ignore into meta values ('version', ?)", (str(VERSION),))

    def close(self) -> None:
        self._db.close()

    @contextmanager
    def change(self) -> Iterator[sqlite3.Connection]:
        with self._guard:
            self._db.execute("begin immediate")
            try:
                yield self._db
            except BaseException:
                self._db.execute("rollback")
                raise
            self._db.execute("commit")

    def _rows(self, query: str, *args) -> list[sqlite3.Row]:
        with self._guard:
            return self._db.execute(query, args).fetchall()

    # versions
    def snapshot(self, name: str, fingerprint: str) -> Snapshot | None:
        rows = self._rows("select * from snapshots where name = ? and fingerprint = ? and claimed is null", name, fingerprint)
        return self._snapshot(rows[0]) if rows else None

    @staticmethod
    def _snapshot(r: sqlite3.Row) -> Snapshot:
        return Snapshot(*(r[k] for k in Snapshot.__dataclass_fields__))

    def snapshots(self) -> list[Snapshot]:
        return [self._snapshot(r) for r in self._rows("select * from snapshots where claimed is null order by name, fingerprint")]

    def sharing(self, name: str, physical: str) -> list[Snapshot]:
        """The versions of a model that use the same files."""
        return [self._snapshot(r) for r in self._rows("select * from snapshots where name = ? and physical = ? and claimed is null order by fingerprint", name, physical)]

    def save_snapshot(self, s: Snapshot) -> None:
        """Insert, or bring an older record of the same version up to date; the time of creation stays."""
        with self.change() as db:
            db.execute(
                "insert into snapshots values (?,?,?,?,?,?,?,?,?,?,?,null,null) on conflict do update set sql = excluded.sql, ast = excluded.ast, physical = excluded.physical, version = excluded.version, "
                "columns = excluded.columns, location = excluded.location, generation = excluded.generation, orphaned = null, claimed = null",
                (s.name, s.fingerprint, s.sql, s.ast, s.physical, s.kind, s.version, s.columns, s.location, s.generation, s.created or _now()),
            )

    # intervals
    def intervals(self, name: str, fingerprint: str, status: str = "done") -> list[Interval]:
        return [Interval(r["start"], r["end"]) for r in self._rows("select start, end from intervals where name = ? and fingerprint = ? and status = ? order by start", name, fingerprint, status)]

    def mark(self, name: str, fingerprint: str, parts: list[Interval], status: str) -> None:
        with self.change() as db:
            db.executemany("insert or replace into intervals values (?,?,?,?,?)", [(name, fingerprint, p.start, p.end, status) for p in parts])

    def clear(self, name: str, fingerprint: str, within: Interval) -> list[Interval]:
        """Forget the intervals inside a range, and return them."""
        with self.change() as db:
            rows = db.execute("select start, end from intervals where name = ? and fingerprint = ? and start >= ? and end <= ? order by start", (name, fingerprint, *within)).fetchall()
            db.execute("delete from intervals where name = ? and fingerprint = ? and start >= ? and end <= ?", (name, fingerprint, *within))
            return [Interval(r["start"], r["end"]) for r in rows]

    def places(self, name: str, physical: str) -> dict[str, str]:
        """Where the directory of each interval of a version's files is."""
        return {r["key"]: r["place"] for r in self._rows("select key, place from places where name = ? and physical = ? order by key", name, physical)}

    def set_places(self, name: str, physical: str, there: list[tuple[str, str]], gone: list[str]) -> list[str]:
        """Switch intervals to new directories, all at once; returns the directories that are no longer in use."""
        with self.change() as db:
            old = {r["key"]: r["place"] for r in db.execute("select key, place from places where name = ? and physical = ?", (name, physical))}
            db.executemany("insert or replace into places values (?,?,?,?)", [(name, physical, k, p) for k, p in there])
            db.executemany("delete from places where name = ? and physical = ? and key = ?", [(name, physical, k) for k in gone])
        return [old[k] for k in [*(k for k, _ in there), *gone] if k in old]

    # environments
    def pointers(self, env: str) -> dict[str, str]:
        return {r["name"]: r["fingerprint"] for r in self._rows("select name, fingerprint from pointers where env = ? order by name", env)}

    def environments(self) -> dict[str, int]:
        return {r["env"]: r["promoted"] for r in self._rows("select env, promoted from environments order by env")}

    def promote(self, env: str, pointers: dict[str, str], unsaved: set[str] = frozenset()) -> None:
        """Point an environment at versions, all at once. Each has to be alive, but for ``unsaved`` names; versions that no environment points at are marked, for the janitor."""
        with self.change() as db:
            for name, fp in pointers.items():
                if name not in unsaved and not db.execute("select 1 from snapshots where name = ? and fingerprint = ? and claimed is null", (name, fp)).fetchone():
                    raise StateError(f"{name}@{fp[:8]} was removed meanwhile; apply again")
            db.execute("delete from pointers where env = ?", (env,))
            db.executemany("insert into pointers values (?,?,?)", [(env, n, f) for n, f in pointers.items()])
            db.execute("insert or replace into environments values (?,?)", (env, _now()))
            self._orphans(db)

    def drop_environment(self, env: str) -> None:
        with self.change() as db:
            db.execute("delete from pointers where env = ?", (env,))
            db.execute("delete from environments where env = ?", (env,))
            self._orphans(db)

    @staticmethod
    def _orphans(db: sqlite3.Connection) -> None:
        live = "exists (select 1 from pointers p where p.name = snapshots.name and p.fingerprint = snapshots.fingerprint)"
        db.execute(f"update snapshots set orphaned = null where {live}")
        db.execute(f"update snapshots set orphaned = ? where orphaned is null and not {live}", (_now(),))

    def claim_orphans(self, before: int) -> list[Snapshot]:
        """Take out of use the versions orphaned before a time; what they had is dropped afterwards. A version claimed but not forgotten is claimed again."""
        with self.change() as db:
            db.execute("update snapshots set claimed = ? where orphaned is not null and orphaned <= ? and claimed is null", (_now(), before))
            return [self._snapshot(r) for r in db.execute("select * from snapshots where claimed is not null order by name, fingerprint")]

    def forget(self, s: Snapshot) -> None:
        with self.change() as db:
            db.execute("delete from places where name = ? and physical = ? and not exists (select 1 from snapshots s where s.name = places.name and s.physical = places.physical and s.claimed is null)", (s.name, s.physical))
            db.execute("delete from snapshots where name = ? and fingerprint = ? and claimed is not null", (s.name, s.fingerprint))
            db.execute("delete from intervals where name = ? and fingerprint = ? and not exists (select 1 from snapshots s where s.name = intervals.name and s.fingerprint = intervals.fingerprint)", (s.name, s.fingerprint))

    # journals
    def journal_plan(self, env: str, who: str, summary: dict) -> None:
        with self.change() as db:
            db.execute("insert into plans (env, applied, who, summary) values (?,?,?,?)", (env, _now(), who, json.dumps(summary)))

    def journal_run(self, env: str, started: int, outcome: str, detail: dict) -> None:
        with self.change() as db:
            db.execute("insert into runs (env, started, finished, outcome, detail) values (?,?,?,?,?)", (env, started, _now(), outcome, json.dumps(detail)))

    def last_plan(self, env: str) -> dict | None:
        rows = self._rows("select * from plans where env = ? order by id desc limit 1", env)
        return {"appliedAt": iso(rows[0]["applied"]), "appliedBy": rows[0]["who"], "summary": json.loads(rows[0]["summary"])} if rows else None

    def last_runs(self, env: str, n: int = 10) -> list[dict]:
        rows = self._rows("select * from runs where env = ? order by id desc limit ?", env, n)
        return [{"startedAt": iso(r["started"]), "finishedAt": iso(r["finished"]), "outcome": r["outcome"], "detail": json.loads(r["detail"])} for r in rows]

    # parse trees
    def canon(self, keys: list[str]) -> dict[str, str]:
        out: dict[str, str] = {}
        for i in range(0, len(keys), 500):
            part = keys[i : i + 500]
            out |= {r["key"]: r["ast"] for r in self._rows(f"select key, ast from canon where key in ({','.join('?' * len(part))})", *part)}
        return out

    def save_canon(self, found: dict[str, str]) -> None:
        if found:
            with self.change() as db:
                db.executemany("insert or replace into canon values (?,?)", list(found.items()))

    # locks
    def acquire(self, key: str, ttl: float) -> str | None:
        """The owner's token, or None if another holds the lock; a lock that ran out is taken over."""
        token, now = uuid.uuid4().hex, time.time()
        with self.change() as db:
            db.execute("delete from locks where key = ? and expires <= ?", (key, now))
            got = db.execute("insert or ignore into locks values (?,?,?)", (key, token, now + ttl)).rowcount
        return token if got else None

    def renew(self, key: str, token: str, ttl: float) -> bool:
        """Only a lock that is still the owner's and hasn't run out is renewed."""
        now = time.time()
        with self.change() as db:
            return db.execute("update locks set expires = ? where key = ? and owner = ? and expires > ?", (now + ttl, key, token, now)).rowcount == 1

    def release(self, key: str, token: str) -> None:
        with self.change() as db:
            db.execute("delete from locks where key = ? and owner = ?", (key, token))


def _now() -> int:
    return round(time.time() * 1000)


def migrate(path: str | Path) -> dict:
    """Bring an older store to this layout, after a copy of it. A store that is up to date is left alone."""
    db = sqlite3.connect(path, isolation_level=None)
    try:
        row = db.execute("select value from meta where key = 'version'").fetchone()
    except sqlite3.DatabaseError:
        raise StateError(f"{path} is no state store") from None
    finally:
        db.close()
    found = int(row[0])
    if found > VERSION:
        raise StateError(f"{path} has layout {found}, which is newer than {VERSION}")
    if found == VERSION:
        return {"from": found, "to": VERSION}
    backup = f"{path}.backup-v{found}"
    shutil.copyfile(path, backup)
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("begin immediate")
    if found < 2:  # layout 1 had no generations and no claims
        have = {r[1] for r in db.execute("pragma table_info(snapshots)")}
        for column in ("generation integer not null default 0", "claimed integer"):
            if column.split()[0] not in have:
                db.execute(f"alter table snapshots add column {column}")
    db.execute("update meta set value = ? where key = 'version'", (str(VERSION),))
    db.execute("commit")
    db.close()
    return {"from": found, "to": VERSION, "backup": backup}


__all__ = ["Snapshot", "StateStore", "VERSION", "migrate", "millis"]
