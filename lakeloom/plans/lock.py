"""Locks that outlive neither their owner nor its right to them."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from ..errors import LockError
from .state import StateStore

TTL = 3600.0


@contextmanager
def held(store: StateStore, key: str, ttl: float = TTL) -> Iterator[threading.Event]:
    """Hold ``key``; a thread renews it every third of ``ttl``. The event is set if the lock was lost, and the holder must then stop."""
    token = store.acquire(key, ttl)
    if token is None:
        raise LockError(f"{key} is locked by another process; it is freed at the latest {ttl:.0f} s after that process died")
    done, lost = threading.Event(), threading.Event()

    def beat() -> None:
        while not done.wait(ttl / 3):
            try:
                if not store.renew(key, token, ttl):
                    lost.set()
                    return
            except Exception:  # noqa: BLE001 - the next beat tries again, and the time to live decides
                continue

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield lost
        if lost.is_set():
            raise LockError(f"{key} was lost meanwhile")
    finally:
        done.set()
        thread.join()
        store.release(key, token)
