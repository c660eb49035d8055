"""Durable state of consumers: cursors, leases, subscriptions, and an append-only audit log.

The state is a small numbered document beside the lake. A change reads the newest one and creates the next; if another writer was
first, the change is made again on what that one wrote. It never makes a snapshot of the lake. Audit rows of a change are part of its document,
and are copied to the log afterwards; a writer that finds them missing there copies them first, so none is lost by a crash between.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import suppress

from ebbtide.errors import Conflict
from ebbtide.sources.files import Files

KEEP = 4
EMPTY = {"next_consumer": 1, "next_audit": 1, "consumers": {}, "subscriptions": [], "last_audit": None}


class StateStore:
    def __init__(self, spark, root: str):
        self.files = Files(spark, root)

    def _numbers(self) -> list[int]:
        return [int(n[6:26]) for n in self.files.names("state") if n.startswith("state-") and n.endswith(".json")]

    def load(self) -> tuple[int, dict]:
        for _ in range(20):
            n = max(self._numbers(), default=-1)
            if n < 0:
                return -1, json.loads(json.dumps(EMPTY))
            try:
                return n, json.loads(self.files.read(f"state/state-{n:020}.json"))
            except Exception:  # pruned by a writer that was faster: a newer one is there
                if max(self._numbers(), default=-1) == n:
                    raise
        raise Conflict("the state changes too fast to be read")

    def change(self, f: Callable[[dict, list], object]) -> object:
        """f gets the state and a list for audit rows; it changes both, or raises and nothing is written."""
        for _ in range(50):
            n, state = self.load()
            self._copy(state)
            before = json.dumps(state, sort_keys=True)
            audit: list[dict] = []
            result = f(state, audit)
            for a in audit:
                a["audit_id"] = state["next_audit"]
                state["next_audit"] += 1
            if json.dumps(state, sort_keys=True) == before:
                return result
            if audit:
                state["last_audit"] = {"n": n + 1, "rows": audit}
            try:
                self.files.create(f"state/state-{n + 1:020}.json", json.dumps(state))
            except Conflict:
                continue
            if audit:
                self._copy(state)
            for old in self._numbers():
                if old < n - KEEP:
                    self.files.delete(f"state/state-{old:020}.json")
            return result
        raise Conflict("too many writers change the state at once")

    def _copy(self, state: dict) -> None:
        last = state.get("last_audit")
        if last and f"audit-{last['n']:020}.json" not in self.files.names("audit"):
            with suppress(Conflict):  # another writer copied them
                self.files.create(f"audit/audit-{last['n']:020}.json", json.dumps(last["rows"]))

    def audit(self) -> list[dict]:
        self._copy(self.load()[1])
        return [a for n in self.files.names("audit") if n.endswith(".json") for a in json.loads(self.files.read(f"audit/{n}"))]
