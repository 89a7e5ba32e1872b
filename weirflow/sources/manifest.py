"""Which stages are complete, kept beside the data."""

from __future__ import annotations

import json
import time

from weirflow.session import get_shared, put_shared, store_of


class Manifest:
    """``completed`` stages as a set and one record per stage, in a folder of any store. An
    unreadable file counts as none."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/manifest.json"
        try:
            self.state = json.loads(get_shared(self.path))
        except (OSError, ValueError):
            self.state = {"completed": []}

    def done(self, stage: int) -> bool:
        return stage in self.state["completed"]

    def record(self, stage: int, facts: dict, began: float) -> None:
        self.state["completed"] = sorted({*self.state["completed"], stage})
        self.state[f"stage_{stage}"] = facts | {"elapsed_time": time.time() - began}
        put_shared(f"{self.path}.tmp", json.dumps(self.state, ensure_ascii=False, indent=2).encode())
        store, inner = store_of(self.path)
        store.move(f"{inner}.tmp", inner)
