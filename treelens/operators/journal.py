"""Answers that were paid for, kept as they come.

Spark keeps what a task made only when it ends. A call that costs is kept
before that: every task attempt appends its answers to files of its own, by
buckets of the request's hash, and reads the bucket before it asks.
"""

from __future__ import annotations

import json
import os
from uuid import uuid4

# Leading characters of a request's hash that name its bucket.
BUCKET = 3


class Journal:
    """Reads and extends a folder of answers; give keys bucket by bucket."""

    def __init__(self, folder: str):
        self.folder, self.own = folder, f"{uuid4().hex}.jsonl"
        self.bucket: str | None = None
        self.known: dict[str, str | None] = {}
        self.stream = None

    def get(self, key: str) -> str | None:
        self._open(key[:BUCKET])
        return self.known.get(key)

    def put(self, key: str, answer: str | None) -> None:
        """Keep an answer; it is on the disk when this returns. An empty one is asked for again."""
        if not answer:
            return
        self._open(key[:BUCKET])
        if self.stream is None:
            os.makedirs(self._place(), exist_ok=True)
            self.stream = open(os.path.join(self._place(), self.own), "a", encoding="utf-8")
        self.stream.write(json.dumps({"key": key, "answer": answer}) + "\n")
        self.stream.flush()
        os.fsync(self.stream.fileno())
        self.known[key] = answer

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None

    def _place(self) -> str:
        return os.path.join(self.folder, self.bucket)

    def _open(self, bucket: str) -> None:
        if bucket == self.bucket:
            return
        self.close()
        self.bucket, self.known = bucket, {}
        if not os.path.isdir(self._place()):
            return
        for name in sorted(os.listdir(self._place())):
            with open(os.path.join(self._place(), name), encoding="utf-8") as lines:
                for line in lines:
                    try:
                        row = json.loads(line)
                    except ValueError:
                        # The line at which a task died.
                        continue
                    self.known[row["key"]] = row["answer"]
