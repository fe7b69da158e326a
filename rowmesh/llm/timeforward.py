"""The priority queue of time-forward processing: nodes are visited in the order of their labels, and each sends messages
to nodes that come later. A message waits in the queue until its label is reached."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

#: Messages that a queue holds in memory, and messages of a run that are read back at once.
MOST_HELD = 500_000
RUN_BATCH = 4096


class SpillingQueue:
    """Messages (label, value), smallest label first; of equal labels, in the order of sending.

    What exceeds ``most`` goes, sorted, to a run in an anonymous file of the task: it has no name, so it ends with the
    task, however that ends, and nobody but this task ever needs it."""

    def __init__(self, most: int = MOST_HELD):
        self.most, self.heap, self.runs, self.sent = most, [], [], 0

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)

    def push(self, label, value) -> None:
        heapq.heappush(self.heap, (label, self.sent, value))
        self.sent += 1
        if len(self.heap) > self.most:
            run = _written(sorted(self.heap))
            self.heap = []
            self._next(run)

    def _next(self, run: Iterator[tuple]) -> None:
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head[:2], head, run))

    def label(self):
        """The smallest label, or None."""
        heads = ([self.heap[0][:2]] if self.heap else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads)[0] if heads else None

    def pop(self, label) -> list:
        """The values of all messages to ``label``, which must be the smallest or one that nothing was sent to."""
        values = []
        while self.label() == label and len(self):
            if self.runs and (not self.heap or self.runs[0][0] < self.heap[0][:2]):
                _, (_, _, value), run = heapq.heappop(self.runs)
                self._next(run)
            else:
                value = heapq.heappop(self.heap)[2]
            values.append(value)
        return values


def _written(messages: list[tuple]) -> Iterator[tuple]:
    file = tempfile.TemporaryFile()
    for i in range(0, len(messages), RUN_BATCH):
        pickle.dump(messages[i : i + RUN_BATCH], file)
    end = file.tell()

    def read() -> Iterator[tuple]:
        file.seek(0)
        while file.tell() < end:
            yield from pickle.load(file)
        file.close()

    return read()
