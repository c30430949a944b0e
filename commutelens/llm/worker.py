"""What Python workers keep between tasks, and how they let go of it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext

_task: int | None = None
_at_work: set[str] = set()
_keepers: dict[str, Callable[[], None]] = {}


def at_work(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Told by an operator's function with every batch. ``forget`` drops what the operator keeps from task to task.

    Spark gives a worker to one operator after another. When a task begins, operators that had no part in the task before
    it forget what they kept, and memory of batches that are done goes back to the system; so a worker holds what one
    stage needs and not what all stages before it did. Operators in one plan share their tasks and keep theirs.
    """
    global _task
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if task != _task:
        for name in _keepers.keys() - _at_work:
            _keepers.pop(name)()
        _at_work.clear()
        pa.default_memory_pool().release_unused()
        _task = task
    _at_work.add(operator)
    if forget:
        _keepers[operator] = forget
