"""From declarations to stages: a system waits for each earlier one that it must not run beside."""

from __future__ import annotations

from collections.abc import Sequence

from weirstone.plans.meta import Access


def conflict(first: Access, second: Access) -> bool:
    """Whether one writes what the other reads or writes."""
    return bool(
        first.writes & (second.reads | second.writes)
        or first.reads & second.writes
        or first.resource_writes & (second.resource_reads | second.resource_writes)
        or first.resource_reads & second.resource_writes
    )


def stages(declared: Sequence[Access], fields: dict[str, list[str]]) -> list[list[int]]:
    """Numbers of the systems by stage. A system's stage is one after the last stage of those before it in order that it conflicts with."""
    own = [a.expanded(fields) for a in declared]
    level: list[int] = []
    for j, a in enumerate(own):
        level.append(max((level[i] + 1 for i in range(j) if conflict(own[i], a)), default=0))
    return [[j for j, x in enumerate(level) if x == k] for k in range(max(level, default=-1) + 1)]
