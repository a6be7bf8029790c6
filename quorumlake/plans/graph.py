"""Paths over the graph of tables and foreign keys."""

from __future__ import annotations

from dataclasses import dataclass

from quorumlake.model import Refusal, Release, Relationship

MAX_STEPS = 16


@dataclass(frozen=True)
class Step:
    rel: Relationship
    down: bool  # from parent to children, else from child to parent

    @property
    def start(self) -> str:
        return self.rel.parent if self.down else self.rel.child

    @property
    def end(self) -> str:
        return self.rel.child if self.down else self.rel.parent


def steps_from(release: Release, table: str) -> list[Step]:
    found = []
    for rel in release.relationships:
        if rel.parent == table:
            found.append(Step(rel, True))
        if rel.child == table:
            found.append(Step(rel, False))
    return [s for s in found if release.tables[s.end].role != "coverage"]


def simple_paths(release: Release, start: str, end: str, limit: int = 3) -> list[tuple[Step, ...]]:
    """Up to ``limit`` paths without a repeated table."""
    out: list[tuple[Step, ...]] = []

    def walk(at: str, seen: tuple[str, ...], path: tuple[Step, ...]) -> None:
        if at == end:
            out.append(path)
            return
        if len(path) >= MAX_STEPS:
            return
        for step in steps_from(release, at):
            if step.end not in seen and len(out) < limit:
                walk(step.end, (*seen, step.end), (*path, step))

    walk(start, (start,), ())
    return out


def path_to(release: Release, start: str, end: str, via: list[str] | None = None) -> tuple[Step, ...]:
    """The path named by ``via`` (relationship ids in order), or the only one there is."""
    if via is None:
        found = simple_paths(release, start, end)
        if not found:
            raise Refusal("NO_PATH", f"{start} to {end}")
        if len(found) > 1:
            shown = " | ".join(", ".join(s.rel.id for s in p) for p in found)
            raise Refusal("AMBIGUOUS_PATH", f"{start} to {end}: {shown}")
        return found[0]
    at, path = start, []
    for id_ in via:
        rel = release.relationship(id_)
        if rel.child == at and (rel.parent != at or not path):
            path.append(Step(rel, False))
        elif rel.parent == at:
            path.append(Step(rel, True))
        else:
            raise Refusal("BROKEN_PATH", f"{id_} does not touch {at}")
        at = path[-1].end
    if at != end:
        raise Refusal("BROKEN_PATH", f"ends at {at}, not {end}")
    return tuple(path)
