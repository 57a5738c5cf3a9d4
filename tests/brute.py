"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations


def episodes(history, has):
    """(opening, closing) revisions of one page: ``history`` in order, ``has(revision)``."""
    found, opened = [], None
    for revision in history:
        if has(revision):
            opened = opened if opened is not None else revision
        elif opened is not None:
            found.append((opened, revision))
            opened = None
    return found


def estimate(votes):
    """{source: [added, removed]} -> {source: (p_added, p_removed, occurrences)}."""
    out = {}
    for src, (added, removed) in votes.items():
        n = added + removed
        out[src] = (added / n, removed / n, n) if n else (0.5, 0.5, 0)
    return out
