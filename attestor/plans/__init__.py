"""Named, runnable queries over the test tables."""

from __future__ import annotations


def load():
    """Import every query module and return the registry."""
    from attestor.plans import extraction, maintenance, registry, reports, sources, text  # noqa: F401

    return registry
