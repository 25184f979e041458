"""Named queries over the given tables, one or more per operator."""

from duelmark.catalog.registry import REGISTRY  # noqa: F401
from duelmark.catalog import (  # noqa: F401
    evaluation, history, ledgers, models, quotes, scalars, selection, sources, streams,
)
