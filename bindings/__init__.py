"""The operators bound to the test tables, each with an equivalent SQL text."""

from bindings import columns, corpus, evaluate, mapped, models, reports, streams  # noqa: F401
from bindings.registry import ORACLES, QUERIES  # noqa: F401
