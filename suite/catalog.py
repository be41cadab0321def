"""All registered queries."""

from suite import messages, storage, training, urls  # noqa: F401
from suite.registry import ORACLES, QUERIES  # noqa: F401
