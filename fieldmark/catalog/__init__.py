"""All registered queries."""

from fieldmark.catalog import boards, labels, learning, refinement, shapes, storage  # noqa: F401
from fieldmark.catalog.base import ORACLES, QUERIES  # noqa: F401
