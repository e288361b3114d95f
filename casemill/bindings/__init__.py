"""The operators bound to the test tables, each beside the SQL that gives the same rows."""

from casemill.bindings import errors, files, models, rows, scores, tags, texts  # noqa: F401
from casemill.bindings.registry import ORACLES, QUERIES  # noqa: F401
