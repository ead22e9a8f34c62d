"""Registered queries: the library's operators over the driver's tables."""

from . import files, keyed, rows, spaces, texts, trace

QUERIES = {**keyed.Q, **trace.Q, **texts.Q, **spaces.Q, **files.Q, **rows.Q}
ORACLES = {**keyed.SQL, **trace.SQL, **texts.SQL, **spaces.SQL, **files.SQL, **rows.SQL}
