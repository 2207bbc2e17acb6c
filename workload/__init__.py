"""The given test tables read as offense data, and the queries run on them.

Each query sits next to the SQL that must give the same rows.
"""

from workload import curate, explore, files, ingest  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401
