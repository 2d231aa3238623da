"""gatewright: audit whole corpora of source repositories with Spark DataFrames.

Every operator takes and returns DataFrames keyed by ``repo_id`` (one value per
repository snapshot).  Nothing is looped over on the driver and no operator
collects a repository into one task; see ``README.md`` for the table layouts.
"""

__version__ = "0.1.0"
