from churnlens.sources.tables import (  # noqa: F401
    activity_events, customers, purchases, read_table, scores,
)
