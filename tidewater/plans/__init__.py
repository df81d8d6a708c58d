"""The query catalogue over the driver tables, and its SQL twins."""
