"""DataFrame-to-DataFrame operators over the tables in ``tidemark.model``."""
