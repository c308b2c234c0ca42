"""Timeline-signal analytics expressed as Spark DataFrame jobs.

Long tables keyed by ``video_id`` (any entity with a time axis) go in; scores,
intervals, selections, chapters, rule hits and measured explanations come out.
"""

__version__ = "0.1.0"
