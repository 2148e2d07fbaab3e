"""Importing this module registers every query."""

from seamline.plans import detection_queries, frame_queries, intake_queries, transcript_queries  # noqa: F401
