"""strandline: Spark jobs that audit large collections of labelled multi-channel recordings."""

from strandline.params import AuditParams, Window

__all__ = ["AuditParams", "Window"]
