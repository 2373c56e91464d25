"""Call-outcome analytics for debt-collection transcripts, as Spark DataFrame jobs."""

from duecall.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
