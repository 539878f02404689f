"""Log normalisation, routing and security analytics as Spark DataFrame jobs."""

from logloom.session import configure, build_session

__all__ = ["configure", "build_session"]
