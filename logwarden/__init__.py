"""Security-log and knowledge-base analytics as Spark DataFrame jobs."""

from logwarden.session import get_session

__all__ = ["get_session"]
