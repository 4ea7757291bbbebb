"""A lazy analytics engine on PySpark: frames, SQL, sources, sinks and change streams."""

from fathomic.errors import Blocked
from fathomic.frame import Frame, Grouped
from fathomic.session import Session, spark_session

__all__ = ["Blocked", "Frame", "Grouped", "Session", "spark_session"]
