"""tarnflow: analytical SQL over Parquet, expressed as Spark plans."""

from tarnflow.session import build_session

__all__ = ["build_session"]
