"""News text joined to daily prices, as lazy Spark DataFrame operators."""

from marketmood.session import build_session

__all__ = ["build_session"]
