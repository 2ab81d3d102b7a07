"""lodestream: news-corpus analytics as composable PySpark DataFrame operators."""

from lodestream.session import session

__all__ = ["session"]
