"""Hashtag activity analytics on Spark DataFrames."""

from tagtide.session import build_session

__all__ = ["build_session"]
