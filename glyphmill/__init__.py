"""glyphmill: text and markup analytics as declarative Spark plans."""

__version__ = "0.1.0"
