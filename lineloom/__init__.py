"""lineloom: locate and cite text passages inside documents at scale, as plain Spark DataFrame operators."""

__version__ = "0.1.0"
