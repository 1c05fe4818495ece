"""facetledger: Spark jobs that label logs of assistant calls and attribute their cost."""

__version__ = "0.1.0"
