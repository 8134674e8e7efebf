"""claimweave: dataset-scale evaluation of generated text as Spark plans."""

__version__ = "0.1.0"
