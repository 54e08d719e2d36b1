"""tidegraph: documents to typed event networks, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
