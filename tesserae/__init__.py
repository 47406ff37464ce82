"""tesserae: multi-model data operators (tables, keyed rows, documents,
key-value pairs, property graphs) expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
