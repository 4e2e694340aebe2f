"""quarrylight: analytics over source-code repositories, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
