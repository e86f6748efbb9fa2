"""strataquill: a PySpark engine for versioned evidence, financial facts and the data around them."""

__version__ = "0.1.0"
