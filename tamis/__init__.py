"""tamis: declarative validation and cleaning of data, compiled to Spark columns."""
