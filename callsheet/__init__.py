"""callsheet: HTTP capture analytics expressed as Spark DataFrame transforms."""
