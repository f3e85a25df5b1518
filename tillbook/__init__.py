"""Receipt, expense and document analytics expressed as Spark DataFrame jobs."""
