"""gridloom: array and image analytics expressed as Spark DataFrame plans."""
