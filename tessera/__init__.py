"""tessera: an analytics engine expressed as Spark DataFrame and SQL plans."""
