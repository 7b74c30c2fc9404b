"""servicenight: point-of-sale analytics for venues, expressed as Spark DataFrame operators."""
