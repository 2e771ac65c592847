"""siltstone: web-content hygiene analytics as Spark DataFrame operators."""
