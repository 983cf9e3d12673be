"""Field-note classification and analytics as Spark DataFrame operators."""
