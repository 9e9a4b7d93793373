"""eventloom: event-sequence analytics as composable PySpark DataFrame operators."""
