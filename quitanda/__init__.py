"""quitanda: a retail lakehouse as plain Spark DataFrame code."""
