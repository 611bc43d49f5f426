"""Column functions: text, rules, extraction, HTML. All are built-in Spark expressions."""
