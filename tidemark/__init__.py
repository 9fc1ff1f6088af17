"""Event studies over minute bars, as Spark DataFrame operators."""
