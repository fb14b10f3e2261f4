"""Differential-abundance analytics as lazy Spark DataFrame operators."""
