"""Demand analytics for distribution centres, written as Spark DataFrame operators."""
