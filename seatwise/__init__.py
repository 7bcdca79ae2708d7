"""Reservations and orders analytics on Spark DataFrames."""
