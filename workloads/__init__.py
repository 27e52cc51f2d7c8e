"""Inputs and queries over the given tables: one database per customer, one
question per order, predictions of several runs."""
