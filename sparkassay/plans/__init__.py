"""Evaluation plans: which metric on which columns, and running them."""
