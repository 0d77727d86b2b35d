"""Registered queries over the supplied tables, and independent SQL for them."""
