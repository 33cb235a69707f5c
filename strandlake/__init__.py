"""Polymer-string and fragment analytics on PySpark."""
