"""Training-data operators over document and page tables.

Nothing else in the package imports this subpackage.  Every operator reads the
columns it needs by name, so extra columns never clash with its own.
"""
