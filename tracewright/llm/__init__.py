"""Training-data operators over the `documents`, `pages` and `conversations` tables.

Nothing else in the library imports this subpackage.
"""
