"""Training-data operators: each module holds one operator with a general interface.

Nothing else in the library imports this subpackage; ``queries.py`` maps the
operators onto the registered ``opN_<name>`` queries.
"""
