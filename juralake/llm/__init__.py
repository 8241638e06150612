"""Training-data operators: ten corpus operations, each in a module of its own.

Nothing else in the library imports this subpackage. ``queries.py`` registers
the operators; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
