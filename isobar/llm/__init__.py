"""Training-data operators: filtering, de-duplication, tokenisation and scoring of text at corpus scale.

Nothing else in the library imports this package. One module holds one operator; ``queries`` binds each of
them to the tables with production parameters.
"""
