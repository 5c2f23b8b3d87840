"""Operators for preparing language-model training text, one module each.

Nothing else in the library imports this package. Text columns may be null (an empty text);
words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and
carriage return; only A-Z are folded where case is ignored.
"""
