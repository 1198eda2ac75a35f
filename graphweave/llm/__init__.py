"""Operators for training data that concern algorithms on text and items; nothing outside this folder imports them."""
