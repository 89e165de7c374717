"""Operators on training corpora and event sequences. Optional: nothing outside this subpackage imports it."""
