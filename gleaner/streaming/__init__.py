"""Incremental forms of the batch operators: term statistics and event windows.  Additions of our own."""
