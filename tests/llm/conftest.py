"""Fixtures shared by the tests of the training-data operators; the session is that of the parent folder."""
