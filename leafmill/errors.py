"""Errors of the library."""


class LeafmillError(Exception):
    """Base of all errors."""


class InvalidRange(LeafmillError, ValueError):
    """Pages or ranges that a document doesn't have."""


class InvalidDocument(LeafmillError, ValueError):
    """A file that can't be read, or a document that can't be written."""


class WrongPassword(LeafmillError):
    """An encrypted file that the password doesn't open."""
