"""Exceptions."""


class TilewrightError(Exception):
    """Base of all errors of this package."""


class UnsupportedSlideError(TilewrightError):
    """A slide that can't be used: no or anisotropic spacing, unknown layout."""


class AnnotationError(TilewrightError):
    """An annotation that can't be used."""
