"""Slide tiling, annotation and mask queries on Spark DataFrames."""

from .api import AnnotationSet, Slide, TileDataset
from .errors import AnnotationError, TilewrightError, UnsupportedSlideError
from .model import AnnotationType, BoundaryMode, GridOrder, TilingMode

__all__ = ["AnnotationError", "AnnotationSet", "AnnotationType", "BoundaryMode", "GridOrder", "Slide", "TileDataset", "TilewrightError", "TilingMode", "UnsupportedSlideError"]
__version__ = "0.1.0"
