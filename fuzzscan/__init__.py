"""fuzzscan: approximate substring search on PySpark."""

from .operators.guides import search_guides
from .operators.search import Searcher, search
from .operators.trace import Match

__all__ = ["Match", "Searcher", "search", "search_guides"]
