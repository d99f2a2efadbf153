"""Recursive-descent parsers with panic-mode recovery for the languages of the code graph."""

from sylvan.llm.syntax.check import LANGUAGES, canonical_language, check_source, functions_of

__all__ = ["LANGUAGES", "canonical_language", "check_source", "functions_of"]
