"""The text form of patterns: documents of patterns, compositions, templates and graphs."""

from .emit import pattern_to_dsl
from .parser import Document, Mapper, ParseError, compile_pattern_body, parse_document, parse_graph, parse_pattern

__all__ = ["Document", "Mapper", "ParseError", "compile_pattern_body", "parse_document", "parse_graph", "parse_pattern", "pattern_to_dsl"]
