"""Operators over tables: matching, mashing, compliance, reshaping, rendering, timing, DDL."""

from .compliance import Field, compliance_script, structure_compliance
from .ddl import db_creator, definitions
from .mashing import mash, mash_script
from .matching import Rule, match
from .render import select_to_html, select_to_html_colour
from .reshape import string_table_split, string_tables_split, transpose, transpose_script
from .timer import Timer, print_parts, printed_parts, report

__all__ = ["Field", "Rule", "Timer", "compliance_script", "db_creator", "definitions", "mash", "mash_script", "match", "print_parts", "printed_parts", "report", "select_to_html", "select_to_html_colour", "string_table_split", "string_tables_split", "structure_compliance", "transpose", "transpose_script"]
