"""Spark-native analytics over security events: search, detection rules and log parsers."""

from tracelight.errors import CompileError, ExecutionError, ProgramError, QueryError, RuleError
from tracelight.functions.schema import Field, Schema
from tracelight.operators.logs.run import parse_logs, run_program
from tracelight.operators.rules import compile_rule, rule_response, run_rule
from tracelight.operators.search import compile_query, search, search_response
from tracelight.plans.program import parse_program
from tracelight.plans.query import parse
from tracelight.plans.rule import parse_rule
from tracelight.session import session
from tracelight.sources.events import event_relation, load_events, load_reference_list, read_events, typed_events, write_events

#: The names that the log parser dialect's users may know these by.
parse_parser, run_parser = parse_program, run_program

__all__ = [
    "CompileError", "ExecutionError", "Field", "ProgramError", "QueryError", "RuleError", "Schema", "compile_query", "compile_rule",
    "event_relation", "load_events", "load_reference_list", "parse", "parse_logs", "parse_parser", "parse_program", "parse_rule", "read_events",
    "rule_response", "run_parser", "run_program", "run_rule", "search", "search_response", "session", "typed_events", "write_events",
]
