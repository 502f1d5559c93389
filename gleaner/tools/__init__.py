"""Tools: named analysis steps with checked arguments, provenance and lineage, for pipelines and for agents."""

from gleaner.tools.framework import BaseTool, ToolContext, ToolInputError, ToolSchema, with_properties
from gleaner.tools.registry import register_reference_tools, register_tool, resolve_tools

__all__ = ["BaseTool", "ToolContext", "ToolInputError", "ToolSchema", "register_reference_tools", "register_tool", "resolve_tools", "with_properties"]
