"""The two tables that describe a code base, and the kinds that their columns hold."""

from __future__ import annotations

#: Schemas, as createDataFrame and reader.schema take them.
ENTITY = (
    "project_id long, id long, qualified_name string, name string, kind string, parent_id long, file_id long, file_path string, module string, package_name string, "
    "stereotype string, http_method string, http_path string, complexity int, is_abstract boolean, start_line int, end_line int, signature string, visibility string, modifiers string, annotations string"
)
#: src depends on dst; (src, dst, type) is unique.
EDGE = "project_id long, src long, dst long, type string, weight int, file_id long"

# fixed values: names that stored tables hold
TYPE_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION")
MEMBER_KINDS = ("METHOD", "CONSTRUCTOR", "FIELD")
METHOD_KINDS = ("METHOD", "CONSTRUCTOR")
EDGE_TYPES = ("CALLS", "USES_TYPE", "EXTENDS", "IMPLEMENTS", "IMPORTS", "OVERRIDES", "ANNOTATED_BY", "CREATES", "ROUTES_TO")
STEREOTYPES = ("CONTROLLER", "SERVICE", "REPOSITORY", "COMPONENT", "CONFIGURATION", "ENTITY", "TEST")
