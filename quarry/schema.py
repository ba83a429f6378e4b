"""Schemas of the graph model's tables, as DDL."""

PROJECTS = "id string, name string, description string, settings string, created_at timestamp_ntz, updated_at timestamp_ntz"
SOURCES = "id string, project_id string, path string, source_type string, is_code boolean, alias string, last_indexed_commit string, last_indexed_branch string, last_indexed_at timestamp_ntz, added_at timestamp_ntz"
WORKSPACES = "id string, project_id string, source_id string, name string, path string, workspace_type string, package_manager string"
PACKAGES = "id string, workspace_id string, name string, path string, version string"
NODES = (
    "node_id string, workspace_id string, package_id string, file_path string, name string, qualified_name string, kind string, language string, "
    "signature string, start_line int, end_line int, source_code string, docstring string, body_hash string, embedding array<float>"
)
EDGES = "source_id string, target_id string, kind string, weight double, line_number int"
FILES = "source_id string, file_path string, digest string"
REFS = "source_id string, raw_import string, kind string, line_number int"

#: Edge kinds that weigh 1; all others weigh 0.5.
STRONG_KINDS = ("contains", "extends", "implements", "embeds")
#: Edge kinds along which code depends on code.
DEPENDENCY_KINDS = ("calls", "imports", "uses_type")
CROSS_KINDS = ("calls", "imports", "uses_type", "extends", "implements")
