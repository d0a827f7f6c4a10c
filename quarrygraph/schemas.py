"""Schemas of the reference model and its declared types."""

from __future__ import annotations

NODES = (
    "id string, name string, type string, file_path string, line_number int, docstring string, source_code string, "
    "full_context string, summary string, signature string, parent string, parent_context string, related_elements array<string>, "
    "metadata struct<file_size:int,num_lines:int,relative_path:string,num_methods:int,num_attributes:int,method_names:array<string>,"
    "attribute_names:array<string>,element_type:string,element_id:string>, attributes array<string>, llm_description string, "
    "embedding array<float>, ord bigint"
)
EDGES = "type string, source string, target string, ord bigint"
IMPORTS = "file_path string, alias string, full_name string"
CHUNKS = (
    "chunk_id string, content string, chunk_type string, file_path string, start_line int, end_line int, element_names array<string>, "
    "parent_context string, metadata map<string,string>, embedding array<float>"
)
ERROR_REPORTS = "error_message string, stack_trace string, factory_site string, application_name string, timestamp string"

#: The declared node and relation types, error classes and the edge collections' allowed ends.
NODE_TYPES = ("file", "class", "method", "function", "attribute", "generated_description")
EDGE_TYPES = ("defines_class", "defines_function", "has_method", "used_in", "has_attribute", "has_description", "imports", "calls", "inherits_from", "related_to")
ERROR_TYPES = ("debug", "environment", "authentication", "network", "other")
EDGE_ENDS = {
    "Contains": (("File",), ("Class", "Function")),
    "Has_Method": (("Class",), ("Method",)),
    "Has_Function": (("File", "Class"), ("Function",)),
    "Has_Attribute": (("Class",), ("Attribute",)),
    "Calls": (("Method", "Function"), ("Method", "Function")),
    "Inherits": (("Class",), ("Class",)),
    "Uses": (("Method", "Function", "Class"), ("Class", "Function")),
    "Describes": (("Generated_Description",), ("Class", "Method", "Function")),
    "Related_To": (("Class", "Method", "Function"), ("Class", "Method", "Function", "Attribute")),
}
#: Settings: embedding size and index, chunk size, retrieval and triage defaults.
EMBEDDING_DIM, SIMILARITY = 384, "cosine"
MAX_CHUNK, OVERLAP = 1500, 100
RETRIEVAL = {"kg_top_k": 5, "vector_top_k": 5, "n_hops": 2, "final_top_k": 10, "kg_weight": 0.5, "vector_weight": 0.5}
DEBUG_RETRIEVAL = {"kg_top_k": 3, "vector_top_k": 5, "n_hops": 2, "final_top_k": 5, "kg_weight": 0.6, "vector_weight": 0.4}
TICKET_THRESHOLD, TICKET_LIMIT = 0.85, 5
EXCLUDED = ("__pycache__", ".git", ".pytest_cache", "test_", "tests", "venv", "env")
EXCLUDED_EARLY = EXCLUDED[:5]
