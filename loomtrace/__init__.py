"""Loomtrace: column lineage of warehouse SQL as DataFrames.

The public names are loaded when they are first asked for, so that workers which need one module don't import all.
"""

from importlib import import_module

_PUBLIC = {
    "operators.audit": "cross_references field_usage gaps impact_of logic_blocks quality_gate raw_quality relations source_coverage statistics target_binding upstream_of",
    "operators.links": "aggregation_detail alias_bindings block_targets branch_sources chains expression_bindings first_writes physical_inputs physical_join_keys predicate_dependencies scope_outputs target_reach union_alignment window_detail window_filters",
    "operators.publish": "InvalidFacts diagnostics_documents mapping_markdown profile statement_documents task_documents violations warnings_markdown write",
    "operators.states": "blocking_reasons conditions coverage final_states fold_sessions reads state_values states",
    "operators.trace": "chain_text closure end_to_end mapping_steps scope_order sources table_edges",
    "plans.catalyst": "ScriptError parse split_script",
    "plans.facts": "Facts analyze qualified_fields",
    "sources.metadata": "MetadataFileError as_schema ddl_columns from_catalog latest merge problems read_csv read_json read_targets related target_columns",
    "sources.scripts": "EmptySource collisions mirrored readable sql_files task_dependencies tasks",
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names.split()}
# names that are modules of their own or mean too much alone are left to their modules
__all__ = sorted(n for n in _HOME if n not in ("sources",))  # noqa: PLE0605


def __getattr__(name: str):
    if name in _HOME and name != "sources":
        return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
