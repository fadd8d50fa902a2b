"""Packs corpora of text files: filter, scrub, mask, render, total, review.

The public surface takes raw files to finished packs. Rendering is reached through
``pack`` only, so nothing that skipped the guard can be rendered by accident.
"""

from importlib import import_module

# Modules are loaded when a name of theirs is first asked for: the processes Spark starts beside
# the driver for a data source need one module and should not hold them all.
_MODULES = {
    "bindery.operators.chunks": ("document_chunks",),
    "bindery.operators.filters": ("collect_files",),
    "bindery.operators.guard": ("guard", "mask_secrets"),
    "bindery.operators.order": ("with_ordinals",),
    "bindery.operators.render": ("join_blocks",),
    "bindery.operators.review": ("decide", "gate"),
    "bindery.operators.selection": ("merge_selection", "select_files", "selection_fallback"),
    "bindery.operators.settings": ("literal_settings", "resolve_settings"),
    "bindery.plans.pack": ("PackTables", "guard_files", "pack", "pack_trees", "workspace_settings"),
    "bindery.sinks": ("deliver", "delivery_outcomes"),
    "bindery.sources.tree": ("list_tree", "read_contents", "read_ignore_texts", "read_tree", "split_by_size"),
    "bindery.sources.tree_source": ("scan_tree",),
    "bindery.targets": ("deliver_documents", "delivery_report", "written_outcomes"),
}
_HOME = {name: module for module, names in _MODULES.items() for name in names}

__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)


def __dir__() -> list[str]:
    return __all__
